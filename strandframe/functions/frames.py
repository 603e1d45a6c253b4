"""Translation of whole sequences, by Arrow batches.

Column expressions turn each codon into a text of its own and back, at about two microseconds; here the letters of a sequence
are one array, and a codon costs a few nanoseconds. ``dna.translate`` is for short texts such as single reading frames.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed_values import CODON_BASES, CODON_RESIDUES

# the function travels to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each letter among the bases (4: none), the complement of a place, and the residue of three places."""
    place = np.full(129, 4, np.intp)
    for i, base in enumerate(CODON_BASES):
        place[ord(base)] = place[ord(base.lower())] = i
    pair = np.array([CODON_BASES.index(dict(zip("ACGT", "TGCA"))[b]) for b in CODON_BASES] + [4])
    residue = np.full((5, 5, 5), ord("X"), np.uint8)
    residue[:4, :4, :4] = np.frombuffer(CODON_RESIDUES.encode(), np.uint8).reshape(4, 4, 4)
    return place, pair, residue.ravel()


@F.pandas_udf(T.ArrayType(T.StringType()))
def all_frames(sequences: pd.Series) -> pd.Series:
    """Residue letters of frames 1, 2, 3, -1, -2 and -3; unknown codons give X, stops give *."""
    place, pair, residue = _tables()

    def frames(text: str | None) -> list[str] | None:
        if text is None:
            return None
        codes = place[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 128)]
        out = []
        for strand in (codes, pair[codes][::-1]):
            for first in range(3):
                n = max(0, len(codes) - first) // 3 * 3
                own = strand[first : first + n]
                out.append(residue[own[0::3] * 25 + own[1::3] * 5 + own[2::3]].tobytes().decode())
        return out

    return sequences.map(frames)

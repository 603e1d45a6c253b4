"""Scores of all peptides of a text by Arrow batches: residues are numbers in one array, and a window is a difference of running sums."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from .fixed_values import RESIDUES

# the functions travel to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: peptides of a batch that is handed on, whatever the batch that was read holds
ROWS = 1 << 15


def per_residue(values: dict, default: float) -> np.ndarray:
    """``values`` by the place of a residue in the fixed order, the value of other letters last."""
    return np.array([float(values[r]) for r in RESIDUES] + [float(default)])


def members(residues: Sequence[str]) -> np.ndarray:
    return per_residue({r: float(r in residues) for r in RESIDUES}, 0.0)


def _best(scores: np.ndarray, starts: np.ndarray, widths: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best scores to six digits, ties by start, then width; scores have nine digits."""
    whole = np.rint(scores * 1e9).astype(np.int64)
    six = np.sign(whole) * ((np.abs(whole) + 500) // 1000)
    high = np.flatnonzero(six >= np.partition(six, len(six) - n)[len(six) - n]) if len(six) > n else np.arange(len(six))
    return high[np.lexsort((widths[high], starts[high], -six[high]))[:n]]


def window_rows(sizes: Sequence[int], threshold: float, scales: dict[str, np.ndarray], score: Callable, keep: Sequence[str], best: int | None = None):
    """A function of Arrow batches with ``text``, ``offset``, ``size`` and ``keep`` that lists peptides of at least ``threshold`` (to nine digits).

    Peptides begin in the first ``size`` letters of a text; ``best`` keeps that many of each text. ``score(mean, value)`` has arrays
    over their starts: the mean of a scale over the peptide, and a scale's value at one of its residues (negative: from its end).
    Rows are handed on in small batches, so memory does not depend on how many peptides the texts of a batch have.
    """
    place = np.full(129, len(RESIDUES), np.intp)
    for i, r in enumerate(RESIDUES):
        place[ord(r)] = i

    def found(text: str, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = place[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 128)]
        values = {k: table[codes] for k, table in scales.items()}
        sums = {k: np.concatenate([[0.0], np.cumsum(v)]) for k, v in values.items()}
        starts, widths, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for w in sizes:
            n = min(own, len(codes) - w + 1)
            if n <= 0:
                continue
            mean = lambda k: (sums[k][w : w + n] - sums[k][:n]) / w  # noqa: B023, E731
            value = lambda k, at: values[k][(at if at >= 0 else w + at) :][:n]  # noqa: B023, E731
            s = np.round(score(mean, value), 9)
            at = np.flatnonzero(s >= threshold)
            starts.append(at)
            widths.append(np.full(len(at), w))
            scores.append(s[at])
        out = tuple(np.concatenate(x) for x in (starts, widths, scores))
        return out if best is None else tuple(x[_best(out[2], out[0], out[1], best)] for x in out)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0

            def handed(parts=parts, batch=batch):
                source = pa.array(np.concatenate([np.full(len(a), i) for i, _, a, _, _ in parts]))
                text = pa.array([t for _, letters, *_ in parts for t in letters], pa.string())
                start, end, scores = (pa.array(np.concatenate([p[k] for p in parts])) for k in (2, 3, 4))
                kept = [batch.column(batch.schema.get_field_index(k)).take(source) for k in keep]
                return pa.RecordBatch.from_arrays([*kept, text, start, end, scores], names=[*keep, "peptide", "start", "end", "score"])

            texts, offsets, owns = (batch.column(batch.schema.get_field_index(k)) for k in ("text", "offset", "size"))
            for i in range(batch.num_rows):
                text, offset = texts[i].as_py() or "", offsets[i].as_py()
                at, width, scores = found(text, owns[i].as_py() or 0)
                for k in range(0, len(at), ROWS):
                    a, w = at[k : k + ROWS], width[k : k + ROWS]
                    parts.append((i, [text[x : x + y] for x, y in zip(a.tolist(), w.tolist())], offset + a, offset + a + w, scores[k : k + ROWS]))
                    held += len(a)
                    if held >= ROWS:
                        yield handed()
                        parts.clear()
                        held = 0
            if parts:
                yield handed()

    return rows

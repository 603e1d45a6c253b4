"""Pairwise alignment of two text columns as Arrow functions: the verify step after a seed join.

Each row is one pair; rows of the score matrix are filled with whole-array numpy steps.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import col

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), dtype="<u4")


def score_rows(a: str, b: str, match: int, mismatch: int, gap: int, local: bool):
    """Rows of the linear-gap score matrix, the first one included."""
    x, y = _codes(a), _codes(b)
    ramp = gap * np.arange(len(y) + 1)
    row = np.zeros(len(y) + 1, dtype=np.int64) if local else ramp.astype(np.int64)
    yield row
    for i, letter in enumerate(x, 1):
        best = np.empty_like(row)
        best[0] = 0 if local else gap * i
        best[1:] = np.maximum(row[:-1] + np.where(y == letter, match, mismatch), row[1:] + gap)
        if local:
            best = np.maximum(best, 0)
        # a gap in the first text extends any better cell to the left
        row = np.maximum.accumulate(best - ramp) + ramp
        yield row


def best_score(a: str, b: str, match: int, mismatch: int, gap: int, local: bool) -> int:
    top, row = 0, None
    for row in score_rows(a, b, match, mismatch, gap, local):
        top = max(top, int(row.max())) if local else 0
    return top if local else int(row[-1])


def _scorer(match: int, mismatch: int, gap: int, local: bool):
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([best_score(x, y, match, mismatch, gap, local) for x, y in zip(a, b)], dtype="int64")

    return F.pandas_udf(score, "long")


def global_score(a, b, match: int = 1, mismatch: int = -1, gap: int = -2) -> Column:
    return _scorer(match, mismatch, gap, False)(col(a), col(b))


def local_score(a, b, match: int = 1, mismatch: int = -1, gap: int = -2) -> Column:
    return _scorer(match, mismatch, gap, True)(col(a), col(b))


def traced(a: str, b: str, match: int, mismatch: int, gap: int) -> tuple[int, str, str]:
    """Global score and both texts with gaps; of equal paths the diagonal comes first, then a gap in ``b``."""
    table = np.vstack(list(score_rows(a, b, match, mismatch, gap, False)))
    i, j = len(a), len(b)
    top, low = [], []
    while i or j:
        here = table[i, j]
        if i and j and here == table[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            top.append(a[i]), low.append(b[j])
        elif i and here == table[i - 1, j] + gap:
            i -= 1
            top.append(a[i]), low.append("-")
        else:
            j -= 1
            top.append("-"), low.append(b[j])
    return int(table[-1, -1]), "".join(reversed(top)), "".join(reversed(low))


def global_alignment(a, b, match: int = 1, mismatch: int = -1, gap: int = -2) -> Column:
    """STRUCT<score, aligned1, aligned2>."""
    def align(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([traced(p, q, match, mismatch, gap) for p, q in zip(x, y)], columns=["score", "aligned1", "aligned2"])

    return F.pandas_udf(align, "score long, aligned1 string, aligned2 string")(col(a), col(b))

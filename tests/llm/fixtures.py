"""Small document tables with the awkward cases: nulls, blanks, repeats, ties, long texts, clashing extra columns."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, pos int, pivot string, score double, block int, spans string"


def frame(spark, rows):
    """Documents from (doc_id, text[, lang[, source]]), with extra columns named like the operators' own."""
    full = [(r[0], r[1], (r + (None, None))[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", None, 1, 2, "x", 0.5, 3, None) for r in rows]
    return spark.createDataFrame(full, COLUMNS)


def sentences(seed: int, n: int, size: int = 30, vocabulary: int = 300) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(size)) + "." for _ in range(n)]


AWKWARD = [(901, None), (902, ""), (903, " \t\n "), (904, "one"), (None, "a text without an id, which is long enough to count."), (905, "é ß 日本 \U0001f600 İ"), (906, "x" * 50_000)]

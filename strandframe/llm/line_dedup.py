"""Line deduplication: a line that several documents hold stays only in the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_lower, let, strip_blanks


def line_key(line: Column) -> Column:
    """What two lines must share to count as one: blanks stripped at both ends, A-Z lower-cased."""
    return ascii_lower(strip_blanks(line))


def _keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key is long enough: ids, position, and the key as two independent 64-bit hashes."""
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        "doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Drop lines whose key is found in two or more documents, except in the smallest ``doc_id`` that holds it.

    Returns ``doc_id, text, n_lines, n_dropped`` for every input row; other columns of ``docs`` are not looked at.
    ``text`` is what stays, joined by newlines, and ``n_lines`` counts lines before dropping. Keys under ``min_chars``
    code points are never dropped, nor are repeats inside the document that keeps the line. A null or empty text is one
    empty line. Rows that repeat a ``doc_id`` belong to one document; rows without ``doc_id`` lose nothing and count for
    nothing.

    A key is in several documents exactly if its smallest and largest ``doc_id`` differ, so a line of any frequency is
    combined in the map tasks to one row per key; only hashes and positions are shuffled for the counting, and texts once
    for the reassembly.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    lines = _keyed_lines(rows, min_chars)
    shared = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last")
    lost = (
        lines.join(shared, ["h1", "h2"])
        .where("doc_id > keeper")
        .groupBy(F.col("doc_id").alias("lost_id"), F.col("row").alias("lost_row"))
        .agg(F.collect_set("pos").alias("lost"))
    )
    joined = rows.join(lost, (F.col("doc_id") == F.col("lost_id")) & (F.col("row") == F.col("lost_row")), "left")
    split = F.struct(F.split("text", "\n", -1).alias("lines"), F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))
    kept = let(split, lambda s: F.array_join(_at(s.lines, F.array_except(F.sequence(F.lit(0), F.size(s.lines) - 1), s.lost)), "\n"))
    newlines = F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return joined.select(
        "doc_id",
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept).alias("text"),
        (newlines + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _at(items: Column, positions: Column) -> Column:
    return F.transform(positions, lambda i: items[i])

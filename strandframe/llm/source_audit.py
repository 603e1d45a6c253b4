"""How the sources of a language differ: distances between their term frequencies, and the terms that stand out in each.

Frequencies are whole parts of ``UNIT``, and all sums and ranks are exact. A term matters to the ranking only by its count in
the group and in the language, so terms are grouped to cells by these two counts and the ranking is made over cells: the value
once per cell, equal values merged, ranks by running multiplicity. Only cells that reach the wanted ranks are expanded to terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .text import written

UNIT = 1_000_000_000
#: two factors of ``UNIT``, near its root: products with counts up to 2.8e14 stay within 64 bits
_HIGH, _LOW = 31_250, 32_000
ADD = 5
#: entries that a task counts before it passes them on
_HELD = 400_000
#: numbers in the matrix of one block of terms and all sources, or eight terms for each source where that is more: a block gives a
#: row for each pair of sources, which then stay few beside what it reads
_BLOCK = 1 << 16
# bytes of UTF-8 outside letters and the characters from U+0080 on become blanks, A-Z become a-z
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _share(count: Column, total: Column) -> Column:
    """``1 + floor(UNIT * (count + ADD) / total)`` by long division in two digits, which stays within 64 bits."""
    high = (count + F.lit(ADD)) * F.lit(_HIGH)
    return F.lit(1) + _div(high, total) * F.lit(_LOW) + _div(high % total * F.lit(_LOW), total)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    high = (counts + ADD) * _HIGH
    return 1 + high // totals * _LOW + high % totals * _LOW // totals


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term, not yet added up over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], Counter] = defaultdict(Counter)
        held: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in seen.items():
                terms = sorted(counts)
                docs_of = held[lang, source]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in terms], pa.int64()), pa.array([docs_of[t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            seen.clear()
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for lang, source, text in zip(*(c.to_pylist() for c in some.columns)):
                    terms = text.encode().translate(_TERMS).split()
                    seen[lang, source].update(terms)
                    held[lang, source].update(set(terms))
                if sum(map(len, seen.values())) > _HELD:
                    yield from flush()
        yield from flush()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


class SourceAudit:
    """The kept terms of ``docs`` with their counts, from which both reports are drawn.

    ``lang``, ``source`` and ``text`` are read, null as an empty string; other columns are not looked at. Every row is a document
    of its own, also where rows or ids repeat. Terms are runs of letters A-Z (lowered), a-z and characters from U+0080 on. A term
    is kept in a language if at least ``min_docs`` of its documents hold it; an empty table has no groups and no rows. Counts
    with ``ADD`` for each kept term may reach 2.8e14 in a language.

    Work: tasks count before they shuffle, terms are added up per source and then per language, so a frequent term costs one row
    for each task and then one for each source. What is kept, and the totals of groups, are written once to the shared folder.
    """

    def __init__(self, docs: DataFrame, min_docs: int = 30):
        by_source = count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        by_lang = by_source.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("uses"))
        self.kept = written(by_lang.where(F.col("docs") >= min_docs).drop("docs"))
        self.uses = self.kept.select("lang", "term", "total", F.inline("uses"))
        names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
        held = self.uses.groupBy("lang", "source").agg(F.sum("n").alias("held"))
        whole = self.kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_held"))
        every = docs.select(*names).distinct().join(held, ["lang", "source"], "left").join(whole, "lang", "left")
        pad = F.lit(ADD) * F.coalesce("terms", F.lit(0))
        self.groups = written(
            every.select("lang", "source", (F.coalesce("held", F.lit(0)) + pad).alias("of_source"), (F.coalesce("lang_held", F.lit(0)) + pad).alias("of_lang"), F.coalesce("terms", F.lit(0)).alias("terms"))
        )

    def standing_out(self, ranks: int = 50) -> DataFrame:
        """``lang, source, item, value, rank``: terms of a group that are more frequent there than in the language, by the difference."""
        cells = self.uses.groupBy("lang", "source", "n", "total").agg(F.count(F.lit(1)).alias("terms_in"))
        p, q = _share(F.col("n"), F.col("of_source")), _share(F.col("total"), F.col("of_lang"))
        valued = cells.join(self.groups, ["lang", "source"]).withColumn("value", p - q).where("value > 0").select("lang", "source", "n", "total", "value", "terms_in")
        group = W.partitionBy("lang", "source").orderBy(F.desc("value"))
        # every value has a term, so values beyond the wanted number cannot reach the ranks: a limit that tasks apply before the shuffle
        best = valued.groupBy("lang", "source", "value").agg(F.sum("terms_in").alias("m")).withColumn("k", F.row_number().over(group)).where(F.col("k") <= ranks)
        placed = best.withColumn("before", F.sum("m").over(group) - F.col("m")).where(F.col("before") < ranks).select("lang", "source", "value", "before")
        chosen = valued.drop("terms_in").join(placed, ["lang", "source", "value"])
        tie = W.partitionBy("lang", "source", "value").orderBy("term")
        expanded = self.uses.join(chosen, ["lang", "source", "n", "total"]).withColumn("k", F.row_number().over(tie)).where(F.col("k") <= ranks)
        return expanded.select("lang", "source", F.col("term").alias("item"), "value", (F.col("before") + F.col("k")).cast("int").alias("rank")).where(F.col("rank") <= ranks)

    def distances(self) -> DataFrame:
        """``lang, source, item, value, rank``: the other sources of the language by the sum of differences over all kept terms.

        Terms of a language are dealt to blocks that hold a bounded matrix of terms and sources; a block sums its differences for
        every pair, which are as many rows as the report itself. A language with one source has no rows.
        """
        sources = self.groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.sort_array(F.collect_list(F.struct("source", "of_source"))).alias("sources"))
        many = F.size("sources").cast("long")
        blocks = F.ceil(F.col("terms") * many / F.greatest(F.lit(_BLOCK), 8 * many * many)).cast("int")
        sized = sources.withColumn("blocks", F.greatest(F.lit(1), blocks))
        asked = sized.select("lang", "sources", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        dealt = self.kept.join(sized.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "uses")

        def sums(key: tuple, terms: pa.Table, group: pa.Table) -> pa.Table:
            names, totals = [], []
            for row in group["sources"].to_pylist():
                names, totals = [s["source"] for s in row], np.array([s["of_source"] for s in row], dtype=np.int64)
            place = {s: i for i, s in enumerate(names)}
            counts = np.zeros((terms.num_rows, len(names)), np.int64)
            uses = terms["uses"].combine_chunks()
            if terms.num_rows:
                row = np.repeat(np.arange(terms.num_rows), pc.list_value_length(uses).to_numpy())
                flat = uses.flatten()
                counts[row, [place[s] for s in flat.field("source").to_pylist()]] = flat.field("n").to_numpy()
            shares = _shares(counts, np.maximum(totals, 1))
            left, right, value = [], [], []
            for i in range(len(names) - 1):
                d = np.abs(shares[:, i + 1 :] - shares[:, i : i + 1]).sum(axis=0).tolist()
                left += [names[i]] * len(d)
                right += names[i + 1 :]
                value += d
            lang = pa.array([key[0].as_py()] * (2 * len(left)), pa.string())
            return pa.table({"lang": lang, "source": pa.array(left + right, pa.string()), "item": pa.array(right + left, pa.string()), "value": pa.array(value + value, pa.int64())})

        parts = dealt.groupBy("lang", "block").cogroup(asked.groupBy("lang", "block")).applyInArrow(sums, "lang string, source string, item string, value long")
        order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))


def audit_sources(docs: DataFrame, min_docs: int = 30, ranks: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: both reports of ``SourceAudit``, ``pair`` and ``term``, under one another."""
    audit = SourceAudit(docs, min_docs)
    pairs, terms = audit.distances(), audit.standing_out(ranks)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionAll(terms.withColumn("part", F.lit("term")).select(columns))

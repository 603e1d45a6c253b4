"""Genomics-shaped inputs derived from the driver tables, as a DataFrame and as the same SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
QUALITIES = "I5+?I:0DF#I;GI<H9I7E2ICI/A"
CHROMS = ("click", "error", "purchase", "signup", "view")


@dataclass(frozen=True)
class Derived:
    frame: Callable[..., DataFrame]
    sql: str
    needs: tuple[str, ...] = ()


def _spread(df: DataFrame) -> DataFrame:
    """A table in fewer files than the cluster has cores, as the driver's are, is dealt out before work on each row.

    Only the list of files is looked at; a table of many files is read as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _letters(t):
    return _spread(t.documents.select("doc_id", "text")).select(
        F.col("doc_id").alias("seq_id"), F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("letters")
    )


def _dna(t):
    return _letters(t).select("seq_id", F.translate("letters", LETTERS, BASES).alias("seq"))


def _reads(t):
    return _letters(t).select(
        F.col("seq_id").alias("read_id"),
        F.translate("letters", LETTERS, BASES).alias("seq"),
        F.translate("letters", LETTERS, QUALITIES).alias("qual"),
    )


def _probes(t):
    return t.benchmark.select(
        F.col("item_id").alias("probe_id"),
        F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, BASES).alias("seq"),
    )


def _protein(t):
    return _letters(t).select("seq_id", F.regexp_replace(F.upper("letters"), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("seq"))


def _counts(t):
    return t.lineitem.groupBy(
        F.col("l_partkey").alias("feature"), F.concat("l_returnflag", "l_linestatus").alias("sample")
    ).agg(F.sum("l_quantity").alias("count"))


def _design_of(sample):
    return F.substring(sample, 2, 1)


def _minutes(c):
    return F.expr(f"timestampdiff(MINUTE, TIMESTAMP_NTZ '2024-01-01 00:00:00', {c})")


def _aligned(t):
    return t.events.select(
        F.col("event_id").alias("read_id"),
        F.col("event_type").alias("chrom"),
        _minutes("ts").alias("start"),
        (_minutes("ts") + 1 + F.floor("value") % 60).alias("end"),
        (F.col("user_id") % 61).alias("mapq"),
        F.when(F.col("user_id") % 10 == 0, 4).when(F.col("user_id") % 10 == 1, 256).otherwise(0).cast("long").alias("flag"),
    )


def _intervals(t):
    kind = F.element_at(F.array(*[F.lit(c) for c in CHROMS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    start = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("long") * 15
    return t.orders.select(
        F.col("o_orderkey").alias("name"),
        kind.alias("chrom"),
        start.alias("start"),
        (start + 10 + F.floor(F.col("o_totalprice") / 1000)).alias("end"),
    )


def _base(c):
    return F.substring(F.lit("ACGT"), (c % 4 + 1).cast("int"), F.lit(1))


def _variants(t):
    alt = F.when(F.col("event_id") % 10 == 0, F.lit("C,T")).when(F.col("event_id") % 10 == 1, F.lit("AG")).otherwise(
        _base(F.col("user_id"))
    )
    return t.events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("chrom"),
        (_minutes("ts") + 1).alias("pos"),
        _base(F.col("event_id")).alias("ref"),
        alt.alias("alt"),
        F.col("value").alias("qual"),
        (F.col("user_id") % 40).alias("depth"),
        (F.col("user_id") % 40 * F.col("event_id") % 40).alias("alt_count"),
    )


def _genotypes(t):
    return (
        t.lineitem.groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 200).alias("site"))
        .agg((F.count(F.lit(1)) % 3).alias("gt"))
        .join(t.supplier.select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("pop")), "sample")
    )


def _abundance(t):
    return t.events.groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("taxon")).agg(
        F.count(F.lit(1)).alias("count")
    )


def _survival(t):
    return (
        t.orders.groupBy("o_custkey")
        .agg(
            F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("double").alias("time"),
            F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("long").alias("event"),
        )
        .join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("grp"), "c_acctbal"), "o_custkey")
        .select(F.col("o_custkey").alias("subject"), "time", "event", "grp", F.col("c_acctbal").alias("covariate"))
    )


def _snps(t):
    return (
        t.documents.join(t.labels, "doc_id")
        .groupBy(F.col("source").alias("snp_id"), F.col("lang").alias("chrom"))
        .agg(
            *[
                F.count_if((F.col("toxic") == c) & (F.col("quality") == a)).alias(n)
                for n, c, a in (("case_alt", 1, 1), ("case_ref", 1, 0), ("ctrl_alt", 0, 1), ("ctrl_ref", 0, 0))
            ]
        )
        .withColumn("pos", F.regexp_replace("snp_id", "[^0-9]", "").cast("long") * 1000)
    )


def _methylation(t):
    level = F.col("l_linenumber")
    return t.lineitem.groupBy(
        F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("pos"), F.col("l_linestatus").alias("grp")
    ).agg(
        F.count(F.lit(1)).alias("coverage"),
        F.count_if(F.col("l_quantity") > 25).alias("methylated"),
        F.element_at(F.array(F.lit("CpG"), F.lit("CHG"), F.lit("CHH")), (F.first("l_partkey") % 3 + 1).cast("int")).alias("context"),
    )


_MINUTES = "CAST(floor((epoch_us(ts) - 1704067200000000) / 60000000) AS BIGINT)"

DERIVED: dict[str, Derived] = {
    "letters": Derived(
        _letters, "SELECT doc_id AS seq_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS letters FROM documents"
    ),
    "dna": Derived(_dna, f"SELECT seq_id, translate(letters, '{LETTERS}', '{BASES}') AS seq FROM letters", ("letters",)),
    "reads": Derived(
        _reads,
        f"SELECT seq_id AS read_id, translate(letters, '{LETTERS}', '{BASES}') AS seq, "
        f"translate(letters, '{LETTERS}', '{QUALITIES}') AS qual FROM letters",
        ("letters",),
    ),
    "probes": Derived(
        _probes,
        f"SELECT item_id AS probe_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') AS seq "
        "FROM benchmark",
    ),
    "protein": Derived(
        _protein,
        "SELECT seq_id, regexp_replace(upper(letters), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS seq FROM letters",
        ("letters",),
    ),
    "counts": Derived(
        _counts,
        'SELECT l_partkey AS feature, l_returnflag || l_linestatus AS sample, sum(l_quantity) AS "count" '
        "FROM lineitem GROUP BY 1, 2",
    ),
    "aligned": Derived(
        _aligned,
        f"SELECT event_id AS read_id, event_type AS chrom, {_MINUTES} AS start, "
        f'{_MINUTES} + 1 + CAST(floor(value) AS BIGINT) % 60 AS "end", user_id % 61 AS mapq, '
        "CASE user_id % 10 WHEN 0 THEN 4 WHEN 1 THEN 256 ELSE 0 END AS flag FROM events",
    ),
    "intervals": Derived(
        _intervals,
        "SELECT o_orderkey AS name, ['click','error','purchase','signup','view'][o_orderkey % 5 + 1] AS chrom, "
        "date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 15 AS start, "
        "date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 15 + 10 + CAST(floor(o_totalprice / 1000) AS BIGINT) "
        'AS "end" FROM orders',
    ),
    "variants": Derived(
        _variants,
        f"SELECT event_id AS id, event_type AS chrom, {_MINUTES} + 1 AS pos, substr('ACGT', event_id % 4 + 1, 1) AS ref, "
        "CASE WHEN event_id % 10 = 0 THEN 'C,T' WHEN event_id % 10 = 1 THEN 'AG' ELSE substr('ACGT', user_id % 4 + 1, 1) END "
        "AS alt, value AS qual, user_id % 40 AS depth, user_id % 40 * event_id % 40 AS alt_count FROM events",
    ),
    "genotypes": Derived(
        _genotypes,
        "SELECT sample, site, gt, s_nationkey AS pop FROM (SELECT l_suppkey AS sample, l_partkey % 200 AS site, "
        "count(*) % 3 AS gt FROM lineitem GROUP BY 1, 2) JOIN supplier ON s_suppkey = sample",
    ),
    "abundance": Derived(
        _abundance, 'SELECT user_id AS sample, event_type AS taxon, count(*) AS "count" FROM events GROUP BY 1, 2'
    ),
    "survival": Derived(
        _survival,
        "SELECT o_custkey AS subject, time, event, c_mktsegment AS grp, c_acctbal AS covariate FROM (SELECT o_custkey, "
        "CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS DOUBLE) AS time, "
        "CAST(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS event FROM orders GROUP BY 1) "
        "JOIN customer ON c_custkey = o_custkey",
    ),
    "snps": Derived(
        _snps,
        "SELECT source AS snp_id, lang AS chrom, count(*) FILTER (toxic = 1 AND quality = 1) AS case_alt, "
        "count(*) FILTER (toxic = 1 AND quality = 0) AS case_ref, count(*) FILTER (toxic = 0 AND quality = 1) AS ctrl_alt, "
        "count(*) FILTER (toxic = 0 AND quality = 0) AS ctrl_ref, "
        "CAST(regexp_replace(source, '[^0-9]', '', 'g') AS BIGINT) * 1000 AS pos "
        "FROM documents JOIN labels USING (doc_id) GROUP BY source, lang",
    ),
    "methylation": Derived(
        _methylation,
        "SELECT l_returnflag AS chrom, l_partkey AS pos, l_linestatus AS grp, count(*) AS coverage, "
        "count(*) FILTER (l_quantity > 25) AS methylated, ['CpG','CHG','CHH'][l_partkey % 3 + 1] AS context "
        "FROM lineitem GROUP BY 1, 2, 3",
    ),
}


def with_clause(names: list[str], seen: set[str] | None = None) -> str:
    """``WITH`` text for the named inputs and what they need, each once, needs first."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in DERIVED[name].needs:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ", ".join(f"{n} AS ({DERIVED[n].sql})" for n in order) + " "

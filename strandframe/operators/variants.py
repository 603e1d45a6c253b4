"""Variant tables: filters, summaries, Ts/Tv and genome-wide positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut_lineage
from . import ordered


def filter_variants(df: DataFrame, min_quality: float = 20, min_depth: int = 5, max_allele_freq: float = 0.95) -> DataFrame:
    share = F.when(F.col("depth") > 0, F.col("alt_count") / F.col("depth")).otherwise(0.0)
    return df.filter((F.col("qual") >= min_quality) & (F.col("depth") >= min_depth) & (share <= max_allele_freq))


def is_transition(ref, alt) -> Column:
    return F.concat(F.upper(ref), F.upper(alt)).isin("AG", "GA", "CT", "TC")


def alleles(df: DataFrame) -> DataFrame:
    """One row per alternate allele with its class."""
    out = df.withColumn("allele", F.explode(F.split("alt", ",")))
    snp = (F.length("ref") == 1) & (F.length("allele") == 1) & (F.col("ref") != F.col("allele"))
    return out.withColumn("is_snp", snp).withColumn("is_ti", snp & is_transition("ref", "allele")).withColumn(
        "is_indel", F.length("ref") != F.length("allele")
    )


def variant_summary(df: DataFrame) -> DataFrame:
    """Counts per chromosome with a total row (chrom NULL): records, SNP and indel alleles, Ts/Tv and quality."""
    per_allele = alleles(df).rollup("chrom").agg(
        F.count_if("is_snp").alias("snps"), F.count_if("is_indel").alias("indels"), F.count_if("is_ti").alias("transitions"),
        F.count_if(F.col("is_snp") & ~F.col("is_ti")).alias("transversions"),
    )
    per_record = df.rollup("chrom").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("alt").contains(",")).alias("multi_allelic"),
        F.avg("qual").alias("qual_mean"), F.count_if(F.col("qual") > 20).alias("qual_above_20"),
    )
    return per_record.alias("r").join(per_allele.alias("a"), F.col("r.chrom").eqNullSafe(F.col("a.chrom"))).select(
        "r.chrom", "records", "multi_allelic", "qual_mean", "qual_above_20", "snps", "indels", "transitions", "transversions",
        (F.col("transitions") / F.when(F.col("transversions") > 0, F.col("transversions"))).alias("ts_tv"),
    )


def quality_median(df: DataFrame) -> DataFrame:
    return ordered.exact_quantiles(df, "qual", [0.5]).select(F.col("q0").alias("qual_median"))


def ts_tv(df: DataFrame) -> DataFrame:
    """Transitions, transversions and their ratio (NULL without transversions)."""
    a = alleles(df).filter("is_snp")
    return a.agg(F.count_if("is_ti").alias("transitions"), F.count_if(~F.col("is_ti")).alias("transversions")).withColumn(
        "ts_tv", F.col("transitions") / F.when(F.col("transversions") > 0, F.col("transversions"))
    )


def manhattan(df: DataFrame, p: str, gap: int = 0) -> DataFrame:
    """Cumulative genome position (chromosomes by name, ``gap`` between them) and -log10 of the named p column."""
    plain = df.withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))
    # one row per chromosome
    sizes = plain.groupBy("chrom").agg(F.max("pos").alias("_max"))
    w = W.orderBy("chrom").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum(F.col("_max") + gap).over(w), F.lit(0))).drop("_max")
    return plain.join(offsets, "chrom").select(
        *plain.columns, (F.col("pos") + F.col("_off")).alias("genome_pos"), (-F.log10(F.col(p) + 1e-300)).alias("neg_log10")
    )


def lead_snps(df: DataFrame, p_threshold: float = 5e-8, window: int = 500_000) -> DataFrame:
    """Lead rows by position: the first significant row, then the first one beyond ``window`` of each lead.

    Every row names its successor, the first row beyond its window. Rows further than ``window`` from the row before are leads
    whatever came before them; from these starts, leads are what successors reach. Each round doubles the steps that a
    pointer takes, so a chain of n leads needs log2(n) rounds, and no task holds a locus.
    """
    hits = df.filter(F.col("p_value") < p_threshold)
    spots = cut_lineage(hits.groupBy("chrom", "pos").agg(F.min_by(F.struct(*[c for c in df.columns if c not in ("chrom", "pos")]), F.col("snp_id")).alias("row")))
    tile, places = ordered.position_tile("pos"), spots.select("chrom", "pos")
    behind = ordered.previous_row(places, "pos", ["pos"], ["chrom"], tile)
    reached = cut_lineage(behind.where(F.col("prev_pos").isNull() | (F.col("pos") - F.col("prev_pos") > window)).select("chrom", "pos"))
    beyond = places.select("chrom", (F.col("pos") + window + 1).alias("pos"))
    after = ordered.neighbours(places.withColumn("name", F.lit(0)), beyond, "pos", "name", ["chrom"], tile).where("after IS NOT NULL")
    steps = after.select("chrom", (F.col("pos") - window - 1).alias("pos"), F.col("after.pos").alias("next"))
    # a start needs no pointer to it
    pointers = cut_lineage(steps.join(reached.withColumnRenamed("pos", "next"), ["chrom", "next"], "left_anti"))
    while True:
        new = cut_lineage(reached.join(pointers, ["chrom", "pos"]).select("chrom", F.col("next").alias("pos")))
        if new.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(new))
        far = pointers.select("chrom", F.col("pos").alias("next"), F.col("next").alias("_next"))
        pointers = cut_lineage(pointers.join(far, ["chrom", "next"]).select("chrom", "pos", F.col("_next").alias("next")))
    return spots.join(reached, ["chrom", "pos"]).select("chrom", "pos", "row.*")

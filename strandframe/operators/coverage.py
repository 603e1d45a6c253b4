"""Depth, windows, pileup, peaks, copy number and structural variants from aligned reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import dna
from ..session import cut_lineage
from . import ordered
from .ordered import position_tile

BY = ["chrom"]


def usable(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    """Mapped, primary reads of enough mapping quality."""
    return reads.filter((F.col("flag").bitwiseAND(4) == 0) & (F.col("flag").bitwiseAND(256) == 0) & (F.col("mapq") >= min_mapq))


def extended(reads: DataFrame, length: int = 200) -> DataFrame:
    """Reads extended to a fixed fragment length from their start."""
    return reads.withColumn("end", F.col("start") + length)


def depth_runs(**tracks: DataFrame) -> DataFrame:
    """Runs ``chrom, start, end`` of constant depth with one depth column per named track of reads.

    Read edges are summed per position before the shuffle; runs where every depth is 0 are left out.
    """
    names = list(tracks)
    edges = None
    for name, reads in tracks.items():
        part = reads.select(
            "chrom",
            F.inline(
                F.array(
                    F.struct(F.col("start").alias("pos"), F.lit(1).alias(f"d_{name}")),
                    F.struct(F.col("end").alias("pos"), F.lit(-1).alias(f"d_{name}")),
                )
            ),
        )
        edges = part if edges is None else edges.unionByName(part, allowMissingColumns=True)
    deltas = [f"d_{n}" for n in names]
    marks = edges.groupBy("chrom", "pos").agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in deltas])
    changes = marks.filter(" OR ".join(f"{d} <> 0" for d in deltas))
    sums = ordered.prefix_sums(changes, "pos", deltas, BY, position_tile("pos"), with_next=True)
    depths = [(F.col(f"{d}_before") + F.col(d)).cast("long").alias(n) for d, n in zip(deltas, names)]
    runs = sums.select("chrom", F.col("pos").alias("start"), F.col("next_pos").alias("end"), *depths)
    return runs.filter(" OR ".join(f"{n} > 0" for n in names))


def chrom_sizes(reads: DataFrame) -> DataFrame:
    """Largest end per chromosome, the length of the covered axis."""
    return reads.groupBy("chrom").agg(F.max("end").alias("size"))


def _spread(runs: DataFrame, width: int, step: int) -> DataFrame:
    """Cut runs at windows [k * step, k * step + width): ``k`` and the bases ``_bases`` of the run inside."""
    first = F.greatest(F.lit(0), F.floor((F.col("start") - width) / step) + 1)
    last = F.floor((F.col("end") - 1) / step)
    cut = runs.filter(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    inside = F.least(F.col("end"), F.col("k") * step + width) - F.greatest(F.col("start"), F.col("k") * step)
    return cut.withColumn("_bases", inside)


def _grid(sizes: DataFrame, count: Column) -> DataFrame:
    return sizes.withColumn("_n", count).filter("_n > 0").select("chrom", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("k"))


def window_means(runs: DataFrame, sizes: DataFrame, width: int, value: str = "depth") -> DataFrame:
    """Mean depth of every full window, zeros included; an axis shorter than the window is one short window."""
    sums = _spread(runs, width, width).groupBy("chrom", "k").agg(F.sum(F.col(value) * F.col("_bases")).alias("_sum"))
    grid = _grid(sizes, F.greatest(F.lit(1), F.floor(F.col("size") / width)))
    span = F.least(F.lit(width), F.col("size"))
    return grid.join(sums, ["chrom", "k"], "left").select(
        "chrom", (F.col("k") * width).alias("start"), (F.coalesce("_sum", F.lit(0)) / span).alias("mean_depth")
    )


def bin_counts(reads: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """Reads touching each bin, zeros included."""
    bins = reads.select("chrom", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("k"))
    counts = bins.groupBy("chrom", "k").agg(F.count(F.lit(1)).alias("_n_reads"))
    return _grid(sizes, F.ceil(F.col("size") / width)).join(counts, ["chrom", "k"], "left").select(
        "chrom", (F.col("k") * width).alias("start"), F.coalesce("_n_reads", F.lit(0)).alias("reads")
    )


def signal_bins(signal: DataFrame, width: int, value: str = "value") -> DataFrame:
    """Mean and maximum of a per-position signal in each bin that has values."""
    return signal.groupBy("chrom", (F.floor(F.col("pos") / width) * width).alias("start")).agg(
        F.avg(value).alias("mean_value"), F.max(value).alias("max_value"), F.count(F.lit(1)).alias("n")
    )


def pileup(reads: DataFrame, cigar: str = "cigar", seq: str = "seq") -> DataFrame:
    """Bases per reference position: M takes both axes, I and S the read, D the reference. ``pos`` keeps its base."""
    ops = dna.cigar_ops(cigar)
    start = F.struct(
        F.col("pos").alias("ref"), F.lit(1).alias("off"), F.array().cast("array<struct<ref:bigint,off:int,n:int>>").alias("blocks")
    )

    def step(a, o):
        both, read_only, ref_only = o["op"] == "M", o["op"].isin("I", "S"), o["op"] == "D"
        block = F.struct(a["ref"].alias("ref"), a["off"].alias("off"), o["n"].alias("n"))
        return F.struct(
            (a["ref"] + F.when(both | ref_only, o["n"]).otherwise(0)).alias("ref"),
            (a["off"] + F.when(both | read_only, o["n"]).otherwise(0)).alias("off"),
            F.when(both, F.array_append(a["blocks"], block)).otherwise(a["blocks"]).alias("blocks"),
        )

    blocks = reads.select("chrom", F.col(seq).alias("_seq"), F.inline(F.aggregate(ops, start, step)["blocks"]))
    bases = blocks.select("chrom", "ref", F.posexplode(F.split(F.expr("substring(_seq, off, n)"), "")).alias("_i", "base"))
    return bases.filter(F.col("base") != "").groupBy("chrom", (F.col("ref") + F.col("_i")).alias("pos"), "base").agg(F.count(F.lit(1)).alias("n"))


def call_variants(piles: DataFrame, reference: DataFrame | None = None, min_depth: int = 4, min_share: float = 0.25) -> DataFrame:
    """Alternate bases by share of depth. Without ``reference`` (chrom, pos, ref) the most frequent base stands in."""
    w = W.partitionBy("chrom", "pos")
    site = piles.withColumn("depth", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "base")))
    if reference is None:
        site = site.withColumn("ref", F.first("base").over(w.orderBy("rank")))
    else:
        site = site.join(reference, ["chrom", "pos"])
    share = F.col("n") / F.col("depth")
    return site.filter((F.col("depth") >= min_depth) & (F.col("base") != F.col("ref")) & (share >= min_share)).select(
        "chrom", "pos", "ref", F.col("base").alias("alt"), F.least(F.lit(99), F.floor(share * 60)).cast("long").alias("quality"),
        F.col("depth").cast("long").alias("depth"), F.col("n").alias("alt_count"), F.when(share < 0.75, "0/1").otherwise("1/1").alias("genotype"),
    )


def smoothed_segments(reads: DataFrame, width: int = 50) -> DataFrame:
    """The moving sum of depth over ``width`` bases as straight segments ``start, end, slope, moment``.

    The moving sum at i is slope * (i + 1) - moment. It bends only where depth changes, so one prefix sum over
    read edges gives it without a row per base.
    """
    left, right = width // 2, width - width // 2 - 1
    bends = (
        depth_edges(reads)
        .select(
            "chrom",
            F.inline(
                F.array(
                    F.struct((F.col("pos") - right).alias("pos"), F.col("d").alias("d")),
                    F.struct((F.col("pos") + left + 1).alias("pos"), (-F.col("d")).alias("d")),
                )
            ),
        )
        .groupBy("chrom", "pos")
        .agg(F.sum("d").alias("d"))
        .filter("d <> 0")
        .withColumn("m", F.col("d") * F.col("pos"))
    )
    sums = ordered.prefix_sums(bends, "pos", ["d", "m"], BY, position_tile("pos"), with_next=True)
    return sums.filter("next_pos IS NOT NULL").select(
        "chrom", F.col("pos").alias("start"), F.col("next_pos").alias("end"),
        (F.col("d_before") + F.col("d")).alias("slope"), (F.col("m_before") + F.col("m")).alias("moment"),
    ).filter("slope <> 0 OR moment <> 0")


def depth_edges(reads: DataFrame) -> DataFrame:
    return (
        reads.select(
            "chrom",
            F.inline(
                F.array(
                    F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"))
                )
            ),
        )
        .groupBy("chrom", "pos")
        .agg(F.sum("d").alias("d"))
        .filter("d <> 0")
    )


def smoothed_depth(reads: DataFrame, width: int = 50) -> DataFrame:
    """``chrom, pos, total``: moving sum at each position where it is positive, within [0, axis size)."""
    segments = clipped_segments(reads, width)
    return segments.select("chrom", "slope", "moment", F.explode(F.sequence("first", "last")).alias("pos")).select("chrom", "pos", _line(F.col("pos")).alias("total")).filter("total > 0")


def _line(at: Column) -> Column:
    """The moving sum at a position of a segment."""
    return F.col("slope") * (at + 1) - F.col("moment")


def clipped_segments(reads: DataFrame, width: int = 50) -> DataFrame:
    """``smoothed_segments`` within the axis: ``chrom, slope, moment, first, last``, positions inclusive."""
    seg = smoothed_segments(reads, width).join(chrom_sizes(reads), "chrom")
    first, last = F.greatest(F.col("start"), F.lit(0)), F.least(F.col("end"), F.col("size")) - 1
    return seg.select("chrom", "slope", "moment", first.alias("first"), last.alias("last")).where("last >= first")


def total_histogram(segments: DataFrame) -> DataFrame:
    """``chrom, total, n``: positions per positive moving sum. A level segment is one row; only slopes, which end within two widths of a
    read's edge, are looked at place by place."""
    level = segments.where("slope = 0").select("chrom", (-F.col("moment")).alias("total"), (F.col("last") - F.col("first") + 1).alias("n"))
    sloped = segments.where("slope <> 0").select("chrom", "slope", "moment", F.explode(F.sequence("first", "last")).alias("pos")).select("chrom", _line(F.col("pos")).alias("total"), F.lit(1).cast("long").alias("n"))
    return level.unionAll(sloped).where("total > 0").groupBy("chrom", "total").agg(F.sum("n").alias("n"))


def above_line(segments: DataFrame, cut: str) -> DataFrame:
    """The part of each segment over the level ``cut``: ``start, end`` (exclusive), its highest ``total`` and the first ``summit`` there."""
    cross = (F.col(cut) + F.col("moment")) / F.col("slope")
    rising, falling = F.col("slope") > 0, F.col("slope") < 0
    guess = F.when(rising, F.floor(cross)).when(falling, F.ceil(cross) - 2)
    # the quotient may be off in its last digit: the place beside it decides
    inner, outer = F.when(rising, 1).otherwise(-1), F.col("guess")
    exact = F.when(_line(outer - inner) > F.col(cut), outer - inner).when(_line(outer) > F.col(cut), outer).otherwise(outer + inner)
    met = segments.withColumn("guess", guess).withColumn("edge", exact)
    low = F.when(rising, F.greatest("first", "edge")).otherwise(F.col("first"))
    high = F.when(falling, F.least("last", "edge")).otherwise(F.col("last"))
    cutout = met.where(F.col("slope").isNotNull() & ((F.col("slope") != 0) | (-F.col("moment") > F.col(cut)))).withColumn("low", low).withColumn("high", high).where("low <= high")
    summit = F.when(rising, F.col("high")).otherwise(F.col("low"))
    return cutout.select("chrom", F.col("low").alias("start"), (F.col("high") + 1).alias("end"), summit.alias("summit"), _line(summit).alias("total"), cut)


def call_peaks(reads: DataFrame, width: int = 50, percentile: float = 0.95, min_score: float = 5.0, drop_open: bool = False) -> DataFrame:
    """Runs where the smoothed depth exceeds the percentile of its positive values on the chromosome.

    The percentile and the runs come from straight segments; runs that touch are numbered in tiles and put together by number.
    """
    segments = cut_lineage(clipped_segments(reads, width))
    cut = ordered.histogram_quantiles(total_histogram(segments), "total", "n", [percentile], BY, position_tile("total")).withColumnRenamed("q0", "_cut")
    above = cut_lineage(above_line(segments.join(cut, "chrom"), "_cut"))
    numbered = ordered.islands(above, "start", F.col("start") > F.col("prev_end"), BY, position_tile("start"), ["end"])
    runs = numbered.groupBy("chrom", "island").agg(
        F.min_by("summit", F.struct(-F.col("total"), F.col("summit"))).alias("summit"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("total").alias("total"), F.first("_cut").alias("_cut"),
    )
    peaks = runs.withColumn("score", F.col("total") / width).filter(F.col("score") >= min_score)
    if drop_open:
        peaks = peaks.join(chrom_sizes(reads), "chrom").filter(F.col("end") < F.col("size"))
    return peaks.select(
        "chrom", "start", "end", "summit", "score",
        (F.col("score") / F.greatest(F.col("_cut") / width, F.lit(1.0))).alias("fold_enrichment"),
        (F.col("end") - F.col("start")).alias("length"),
    )


def depth_median(runs: DataFrame, sizes: DataFrame, value: str = "depth", positive: bool = False) -> DataFrame:
    """Median per-base depth per chromosome, uncovered bases included unless ``positive``."""
    counts = runs.filter(F.col(value) > 0).groupBy("chrom", value).agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    if not positive:
        covered = counts.groupBy("chrom").agg(F.sum("n").alias("_c"))
        zeros = sizes.join(covered, "chrom", "left").select("chrom", F.lit(0).cast("long").alias(value), (F.col("size") - F.coalesce("_c", F.lit(0))).alias("n"))
        counts = counts.unionByName(zeros.filter("n > 0"))
    return ordered.histogram_quantiles(counts, value, "n", [0.5], BY, position_tile(value)).withColumnRenamed("q0", "median")


def copy_number(sample: DataFrame, reference: DataFrame | None = None, width: int = 1000) -> DataFrame:
    """Copy number and log2 ratio per bin against reference reads, or against the sample's median depth."""
    sizes = chrom_sizes(sample)
    cov = window_means(depth_runs(depth=sample), sizes, width).withColumnRenamed("mean_depth", "cov")
    if reference is not None:
        ref = window_means(depth_runs(depth=reference), sizes, width).withColumnRenamed("mean_depth", "ref")
        both = cov.join(ref, ["chrom", "start"])
    else:
        both = cov.join(depth_median(depth_runs(depth=sample), sizes).withColumnRenamed("median", "ref"), "chrom")
    has = F.col("ref") > 0
    return both.select(
        "chrom", "start",
        F.when(has, F.greatest(F.lit(0), F.bround(2 * F.col("cov") / F.greatest(F.col("ref"), F.lit(1.0)), 0).cast("long"))).otherwise(2).alias("cn"),
        F.when(has, F.log2((F.col("cov") + 1) / (F.col("ref") + 1))).otherwise(0.0).alias("log2_ratio"),
        F.col("cov").alias("coverage"),
    )


def structural_variants(sample: DataFrame, reference: DataFrame, width: int = 100, dup: float = 1.5, deletion: float = 0.5, gap: int = 1000) -> DataFrame:
    """DEL and DUP calls of half-overlapping windows of the normalised depth ratio, merged when near and alike."""
    step = width // 2
    sizes = chrom_sizes(sample)
    runs = depth_runs(cov=sample, ref=reference)

    def scale(track: str) -> DataFrame:
        return depth_median(runs, sizes, track, positive=True).select("chrom", F.greatest(F.col("median"), F.lit(1.0)).alias(f"_m_{track}"))

    rated = runs.join(scale("cov"), "chrom").join(scale("ref"), "chrom", "left").withColumn(
        "ratio", (F.col("cov") / F.col("_m_cov")) / (F.col("ref") / F.coalesce("_m_ref", F.lit(1.0)) + 1e-10)
    )
    sums = _spread(rated, width, step).groupBy("chrom", "k").agg(
        F.sum(F.col("ratio") * F.col("_bases")).alias("_ratio"), F.sum(F.col("cov") * F.col("_bases")).alias("_support")
    )
    grid = _grid(sizes, F.ceil((F.col("size") - width) / step))
    mean = F.coalesce(F.col("_ratio"), F.lit(0.0)) / width
    kind = F.when(mean < deletion, "DEL").when(mean > dup, "DUP")
    conf = F.when(mean < deletion, (deletion - mean) / deletion).otherwise((mean - dup) / dup)
    calls = (
        grid.join(sums, ["chrom", "k"], "left")
        .select(
            "chrom", (F.col("k") * step).alias("start"), (F.col("k") * step + width).alias("end"), kind.alias("sv_type"),
            F.least(F.lit(1.0), conf).alias("confidence"), F.coalesce("_support", F.lit(0)).cast("long").alias("support"),
        )
        .filter("sv_type IS NOT NULL")
    )
    breaks = (F.col("sv_type") != F.col("prev_sv_type")) | (F.col("start") > F.col("prev_end") + gap)
    # windows are of one width, so the row before ends last: runs are numbered in tiles and put together by number
    numbered = ordered.islands(cut_lineage(calls), "start", breaks, BY, position_tile("start"), ["sv_type", "end"])
    out = numbered.groupBy("chrom", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("sv_type").alias("sv_type"), F.max("confidence").alias("confidence"), F.sum("support").alias("support")
    )
    return out.select(
        "chrom", "start", "end", "sv_type", (F.col("end") - F.col("start")).alias("size"), "confidence",
        F.col("support").alias("support_reads"),
    )

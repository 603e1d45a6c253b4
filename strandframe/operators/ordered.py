"""Running sums, ranks, quantiles and false-discovery correction without one-task windows.

A window over a whole chromosome, or over a whole table, would put an unbounded group into one task. Here the
ordered axis is cut into tiles. Each tile is summed first (map-side combined), the few tile totals are scanned
once, and the rows are then scanned tile by tile with the carry from the tiles before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut_lineage

FIRST = W.unboundedPreceding
POSITION_TILE = 1 << 16


def position_tile(pos: str) -> Column:
    return F.floor(F.col(pos) / POSITION_TILE)


def real(value: str) -> Column:
    """Neither NULL nor NaN."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def quantile_tile(df: DataFrame, key: str, tiles: int | None = None) -> Column:
    """Tile number of ``key`` between approximate quantiles, which come from a scalar subquery.

    Four tiles for each shuffle partition, the number that a cluster sets by the size of its data, and 32 at least.
    """
    x = F.col(key).cast("double")
    tiles = tiles or max(32, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    steps = [i / tiles for i in range(1, tiles)]
    bounds = df.agg(F.percentile_approx(x, steps, max(1000, 10 * tiles))).scalar()
    return F.array_position(F.sort_array(F.array_append(bounds, x)), x)


def prefix_sums(
    df: DataFrame,
    key: str,
    values: Sequence[str],
    part: Sequence[str] = (),
    tile: Column | None = None,
    keep_tile: bool = False,
    with_next: bool = False,
) -> DataFrame:
    """Add ``<v>_before`` (sum over smaller keys) and ``<v>_total`` for each value column.

    ``with_next`` adds ``next_<key>``, the following key of the part (NULL after the last), in the same scan.

    ``df`` must hold one row per (part, key): aggregate to that grain first, so that ties cost one row.
    """
    part = list(part)
    tile = quantile_tile(df, key) if tile is None else tile
    tiled = df.withColumn("_tile", tile)
    heads = [F.min(key).alias("_head")] if with_next else []
    sums = tiled.groupBy(*part, "_tile").agg(*[F.sum(v).alias(f"_s_{v}") for v in values], *heads)
    tiles_in_order = W.partitionBy(*part).orderBy("_tile")
    by_tile = tiles_in_order.rowsBetween(FIRST, -1)
    whole = W.partitionBy(*part)
    carry = sums.select(
        *part,
        "_tile",
        *([F.lead("_head").over(tiles_in_order).alias("_ahead")] if with_next else []),
        *[F.coalesce(F.sum(f"_s_{v}").over(by_tile), F.lit(0)).alias(f"_c_{v}") for v in values],
        *[F.sum(f"_s_{v}").over(whole).alias(f"{v}_total") for v in values],
    )
    rows = W.partitionBy(*part, "_tile").orderBy(key)
    inside = rows.rowsBetween(FIRST, -1)
    out = tiled.join(carry, [*part, "_tile"]).select(
        *df.columns,
        "_tile",
        *[(F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_c_{v}")).alias(f"{v}_before") for v in values],
        *[f"{v}_total" for v in values],
        *([F.coalesce(F.lead(key).over(rows), F.col("_ahead")).alias(f"next_{key}")] if with_next else []),
    )
    return out if keep_tile else out.drop("_tile")


def average_ranks(df: DataFrame, value: str, part: Sequence[str] = (), tile: Column | None = None) -> DataFrame:
    """Distinct values with ``n``, ``n_total`` and their average rank ``avg_rank``: the rank table of ``value`` (NULL and NaN have none)."""
    counts = df.filter(real(value)).groupBy(*part, value).agg(F.count(F.lit(1)).alias("n"))
    out = prefix_sums(counts, value, ["n"], part, tile)
    return out.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2).drop("n_before")


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], part: Sequence[str] = (), tile: Column | None = None
) -> DataFrame:
    """Exact, linearly interpolated quantiles ``q0, q1, ..`` per part, from the value histogram; NULL and NaN are left out."""
    counts = df.filter(real(value)).groupBy(*part, value).agg(F.count(F.lit(1)).alias("n"))
    return histogram_quantiles(counts, value, "n", probs, part, tile)


def histogram_quantiles(
    counts: DataFrame, value: str, n: str, probs: Sequence[float], part: Sequence[str] = (), tile: Column | None = None
) -> DataFrame:
    """Quantiles of a table that already holds one row per (part, value) with its count.

    Whole-numbered values can pass ``position_tile(value)`` and save the pass that looks for tile bounds.
    """
    ranked = prefix_sums(counts, value, [n], part, tile)
    before, total = F.col(f"{n}_before"), F.col(f"{n}_total")

    def at(index: Column) -> Column:
        return F.max(F.when((before <= index) & (index < before + F.col(n)), F.col(value)))

    picks = []
    for i, p in enumerate(probs):
        place = (total - 1) * F.lit(float(p))
        picks += [
            at(F.floor(place)).alias(f"_lo{i}"),
            at(F.ceil(place)).alias(f"_hi{i}"),
            F.max(place - F.floor(place)).alias(f"_f{i}"),
        ]
    got = ranked.groupBy(*part).agg(*picks)
    return got.select(
        *part,
        *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"q{i}") for i in range(len(probs))],
    )


def benjamini_hochberg(
    df: DataFrame, p: str = "p_value", out: str = "p_adjusted", part: Sequence[str] = (), materialize: bool = True
) -> DataFrame:
    """Step-up adjusted p-values; a NULL p stays NULL, a NaN p stays NaN, and neither is counted.

    Equal p-values share one adjusted value, so the work runs over distinct p with their counts. The table of
    tests is read several times, so by default it is checkpointed and the tests behind it run once.
    """
    part = list(part)
    df = cut_lineage(df) if materialize else df
    counts = df.filter(real(p)).groupBy(*part, p).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counts, p, ["n"], part, keep_tile=True).withColumn(
        "_raw", F.col(p) * F.col("n_total") / (F.col("n_before") + F.col("n"))
    )
    lows = ranked.groupBy(*part, "_tile").agg(F.min("_raw").alias("_low"))
    later = lows.withColumn(
        "_later", F.min("_low").over(W.partitionBy(*part).orderBy(F.desc("_tile")).rowsBetween(FIRST, -1))
    ).drop("_low")
    # frames grow backwards from the end: a frame that reaches forward to the end is summed anew for every row
    inside = W.partitionBy(*part, "_tile").orderBy(F.desc(p)).rowsBetween(FIRST, 0)
    adjusted = ranked.join(later, [*part, "_tile"]).select(
        *part, p, F.least(F.lit(1.0), F.min("_raw").over(inside), F.col("_later")).alias(out)
    )
    shown = F.when(F.isnan(p), F.col(p)).otherwise(F.col(out)).alias(out)
    return df.join(adjusted, [*part, p], "left").select(*df.columns, shown)


def bonferroni(df: DataFrame, p: str = "p_value", out: str = "p_adjusted") -> DataFrame:
    n = df.agg(F.count_if(real(p))).scalar()
    return df.withColumn(out, F.when(real(p), F.least(F.lit(1.0), F.col(p) * n)).otherwise(F.col(p)))


def n50(df: DataFrame, length: str, part: Sequence[str] = ()) -> DataFrame:
    """N50 and L50 of a length column per part."""
    counts = df.groupBy(*part, length).agg(F.count(F.lit(1)).alias("n")).withColumn("bases", F.col(length) * F.col("n"))
    ranked = prefix_sums(counts, length, ["n", "bases"], part)
    # sequences at least as long as this row's, counted from the long end
    longer_bases = F.col("bases_total") - F.col("bases_before") - F.col("bases")
    longer_n = F.col("n_total") - F.col("n_before") - F.col("n")
    half = F.col("bases_total") / 2
    hit = (longer_bases < half) & (longer_bases + F.col("bases") >= half)
    return (
        ranked.filter(hit)
        .select(
            *part,
            F.col(length).cast("long").alias("n50"),
            (longer_n + F.ceil((half - longer_bases) / F.col(length))).cast("long").alias("l50"),
        )
    )


def running_score(df: DataFrame, score: str, row_id: str) -> DataFrame:
    """Running sum of scores from the highest down over the sum of positive scores, ties by ``row_id``.

    Ties are scanned as one row first; within a tie the running sum grows by equal steps in ``row_id`` order,
    which the rank within the tie gives.
    """
    ties = df.groupBy(score).agg(F.count(F.lit(1)).alias("n")).withColumn("mass", F.col(score) * F.col("n"))
    ranked = prefix_sums(ties, score, ["n", "mass"])
    positive = df.agg(F.sum(F.greatest(F.col(score), F.lit(0.0)))).scalar()
    above = ranked.select(
        score,
        (F.col("mass_total") - F.col("mass_before") - F.col("mass")).alias("_above"),
        (F.col("n_total") - F.col("n_before") - F.col("n")).alias("_rank_above"),
    )
    inner = prefix_within_ties(df, score, row_id)
    return inner.join(above, score).select(
        row_id,
        score,
        (F.col("_rank_above") + F.col("_place")).cast("long").alias("rank"),
        ((F.col("_above") + F.col(score) * F.col("_place")) / (positive + F.lit(1e-10))).alias("running_sum"),
    )


def prefix_within_ties(df: DataFrame, score: str, row_id: str) -> DataFrame:
    """1-based place ``_place`` of each row among rows of equal score, by ``row_id``, in tiles of ``row_id``."""
    rows = df.select(score, row_id, F.lit(1).alias("_one"))
    out = prefix_sums(rows, row_id, ["_one"], [score])
    return out.select(score, row_id, (F.col("_one_before") + 1).alias("_place"))


def previous_row(df: DataFrame, key: str, columns: Sequence[str], part: Sequence[str] = (), tile: Column | None = None) -> DataFrame:
    """Add ``prev_<c>`` of the row before in ``key`` order, also across tiles. ``key`` is unique within ``part``."""
    part = list(part)
    tile = quantile_tile(df, key) if tile is None else tile
    tiled = df.withColumn("_tile", tile)
    tails = tiled.groupBy(*part, "_tile").agg(F.max_by(F.struct(*columns), F.col(key)).alias("_tail"))
    behind = tails.withColumn("_behind", F.lag("_tail").over(W.partitionBy(*part).orderBy("_tile"))).drop("_tail")
    w = W.partitionBy(*part, "_tile").orderBy(key)
    return tiled.join(behind, [*part, "_tile"]).select(
        *df.columns, *[F.coalesce(F.lag(c).over(w), F.col(f"_behind.{c}")).alias(f"prev_{c}") for c in columns]
    )


def islands(df: DataFrame, key: str, breaks: Column, part: Sequence[str], tile: Column, columns: Sequence[str]) -> DataFrame:
    """Number runs of neighbouring rows: ``breaks`` (over ``prev_*`` columns) starts a new ``island``."""
    flagged = previous_row(df, key, columns, part, tile).withColumn(
        "_break", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)
    )
    out = prefix_sums(flagged, key, ["_break"], part, tile)
    return out.withColumn("island", F.col("_break_before") + F.col("_break")).select(*df.columns, "island")


def neighbours(points: DataFrame, queries: DataFrame, pos: str, name: str, part: Sequence[str], tile: Column) -> DataFrame:
    """For each distinct query position the nearest point at or before it and at or after it.

    Result: ``part, pos, before, after`` with structs of position and smallest name at that position.
    """
    part = list(part)
    rows = (
        points.groupBy(*part, pos).agg(F.min(name).alias("_name"))
        .unionByName(queries.select(*part, pos).distinct().withColumn("_name", F.lit(None)), allowMissingColumns=True)
        .groupBy(*part, pos)
        .agg(F.max("_name").alias("_name"))
        .withColumn("_here", F.when(F.col("_name").isNotNull(), F.struct(F.col(pos).alias("pos"), F.col("_name").alias("name"))))
        .withColumn("_tile", tile)
    )
    ends = rows.groupBy(*part, "_tile").agg(F.max("_here").alias("_last"), F.min("_here").alias("_first"))
    up, down = (W.partitionBy(*part).orderBy(o).rowsBetween(FIRST, -1) for o in (F.asc("_tile"), F.desc("_tile")))
    carry = ends.select(
        *part, "_tile",
        F.last("_last", ignorenulls=True).over(up).alias("_from"),
        F.last("_first", ignorenulls=True).over(down).alias("_to"),
    )
    rising, falling = (W.partitionBy(*part, "_tile").orderBy(o).rowsBetween(FIRST, 0) for o in (F.asc(pos), F.desc(pos)))
    return rows.join(carry, [*part, "_tile"]).select(
        *part, pos,
        F.coalesce(F.last("_here", ignorenulls=True).over(rising), F.col("_from")).alias("before"),
        F.coalesce(F.last("_here", ignorenulls=True).over(falling), F.col("_to")).alias("after"),
    )

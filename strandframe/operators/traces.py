"""Peaks of intensity traces ``sample, scan, intensity``."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import ordered

# functions that run in Python workers travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BY = ["sample"]
#: places of a trace that are looked at together
TILE = 1024


def local_maxima(df: DataFrame) -> DataFrame:
    """Scans higher than both neighbours (ends excluded), with both steps."""
    tile = ordered.position_tile("scan")
    back = ordered.previous_row(df, "scan", ["intensity"], BY, tile)
    flipped = back.withColumn("_back", -F.col("scan"))
    both = ordered.previous_row(flipped.withColumnRenamed("prev_intensity", "left").withColumnRenamed("intensity", "v"), "_back", ["v"], BY, ordered.position_tile("_back"))
    return both.filter((F.col("v") > F.col("left")) & (F.col("v") > F.col("prev_v"))).select("sample", "scan", F.col("v").alias("intensity"))


def noise(df: DataFrame) -> DataFrame:
    """Median absolute step per sample."""
    steps = ordered.previous_row(df, "scan", ["intensity"], BY, ordered.position_tile("scan"))
    return ordered.exact_quantiles(steps.select("sample", F.abs(F.col("intensity") - F.col("prev_intensity")).alias("step")), "step", [0.5], BY).withColumnRenamed("q0", "noise")


def detect_peaks(df: DataFrame, min_snr: float = 3.0, min_height: float | None = None) -> DataFrame:
    """Local maxima with their signal-to-noise ratio, by height (``min_snr`` stands in when it is not given)."""
    floor = min_snr if min_height is None else min_height
    return (
        local_maxima(df).filter(F.col("intensity") >= floor).join(noise(df), "sample")
        .select("sample", "scan", "intensity", (F.col("intensity") / F.greatest("noise", F.lit(1e-10))).alias("snr"))
    )


def _halves(xs: np.ndarray, at: np.ndarray, level: np.ndarray, left: bool, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each place and level, the nearest place on one side with a value over the level (-1: none), and the lowest value passed."""
    found, low = np.full(len(at), -1), np.full(len(at), np.inf)
    for i in range(0, len(at), 1024):
        q = slice(i, i + 1024)
        place = np.arange(len(xs))
        side = place[None, :] < at[q, None] if left else place[None, :] > at[q, None]
        over = side & (xs[None, :] > level[q, None] if strict else xs[None, :] >= level[q, None])
        any_ = over.any(axis=1)
        hit = len(xs) - 1 - over[:, ::-1].argmax(axis=1) if left else over.argmax(axis=1)
        found[q] = np.where(any_, hit, -1)
        passed = side & (~any_[:, None] | (place[None, :] > hit[:, None] if left else place[None, :] < hit[:, None]))
        low[q] = np.where(passed, xs[None, :], np.inf).min(axis=1)
    return found, low


def _tile_jumps(high: np.ndarray, low: np.ndarray, tile: np.ndarray, level: np.ndarray, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """The nearest tile before ``tile`` whose highest value is over the level (-1: none), and the lowest value of tiles between.

    Blocks of two, four, eight.. tiles are skipped while their highest value is not over the level, the longest first.
    """
    highs, lows = [high], [low]
    while 2 ** len(highs) <= len(high):
        step = 2 ** (len(highs) - 1)
        highs.append(np.maximum(highs[-1][:-step], highs[-1][step:]))
        lows.append(np.minimum(lows[-1][:-step], lows[-1][step:]))
    at, passed = tile.copy(), np.full(len(tile), np.inf)
    for j in range(len(highs) - 1, -1, -1):
        start = at - 2**j
        inside = np.maximum(start, 0)
        inside = np.minimum(inside, len(highs[j]) - 1)
        over = highs[j][inside] > level if strict else highs[j][inside] >= level
        skip = (start >= 0) & ~over
        passed = np.where(skip, np.minimum(passed, lows[j][inside]), passed)
        at = np.where(skip, start, at)
    return at - 1, passed


def nearest_over(series: DataFrame, asked: DataFrame, left: bool, strict: bool = True) -> DataFrame:
    """For each ``sample, at, level`` of ``asked``: ``found``, the nearest place on one side whose ``x`` is over the level (null: none),
    and ``low``, the lowest ``x`` between (null: no places there).

    ``series`` has ``sample, at, x`` with ``at`` counted from 0. A place looks in its own tile; if nothing is over the level there,
    the highest and lowest values of tiles (one row for each) lead to the tile that has it, and only that one is looked into.
    """
    tile = lambda: F.floor(F.col("at") / TILE)
    kind = dict(series.dtypes)["sample"]
    tiled, asked = series.withColumn("tile", tile()), asked.select("sample", "at", "level").distinct().withColumn("tile", tile())
    answer = f"sample {kind}, at long, level double, tile long, found long, low double"

    def look(offset_of, key_of):
        def run(values: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
            values = values.sort_values("at")
            first = int(values["at"].iloc[0]) if len(values) else 0
            found, low = _halves(values["x"].to_numpy(float), offset_of(places, first, len(values)), places["level"].to_numpy(float), left, strict)
            held = np.minimum(low, places["low"].to_numpy(float)) if "low" in places else low
            return pd.DataFrame({"sample": places["sample"], "at": places["at"], "level": places["level"], "tile": places[key_of], "found": np.where(found < 0, -1, found + first), "low": held})

        return run

    key = ["sample", "tile"]
    here = cut_lineage(tiled.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(look(lambda q, first, n: q["at"].to_numpy() - first, "tile"), answer))
    figures = tiled.groupBy(*key).agg(F.max("x").alias("high"), F.min("x").alias("deep"))
    open_ = here.where("found < 0")

    def jump(tiles: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        tiles = tiles.sort_values("tile")
        high, deep, at = tiles["high"].to_numpy(float), tiles["deep"].to_numpy(float), np.searchsorted(tiles["tile"].to_numpy(), places["tile"].to_numpy())
        if left:
            target, passed = _tile_jumps(high, deep, at, places["level"].to_numpy(float), strict)
        else:
            back, passed = _tile_jumps(high[::-1].copy(), deep[::-1].copy(), len(high) - 1 - at, places["level"].to_numpy(float), strict)
            target = np.where(back < 0, -1, len(high) - 1 - back)
        to = np.where(target < 0, -1, tiles["tile"].to_numpy()[np.maximum(target, 0)]) if len(tiles) else target
        return places.assign(found=-1, low=np.minimum(places["low"].to_numpy(float), passed), to=to)

    led = cut_lineage(figures.groupBy("sample").cogroup(open_.groupBy("sample")).applyInPandas(jump, f"{answer}, to long"))
    edge = lambda q, first, n: np.full(len(q), n if left else -1)
    there = tiled.groupBy(*key).cogroup(led.where("to >= 0").select("sample", "at", "level", F.col("to").alias("tile"), "low").groupBy(*key)).applyInPandas(look(edge, "tile"), answer)
    every = here.where("found >= 0").unionByName(there).unionByName(led.where("to < 0").drop("to"))
    return every.select("sample", "at", "level", F.when(F.col("found") >= 0, F.col("found")).alias("found"), F.when(F.col("low") < float("inf"), F.col("low")).alias("low"))


def prominent_peaks(df: DataFrame, min_snr: float = 3.0, deviations: float = 1.5, prominence: float | None = None, width: float = 5.0) -> DataFrame:
    """Peaks by height, prominence and width at half prominence: ``sample, scan, intensity, prominence, width, snr``.

    A peak is higher than what is next to it on both sides; a plateau counts once, at its middle (the lower of two). Its prominence
    is the height over the higher of the lowest values on either side up to a higher value or the end, at least
    ``prominence`` (``deviations`` standard deviations of the sample unless given); its width is between the crossings of the
    line half a prominence below it, linear between scans, at least ``width`` scans. Rows are counted in ``scan`` order, which
    is unique in a sample; rows without an intensity are left out.
    """
    rows = df.where("intensity IS NOT NULL").select("sample", "scan", F.col("intensity").cast("double").alias("x"), F.lit(1).alias("one"))
    numbered = ordered.prefix_sums(rows, "scan", ["one"], BY, ordered.position_tile("scan"))
    series = cut_lineage(numbered.select("sample", F.col("one_before").cast("long").alias("at"), "scan", "x"))
    place = ordered.position_tile("at")
    back = ordered.previous_row(series, "at", ["x"], BY, place).withColumnRenamed("prev_x", "before")
    ahead = back.withColumn("_at", -F.col("at"))
    both = ordered.previous_row(ahead, "_at", ["x"], BY, ordered.position_tile("_at")).withColumnRenamed("prev_x", "after")
    rising = cut_lineage(both.where("x > before AND x >= after").select("sample", "at", "scan", "x", (F.col("after") == F.col("x")).alias("flat")))

    level = rising.withColumnRenamed("x", "level")
    side = lambda found, name: found.select("sample", "at", F.col("found").alias(f"{name}_at"), F.col("low").alias(f"{name}_low"))
    higher_left, higher_right = (side(nearest_over(series, level, left), name) for left, name in ((True, "l"), (False, "r")))
    down = series.withColumn("x", -F.col("x"))
    lower = side(nearest_over(down, level.where("flat").withColumn("level", -F.col("level")), False), "end")
    met = rising.join(higher_left, ["sample", "at"]).join(higher_right, ["sample", "at"]).join(lower, ["sample", "at"], "left")
    # a plateau is a peak if what ends it is lower, and does not end the trace
    whole = met.where(~F.col("flat") | (F.col("end_at") < F.coalesce("r_at", F.lit(2**62))))
    base = F.greatest("l_low", F.least(F.col("r_low"), F.col("x")))
    spread = series.groupBy("sample").agg((F.stddev_pop("x") * deviations).alias("least"))
    measured = whole.join(spread, "sample").withColumn("prominence", F.col("x") - base)
    least = F.col("least") if prominence is None else F.lit(float(prominence))
    tall = cut_lineage(measured.where((F.col("prominence") >= least) & (F.col("x") >= min_snr)).select("sample", "at", "x", "prominence", F.when(F.col("flat"), F.floor((F.col("at") + F.col("end_at") - 1) / 2)).otherwise(F.col("at")).alias("middle")))

    line = tall.withColumn("line", F.col("x") - F.col("prominence") / 2)
    crossed = line
    for left, name, step in ((True, "from", 1), (False, "to", -1)):
        cross = nearest_over(down, line.select("sample", F.col("middle").alias("at"), (-F.col("line")).alias("level")), left, strict=False)
        crossed = crossed.join(cross.select("sample", F.col("at").alias("middle"), F.col("found").alias(name)), ["sample", "middle"])
        for shift, value in ((0, "out"), (step, "in")):
            near = series.select("sample", (F.col("at") - shift).alias(name), F.col("x").alias(f"{name}_{value}"))
            crossed = crossed.join(near, ["sample", name])
    at = lambda name, sign: F.col(name) + sign * (F.col("line") - F.col(f"{name}_out")) / (F.col(f"{name}_in") - F.col(f"{name}_out"))
    wide = crossed.withColumn("width", at("to", -1) - at("from", 1)).where(F.col("width") >= width)
    named = wide.join(series.select("sample", F.col("at").alias("middle"), "scan"), ["sample", "middle"]).join(noise(df.where("intensity IS NOT NULL")), "sample")
    return named.select("sample", "scan", F.col("x").alias("intensity"), "prominence", "width", (F.col("x") / F.greatest("noise", F.lit(1e-10))).alias("snr"))


def prominences(maxima: DataFrame, minima: DataFrame) -> DataFrame:
    """Prominence of each maximum over the alternating extremes of its sample (``sample, scan, intensity`` each).

    Only extremes are handed to the per-sample walk; a sample's extremes must fit one task.
    """
    points = maxima.withColumn("top", F.lit(True)).unionByName(minima.withColumn("top", F.lit(False)))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("scan")
        y = pdf["intensity"].to_numpy(float)

        def bases(values: np.ndarray) -> np.ndarray:
            """Lowest value between each place and the nearest higher one before it."""
            stack: list[tuple[float, float]] = []
            out = np.empty(len(values))
            for i, v in enumerate(values):
                low = v
                while stack and stack[-1][0] <= v:
                    low = min(low, stack.pop()[1])
                out[i] = low
                stack.append((v, low))
            return out

        left, right = bases(y), bases(y[::-1])[::-1]
        out = pdf.assign(prominence=y - np.maximum(left, right))
        return out[out["top"]][["sample", "scan", "intensity", "prominence"]]

    kinds = dict(maxima.dtypes)
    schema = f"sample {kinds['sample']}, scan {kinds['scan']}, intensity double, prominence double"
    return points.groupBy("sample").applyInPandas(walk, schema)

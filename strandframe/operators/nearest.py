"""Nearest neighbours of vectors by pivot partitions.

Every row belongs to the cell of its nearest pivot, and neighbouring cells are packed into parts of bounded size. A row first
looks among the rows of its own part, which gives the distance beyond which no neighbour can be. By the triangle inequality that
rules out whole cells: those whose rows are all too far from their pivot's side, and those behind the plane between two pivots. It
goes to the parts that hold any other cell, and gives at most ``k`` rows in each. Inside a part a matrix product in single precision,
with a bound on its error, names the pairs whose distance is worth computing; so the result is exact. ``probes`` stops at that many
nearest cells instead.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut_lineage

# functions that run in Python workers travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: rows of a part and searching rows that meet it at a time, at most; a part holds at most so many numbers
BLOCK, ASKING, NUMBERS = 32768, 32768, 1 << 22
#: parts that a table of more than ``SMALL`` rows a part is cut into at least, so that small tables are many tasks too
PARTS, SMALL = 16, 2048
#: pivots at most, and rows per pivot that they are fitted on: the matrix of pivots is the only thing sent to every task
PIVOTS, PER_PIVOT = 2048, 40
#: numbers of a distance matrix in memory; rows of a part that are looked through at a time, and by how many rows
_MATRIX, _STEP, _ROWS = 1 << 21, 2048, 256


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, without the loss of digits that products bring; few rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, _MATRIX // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


def _pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows ``i`` of ``a`` and ``j`` of ``b``, by differences."""
    out = np.empty(len(i))
    step = max(1, _MATRIX // a.shape[1])
    for at in range(0, len(i), step):
        out[at : at + step] = np.sqrt(((a[i[at : at + step]] - b[j[at : at + step]]) ** 2).sum(axis=1))
    return out


def _close(a: np.ndarray, b: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that hold every row of ``b`` within ``limit``; for a row without limit, its ``k`` nearest and a few more.

    Squares come from a product in single precision around the middle of ``b``. Its error is at most ``d`` roundings of the product
    of both lengths, besides a few of the lengths themselves; twice that is allowed for.
    """
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    with np.errstate(over="ignore", invalid="ignore"):
        a32, b32 = a.astype(np.float32), b.astype(np.float32)
        aa, bb = (a**2).sum(axis=1), (b**2).sum(axis=1)
        error = (2 * (a.shape[1] + 16) * 2.0**-24 * (np.sqrt(aa) + np.sqrt(bb.max())) ** 2 + 1e-30).astype(np.float64)
        # the square less that of the row's own length
        s = b32 @ a32.T
        s *= np.float32(-2)
        s += bb.astype(np.float32)[:, None]
        bound = (limit**2) * (1 + 1e-12) - aa + error
        free = np.flatnonzero(np.isinf(limit))
        if len(free):
            some = s[:, free]
            bound[free] = np.inf if len(b) <= k else np.partition(some, k - 1, axis=0)[k - 1].astype(np.float64) + 2 * error[free]
        # rows of numbers beyond single precision have no bound and are compared exactly
        bound[~(np.isfinite(error) & (error < 1e30))] = np.inf
        top = np.nextafter(bound.astype(np.float32), np.float32(np.inf))
        j, i = np.divmod(np.flatnonzero(~(s > top)), len(a))
    return i, j


def _nearest(a_ids: np.ndarray, a: np.ndarray, b_ids: np.ndarray, b: np.ndarray, k: int, limit: np.ndarray | None = None, cells: np.ndarray | None = None, open_: np.ndarray | None = None, strict: bool = False) -> pd.DataFrame:
    """The ``k`` nearest of ``b`` within ``limit`` for each row of ``a``, itself left out; equal distances go by id.

    ``cells`` numbers the cells of ``b``, in order, and ``open_`` marks those that a row of ``a`` has to look in; others are left out if
    ``strict``, else only where that saves work.
    """
    none = pd.DataFrame({"src": a_ids[:0], "dst": b_ids[:0], "distance": np.zeros(0)})
    if not len(a) or not len(b):
        return none
    limit = np.full(len(a), np.inf) if limit is None else limit
    by_id = np.empty(len(b), np.int64)
    by_id[np.argsort(b_ids, kind="stable")] = np.arange(len(b))
    parts = [none]
    rows = _ROWS
    for at in range(0, len(a), rows):
        x, x_ids, within = a[at : at + rows], a_ids[at : at + rows], limit[at : at + rows].copy()
        q, n, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(b), _STEP):
            step = slice(start, start + _STEP)
            some = np.arange(len(x)) if open_ is None else np.flatnonzero(open_[at : at + rows, cells[start] : cells[step][-1] + 1].any(axis=1))
            if not len(some):
                continue
            # the row itself may be one of the nearest
            i, j = _close(x[some], b[step], within[some], k + 1)
            i, j = some[i], start + j
            if strict:
                i, j = (z[open_[at + i, cells[j]]] for z in (i, j))
            other = x_ids[i] != b_ids[j]
            i, j = i[other], j[other]
            off = _pair_distances(x, b, i, j)
            near = (off <= within[i]) & np.isfinite(off)
            q, n, d = np.concatenate([q, i[near]]), np.concatenate([n, j[near]]), np.concatenate([d, off[near]])
            order = np.lexsort((by_id[n], d, q))
            q, n, d = q[order], n[order], d[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, n, d, place = (z[place < k] for z in (q, n, d, place))
            last = place == k - 1
            within[q[last]] = d[last]
        parts.append(pd.DataFrame({"src": x_ids[q], "dst": b_ids[n], "distance": d}))
    return pd.concat(parts)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def nearest_neighbours(df: DataFrame, id: str, k: int = 15, features: str = "features", probes: int | None = None, pivots: int | None = None, seed: int = 42) -> DataFrame:
    """``src, dst, distance, rank``: the ``k`` nearest other rows of every row, or all there are; equal distances go by ``dst``.

    Exact by default. With ``probes`` a row looks in that many cells only, the nearest first, and may miss neighbours (99 % found
    with 8 of 45 cells on the given vectors); a row that finds fewer than ``k`` there is searched for exactly. ``features`` is a
    vector or an array column; rows where it is null are left out, and ``id`` is unique.

    Work: pivots (the square root of the number of rows, ``PIVOTS`` at most) are fitted on ``PER_PIVOT`` rows each, chosen by
    hash; all rows are searched. Pivots and cell figures are the only data in every task. A part meets ``ASKING`` rows at a time, so
    no cell, however many rows or visitors it has, is one task. Where pivots rule out nothing, all pairs are looked at, and a row
    is sent to each part once.
    """
    kind = df.schema[features].dataType.simpleString()
    values = vector_to_array(F.col(features)) if kind == "vector" else F.col(features).cast("array<double>")
    rows = cut_lineage(df.where(F.col(features).isNotNull()).select(F.col(id).alias("id"), values.alias("v")))
    n = rows.count()
    id_type = rows.schema["id"].dataType.simpleString()
    result = f"src {id_type}, dst {id_type}, distance double"
    if n < 2:
        return rows.sparkSession.createDataFrame([], f"{result}, rank int")
    count = min(PIVOTS, pivots or max(1, round(n**0.5)), n)
    sample = rows.orderBy(F.xxhash64("id")).limit(PER_PIVOT * count).select(array_to_vector("v").alias("features"))
    centres = np.array(KMeans(k=count, initMode="random", maxIter=5, seed=seed).fit(sample).clusterCenters()) if count > 1 else np.zeros((1, len(rows.first()["v"])))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = _distances(_matrix(batch["v"]), centres)
            cell = d.argmin(axis=1)
            yield batch.assign(cell=cell.astype(np.int32), off=d[np.arange(len(d)), cell])

    celled = cut_lineage(rows.mapInPandas(assign, f"id {id_type}, v array<double>, cell int, off double"))
    figures = {r["cell"]: r for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("off").alias("low"), F.max("off").alias("high")).collect()}
    dim = centres.shape[1]
    part_rows = max(1, min(BLOCK, NUMBERS // dim, max(SMALL, -(-n // PARTS))))
    asking = max(1, min(ASKING, NUMBERS // dim))
    sizes = np.array([figures[c]["n"] if c in figures else 0 for c in range(len(centres))])
    blocks = -(-sizes // part_rows)
    low, high = (np.array([figures[c][x] if c in figures else 0.0 for c in range(len(centres))]) for x in ("low", "high"))
    between = _distances(centres, centres)
    # blocks of cells, in the order of the cells along their widest direction, are packed into parts
    line = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0]
    first, parts_of, part, held = np.zeros(len(centres), np.int64), [], 0, 0
    for c in np.argsort(centres @ line, kind="stable"):
        first[c] = len(parts_of)
        for _ in range(blocks[c]):
            size = -(-sizes[c] // blocks[c])
            if held and held + size > part_rows:
                part, held = part + 1, 0
            parts_of.append(part)
            held += size
    part_count = part + 1
    visits = np.zeros((len(centres), part_count), bool)
    for c in range(len(centres)):
        visits[c, parts_of[first[c] : first[c] + blocks[c]]] = True
    unit = F.get(F.lit(first.tolist()), F.col("cell")) + F.pmod(F.xxhash64("id"), F.get(F.lit(blocks.tolist()), F.col("cell")))
    members = cut_lineage(celled.withColumn("part", F.get(F.lit(parts_of), unit.cast("int"))))

    def own(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cell", kind="stable")
        v, ids = _matrix(group["v"]), group["id"].to_numpy()
        return _nearest(ids, v, ids, v, k)

    inside = cut_lineage(members.repartition(part_count, "part").groupBy("part").applyInPandas(own, result))
    reach = inside.groupBy("src").agg(F.count(F.lit(1)).alias("found"), F.max("distance").alias("farthest"))
    bounded = members.join(reach, members["id"] == reach["src"], "left").select("id", "v", "cell", "part", F.when(F.col("found") >= k, F.col("farthest")).otherwise(F.lit(float("inf"))).alias("reach"))

    def open_cells(v: np.ndarray, at: np.ndarray, limit: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Which of the cells ``some`` a row of cell ``at`` has to look in."""
        look = np.arange(len(centres)) if probes is not None else some
        d = _distances(v, centres[look])
        mine = np.sqrt(((v - centres[at]) ** 2).sum(axis=1))
        slack = limit[:, None] * (1 + 1e-12) + 1e-12
        apart = between[at][:, look]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (d**2 - mine[:, None] ** 2) / (2 * apart), 0.0)
        open_ = (d - high[look] <= slack) & (low[look] - d <= slack) & (plane <= slack) & (blocks[look] > 0)
        if probes is not None:
            place = d.argsort(axis=1, kind="stable").argsort(axis=1)
            open_ = (open_ & ((place < probes) | np.isinf(limit)[:, None]))[:, some]
        return open_

    @F.pandas_udf("array<int>")
    def route(v: pd.Series, cell: pd.Series, part: pd.Series, reach: pd.Series) -> pd.Series:
        goes = open_cells(_matrix(v), cell.to_numpy(), reach.to_numpy(), np.arange(len(centres))).astype(np.float32) @ visits.astype(np.float32) > 0
        goes[np.arange(len(goes)), part.to_numpy()] = False
        return pd.Series([np.flatnonzero(row).astype(np.int32) for row in goes])

    routed = cut_lineage(bounded.withColumn("to", route("v", "cell", "part", "reach")))
    asked = {r["to"]: r["n"] for r in routed.select(F.explode("to").alias("to")).groupBy("to").agg(F.count(F.lit(1)).alias("n")).collect()}
    turns = F.get(F.lit([-(-asked.get(p, 0) // asking) for p in range(part_count)]), F.col("part"))
    questions = routed.select("id", "v", "cell", "reach", F.explode("to").alias("part")).withColumn("turn", F.pmod(F.xxhash64("id"), turns).cast("int"))
    answers = members.where(turns > 0).select("id", "v", "cell", "part", F.explode(F.sequence(F.lit(0), (turns - 1).cast("int"))).alias("turn"))

    def meet(questions: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("cell", kind="stable")
        v, to, limit = _matrix(questions["v"]), answers["cell"].to_numpy(), questions["reach"].to_numpy()
        cells, column = np.unique(to, return_inverse=True)
        open_ = np.empty((len(v), len(cells)), bool)
        rows = max(1, _MATRIX // max(1, len(centres)))
        for i in range(0, len(v), rows):
            open_[i : i + rows] = open_cells(v[i : i + rows], questions["cell"].to_numpy()[i : i + rows], limit[i : i + rows], cells)
        return _nearest(questions["id"].to_numpy(), v, answers["id"].to_numpy(), _matrix(answers["v"]), k, limit, column, open_, probes is not None)

    key, groups = ["part", "turn"], max(1, sum(-(-x // asking) for x in asked.values()))
    dealt, held_by = questions.repartition(groups, *key), answers.repartition(groups, *key)
    outside = dealt.groupBy(*key).cogroup(held_by.groupBy(*key)).applyInPandas(meet, result)
    best = W.partitionBy("src").orderBy("distance", "dst")
    return inside.unionByName(outside).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

"""Named sets, gene-set enrichment, ontologies and networks over long tables and edge tables."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats
from ..session import cut_lineage, stored
from . import ordered

# functions that run in Python workers travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: draws of a null distribution that one task makes
DRAWS = 1 << 24
#: nodes of highest degree that are told to every task; edges of a task's index; places of its table of marks; wedges tried at a time
HUBS, INDEXED, MARKED, TRIED = 1 << 17, 1 << 21, 1 << 25, 1 << 22
#: edges between which a task joins nodes at a time
JOINED = 1 << 20

# ---- named sets: set_name, element ---------------------------------------------------------------------------


def combinations(df: DataFrame) -> DataFrame:
    """Each distinct sorted array ``s`` of sets that hold some element together, and how many elements do so."""
    return df.groupBy("element").agg(F.sort_array(F.collect_set("set_name")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("elements"))


def memberships(df: DataFrame) -> DataFrame:
    """Exclusive intersections: each element's sorted list of sets joined by '&', and how many elements share it."""
    return combinations(df).select(F.array_join("s", "&").alias("combination"), "elements")


def set_pairs(df: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Shared elements, union and Jaccard index of each pair of sets (set1, set2), also of those that share nothing.

    Pairs are formed once per distinct combination of sets and weighted by its element count, never per element.
    ``pairs`` names the pairs wanted; without it there is a row for every two sets.
    """
    combos = combinations(df)
    sizes = combos.select(F.explode("s").alias("set_name"), "elements").groupBy("set_name").agg(F.sum("elements").alias("n"))
    shared = (
        combos.select("elements", "s", F.posexplode("s").alias("i", "set1"))
        .select("elements", "set1", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("set2"))
        .groupBy("set1", "set2")
        .agg(F.sum("elements").alias("shared"))
    )
    one, two = (sizes.select(F.col("set_name").alias(f"set{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    union = F.col("n1") + F.col("n2") - F.col("shared")
    if pairs is None:
        # the names of all sets in one row: the result has a row for every two of them
        names = sizes.agg(F.sort_array(F.collect_list("set_name")).alias("s"))
        pairs = names.select("s", F.posexplode("s").alias("i", "set1")).select("set1", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("set2"))
    counted = pairs.join(shared, ["set1", "set2"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return counted.join(one, "set1").join(two, "set2").select("set1", "set2", "shared", union.alias("union"), (F.col("shared") / union).alias("jaccard"))


def set_sizes(df: DataFrame) -> DataFrame:
    """Size of each set and the elements found in no other set."""
    per = combinations(df)
    return per.select(F.explode("s").alias("set_name"), "elements", (F.size("s") == 1).alias("_alone")).groupBy("set_name").agg(
        F.sum("elements").alias("size"), F.sum(F.when(F.col("_alone"), F.col("elements")).otherwise(0)).alias("unique")
    )


# ---- gene sets: term, gene ------------------------------------------------------------------------------------


def over_representation(
    annotations: DataFrame, study: DataFrame, background: DataFrame, min_size: int = 1, max_size: int | None = None, correction: str = "bh"
) -> DataFrame:
    """Right-tail hypergeometric test per term of a study set within a required background.

    ``annotations`` has term, gene; ``study`` and ``background`` have gene. The study is cut to the background.
    """
    genes = background.select("gene").distinct()
    chosen = study.select("gene").distinct().join(genes, "gene", "left_semi").withColumn("_in", F.lit(1))
    marked = annotations.select("term", "gene").distinct().join(genes, "gene", "left_semi").join(chosen, "gene", "left")
    total = genes.agg(F.count(F.lit(1))).scalar()
    drawn = chosen.agg(F.count(F.lit(1))).scalar()
    terms = marked.groupBy("term").agg(F.sum(F.coalesce("_in", F.lit(0))).alias("count"), F.count(F.lit(1)).alias("term_size"))
    sized = terms.filter(F.col("term_size") >= min_size)
    if max_size is not None:
        sized = sized.filter(F.col("term_size") <= max_size)
    tests = sized.withColumn("study_size", drawn).withColumn("background", total)
    expected = F.col("term_size") / F.col("background")
    tests = tests.withColumn("enrichment", F.col("count") / F.col("study_size") / expected).withColumn(
        "p_value", stats.hypergeometric_p("count", "term_size", "study_size", "background")
    )
    return ordered.benjamini_hochberg(tests) if correction == "bh" else ordered.bonferroni(tests)


def enrichment_score(annotations: DataFrame, ranking: DataFrame, min_size: int = 15, max_size: int = 500) -> DataFrame:
    """Weighted running-sum enrichment score per term over a ranking ``gene, rank, score`` with ranks 1..n.

    Between hits the running sum only falls, so its extremes lie at the hits: only hit rows are walked, and the
    fall before each hit follows from its rank. The work is linear in annotations, not in terms times genes.
    """
    n = ranking.agg(F.count(F.lit(1))).scalar()
    hits = annotations.select("term", "gene").distinct().join(ranking, "gene").withColumn("w", F.abs("score"))
    sizes = hits.groupBy("term").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("mass")).filter(F.col("k").between(min_size, max_size))
    # a term has at most max_size hits left here
    w = W.partitionBy("term").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    walk = hits.join(sizes, "term").withColumn("n", n).select(
        "term", "k", "rank", F.row_number().over(W.partitionBy("term").orderBy("rank")).alias("i"),
        (F.sum("w").over(w) / F.col("mass")).alias("up"), (F.col("w") / F.col("mass")).alias("step"), "n",
    )
    miss = F.col("n") - F.col("k")
    top = F.col("up") - (F.col("rank") - F.col("i")) / miss
    bottom = F.col("up") - F.col("step") - (F.col("rank") - F.col("i")) / miss
    peaks = walk.groupBy("term", "k").agg(F.max(top).alias("hi"), F.min(bottom).alias("lo"))
    return peaks.select("term", F.col("k").alias("size"), F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("es"))


def null_scores(ranking: DataFrame, sizes: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """``size, null``: for each ``size`` the enrichment scores of as many random sets of that size as there are permutations.

    A permutation is the order of ranks by the MD5 of ``seed:permutation:rank``, and its set of size k is the first k of them, so
    one draw serves all sizes, and the scores of a size all terms of that size. MD5s are even, so those of the largest set lie below
    a bound known beforehand: the tasks that draw them drop the rest, and only the sets themselves are shuffled. Ten standard
    deviations are left for chance; should a permutation still have too few below the bound, all are drawn again without one.
    """
    most, n = sizes.agg(F.max("size")).first()[0] or 0, ranking.count()
    wanted = sizes.agg(F.array_sort(F.collect_set(F.col("size").cast("long")))).first()[0]
    share = (most + 10 * most**0.5 + 100) / max(n, 1)
    # a ranking is few bytes, so it is dealt out by the draws that come of it
    dealt = ranking.repartition(max(ranking.sparkSession.sparkContext.defaultParallelism, n * permutations // DRAWS), "rank")

    def score(key: tuple, group: pa.Table) -> pa.Table:
        ranks, w, md5 = (group.column(c).combine_chunks() for c in ("rank", "w", "key"))
        high, low = np.frombuffer(b"".join(md5.to_pylist()), dtype=">u8").reshape(-1, 2).T
        place = np.empty(len(ranks), np.int64)
        place[np.lexsort((low, high))] = np.arange(len(ranks))
        by_rank = np.argsort(ranks.to_numpy(), kind="stable")
        place, ranks, w = place[by_rank], ranks.to_numpy()[by_rank], w.to_numpy(zero_copy_only=False)[by_rank]
        out = []
        for k in wanted:
            if k > len(ranks):
                out.append(None)
                continue
            mine = place < k
            step = w[mine]
            up = np.cumsum(step) / step.sum() if step.sum() else np.zeros(k)
            fall = (ranks[mine] - np.arange(1, k + 1)) / (n - k) if n > k else np.zeros(k)
            top, bottom = (up - fall).max(), (np.concatenate([[0.0], up[:-1]]) - fall).min()
            out.append(float(top if top >= -bottom else bottom))
        return pa.table({"size": pa.array(wanted, pa.int64()), "es": pa.array(out, pa.float64())})

    def scored(bound: str | None) -> DataFrame:
        drawn = dealt.select(F.col("rank").cast("long").alias("rank"), F.abs("score").cast("double").alias("w"), F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm"))
        keyed = drawn.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), "perm", "rank").cast("binary")))
        below = keyed if bound is None else keyed.where(F.col("key") < bound)
        return cut_lineage(below.withColumn("key", F.unhex("key")).groupBy("perm").applyInArrow(score, "size long, es double"))

    out = scored(f"{int(share * 16**12):012x}" if share < 1 else None)
    # all permutations have a row, and a size without a score only where the bound left too few
    whole, short = out.agg(F.count(F.lit(1)), F.count_if(F.col("es").isNull())).first()
    if share < 1 and (short or whole < permutations * len(wanted)):
        out = scored(None)
    return out.groupBy("size").agg(F.collect_list("es").alias("null"))


def preranked_gsea(annotations: DataFrame, ranking: DataFrame, permutations: int = 1000, seed: int = 42, min_size: int = 15, max_size: int = 500) -> DataFrame:
    """ES, normalised ES, permutation p and FDR per term.

    The p-value is the share of ``null_scores`` of the term's size and sign that are as far from zero; NES divides by their mean.
    Scores of a size are one list that its terms look through, so no row is made for a term and permutation.
    """
    ranking = cut_lineage(ranking.select("gene", "rank", "score"))
    observed = cut_lineage(enrichment_score(annotations, ranking, min_size, max_size))
    null = null_scores(ranking, observed.select("size").distinct(), permutations, seed)
    same = F.filter("null", lambda x: F.signum(x) == F.signum(F.col("es")))
    with_null = observed.join(null, "size").withColumn("_same", same)
    far = F.size(F.filter("_same", lambda x: F.abs(x) >= F.abs(F.col("es"))))
    mean = F.aggregate("_same", F.lit(0.0), lambda a, x: a + F.abs(x)) / F.nullif(F.size("_same"), F.lit(0))
    return ordered.benjamini_hochberg(
        with_null.select("term", "size", "es", (F.col("es") / mean).alias("nes"), (far / F.greatest(F.size("_same"), F.lit(1))).alias("p_value")), out="fdr"
    )


# ---- ontology: terms and edges child, parent -------------------------------------------------------------------


def search_terms(terms: DataFrame, text: str) -> DataFrame:
    q = text.lower()
    return terms.filter(F.lower("name").contains(q) | F.lower(F.col("term_id").cast("string")).contains(q))


def closure(edges: DataFrame, start: DataFrame, max_depth: int | None = None, from_col: str = "child", to_col: str = "parent") -> DataFrame:
    """Nodes reachable from each start node with the least number of steps, the start itself at depth 0.

    A breadth-first join: each round keeps only nodes not seen before, and its result is checkpointed so the plan
    stays small. Ancestors by default; swap the columns for descendants.
    """
    step = edges.select(F.col(from_col).alias("node"), F.col(to_col).alias("_next")).distinct()
    front = cut_lineage(start.select(F.col("node").alias("origin"), "node").distinct().withColumn("depth", F.lit(0)))
    seen = front
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = (
            front.join(step, "node").select("origin", F.col("_next").alias("node")).distinct()
            .join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth))
        )
        front = cut_lineage(new)
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front))
    return seen


# ---- networks: src, dst ----------------------------------------------------------------------------------------


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once with the smaller node first, without loops."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return _degrees(undirected(edges))


def _degrees(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def oriented(e: DataFrame, d: DataFrame) -> DataFrame:
    """Each edge of ``e`` as ``a, b``, from the end of lower degree to the other, ties by id; ``d`` has the degrees.

    Only the ``HUBS`` nodes of highest degree count as having one, so no edge is moved. A node has at most ``HUBS`` out-neighbours or
    as many as the highest degree of the others.
    """
    steps = d.groupBy("degree").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("degree", ascending=False)
    least = steps["degree"][steps["n"].cumsum() <= HUBS].min()
    hubs = d.where(F.col("degree") >= F.lit(int(least) if least == least else 1 << 62))
    for end in ("src", "dst"):
        e = e.join(F.broadcast(hubs.select(F.col("node").alias(end), F.col("degree").alias(f"_{end}"))), end, "left")
    low = F.struct(F.coalesce("_src", F.lit(0)).alias("d"), F.col("src").alias("n")) < F.struct(F.coalesce("_dst", F.lit(0)).alias("d"), F.col("dst").alias("n"))
    return e.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("b"))


class _Closing:
    """Edges b to c, looked up by what lies between the out-neighbours of a node; counts of triangles at b and c are kept."""

    def __init__(self, b: np.ndarray, c: np.ndarray):
        self.nodes = np.unique(np.concatenate([b, c]))
        self.places = None if self.nodes.dtype.kind == "i" else {x: i for i, x in enumerate(self.nodes.tolist())}
        start, target = self.place(b), self.place(c)
        self.target = target[np.argsort(start, kind="stable")]
        self.degree = np.bincount(start, minlength=len(self.nodes))
        self.begin = np.cumsum(self.degree) - self.degree
        self.found = np.zeros(len(self.nodes), dtype=np.int64)

    def place(self, x: np.ndarray) -> np.ndarray:
        """Places among the nodes, -1 for others."""
        if self.places is not None:
            return np.array([self.places.get(v, -1) for v in x.tolist()], dtype=np.int64)
        at = np.minimum(np.searchsorted(self.nodes, x), max(len(self.nodes) - 1, 0))
        return np.where(self.nodes[at] == x, at, -1) if len(self.nodes) else np.full(len(x), -1)

    def count(self, row: np.ndarray, n: np.ndarray, as_b: np.ndarray, as_c: np.ndarray) -> np.ndarray:
        """Triangles at each of the nodes a, 0 to ``row[-1]``, whose out-neighbours are ``n``; ``row`` goes up."""
        at = self.place(n)
        row_b, b = (x[as_b & (at >= 0)] for x in (row, at))
        row_c, c = (x[as_c & (at >= 0)] for x in (row, at))
        out, most = np.zeros(int(row[-1]) + 1, dtype=np.int64), max(1, MARKED // max(1, len(self.nodes)))
        for first in range(0, len(out), most):
            (i, j), (k, m) = (np.searchsorted(x, [first, first + most]) for x in (row_b, row_c))
            marks = np.zeros((min(most, len(out) - first), len(self.nodes)), dtype=bool)
            marks[row_c[k:m] - first, c[k:m]] = True
            ends = np.cumsum(self.degree[b[i:j]])
            while i < j:
                done = ends[-(j - i)] - self.degree[b[i]]
                stop = i + max(1, int(np.searchsorted(ends[len(ends) - (j - i) :], done + TRIED, side="right")))
                size = self.degree[b[i:stop]]
                own = np.repeat(np.arange(i, stop), size)
                tried = self.target[np.arange(len(own)) + np.repeat(self.begin[b[i:stop]] - np.cumsum(size) + size, size)]
                hit = marks[row_b[own] - first, tried]
                own, tried = own[hit], tried[hit]
                out += np.bincount(row_b[own], minlength=len(out))
                self.found += np.bincount(b[own], minlength=len(self.nodes)) + np.bincount(tried, minlength=len(self.nodes))
                i = stop
        return out


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles at each node.

    Every edge points from the end of lower degree to the other, so hubs do not expand all pairs of their neighbours. Of a triangle
    a, b, c the edge b to c starts at a node that edges lead to. If such edges are few, every task has them all; otherwise they are dealt over
    cells by both ends, and the out-neighbours of a go to the cells of one end each. Pairs of out-neighbours are tried where the list of
    a node is, and never become rows.
    """
    e = stored(undirected(edges))
    return _triangles(e, stored(_degrees(e)))


def _triangles(e: DataFrame, d: DataFrame) -> DataFrame:
    out = oriented(e, d)
    reached = stored(out.select(F.col("b").alias("a")).distinct())
    known = F.broadcast(reached) if reached.count() <= HUBS else reached
    inner = stored(out.join(known, "a", "left_semi"))
    n, kind, tasks = inner.count(), e.schema["src"].dataType.simpleString(), int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = int(np.ceil(np.sqrt(n / INDEXED))) or 1
    ends = None
    if side == 1:
        # the few nodes that close a triangle; lists need no others
        ends = inner.toArrow()
        ends = ends.column("a").to_numpy(), ends.column("b").to_numpy()
        nodes = inner.select(F.explode(F.array("a", "b")).alias("b")).distinct()
        lists = out.join(F.broadcast(nodes) if n <= HUBS else nodes, "b", "left_semi").select(F.lit(0).alias("cell"), F.lit(3).alias("role"), F.col("a").alias("x"), F.col("b").alias("y"))
        rows = lists.repartition("x").sortWithinPartitions("x")
    else:
        part = lambda x: F.pmod(F.xxhash64(x), F.lit(side)).cast("int")
        shares = -(-tasks // (side * side))
        share, every, other = F.pmod(F.xxhash64(F.lit(1), "a"), F.lit(shares)), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))), F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
        index = inner.withColumn("_s", every).select(((part("a") * side + part("b")) * shares + F.col("_s")).cast("int").alias("cell"), F.lit(0).alias("role"), F.col("a").alias("x"), F.col("b").alias("y"))
        dealt = out.withColumn("_o", other)
        as_b = dealt.select(((part("b") * side + F.col("_o")) * shares + share).cast("int").alias("cell"), F.lit(1).alias("role"), F.col("a").alias("x"), F.col("b").alias("y"))
        as_c = dealt.select(((F.col("_o") * side + part("b")) * shares + share).cast("int").alias("cell"), F.lit(2).alias("role"), F.col("a").alias("x"), F.col("b").alias("y"))
        rows = index.unionByName(as_b).unionByName(as_c).repartition("cell").withColumn("_k", F.when(F.col("role") > 0, 1).otherwise(0)).sortWithinPartitions("cell", "_k", "x").drop("_k")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(nodes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(nodes[n > 0], ids), pa.array(n[n > 0])], names=["node", "n"])

        def tried(role: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            row = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(x))))
            return counted(x[new], index.count(row, y, role & 1 > 0, role & 2 > 0))

        cell, index, edges_, held = None, None, [], None
        for batch in batches:
            ids = batch.schema.field("x").type
            cells, role, x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for i, j in itertools.pairwise([0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]):
                if i == j:
                    continue
                if cells[i] != cell:
                    if held is not None:
                        yield tried(*held)
                    if index is not None:
                        yield counted(index.nodes, index.found)
                    cell, index, edges_, held = cells[i], None if ends is None else _Closing(*ends), [], None
                known = i + int(np.count_nonzero(role[i:j] == 0))
                if known > i:
                    edges_.append((x[i:known], y[i:known]))
                if known == j:
                    continue
                if index is None:
                    nothing = x[:0]
                    index, edges_ = _Closing(*(np.concatenate([nothing, *(p[k] for p in edges_)]) for k in (0, 1))), []
                now = tuple(v[known:j] for v in (role, x, y))
                held = now if held is None else tuple(np.concatenate(v) for v in zip(held, now))
                # the list of the last node may go on in the next batch
                last = int(np.flatnonzero(held[1] != held[1][-1])[-1]) + 1 if held[1][0] != held[1][-1] else 0
                if last:
                    yield tried(*(v[:last] for v in held))
                    held = tuple(v[last:] for v in held)
        if held is not None:
            yield tried(*held)
        if index is not None:
            yield counted(index.nodes, index.found)

    found = rows.mapInArrow(find, f"node {kind}, n long")
    return found.groupBy("node").agg(F.sum("n").alias("triangles"))


def _forest(out: DataFrame) -> DataFrame:
    """Edges ``src, dst`` that join the same nodes as ``a, b`` of ``out``: of what a task reads, one for each node but the first of a part."""
    kind = out.schema["a"].dataType.simpleString()

    def joined(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        u, v = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        u, v = place[: len(u)], place[len(u) :]
        root = np.arange(len(nodes))
        while len(u):
            root[np.maximum(u, v)] = np.minimum(u, v)
            while not np.array_equal(root, up := root[root]):
                root = up
            u, v = root[u], root[v]
            u, v = u[u != v], v[u != v]
        other = np.flatnonzero(root != np.arange(len(nodes)))
        return nodes[other], nodes[root[other]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        whole = lambda pair: pa.RecordBatch.from_arrays([pa.array(x, ids) for x in pair], names=["src", "dst"])
        for batch in batches:
            ids = batch.schema.field("a").type
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            n += batch.num_rows
            if n >= 2 * JOINED:
                held = [joined(held)]
                n = len(held[0][0])
                if n > JOINED:
                    yield whole(held[0])
                    held, n = [], 0
        if held:
            yield whole(joined(held))

    return out.repartition("a").mapInArrow(rows, f"src {kind}, dst {kind}")


def components(edges: DataFrame) -> DataFrame:
    """Connected component of each node, named by its smallest node.

    Large-star / small-star rounds: labels contract in a logarithmic number of rounds, each checkpointed.
    """
    e = undirected(edges)
    pairs = cut_lineage(e.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        flat = large.filter("u <> v")
        directed = flat.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = directed.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            directed.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        new = cut_lineage(small)
        if new.exceptAll(pairs).isEmpty() and pairs.exceptAll(new).isEmpty():
            break
        pairs = new
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def network_summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density, mean degree, connectedness and mean clustering coefficient of an undirected graph."""
    e = stored(undirected(edges))
    d = stored(_degrees(e))
    possible = F.col("degree") * (F.col("degree") - 1) / 2
    local = d.join(_triangles(e, d), "node", "left").select(
        "degree", F.when(possible > 0, F.coalesce("triangles", F.lit(0)) / possible).otherwise(0.0).alias("c")
    )
    g = local.agg(F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.avg("c").alias("clustering"))
    parts = components(_forest(oriented(e, d))).agg(F.countDistinct("component")).scalar()
    n, m = F.col("nodes"), F.col("edges")
    return g.select("nodes", "edges", (2 * m / (n * (n - 1))).alias("density"), (2 * m / n).alias("mean_degree"), (parts == 1).alias("connected"), "clustering")


def overlay(nodes: DataFrame, expression: DataFrame, node: str = "node") -> DataFrame:
    """Expression joined onto nodes, clipped to 0..1 and 0 where missing."""
    return nodes.join(expression, node, "left").withColumn("expression", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("expression", F.lit(0.0)))))


def synteny(first: DataFrame, second: DataFrame) -> DataFrame:
    """Shared genes and the share of gene pairs in the same order in both tables ``gene, pos``.

    Two genes differ in exactly one highest bit of their second position. For each bit level the genes that agree
    above it form a part, and a gene with the bit set counts the genes before it on the first axis with the bit
    clear: running counts over n log n rows in place of n squared pairs.
    """
    both = first.select("gene", F.col("pos").alias("x")).join(second.select("gene", F.col("pos").cast("long").alias("y")), "gene").select("x", "y")
    bits = both.agg(F.floor(F.log2(F.max("y") + 1)).cast("int")).scalar()
    levels = both.withColumn("_b", bits).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_b")))).select(
        "x", "level", F.expr("shiftright(y, level + 1)").alias("above"), F.expr("1 - (shiftright(y, level) & 1)").alias("clear")
    )
    run = ordered.prefix_sums(levels, "x", ["clear"], ["level", "above"], ordered.position_tile("x"))
    collinear = run.filter("clear = 0").agg(F.coalesce(F.sum("clear_before"), F.lit(0))).scalar()
    total = F.col("genes") * (F.col("genes") - 1) / 2
    return both.agg(F.count(F.lit(1)).alias("genes")).withColumn("collinear", collinear.cast("long")).select(
        "genes", "collinear", F.when(total > 0, F.col("collinear") / total).otherwise(0.0).alias("score")
    )

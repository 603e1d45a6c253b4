"""Single-cell tables in long sparse form ``cell, gene, count``: absent cells are zero and never stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats
from . import ordered


def quality_filter(df: DataFrame, min_genes: int = 200, min_cells: int = 3, max_percent_mito: float = 5.0, mito_prefix: str = "MT-") -> DataFrame:
    """Cells with enough genes, then genes in enough cells, then cells with little mitochondrial count, in that order."""
    seen = df.filter("count > 0")
    cells = seen.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_genes).select("cell")
    kept = seen.join(cells, "cell", "left_semi")
    genes = kept.groupBy("gene").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_cells).select("gene")
    kept = kept.join(genes, "gene", "left_semi")
    mito = F.sum(F.when(F.col("gene").cast("string").startswith(mito_prefix), F.col("count")).otherwise(0))
    clean = kept.groupBy("cell").agg((mito / F.sum("count") * 100).alias("_p")).filter(F.col("_p") < max_percent_mito).select("cell")
    return kept.join(clean, "cell", "left_semi").select("cell", "gene", "count")


def log_normalized(df: DataFrame, target: float = 1e4) -> DataFrame:
    """ln(1 + count / cell total * target)."""
    totals = df.groupBy("cell").agg(F.sum("count").alias("_t"))
    return df.join(totals, "cell").select("cell", "gene", F.log1p(F.col("count") / F.col("_t") * target).alias("value"))


def gene_dispersion(values: DataFrame, bins: int = 20) -> DataFrame:
    """Mean, dispersion (log of variance over mean, of the back-transformed values) and its z-score within mean bins.

    Zeros enter through the number of cells: sums over stored values are divided by all cells.
    """
    n = values.agg(F.countDistinct("cell")).scalar()
    x = F.expm1("value")
    g = values.groupBy("gene").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q")).withColumn("n", n)
    mean = F.col("s") / F.col("n")
    var = (F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)
    d = g.select("gene", F.log1p(mean).alias("mean"), F.when((mean > 0) & (var > 0), F.log(var / mean)).alias("dispersion"))
    low, high = d.agg(F.min("mean")).scalar(), d.agg(F.max("mean")).scalar()
    placed = d.withColumn("_lo", low).withColumn("_w", (high - F.col("_lo")) / bins).withColumn(
        "bin", F.when(F.col("_w") > 0, F.greatest(F.lit(0), F.ceil(F.round((F.col("mean") - F.col("_lo")) / F.col("_w"), 9)) - 1)).otherwise(0).cast("int")
    )
    per = placed.groupBy("bin").agg(F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_s"))
    z = (F.col("dispersion") - F.when(F.col("_s").isNull(), 0.0).otherwise(F.col("_m"))) / F.when(F.col("_s").isNull(), F.col("_m")).otherwise(F.col("_s"))
    return placed.join(per, "bin").select("gene", "mean", "dispersion", "bin", z.alias("normalized"))


def highly_variable(values: DataFrame, n_top: int = 2000, bins: int = 20) -> DataFrame:
    return gene_dispersion(values, bins).orderBy(F.desc_nulls_last("normalized"), "gene").limit(n_top)


def scaled(values: DataFrame, limit: float = 10.0) -> DataFrame:
    """z-scores over all cells, clipped above; absent entries share the gene's score of zero, given as ``zero``."""
    n = values.agg(F.countDistinct("cell")).scalar()
    g = values.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).withColumn("n", n)
    mean = F.col("s") / F.col("n")
    sd = F.sqrt((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1))
    g = g.select("gene", mean.alias("_mean"), F.when(sd > 0, sd).otherwise(1.0).alias("_sd"))
    return values.join(g, "gene").select(
        "cell", "gene", F.least(F.lit(limit), (F.col("value") - F.col("_mean")) / F.col("_sd")).alias("scaled"), (-F.col("_mean") / F.col("_sd")).alias("zero")
    )


def cell_vectors(scaled_values: DataFrame, genes: list) -> DataFrame:
    """Dense ``features`` arrays over a bounded list of genes, for Spark ML."""
    wide = scaled_values.filter(F.col("gene").isin(genes)).groupBy("cell").pivot("gene", genes).agg(F.first("scaled"))
    zeros = {str(r["gene"]): r["zero"] for r in scaled_values.filter(F.col("gene").isin(genes)).groupBy("gene").agg(F.first("zero").alias("zero")).collect()}
    return wide.select("cell", F.array(*[F.coalesce(F.col(f"`{g}`"), F.lit(zeros.get(str(g), 0.0))) for g in genes]).alias("features"))


def marker_tests(values: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rank-sum test of every (gene, cluster) against all other cells.

    Ranks come from the gene's histogram of values with its zeros added as one row, and serve all clusters.
    """
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n1"))
    n = clusters.agg(F.count(F.lit(1))).scalar()
    per = values.join(clusters, "cell").groupBy("gene", "cluster", "value").agg(F.count(F.lit(1)).alias("k"))
    stored = per.groupBy("gene", "cluster").agg(F.sum("k").alias("_s"))
    # one array of cluster sizes as a scalar subquery gives every gene every cluster
    listed = sizes.agg(F.collect_list(F.struct("cluster", "n1"))).scalar()
    every = values.select("gene").distinct().withColumn("_c", listed).select("gene", F.inline("_c"))
    zeros = every.join(stored, ["gene", "cluster"], "left").select("gene", "cluster", F.lit(0.0).alias("value"), (F.col("n1") - F.coalesce("_s", F.lit(0))).alias("k"))
    full = per.unionByName(zeros.filter("k > 0")).groupBy("gene", "cluster", "value").agg(F.sum("k").alias("k"))
    hist = full.groupBy("gene", "value").agg(F.sum("k").alias("n"))
    ranks = ordered.prefix_sums(hist, "value", ["n"], ["gene"]).withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2)
    ties = hist.groupBy("gene").agg(F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    r = full.join(ranks.select("gene", "value", "rank"), ["gene", "value"]).groupBy("gene", "cluster").agg(
        F.sum(F.col("k") * F.col("rank")).alias("r"), (F.sum(F.col("k") * F.col("value"))).alias("_sum")
    )
    j = r.join(sizes, "cluster").join(ties, "gene").withColumn("n", n)
    n1, n2, total = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    u = F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    z = F.when(sd > 0, (u - n1 * n2 / 2) / sd).otherwise(0.0)
    return j.filter(n2 > 0).select("gene", "cluster", (F.col("_sum") / n1).alias("mean_value"), z.alias("z")).withColumn("p_value", stats.normal_p("z"))


def top_markers(tests: DataFrame, n: int = 10) -> DataFrame:
    w = W.partitionBy("cluster").orderBy(F.desc("z"), "gene")
    return tests.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def report(raw: DataFrame, kept: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cells and genes before and after filtering, and clusters."""
    def counts(df, tag):
        return df.agg(F.countDistinct("cell").alias(f"cells_{tag}"), F.countDistinct("gene").alias(f"genes_{tag}"))

    return counts(raw, "before").select(
        "*", kept.agg(F.countDistinct("cell")).scalar().alias("cells_after"), kept.agg(F.countDistinct("gene")).scalar().alias("genes_after"),
        clusters.agg(F.countDistinct("cluster")).scalar().alias("clusters"),
    )

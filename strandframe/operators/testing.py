"""Statistical tests over groups: one aggregate per feature, then column maths and a tail probability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import ordered


def anova(df: DataFrame, feature: str, group: str, value: str) -> DataFrame:
    """One-way ANOVA per feature; with fewer than two groups F is 0 and p is 1."""
    cells = df.groupBy(feature, group).agg(
        F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")
    )
    per = cells.groupBy(feature).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"),
    )
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    ratio = ((F.col("between") - F.col("s") * F.col("s") / F.col("n")) / d1) / ((F.col("q") - F.col("between")) / d2)
    out = per.select(feature, "k", d1.alias("d1"), d2.alias("d2"), F.when((F.col("k") > 1) & (d2 > 0), ratio).otherwise(0.0).alias("f_statistic"))
    p = F.when((F.col("k") > 1) & (F.col("d2") > 0), stats.f_p("f_statistic", F.greatest("d1", F.lit(1)), F.greatest("d2", F.lit(1)))).otherwise(1.0)
    return out.withColumn("p_value", p).select(feature, "f_statistic", "d1", "d2", "p_value")


def pooled_t(df: DataFrame, feature: str, group: str, first: str, second: str, value: str) -> DataFrame:
    """Student's t with pooled variance between two named groups per feature."""
    def of(g):
        return F.when(F.col(group) == g, F.col(value))

    m = df.groupBy(feature).agg(
        *[f(of(g)).alias(n + t) for t, g in (("1", first), ("2", second)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    ).filter("n1 > 1 AND n2 > 1")
    dof = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    t = (F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    return m.filter(pooled > 0).select(feature, t.alias("t"), dof.alias("dof")).withColumn("p_value", stats.student_p("t", "dof"))


def rank_sum(df: DataFrame, value: str, is_first: Column, part: Sequence[str] = (), tile: Column | None = None) -> DataFrame:
    """Mann-Whitney U with tie and continuity corrections per part.

    Ranks come from the histogram of values, so ties and hot values cost one row each.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*part, value).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_first).alias("k")
    )
    ranked = ordered.prefix_sums(counts, value, ["n"], part, tile)
    sums = ranked.groupBy(*part).agg(
        F.sum(F.col("k") * (F.col("n_before") + (F.col("n") + 1) / 2)).alias("r"),
        F.sum("k").alias("n1"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"),
    )
    n1, n = F.col("n1"), F.col("total")
    n2 = n - n1
    u = F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.when(sd > 0, F.greatest(F.lit(0.0), F.abs(u - n1 * n2 / 2) - 0.5) / sd).otherwise(0.0)
    return (
        sums.filter((n1 > 0) & (n2 > 0))
        .select(*part, n1.alias("n1"), n2.alias("n2"), u.alias("u"), z.alias("z"))
        .withColumn("p_value", stats.normal_p("z"))
    )


def linear_regression(df: DataFrame, x: str, y: str, part: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept, r squared and the p-value of the slope."""
    m = df.groupBy(*part).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n")
    )
    dof = F.col("n") - 2
    t = F.sqrt(F.col("r2") * dof / F.greatest(1 - F.col("r2"), F.lit(1e-300)))
    return m.filter(dof > 0).withColumn("p_value", stats.student_p(t, dof))


def pearson(df: DataFrame, x: str, y: str, part: Sequence[str] = ()) -> DataFrame:
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = both.groupBy(*part).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    return m.filter("n > 2").withColumn("p_value", stats.student_p(t, F.col("n") - 2))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of the average ranks of both columns over the whole table."""
    rx = ordered.average_ranks(df, x).select(x, F.col("avg_rank").alias("_rx"))
    ry = ordered.average_ranks(df, y).select(y, F.col("avg_rank").alias("_ry"))
    return pearson(df.select(x, y).join(rx, x).join(ry, y), "_rx", "_ry")


def roc_curve(df: DataFrame, score: str, is_positive: Column) -> DataFrame:
    """Points ``score, tpr, fpr`` of falling thresholds, one per distinct score."""
    counts = df.groupBy(score).agg(F.count_if(is_positive).alias("p"), F.count_if(~is_positive).alias("n"))
    run = ordered.prefix_sums(counts, score, ["p", "n"])
    return run.select(
        score,
        ((F.col("p_total") - F.col("p_before")) / F.col("p_total")).alias("tpr"),
        ((F.col("n_total") - F.col("n_before")) / F.col("n_total")).alias("fpr"),
    )


def auc(df: DataFrame, score: str, is_positive: Column) -> DataFrame:
    """Area under the ROC curve: the rank-sum U of positives over the number of pairs."""
    return rank_sum(df, score, is_positive).select((F.col("u") / (F.col("n1") * F.col("n2"))).alias("auc"))

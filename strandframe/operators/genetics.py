"""Association and population statistics over long genotype tables ``sample, site, gt[, pop]``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import ordered


def case_control(df: DataFrame) -> DataFrame:
    """2x2 chi-square with Yates' correction, case odds ratio, -log10 p; rows without cases or controls are dropped."""
    a, b, c, d = (F.col(x) for x in ("case_alt", "case_ref", "ctrl_alt", "ctrl_ref"))
    n = a + b + c + d
    rows, cols = (a + b, c + d), (a + c, b + d)
    stat = None
    for i, r in enumerate(((a, b), (c, d))):
        for j, o in enumerate(r):
            e = rows[i] * cols[j] / n
            gap = F.abs(o - e)
            term = F.when(e > 0, (gap - F.least(F.lit(0.5), gap)) ** 2 / e).otherwise(0.0)
            stat = term if stat is None else stat + term
    odds = (a * d) / F.when(b * c > 0, b * c)
    return (
        df.filter((a + b > 0) & (c + d > 0))
        .select(*df.columns, odds.alias("odds_ratio"), stat.alias("chi2"))
        .withColumn("p_value", stats.chi2_p("chi2"))
        .withColumn("neg_log10", -F.log10(F.col("p_value") + 1e-300))
    )


def hardy_weinberg(gt: DataFrame) -> DataFrame:
    """Chi-square against p2, 2pq, q2 per site."""
    g = gt.groupBy("site").agg(*[F.count_if(F.col("gt") == k).alias(f"n{k}") for k in range(3)])
    n = F.col("n0") + F.col("n1") + F.col("n2")
    p = (2 * F.col("n0") + F.col("n1")) / (2 * n)
    out = g.filter(n > 0).select("site", "n0", "n1", "n2", n.alias("n"), p.alias("p"), (1 - p).alias("q"))
    expected = (F.col("p") * F.col("p") * F.col("n"), 2 * F.col("p") * F.col("q") * F.col("n"), F.col("q") * F.col("q") * F.col("n"))
    chi2 = sum((F.col(f"n{k}") - F.greatest(e, F.lit(1e-10))) ** 2 / F.greatest(e, F.lit(1e-10)) for k, e in enumerate(expected))
    return (
        out.select("site", "p", "q", *[e.alias(f"expected{k}") for k, e in enumerate(expected)], chi2.alias("chi2"))
        .withColumn("p_value", stats.chi2_p("chi2"))
        .withColumn("in_hwe", F.col("p_value") > 0.05)
    )


def fst(gt: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Mean over shared sites of between-variance over total variance, per pair of populations.

    ``pairs`` (pop1, pop2) names the pairs wanted; without it there is a row for every two populations that share a site.
    Populations meet in a join per site, and pairs are combined over sites before they are shuffled.
    """
    freq = gt.groupBy("site", "pop").agg((F.avg("gt") / 2).alias("f"), F.count(F.lit(1)).alias("n"))
    one, two = (freq.select("site", F.struct("pop", "f", "n").alias(side)) for side in "xy")
    if pairs is None:
        met = one.join(two, "site").filter("x.pop < y.pop")
    else:
        met = one.join(pairs, F.col("x.pop") == F.col("pop1")).join(two.withColumnRenamed("site", "_site"), (F.col("site") == F.col("_site")) & (F.col("y.pop") == F.col("pop2")))
    pairs = met.select("x", "y")
    n = F.col("x.n") + F.col("y.n")
    mean = (F.col("x.f") * F.col("x.n") + F.col("y.f") * F.col("y.n")) / n
    between = ((F.col("x.f") - mean) ** 2 * F.col("x.n") + (F.col("y.f") - mean) ** 2 * F.col("y.n")) / n
    within = (2 * F.col("x.f") * (1 - F.col("x.f")) * F.col("x.n") + 2 * F.col("y.f") * (1 - F.col("y.f")) * F.col("y.n")) / n
    total = between + within / 2
    return (
        pairs.select(F.col("x.pop").alias("pop1"), F.col("y.pop").alias("pop2"), F.when(total > 0, between / total).otherwise(0.0).alias("f"))
        .groupBy("pop1", "pop2")
        .agg(F.avg("f").alias("fst"))
    )


def site_diversity(gt: DataFrame) -> DataFrame:
    """Per site: samples, distinct genotypes and 2 p q n / (n - 1)."""
    g = gt.groupBy("site").agg((F.avg("gt") / 2).alias("p"), F.count(F.lit(1)).alias("n"), F.min("gt").alias("lo"), F.max("gt").alias("hi"))
    return g.select("site", "n", (F.col("lo") < F.col("hi")).alias("segregating"), "p", F.when(F.col("n") > 1, 2 * F.col("p") * (1 - F.col("p")) * F.col("n") / (F.col("n") - 1)).otherwise(0.0).alias("pi"))


def nucleotide_diversity(gt: DataFrame) -> DataFrame:
    return site_diversity(gt).agg(F.avg("pi").alias("pi"), F.count(F.lit(1)).alias("sites"))


def tajimas_d(gt: DataFrame) -> DataFrame:
    """Tajima's D (1989) over 2n chromosomes of n samples."""
    d = site_diversity(gt)
    chromosomes = F.col("m")
    m = gt.agg((F.countDistinct("sample") * 2).alias("m")).scalar()
    pairwise = F.sum(2 * F.col("p") * (1 - F.col("p")) * 2 * F.col("n") / (2 * F.col("n") - 1))
    base = d.agg(F.count_if("segregating").alias("s"), pairwise.alias("k")).withColumn("m", m)
    # sums of 1/i and 1/i^2 up to m - 1: term by term to 64, from there by the Euler-Maclaurin formula
    first, last = 64, F.greatest(chromosomes - 1, F.lit(64)).cast("double")
    steps = F.transform(F.sequence(F.lit(1), F.least(chromosomes - 1, F.lit(first)).cast("int")), lambda i: i.cast("double"))

    def tail(f) -> Column:
        return f(last) - f(F.lit(float(first)))

    a1_tail = tail(lambda x: F.ln(x) + 0.5 / x - 1 / (12 * x * x) + 1 / (120 * x**4))
    a2_tail = tail(lambda x: -1 / x + 0.5 / (x * x) - 1 / (6 * x**3) + 1 / (30 * x**5))
    base = base.withColumn("a1", F.aggregate(steps, F.lit(0.0), lambda a, i: a + 1 / i) + a1_tail).withColumn(
        "a2", F.aggregate(steps, F.lit(0.0), lambda a, i: a + 1 / (i * i)) + a2_tail
    )
    a1, a2, s = F.col("a1"), F.col("a2"), F.col("s")
    n = chromosomes.cast("double")
    e1 = ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1
    e2 = (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2)
    var = e1 * s + e2 * s * (s - 1)
    return base.select(s.alias("segregating_sites"), F.col("k").alias("pairwise"), F.when(var > 0, (F.col("k") - s / a1) / F.sqrt(var)).otherwise(0.0).alias("tajimas_d"))


def linkage(gt: DataFrame, span: int = 20) -> DataFrame:
    """Squared correlation of genotypes for site pairs less than ``span`` apart; constant sites are dropped."""
    ahead = F.sequence(F.col("site") + 1, F.col("site") + span - 1)
    left = gt.select("sample", F.col("site").alias("site1"), F.col("gt").alias("a"), F.explode(ahead).alias("site2"))
    right = gt.select("sample", F.col("site").alias("site2"), F.col("gt").alias("b"))
    r = left.join(right, ["sample", "site2"]).groupBy("site1", "site2").agg(
        F.try_divide(F.covar_pop("a", "b"), F.sqrt(F.var_pop("a") * F.var_pop("b"))).alias("r"), F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1")
    )
    return r.filter("a0 < a1 AND b0 < b1").select("site1", "site2", (F.col("r") * F.col("r")).alias("r2"))


def population_report(gt: DataFrame) -> DataFrame:
    """One row: sites, share in equilibrium, mean FST, pi, Tajima's D and mean r2."""
    hwe = hardy_weinberg(gt).agg(F.count(F.lit(1)).alias("sites"), F.avg(F.col("in_hwe").cast("double")).alias("share_in_hwe"))
    return hwe.select(
        "sites", "share_in_hwe",
        fst(gt).agg(F.avg("fst")).scalar().alias("mean_fst"),
        nucleotide_diversity(gt).select("pi").scalar().alias("pi"),
        tajimas_d(gt).select("tajimas_d").scalar().alias("tajimas_d"),
        linkage(gt).agg(F.avg("r2")).scalar().alias("mean_r2"),
    )


def genotype_matrix(gt: DataFrame, sites: list) -> DataFrame:
    """Wide sample x site table for Spark ML; absent cells are 0."""
    return gt.groupBy("sample").pivot("site", sites).agg(F.first("gt")).fillna(0)


def significant_counts(df: DataFrame, p: str = "p_value", cuts=(0.05, 1e-5, 5e-8)) -> DataFrame:
    """Rows below each significance level, and all rows."""
    return df.agg(F.count(F.lit(1)).alias("tests"), *[F.count_if(F.col(p) < c).alias(f"below_{i}") for i, c in enumerate(cuts)])


def adjusted(df: DataFrame) -> DataFrame:
    return ordered.benjamini_hochberg(df)

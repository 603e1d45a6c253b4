"""Count matrices in long form: ``feature, sample, count`` with a design table ``sample, condition``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats
from ..functions.dna import effect_size_label
from . import ordered


def library_sizes(counts: DataFrame, sample: str = "sample", count: str = "count") -> DataFrame:
    return counts.groupBy(sample).agg(F.sum(count).alias("library_size"))


def cpm(counts: DataFrame, sample: str = "sample", count: str = "count") -> DataFrame:
    """Counts per million of the sample; an empty library counts as 1.

    Totals are a partial aggregate joined back, so a sample holding most rows is never gathered in one task.
    """
    totals = library_sizes(counts, sample, count)
    size = F.when(F.col("library_size") == 0, F.lit(1.0)).otherwise(F.col("library_size"))
    return counts.join(totals, sample).select(*counts.columns, (F.col(count) / size * 1e6).alias("cpm"))


def tpm(counts: DataFrame, lengths: DataFrame, feature: str = "feature", sample: str = "sample", count: str = "count") -> DataFrame:
    """Transcripts per million; ``lengths`` has ``feature, length`` in bases, a zero length counts as 1."""
    kb = F.when(F.col("length") == 0, F.lit(1.0)).otherwise(F.col("length")) / 1000
    rpk = counts.join(lengths, feature).withColumn("rpk", F.col(count) / kb)
    scale = rpk.groupBy(sample).agg((F.sum("rpk") / 1e6).alias("scale"))
    size = F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale"))
    return rpk.join(scale, sample).select(*counts.columns, (F.col("rpk") / size).alias("tpm"))


def size_factors(counts: DataFrame, feature: str = "feature", sample: str = "sample", count: str = "count", min_features: int = 5) -> DataFrame:
    """Median-of-ratios factors over features positive in all samples.

    With fewer than ``min_features`` such features the factor is the library size over the mean library size.
    """
    libraries = library_sizes(counts, sample, count)
    n_samples = libraries.agg(F.count(F.lit(1))).scalar()
    reference = (
        counts.groupBy(feature)
        .agg(F.avg(F.ln(count)).alias("log_mean"), F.min(count).alias("low"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("low") > 0) & (F.col("n") == n_samples))
        .select(feature, "log_mean")
    )
    ratios = counts.join(reference, feature).select(sample, (F.col(count) / F.exp("log_mean")).alias("ratio"))
    medians = ordered.exact_quantiles(ratios, "ratio", [0.5], [sample])
    usable = reference.agg(F.count(F.lit(1))).scalar()
    mean_size = libraries.agg(F.avg(F.when(F.col("library_size") == 0, 1.0).otherwise(F.col("library_size")))).scalar()
    by_size = F.when(F.col("library_size") == 0, F.lit(1.0)).otherwise(F.col("library_size")) / mean_size
    return libraries.join(medians, sample, "left").select(
        sample,
        F.when(usable >= min_features, F.greatest(F.col("q0"), F.lit(1e-8))).otherwise(by_size).alias("size_factor"),
    )


def normalize(counts: DataFrame, factors: DataFrame, sample: str = "sample", count: str = "count") -> DataFrame:
    return counts.join(factors, sample).select(*counts.columns, (F.col(count) / F.col("size_factor")).alias("normalized"))


def variance_stabilized(counts: DataFrame, factors: DataFrame, method: str = "vst", sample: str = "sample", count: str = "count") -> DataFrame:
    """``vst``: log2(sqrt(x) + sqrt(x + 1)); ``log``: log2(x + 0.5), of the normalised count."""
    if method not in ("vst", "log"):
        raise ValueError("method must be vst or log")
    x = F.col("normalized")
    value = F.log2(F.sqrt(x) + F.sqrt(x + 1)) if method == "vst" else F.log2(x + 0.5)
    return normalize(counts, factors, sample, count).select(*counts.columns, value.alias("stabilized"))


def in_group(condition: str, group: str, value: str = "count") -> Column:
    return F.when(F.col(condition) == group, F.col(value))


def fold_change(
    df: DataFrame,
    control: str,
    treated: str,
    method: str = "mean",
    pseudocount: float = 1.0,
    shrinkage: bool = False,
    feature: str = "feature",
    condition: str = "condition",
    count: str = "count",
) -> DataFrame:
    """log2 fold change, base mean and the |log2FC| > 1 flag per feature.

    ``df`` is the matrix joined with its design. Replicates per feature are few, so medians and trimmed means
    are taken over the feature's own values.
    """
    if method == "trimmed":
        w = W.partitionBy(feature, condition)
        cut = F.floor(F.count(F.lit(1)).over(w) * 0.1)
        place = F.row_number().over(w.orderBy(count))
        kept = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_kept", (place > cut) & (place <= F.col("_n") - cut))
        level = {g: F.avg(F.when((F.col(condition) == g) & F.col("_kept"), F.col(count))) for g in (control, treated)}
    else:
        kept = df
        agg = {"mean": F.avg, "median": F.median}[method]
        level = {g: agg(in_group(condition, g, count)) for g in (control, treated)}
    out = kept.groupBy(feature).agg(
        level[control].alias("_control"), level[treated].alias("_treated"), F.avg(count).alias("base_mean")
    )
    log2fc = F.log2((F.col("_treated") + pseudocount) / (F.col("_control") + pseudocount))
    if shrinkage:
        log2fc = log2fc * F.col("base_mean") / (F.col("base_mean") + 2)
    return out.select(feature, log2fc.alias("log2fc"), "base_mean").withColumn("significant", F.abs("log2fc") > 1)


def group_moments(df: DataFrame, control: str, treated: str, feature: str = "feature", condition: str = "condition", count: str = "count") -> DataFrame:
    """One aggregate per feature: n, mean and sample variance of both groups."""
    aggs = []
    for tag, g in (("1", control), ("2", treated)):
        v = in_group(condition, g, count)
        aggs += [F.count(v).alias(f"n{tag}"), F.avg(v).alias(f"mean{tag}"), F.var_samp(v).alias(f"var{tag}")]
    return df.groupBy(feature).agg(*aggs)


def effect_size(df: DataFrame, control: str, treated: str, feature: str = "feature", condition: str = "condition", count: str = "count") -> DataFrame:
    """Cohen's d with the small-sample correction (Hedges' g) and its label; needs two values in each group."""
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = ((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")) / (n1 + n2 - 2)
    d = (F.col("mean2") - F.col("mean1")) / F.sqrt(F.when(pooled > 0, pooled).otherwise(1.0))
    g = d * (1 - 3 / (4 * (n1 + n2) - 9))
    return (
        group_moments(df, control, treated, feature, condition, count)
        .filter((n1 > 1) & (n2 > 1))
        .select(feature, g.alias("effect_size"))
        .withColumn("interpretation", effect_size_label("effect_size"))
    )


def rank_in_feature(df: DataFrame, feature: str = "feature", count: str = "count") -> DataFrame:
    """Average rank of each replicate among its feature's values."""
    w = W.partitionBy(feature)
    peers = F.count(F.lit(1)).over(W.partitionBy(feature, count))
    return df.withColumn("avg_rank", F.rank().over(w.orderBy(count)) + (peers - 1) / 2)


def rank_biserial(df: DataFrame, control: str, treated: str, feature: str = "feature", condition: str = "condition", count: str = "count") -> DataFrame:
    """2 (R1 - n1 (n + 1) / 2) / (n1 n2) with its label."""
    a = F.abs("effect_size")
    n1, n2 = F.col("n1"), F.col("n2")
    return (
        rank_in_feature(df, feature, count)
        .groupBy(feature)
        .agg(
            F.sum(in_group(condition, control, "avg_rank")).alias("r1"),
            F.count_if(F.col(condition) == control).alias("n1"),
            F.count_if(F.col(condition) == treated).alias("n2"),
        )
        .filter((n1 > 0) & (n2 > 0))
        .select(feature, (2 * (F.col("r1") - n1 * (n1 + n2 + 1) / 2) / (n1 * n2)).alias("effect_size"))
        .withColumn(
            "interpretation",
            F.when(a < 0.1, "negligible").when(a < 0.3, "small").when(a < 0.5, "medium").otherwise("large"),
        )
    )


def welch(df: DataFrame, control: str, treated: str, feature: str = "feature", condition: str = "condition", count: str = "count") -> DataFrame:
    """Welch t, Satterthwaite degrees of freedom (at least 1) and p; without spread t is 0 and p is 1."""
    n1, n2 = F.greatest(F.col("n1"), F.lit(1)), F.greatest(F.col("n2"), F.lit(1))
    e1, e2 = F.coalesce("var1", F.lit(0.0)) / n1, F.coalesce("var2", F.lit(0.0)) / n2
    err = F.sqrt(e1 + e2)
    spread = e1 * e1 / F.greatest(n1 - 1, F.lit(1)) + e2 * e2 / F.greatest(n2 - 1, F.lit(1))
    out = (
        group_moments(df, control, treated, feature, condition, count)
        .filter((F.col("n1") > 0) & (F.col("n2") > 0))
        .select(
            feature,
            F.log2((F.col("mean2") + 1) / (F.col("mean1") + 1)).alias("log2fc"),
            F.when(err > 0, (F.col("mean1") - F.col("mean2")) / err).otherwise(0.0).alias("t"),
            F.greatest(F.lit(1.0), F.when(spread > 0, (e1 + e2) * (e1 + e2) / spread).otherwise(1.0)).alias("dof"),
            (err > 0).alias("_testable"),
        )
    )
    p = F.when(F.col("_testable"), stats.student_p("t", "dof")).otherwise(1.0)
    return out.withColumn("p_value", p).drop("_testable")


def differential_expression(df: DataFrame, control: str, treated: str, **names) -> DataFrame:
    """Welch tests with Benjamini-Hochberg adjusted p-values."""
    return ordered.benjamini_hochberg(welch(df, control, treated, **names))


def negative_binomial(df: DataFrame, control: str, treated: str, feature: str = "feature", condition: str = "condition", count: str = "count") -> DataFrame:
    """Wald test with a method-of-moments dispersion; Fisher's test of the median split where variance <= mean."""
    g1, g2 = in_group(condition, control, count), in_group(condition, treated, count)
    base = df.groupBy(feature).agg(
        F.avg(count).alias("m"),
        F.var_pop(count).alias("v"),
        F.median(count).alias("med"),
        F.count(g1).alias("n1"),
        F.count(g2).alias("n2"),
        (F.avg(g1) + 0.5).alias("m1"),
        (F.avg(g2) + 0.5).alias("m2"),
    )
    split = (
        df.join(base.select(feature, "med"), feature)
        .groupBy(feature)
        .agg(
            F.count_if((F.col(condition) == control) & (F.col(count) >= F.col("med"))).alias("up1"),
            F.count_if((F.col(condition) == treated) & (F.col(count) >= F.col("med"))).alias("up2"),
        )
    )
    size = F.greatest(F.lit(0.1), F.col("m") * F.col("m") / (F.col("v") - F.col("m")))
    se = F.sqrt(
        (F.col("m1") + F.col("m1") ** 2 / size) / (F.col("n1") * F.col("m1") ** 2)
        + (F.col("m2") + F.col("m2") ** 2 / size) / (F.col("n2") * F.col("m2") ** 2)
    )
    wald = F.when(F.col("v") > F.col("m"), F.log2(F.col("m2") / F.col("m1")) / se)
    # Arrow functions run on every row, so rows that take the Wald test pass NULL cells and cost nothing
    cells = [
        F.when(F.col("v") <= F.col("m"), F.greatest(F.lit(1), c))
        for c in (F.col("up1"), F.col("n1") - F.col("up1"), F.col("up2"), F.col("n2") - F.col("up2"))
    ]
    return (
        base.filter((F.col("n1") > 0) & (F.col("n2") > 0))
        .join(split, feature)
        .select(
            feature,
            F.log2(F.col("m2") / F.col("m1")).alias("log2fc"),
            wald.alias("wald"),
            F.when(F.col("m") == 0, F.lit(1.0))
            .when(F.col("v") > F.col("m"), stats.normal_p(F.coalesce(wald, F.lit(0.0))))
            .otherwise(stats.fisher_exact_p(*cells))
            .alias("p_value"),
        )
    )


def volcano(df: DataFrame, log2fc: str = "log2fc", p: str = "p_value", fc_cut: float = 1.0, p_cut: float = 0.05) -> DataFrame:
    """Class up / down / ns and -log10 of p with the 1e-300 floor."""
    hit = F.col(p) < p_cut
    return df.withColumn("neg_log10", -F.log10(F.col(p) + 1e-300)).withColumn(
        "volcano_class",
        F.when(hit & (F.col(log2fc) > fc_cut), "up").when(hit & (F.col(log2fc) < -fc_cut), "down").otherwise("ns"),
    )


def ma_values(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean (A) and difference (M) of log2(x + 1) of two expression columns."""
    la, lb = F.log2(F.col(a) + 1), F.log2(F.col(b) + 1)
    return df.withColumn("a_value", (la + lb) / 2).withColumn("m_value", lb - la)


def min_max_scaled(df: DataFrame, value: str, part: str) -> DataFrame:
    """(x - min) / (max - min) within each ``part``; a constant part gives 0."""
    span = df.groupBy(part).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    width = F.col("_max") - F.col("_min")
    return df.join(span, part).select(
        *df.columns, F.when(width == 0, F.lit(0.0)).otherwise((F.col(value) - F.col("_min")) / width).alias("scaled")
    )


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, inter-quartile range and the number of values beyond 1.5 ranges, per group."""
    q = ordered.exact_quantiles(df, value, [0.25, 0.5, 0.75], [group])
    iqr = F.col("q2") - F.col("q0")
    outside = (F.col(value) < F.col("q0") - 1.5 * iqr) | (F.col(value) > F.col("q2") + 1.5 * iqr)
    return (
        df.join(q, group)
        .groupBy(group)
        .agg(
            F.count(value).alias("n"),
            F.first("q0").alias("lower_quartile"),
            F.first("q1").alias("median"),
            F.first("q2").alias("upper_quartile"),
            F.count_if(outside).alias("outliers"),
        )
    )


def dot_matrix(df: DataFrame, feature: str, cluster: str, value: str) -> DataFrame:
    """Share of positive values and mean value per feature and cluster."""
    return df.groupBy(feature, cluster).agg(
        (F.count_if(F.col(value) > 0) / F.count(F.lit(1)) * 100).alias("percent"), F.avg(value).alias("mean_value")
    )


def correlation_pairs(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of every pair of named columns in one aggregate; the number of columns is fixed by the caller."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = wide.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*items)))


def top_variance(df: DataFrame, feature: str, value: str, n: int) -> DataFrame:
    """The ``n`` features of largest population variance."""
    return df.groupBy(feature).agg(F.var_pop(value).alias("variance")).orderBy(F.desc("variance"), feature).limit(n)

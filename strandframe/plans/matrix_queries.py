"""Registered queries over count matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import matrix, ordered
from . import sql_stats as S
from .catalog import query


def rounded(df, *keep, digits: int = 6, **values):
    return df.select(*keep, *[F.round(c, digits).alias(n) for n, c in values.items()])


def designed(t):
    return t.counts.withColumn("condition", F.substring("sample", 2, 1))


def lengths(t):
    return t.part.select(F.col("p_partkey").alias("feature"), (F.col("p_size") * 100).alias("length"))


@query("cpm", """
SELECT feature, sample, round("count" / sum("count") OVER (PARTITION BY sample) * 1e6, 6) AS cpm FROM counts
""", uses="counts")
def _cpm(t):
    return rounded(matrix.cpm(t.counts), "feature", "sample", cpm="cpm")


@query("tpm", """
, rpk AS (SELECT feature, sample, "count" / (greatest(p_size * 100, 1) / 1000.0) AS rpk FROM counts JOIN part ON p_partkey = feature)
SELECT feature, sample, round(rpk / (sum(rpk) OVER (PARTITION BY sample) / 1e6), 5) AS tpm FROM rpk
""", uses="counts")
def _tpm(t):
    return rounded(matrix.tpm(t.counts, lengths(t)), "feature", "sample", digits=5, tpm="tpm")


_FACTORS = """
, pos AS (SELECT feature, avg(ln("count")) AS lm FROM counts GROUP BY feature HAVING min("count") > 0 AND count(*) = (SELECT count(DISTINCT sample) FROM counts)),
factors AS (SELECT sample, greatest(median("count" / exp(lm)), 1e-8) AS f FROM counts JOIN pos USING (feature) GROUP BY sample)
"""


@query("size_factors", _FACTORS + "SELECT sample, round(f, 6) AS size_factor FROM factors", uses="counts")
def _factors(t):
    return rounded(matrix.size_factors(t.counts), "sample", size_factor="size_factor")


@query("median_of_ratios_normalized", _FACTORS + """
SELECT feature, sample, round("count" / f, 5) AS normalized FROM counts JOIN factors USING (sample)""", uses="counts")
def _normalized(t):
    return rounded(matrix.normalize(t.counts, matrix.size_factors(t.counts)), "feature", "sample", digits=5, normalized="normalized")


@query("variance_stabilized", _FACTORS + """
SELECT feature, sample, round(log2(sqrt("count" / f) + sqrt("count" / f + 1)), 6) AS stabilized FROM counts JOIN factors USING (sample)
""", uses="counts")
def _vst(t):
    return rounded(matrix.variance_stabilized(t.counts, matrix.size_factors(t.counts)), "feature", "sample", stabilized="stabilized")


@query("log_stabilized", _FACTORS + """
SELECT feature, sample, round(log2("count" / f + 0.5), 6) AS stabilized FROM counts JOIN factors USING (sample)
""", uses="counts")
def _vst_log(t):
    return rounded(matrix.variance_stabilized(t.counts, matrix.size_factors(t.counts), "log"), "feature", "sample", stabilized="stabilized")


_GROUPS = """
, d AS (SELECT feature, sample, "count" AS x, substr(sample, 2, 1) AS c FROM counts)
"""


def _fc_sql(level1, level2, factor="1"):
    return _GROUPS + f"""
, g AS (SELECT feature, {level1} AS a, {level2} AS b, avg(x) AS bm FROM d GROUP BY feature)
SELECT feature, round(log2((b + 1) / (a + 1)) * {factor}, 6) AS log2fc, round(bm, 6) AS base_mean,
abs(log2((b + 1) / (a + 1)) * {factor}) > 1 AS significant FROM g
"""


def _fc(t, **kw):
    return rounded(matrix.fold_change(designed(t), "F", "O", **kw), "feature", "significant", log2fc="log2fc", base_mean="base_mean")


@query("fold_change_mean", _fc_sql("avg(x) FILTER (c = 'F')", "avg(x) FILTER (c = 'O')"), uses="counts")
def _fc_mean(t):
    return _fc(t)


@query("fold_change_shrunk", _fc_sql("avg(x) FILTER (c = 'F')", "avg(x) FILTER (c = 'O')", "bm / (bm + 2)"), uses="counts")
def _fc_shrunk(t):
    return _fc(t, shrinkage=True)


@query("fold_change_median", _fc_sql("median(x) FILTER (c = 'F')", "median(x) FILTER (c = 'O')"), uses="counts")
def _fc_median(t):
    return _fc(t, method="median")


@query("fold_change_trimmed", _GROUPS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY feature, c ORDER BY x) AS rn, count(*) OVER (PARTITION BY feature, c) AS n FROM d),
g AS (SELECT feature, avg(x) FILTER (c = 'F' AND rn > floor(n * .1) AND rn <= n - floor(n * .1)) AS a,
avg(x) FILTER (c = 'O' AND rn > floor(n * .1) AND rn <= n - floor(n * .1)) AS b, avg(x) AS bm FROM r GROUP BY feature)
SELECT feature, round(log2((b + 1) / (a + 1)), 6) AS log2fc, round(bm, 6) AS base_mean, abs(log2((b + 1) / (a + 1))) > 1 AS significant FROM g
""", uses="counts")
def _fc_trimmed(t):
    return _fc(t, method="trimmed")


_MOMENTS = _GROUPS + """
, g AS (SELECT feature, count(*) FILTER (c = 'F') AS n1, count(*) FILTER (c = 'O') AS n2, avg(x) FILTER (c = 'F') AS m1,
avg(x) FILTER (c = 'O') AS m2, var_samp(x) FILTER (c = 'F') AS v1, var_samp(x) FILTER (c = 'O') AS v2 FROM d GROUP BY feature)
"""


@query("effect_size_hedges", _MOMENTS + """
, e AS (SELECT feature, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS pv, m2 - m1 AS dm, n1 + n2 AS n FROM g WHERE n1 > 1 AND n2 > 1),
h AS (SELECT feature, dm / sqrt(CASE WHEN pv > 0 THEN pv ELSE 1 END) * (1 - 3.0 / (4 * n - 9)) AS g FROM e)
SELECT feature, round(g, 6) AS effect_size, CASE WHEN abs(g) < .2 THEN 'negligible' WHEN abs(g) < .5 THEN 'small'
WHEN abs(g) < .8 THEN 'medium' ELSE 'large' END AS interpretation FROM h
""", uses="counts")
def _hedges(t):
    return rounded(matrix.effect_size(designed(t), "F", "O"), "feature", "interpretation", effect_size="effect_size")


@query("effect_size_rank_biserial", _GROUPS + """
, r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk FROM d),
g AS (SELECT feature, sum(rk) FILTER (c = 'F') AS r1, count(*) FILTER (c = 'F') AS n1, count(*) FILTER (c = 'O') AS n2 FROM r GROUP BY feature),
e AS (SELECT feature, 2 * (r1 - n1 * (n1 + n2 + 1) / 2.0) / (n1 * n2) AS s FROM g WHERE n1 > 0 AND n2 > 0)
SELECT feature, round(s, 6) AS effect_size, CASE WHEN abs(s) < .1 THEN 'negligible' WHEN abs(s) < .3 THEN 'small'
WHEN abs(s) < .5 THEN 'medium' ELSE 'large' END AS interpretation FROM e
""", uses="counts")
def _biserial(t):
    return rounded(matrix.rank_biserial(designed(t), "F", "O"), "feature", "interpretation", effect_size="effect_size")


@query("average_rank_in_feature", _GROUPS + """
SELECT feature, sample, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS avg_rank FROM d
""", uses="counts")
def _ranks(t):
    return matrix.rank_in_feature(t.counts).select("feature", "sample", "avg_rank")


_WELCH = _MOMENTS + """
, w AS (SELECT feature, log2((m2 + 1) / (m1 + 1)) AS fc, m1 - m2 AS dm, coalesce(v1, 0) / n1 AS e1, coalesce(v2, 0) / n2 AS e2, n1, n2
FROM g WHERE n1 > 0 AND n2 > 0),
s AS (SELECT feature, fc, CASE WHEN e1 + e2 > 0 THEN dm / sqrt(e1 + e2) ELSE 0 END AS t, e1 + e2 > 0 AS ok,
greatest(1.0, coalesce((e1 + e2) * (e1 + e2) / nullif(e1 * e1 / greatest(n1 - 1, 1) + e2 * e2 / greatest(n2 - 1, 1), 0), 1.0)) AS df FROM w),
p AS (SELECT feature, fc, t, df, CASE WHEN ok THEN """ + S.student_p("t", "df") + """ ELSE 1.0 END AS p FROM s)
"""


@query("welch_test", _WELCH + """
SELECT feature, round(fc, 6) AS log2fc, round(t, 6) AS t, round(df, 6) AS dof, round(p, 6) AS p_value FROM p
""", uses="counts")
def _welch(t):
    return rounded(matrix.welch(designed(t), "F", "O"), "feature", log2fc="log2fc", t="t", dof="dof", p_value="p_value")


# Adjusting p rounded to 9 places keeps equal p-values equal in both engines.
@query("differential_expression", _WELCH + """
, q AS (SELECT feature, fc, round(p, 9) AS p FROM p),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, feature) AS raw FROM q)
SELECT feature, round(fc, 6) AS log2fc, round(p, 6) AS p_value,
round(least(1.0, min(raw) OVER (ORDER BY p, feature ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adjusted FROM r
""", uses="counts")
def _de(t):
    tests = matrix.welch(designed(t), "F", "O").withColumn("p_value", F.round("p_value", 9))
    return rounded(ordered.benjamini_hochberg(tests), "feature", log2fc="log2fc", p_value="p_value", p_adjusted="p_adjusted")


@query("volcano_classes", _WELCH + """
SELECT CASE WHEN p < .2 AND fc > .2 THEN 'up' WHEN p < .2 AND fc < -.2 THEN 'down' ELSE 'ns' END AS volcano_class, count(*) AS n,
round(max(-log10(p + 1e-300)), 5) AS top FROM p GROUP BY 1
""", uses="counts")
def _volcano(t):
    out = matrix.volcano(matrix.welch(designed(t), "F", "O"), fc_cut=0.2, p_cut=0.2)
    return out.groupBy("volcano_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("neg_log10"), 5).alias("top"))


_NB = _GROUPS + """
, b AS (SELECT feature, avg(x) AS m, var_pop(x) AS v, median(x) AS med, count(*) FILTER (c = 'F') AS n1, count(*) FILTER (c = 'O') AS n2,
avg(x) FILTER (c = 'F') + .5 AS m1, avg(x) FILTER (c = 'O') + .5 AS m2 FROM d GROUP BY feature HAVING n1 > 0 AND n2 > 0),
z AS (SELECT feature, m, v, log2(m2 / m1) AS fc, CASE WHEN v > m THEN greatest(.1, m * m / (v - m)) END AS size, m1, m2, n1, n2 FROM b),
w AS (SELECT feature, fc, CASE WHEN v > m THEN fc / sqrt((m1 + m1 * m1 / size) / (n1 * m1 * m1) + (m2 + m2 * m2 / size) / (n2 * m2 * m2)) END AS wald FROM z)
"""


@query("negative_binomial_wald", _NB + "SELECT feature, round(fc, 6) AS log2fc, round(wald, 6) AS wald, round("
       + S.normal_p("wald") + ", 6) AS p_value FROM w WHERE wald IS NOT NULL", uses="counts")
def _nb(t):
    out = matrix.negative_binomial(designed(t), "F", "O").filter("wald IS NOT NULL")
    return rounded(out, "feature", log2fc="log2fc", wald="wald", p_value="p_value")


@query("median_split_fisher", _GROUPS + """
, b AS (SELECT feature, avg(x) AS m, var_pop(x) AS v, median(x) AS med, count(*) FILTER (c = 'F') AS n1, count(*) FILTER (c = 'O') AS n2
FROM d GROUP BY feature HAVING n1 > 0 AND n2 > 0 AND v <= m),
u AS (SELECT feature, n1, n2, count(*) FILTER (c = 'F' AND x >= med) AS u1, count(*) FILTER (c = 'O' AND x >= med) AS u2
FROM d JOIN b USING (feature) GROUP BY ALL),
f AS (SELECT feature, greatest(u1, 1) AS w, greatest(n1 - u1, 1) AS x, greatest(u2, 1) AS y, greatest(n2 - u2, 1) AS z FROM u),
l AS (SELECT feature, w, w + y AS h, w + x AS dr, w + x + y + z AS n, lambda_k FROM (SELECT *, unnest(range(0, 20)) AS lambda_k FROM f)),
pr AS (SELECT feature, w, lambda_k AS k, exp(lgamma(h+1)-lgamma(lambda_k+1)-lgamma(h-lambda_k+1)+lgamma(n-h+1)-lgamma(dr-lambda_k+1)
-lgamma(n-h-dr+lambda_k+1)-lgamma(n+1)+lgamma(dr+1)+lgamma(n-dr+1)) AS p FROM l WHERE lambda_k <= least(h, dr) AND lambda_k >= greatest(0, h + dr - n))
SELECT feature, round(least(1.0, sum(p.p) FILTER (p.p <= o.p * (1 + 1e-7))), 6) AS p_value
FROM pr p JOIN (SELECT feature, p FROM pr WHERE k = w) o USING (feature) GROUP BY feature
""", uses="counts")
def _fisher(t):
    out = matrix.negative_binomial(designed(t), "F", "O").filter("wald IS NULL")
    return rounded(out, "feature", p_value="p_value")


@query("ma_values", """
, w AS (SELECT feature, avg("count") FILTER (sample LIKE '_F') AS a, avg("count") FILTER (sample LIKE '_O') AS b FROM counts GROUP BY feature)
SELECT feature, round((log2(a + 1) + log2(b + 1)) / 2, 6) AS a_value, round(log2(b + 1) - log2(a + 1), 6) AS m_value FROM w
""", uses="counts")
def _ma(t):
    m = matrix.group_moments(designed(t), "F", "O")
    return rounded(matrix.ma_values(m, "mean1", "mean2"), "feature", a_value="a_value", m_value="m_value")


@query("min_max_scaled", """
SELECT feature, sample, round(("count" - min("count") OVER w) / (max("count") OVER w - min("count") OVER w), 6) AS scaled
FROM counts WINDOW w AS (PARTITION BY sample)
""", uses="counts")
def _scaled(t):
    return rounded(matrix.min_max_scaled(t.counts, "count", "sample"), "feature", "sample", scaled="scaled")


@query("box_stats", """
WITH q AS (SELECT l_returnflag AS grp, quantile_cont(l_extendedprice, .25) AS a, median(l_extendedprice) AS b, quantile_cont(l_extendedprice, .75) AS c
FROM lineitem GROUP BY 1)
SELECT grp, count(*) AS n, round(a, 4) AS lower_quartile, round(b, 4) AS median, round(c, 4) AS upper_quartile,
count(*) FILTER (l_extendedprice < a - 1.5 * (c - a) OR l_extendedprice > c + 1.5 * (c - a)) AS outliers
FROM lineitem JOIN q ON grp = l_returnflag GROUP BY grp, a, b, c
""")
def _box(t):
    out = matrix.box_stats(t.lineitem.select(F.col("l_returnflag").alias("grp"), "l_extendedprice"), "grp", "l_extendedprice")
    return rounded(out, "grp", "n", "outliers", digits=4, lower_quartile="lower_quartile", median="median", upper_quartile="upper_quartile")


@query("dot_matrix", """
SELECT l_partkey AS feature, l_returnflag AS cluster, round(count(*) FILTER (l_discount > 0) * 100.0 / count(*), 6) AS percent,
round(avg(l_discount), 6) AS mean_value FROM lineitem GROUP BY 1, 2
""")
def _dots(t):
    df = t.lineitem.select(F.col("l_partkey").alias("feature"), F.col("l_returnflag").alias("cluster"), "l_discount")
    return rounded(matrix.dot_matrix(df, "feature", "cluster", "l_discount"), "feature", "cluster", percent="percent", mean_value="mean_value")


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i:]))
def _corr(t):
    return rounded(matrix.correlation_pairs(t.lineitem, list(_CORR)), "a", "b", r="r")


@query("top_variance_features", """
SELECT feature, round(var_pop("count"), 4) AS variance FROM counts GROUP BY feature ORDER BY var_pop("count") DESC, feature LIMIT 20
""", uses="counts")
def _top(t):
    return rounded(matrix.top_variance(t.counts, "feature", "count", 20), "feature", digits=4, variance="variance")


@query("benjamini_hochberg_global", """
WITH q AS (SELECT o_orderkey AS id, (o_totalprice % 9973) / 9973.0 AS p FROM orders),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, id) AS raw FROM q)
SELECT id, round(p, 6) AS p_value, round(least(1.0, min(raw) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adjusted FROM r
""")
def _bh(t):
    df = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") % 9973 / 9973.0).alias("p_value"))
    return rounded(ordered.benjamini_hochberg(df), "id", p_value="p_value", p_adjusted="p_adjusted")


@query("bonferroni", """
SELECT o_orderkey AS id, round(least(1.0, (o_totalprice % 9973) / 9973.0 / 10000 * (SELECT count(*) FROM orders)), 6) AS p_adjusted FROM orders
""")
def _bonferroni(t):
    df = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") % 9973 / 9973.0 / 10000).alias("p_value"))
    return rounded(ordered.bonferroni(df), "id", p_adjusted="p_adjusted")


@query("running_score", """
WITH s AS (SELECT event_id AS id, value - 50 AS score FROM events)
SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank,
round(sum(score) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) / ((SELECT sum(greatest(score, 0)) FROM s) + 1e-10), 6) AS running_sum FROM s
""")
def _running(t):
    df = t.events.select(F.col("event_id").alias("id"), (F.col("value") - 50).alias("score"))
    return rounded(ordered.running_score(df, "score", "id"), "id", "rank", running_sum="running_sum")


@query("qq_points", """
WITH s AS (SELECT event_id AS id, value AS x, row_number() OVER (ORDER BY value, event_id) / (count(*) OVER () + 1.0) AS e FROM events)
SELECT id, round(x, 6) AS observed, round(e, 6) AS expected_p FROM s
""")
def _qq(t):
    df = t.events.select(F.col("event_id").alias("id"), (-F.col("value")).alias("score"))
    out = ordered.running_score(df, "score", "id")
    n = t.events.agg(F.count(F.lit(1))).scalar()
    return out.select("id", F.round(-F.col("score"), 6).alias("observed"), F.round(F.col("rank") / (n + 1.0), 6).alias("expected_p"))


def _quantile_sql(p: str) -> str:
    """The place where the normal distribution reaches ``p``, found by halving steps."""
    steps = ", ".join(repr(8.0 / 2**i) for i in range(34))
    upper = S.normal_p("abs(a + s)")
    return f"list_reduce([-8.0, {steps}], lambda a, s: CASE WHEN (CASE WHEN a + s < 0 THEN ({upper}) / 2 ELSE 1 - ({upper}) / 2 END) <= {p} THEN a + s ELSE a END)"


@query("normal_qq_points", f"""
WITH s AS (SELECT c_custkey AS id, c_acctbal AS x, (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 0.5) / count(*) OVER () AS e FROM customer)
SELECT id, round(x, 6) AS observed, round({_quantile_sql("e")}, 3) + 0.0 AS expected FROM s
""")
def _normal_qq(t):
    df = t.customer.select(F.col("c_custkey").alias("id"), (-F.col("c_acctbal")).alias("score"))
    n = t.customer.agg(F.count(F.lit(1))).scalar()
    out = ordered.running_score(df, "score", "id").withColumn("e", (F.col("rank") - 0.5) / n)
    return out.select("id", F.round(-F.col("score"), 6).alias("observed"), (F.round(stats.normal_quantile("e"), 3) + 0.0).alias("expected"))

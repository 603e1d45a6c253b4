"""Registered queries: tests, genetics, diversity, methylation, survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genetics, omics, ordered, tables, testing, traces
from . import sql_stats as S
from .catalog import query
from .matrix_queries import rounded


@query("anova", """
WITH c AS (SELECT l_partkey AS feature, l_returnflag AS g, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM lineitem GROUP BY 1, 2),
p AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM c GROUP BY 1),
f AS (SELECT feature, (k - 1)::DOUBLE AS d1, (n - k)::DOUBLE AS d2, ((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)) AS f FROM p WHERE k > 1)
SELECT feature, round(f, 5) AS f_statistic, round(""" + S.f_p("f", "d1", "d2") + ", 5) AS p_value FROM f")
def _anova(t):
    df = t.lineitem.select(F.col("l_partkey").alias("feature"), "l_returnflag", "l_quantity")
    return rounded(testing.anova(df, "feature", "l_returnflag", "l_quantity"), "feature", digits=5, f_statistic="f_statistic", p_value="p_value")


@query("pooled_t_test", """
WITH m AS (SELECT l_partkey AS feature, count(*) FILTER (l_linestatus = 'F') AS n1, count(*) FILTER (l_linestatus = 'O') AS n2, avg(l_quantity) FILTER (l_linestatus = 'F') AS m1,
avg(l_quantity) FILTER (l_linestatus = 'O') AS m2, var_samp(l_quantity) FILTER (l_linestatus = 'F') AS v1, var_samp(l_quantity) FILTER (l_linestatus = 'O') AS v2 FROM lineitem GROUP BY 1),
t AS (SELECT feature, (n1 + n2 - 2)::DOUBLE AS df, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t FROM m WHERE n1 > 1 AND n2 > 1)
SELECT feature, round(t, 6) AS t, round(""" + S.student_p("t", "df") + ", 6) AS p_value FROM t")
def _pooled(t):
    df = t.lineitem.select(F.col("l_partkey").alias("feature"), "l_linestatus", "l_quantity")
    return rounded(testing.pooled_t(df, "feature", "l_linestatus", "F", "O", "l_quantity"), "feature", t="t", p_value="p_value")


@query("rank_sum", """
WITH c AS (SELECT l_returnflag AS g, l_extendedprice AS v, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS k FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY v) - n + (n + 1) / 2.0 AS rk FROM c),
s AS (SELECT g, sum(k * rk) AS r, sum(k) AS n1, sum(n) AS n, sum(n::DOUBLE * n * n - n) AS ties FROM r GROUP BY g),
z AS (SELECT g, r - n1 * (n1 + 1) / 2.0 AS u, greatest(0, abs(r - n1 * (n1 + 1) / 2.0 - n1 * (n - n1) / 2.0) - .5) / sqrt(n1 * (n - n1) / 12.0 * (n + 1 - ties / (n * (n - 1.0)))) AS z FROM s)
SELECT g AS grp, u, round(z, 6) AS z, round(""" + S.normal_p("z") + ", 6) AS p_value FROM z")
def _ranksum(t):
    df = t.lineitem.select(F.col("l_returnflag").alias("grp"), "l_extendedprice", "l_linestatus")
    return rounded(testing.rank_sum(df, "l_extendedprice", F.col("l_linestatus") == "F", ["grp"]), "grp", "u", z="z", p_value="p_value")


@query("linear_regression", """
WITH m AS (SELECT l_returnflag AS grp, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2,
count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT l_shipdate::DATE AS d, corr(l_discount, l_tax) AS r, regr_slope(l_tax, l_discount) AS slope, count(*) AS n FROM lineitem GROUP BY 1 HAVING n > 2),
t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, (n - 2)::DOUBLE AS df FROM p)
SELECT strftime(d, '%Y-%m-%d') AS day, round(slope, 6) AS slope, round(r * r, 6) AS r2, n, round(""" + S.student_p("t", "df") + ", 5) AS p_value FROM t WHERE abs(r) < 1")
def _regression(t):
    df = t.lineitem.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_discount", "l_tax")
    out = testing.linear_regression(df, "l_discount", "l_tax", ["day"]).filter("r2 < 1")
    return out.select("day", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), "n", F.round("p_value", 5).alias("p_value"))


@query("pearson", """
WITH m AS (SELECT l_returnflag AS grp, corr(l_quantity, l_tax) AS r, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, (n - 2)::DOUBLE AS df FROM m)
SELECT grp, round(r, 6) AS r, n, round(""" + S.normal_p("t") + ", 3) AS p_value FROM t")
def _pearson(t):
    df = t.lineitem.select(F.col("l_returnflag").alias("grp"), "l_quantity", "l_tax")
    out = testing.pearson(df, "l_quantity", "l_tax", ["grp"])
    return out.select("grp", F.round("r", 6).alias("r"), "n", F.round("p_value", 3).alias("p_value"))


@query("spearman", """
WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x)
SELECT round(corr(ra, rb), 6) AS r, count(*) AS n FROM r
""")
def _spearman(t):
    return testing.spearman(t.lineitem, "l_quantity", "l_extendedprice").select(F.round("r", 6).alias("r"), "n")


@query("average_ranks", """
WITH r AS (SELECT l_extendedprice AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT v, n, sum(n) OVER (ORDER BY v) - n + (n + 1) / 2.0 AS avg_rank FROM r
""")
def _avg_ranks(t):
    return ordered.average_ranks(t.lineitem.select(F.col("l_extendedprice").alias("v")), "v").select("v", "n", "avg_rank")


_ROC = """
WITH c AS (SELECT value AS score, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type <> 'purchase') AS n FROM events GROUP BY 1),
r AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM c WINDOW w AS (ORDER BY score DESC))
"""


@query("roc_curve", _ROC + "SELECT score, round(tp / np, 6) AS tpr, round(fp / nn, 6) AS fpr FROM r")
def _roc(t):
    df = t.events.select(F.col("value").alias("score"), "event_type")
    return rounded(testing.roc_curve(df, "score", F.col("event_type") == "purchase"), "score", tpr="tpr", fpr="fpr")


@query("roc_auc", _ROC + "SELECT round(sum(n * (tp - p) + n * p / 2.0) / any_value(np * nn), 6) AS auc FROM r")
def _auc(t):
    df = t.events.select(F.col("value").alias("score"), "event_type")
    return rounded(testing.auc(df, "score", F.col("event_type") == "purchase"), auc="auc")


def _term(o, r, c):
    e = f"(({r}) * ({c}) * 1.0 / n)"
    return f"CASE WHEN {e} > 0 THEN (abs({o} - {e}) - least(.5, abs({o} - {e})))**2 / {e} ELSE 0 END"


_GWAS = """
, k AS (SELECT *, case_alt + case_ref + ctrl_alt + ctrl_ref AS n FROM snps WHERE case_alt + case_ref > 0 AND ctrl_alt + ctrl_ref > 0),
g AS (SELECT *, case_alt * ctrl_ref * 1.0 / nullif(case_ref * ctrl_alt, 0) AS orr, """ + " + ".join(
    _term(o, r, c) for o, r, c in (
        ("case_alt", "case_alt + case_ref", "case_alt + ctrl_alt"), ("case_ref", "case_alt + case_ref", "case_ref + ctrl_ref"),
        ("ctrl_alt", "ctrl_alt + ctrl_ref", "case_alt + ctrl_alt"), ("ctrl_ref", "ctrl_alt + ctrl_ref", "case_ref + ctrl_ref"))
) + " AS chi2 FROM k), p AS (SELECT *, " + S.chi2_p("chi2") + " AS p FROM g)"


@query("case_control_association", _GWAS + """
, q AS (SELECT *, round(p, 9) AS p9 FROM p), r AS (SELECT *, p9 * count(*) OVER () / row_number() OVER (ORDER BY p9, snp_id, chrom) AS raw FROM q)
SELECT chrom, pos, snp_id, case_alt, round(orr, 6) AS odds_ratio, round(chi2, 6) AS chi2, round(p, 6) AS p_value, round(-log10(p + 1e-300), 5) AS neg_log10,
round(least(1.0, min(raw) OVER (ORDER BY p9, snp_id, chrom ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adjusted FROM r
""", uses="snps")
def _gwas(t):
    df = genetics.case_control(t.snps).withColumn("p_value", F.round("p_value", 9))
    out = ordered.benjamini_hochberg(df)
    return rounded(out, "chrom", "pos", "snp_id", "case_alt", odds_ratio="odds_ratio", chi2="chi2", p_value="p_value", p_adjusted="p_adjusted", neg_log10=F.round("neg_log10", 5))


@query("association_counts", _GWAS + "SELECT count(*) AS tests, count(*) FILTER (p < .05) AS below_0, count(*) FILTER (p < 1e-5) AS below_1, count(*) FILTER (p < 5e-8) AS below_2 FROM p", uses="snps")
def _gwas_counts(t):
    return genetics.significant_counts(genetics.case_control(t.snps))


_HWE = """
, g AS (SELECT site, count(*) FILTER (gt = 0) AS n0, count(*) FILTER (gt = 1) AS n1, count(*) FILTER (gt = 2) AS n2, count(*) AS n FROM genotypes GROUP BY site),
f AS (SELECT *, (2 * n0 + n1) / (2.0 * n) AS p FROM g),
e AS (SELECT *, greatest(p * p * n, 1e-10) AS e0, greatest(2 * p * (1 - p) * n, 1e-10) AS e1, greatest((1 - p) * (1 - p) * n, 1e-10) AS e2 FROM f),
h AS (SELECT *, (n0 - e0)**2 / e0 + (n1 - e1)**2 / e1 + (n2 - e2)**2 / e2 AS chi2 FROM e)
"""


@query("hardy_weinberg", _HWE + ", k AS (SELECT *, " + S.chi2_p("chi2") + " AS pv FROM h) SELECT site, round(p, 6) AS p, round(chi2, 5) AS chi2, round(pv, 6) AS p_value, pv > .05 AS in_hwe FROM k", uses="genotypes")
def _hwe(t):
    out = genetics.hardy_weinberg(t.genotypes)
    return out.select("site", F.round("p", 6).alias("p"), F.round("chi2", 5).alias("chi2"), F.round("p_value", 6).alias("p_value"), "in_hwe")


_FST = """
, q AS (SELECT site, pop, avg(gt) / 2 AS f, count(*) AS n FROM genotypes GROUP BY 1, 2),
m AS (SELECT a.pop AS pop1, b.pop AS pop2, a.f AS f1, b.f AS f2, a.n AS n1, b.n AS n2, (a.f * a.n + b.f * b.n) / (a.n + b.n) AS pm FROM q a JOIN q b ON a.site = b.site AND a.pop < b.pop),
v AS (SELECT pop1, pop2, ((f1 - pm)**2 * n1 + (f2 - pm)**2 * n2) / (n1 + n2) AS vb, (2 * f1 * (1 - f1) * n1 + 2 * f2 * (1 - f2) * n2) / (n1 + n2) AS vw FROM m),
fst AS (SELECT pop1, pop2, avg(CASE WHEN vb + vw / 2 > 0 THEN vb / (vb + vw / 2) ELSE 0 END) AS fst FROM v GROUP BY 1, 2)
"""


@query("fst_pairs", _FST + "SELECT pop1, pop2, round(fst, 6) AS fst FROM fst", uses="genotypes")
def _fst(t):
    return rounded(genetics.fst(t.genotypes), "pop1", "pop2", fst="fst")


_PI = """
, s AS (SELECT site, avg(gt) / 2 AS p, count(*) AS n, min(gt) < max(gt) AS seg FROM genotypes GROUP BY site),
pi AS (SELECT avg(CASE WHEN n > 1 THEN 2 * p * (1 - p) * n / (n - 1) ELSE 0 END) AS pi, count(*) AS sites FROM s)
"""


@query("nucleotide_diversity", _PI + "SELECT round(pi, 6) AS pi, sites FROM pi", uses="genotypes")
def _pi(t):
    return rounded(genetics.nucleotide_diversity(t.genotypes), "sites", pi="pi")


_TAJIMA = _PI + """
, b AS (SELECT count(*) FILTER (seg) AS s, sum(2 * p * (1 - p) * 2 * n / (2 * n - 1)) AS k, (SELECT 2.0 * count(DISTINCT sample) FROM genotypes) AS m FROM s),
hs AS (SELECT *, list_sum(list_transform(range(1, m::BIGINT), lambda i: 1.0 / i)) AS a1, list_sum(list_transform(range(1, m::BIGINT), lambda i: 1.0 / (i * i))) AS a2 FROM b),
es AS (SELECT *, ((m + 1) / (3 * (m - 1)) - 1 / a1) / a1 AS e1, (2 * (m * m + m + 3) / (9 * m * (m - 1)) - (m + 2) / (a1 * m) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM hs),
tj AS (SELECT s, k, (k - s / a1) / sqrt(e1 * s + e2 * s * (s - 1)) AS d FROM es)
"""


@query("tajimas_d", _TAJIMA + "SELECT s AS segregating_sites, round(k, 5) AS pairwise, round(d, 5) AS tajimas_d FROM tj", uses="genotypes")
def _tajima(t):
    return rounded(genetics.tajimas_d(t.genotypes), "segregating_sites", digits=5, pairwise="pairwise", tajimas_d="tajimas_d")


_LD = """
, ld AS (SELECT a.site AS site1, b.site AS site2, corr(a.gt, b.gt)**2 AS r2 FROM genotypes a JOIN genotypes b ON a.sample = b.sample AND b.site > a.site AND b.site < a.site + 20
GROUP BY 1, 2 HAVING min(a.gt) < max(a.gt) AND min(b.gt) < max(b.gt))
"""


@query("linkage_disequilibrium", _LD + "SELECT site1, site2, round(r2, 6) AS r2 FROM ld", uses="genotypes")
def _ld(t):
    return rounded(genetics.linkage(t.genotypes), "site1", "site2", r2="r2")


@query("population_report", _HWE + ", hk AS (SELECT count(*) AS sites, avg(CASE WHEN " + S.chi2_p("chi2") + " > .05 THEN 1.0 ELSE 0.0 END) AS share FROM h)" + _FST + _TAJIMA + _LD + """
SELECT sites, round(share, 6) AS share_in_hwe, round((SELECT avg(fst) FROM fst), 6) AS mean_fst, round((SELECT pi FROM pi), 6) AS pi, round((SELECT d FROM tj), 5) AS tajimas_d,
round((SELECT avg(r2) FROM ld), 6) AS mean_r2 FROM hk
""", uses="genotypes")
def _pop(t):
    out = genetics.population_report(t.genotypes)
    return out.select("sites", *[F.round(c, 5 if c == "tajimas_d" else 6).alias(c) for c in ("share_in_hwe", "mean_fst", "pi", "tajimas_d", "mean_r2")])


@query("alpha_diversity", """
, s AS (SELECT sample, count(*) AS k, sum("count") AS t, sum("count" * ln("count")) AS h, sum("count" * ("count" - 1)) AS d, count(*) FILTER ("count" = 1) AS f1, count(*) FILTER ("count" = 2) AS f2 FROM abundance GROUP BY 1)
SELECT sample, k AS observed, round(ln(t) - h / t, 6) AS shannon, round(CASE WHEN t <= 1 THEN 0 ELSE 1 - d / (t * (t - 1.0)) END, 6) AS simpson,
round(k + CASE WHEN f2 = 0 THEN f1 * (f1 - 1) / 2.0 ELSE f1 * f1 / (2.0 * f2) END, 6) AS chao1 FROM s
""", uses="abundance")
def _alpha(t):
    return rounded(omics.alpha_diversity(t.abundance), "sample", "observed", shannon="shannon", simpson="simpson", chao1="chao1")


@query("beta_diversity", """
, s AS (SELECT sample, sum("count") AS t FROM abundance GROUP BY 1), tx AS (SELECT DISTINCT taxon FROM abundance),
w AS (SELECT s.sample, s.t, list(coalesce("count", 0) ORDER BY tx.taxon) AS v FROM s CROSS JOIN tx LEFT JOIN abundance a ON a.sample = s.sample AND a.taxon = tx.taxon GROUP BY ALL)
SELECT a.sample AS sample1, b.sample AS sample2, round(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: abs(a.v[i] - b.v[i]))) * 1.0 / (a.t + b.t), 6) AS distance FROM w a JOIN w b ON a.sample < b.sample
""", uses="abundance")
def _beta(t):
    return rounded(omics.beta_diversity(t.abundance), "sample1", "sample2", distance="distance")


@query("beta_diversity_within", """
WITH a AS (SELECT o_custkey AS sample, o_orderdate::DATE - DATE '1992-01-01' AS day, count(*) AS n FROM orders GROUP BY 1, 2), x AS (SELECT sample, day // 60 AS taxon, sum(n) AS c FROM a GROUP BY 1, 2),
s AS (SELECT sample, sum(c) AS t FROM x GROUP BY 1), m AS (SELECT a.sample AS sample1, b.sample AS sample2, sum(least(a.c, b.c)) AS shared FROM x a JOIN x b ON a.taxon = b.taxon AND a.sample < b.sample GROUP BY 1, 2)
SELECT sample1, sample2, round(1 - 2 * shared / (p.t + q.t), 6) AS distance FROM m JOIN s p ON p.sample = sample1 JOIN s q ON q.sample = sample2 WHERE 1 - 2 * shared / (p.t + q.t) <= 0.5 + 1e-12
""")
def _beta_within(t):
    day = F.datediff("o_orderdate", F.lit("1992-01-01"))
    visits = t.orders.groupBy(F.col("o_custkey").alias("sample"), F.floor(day / 60).alias("taxon")).agg(F.count(F.lit(1)).alias("count"))
    return rounded(omics.beta_diversity_within(visits, 0.5), "sample1", "sample2", distance="distance")


@query("taxon_abundance", 'SELECT event_type AS taxon, count(*) AS "count", round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS relative_abundance FROM events GROUP BY 1')
def _abundance(t):
    return rounded(omics.abundance(t.events.select(F.col("event_type").alias("taxon"))), "taxon", "count", relative_abundance="relative_abundance")


@query("methylation_report", """
, l AS (SELECT context, methylated * 1.0 / greatest(coverage, 1) AS v FROM methylation WHERE coverage >= 5)
SELECT context, count(*) AS sites, round(avg(v), 6) AS mean_level, count(*) FILTER (v < .25) AS low, count(*) FILTER (v >= .25 AND v < .5) AS mid_low, count(*) FILTER (v >= .5 AND v < .75) AS mid_high,
count(*) FILTER (v >= .75) AS high FROM l GROUP BY ROLLUP (context)
""", uses="methylation")
def _meth(t):
    return rounded(omics.methylation_report(t.methylation), "context", "sites", "low", "mid_low", "mid_high", "high", mean_level="mean_level")


@query("differential_methylation", """
, j AS (SELECT a.chrom, a.pos, a.methylated AS m1, a.coverage AS n1, b.methylated AS m2, b.coverage AS n2 FROM methylation a JOIN methylation b ON a.chrom = b.chrom AND a.pos = b.pos AND a.grp = 'F' AND b.grp = 'O'
WHERE a.coverage >= 5 AND b.coverage >= 5),
k AS (SELECT *, m1 + m2 AS o, n1 + n2 - m1 - m2 AS e, n1 + n2 AS n, m1 * (n2 - m2) + .5 * (m1 * m2 + (n1 - m1) * (n2 - m2)) AS u FROM j),
sd AS (SELECT *, sqrt(n1 * n2 / 12.0 * (n + 1 - (o * o * o - o + e * e * e - e) / (n * (n - 1.0)))) AS s FROM k),
z AS (SELECT chrom, pos, m1 / n1 AS l1, m2 / n2 AS l2, CASE WHEN s > 0 THEN greatest(0.0, abs(u - n1 * n2 / 2.0) - .5) / s ELSE 0.0 END AS z FROM sd WHERE abs(m1 / n1 - m2 / n2) >= .2)
SELECT chrom, pos, round(l1, 6) AS level1, round(l2, 6) AS level2, round(l1 - l2, 6) AS delta, round(""" + S.normal_p("z") + ", 6) AS p_value FROM z", uses="methylation")
def _dmr(t):
    m = t.methylation
    out = omics.differential_sites(m.filter("grp = 'F'"), m.filter("grp = 'O'"))
    return rounded(out, "chrom", "pos", level1="level1", level2="level2", delta="delta", p_value="p_value")


def features(t):
    return t.lineitem.select(
        (F.col("l_extendedprice") / 1000).alias("mz"), F.col("l_quantity").alias("rt"), F.concat(F.lit("s"), "l_returnflag").alias("sample"), (F.col("l_tax") * 1000).alias("intensity")
    )


_FEATURES = """
WITH a AS (SELECT round_even(l_extendedprice / 1000 / 1.0, 0)::BIGINT AS mz_bin, round_even(l_quantity / 5.0, 0)::BIGINT AS rt_bin, 's' || l_returnflag AS sample, max(l_tax * 1000) AS intensity FROM lineitem GROUP BY 1, 2, 3)
"""


@query("aligned_features", _FEATURES + "SELECT mz_bin, rt_bin, sample, round(intensity, 4) AS intensity FROM a")
def _features(t):
    return rounded(omics.align_features(features(t), 1.0, 5.0), "mz_bin", "rt_bin", "sample", digits=4, intensity="intensity")


@query("feature_matrix", _FEATURES + """
SELECT mz_bin, rt_bin, round(coalesce(max(intensity) FILTER (sample = 'sA'), 0), 4) AS "sA", round(coalesce(max(intensity) FILTER (sample = 'sN'), 0), 4) AS "sN", round(coalesce(max(intensity) FILTER (sample = 'sR'), 0), 4) AS "sR"
FROM a GROUP BY 1, 2
""")
def _matrix(t):
    out = omics.feature_matrix(omics.align_features(features(t), 1.0, 5.0), ["sA", "sN", "sR"])
    return rounded(out, "mz_bin", "rt_bin", digits=4, sA="sA", sN="sN", sR="sR")


_KM = """
, c AS (SELECT grp, time, count(*) AS n, sum(event) AS d FROM survival GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY grp) - (sum(n) OVER (PARTITION BY grp ORDER BY time) - n) AS y FROM c),
e AS (SELECT grp, time, y::BIGINT AS at_risk, d::BIGINT AS events, product(1 - d / y) OVER w AS s, sum(CASE WHEN d < y THEN d / (y * (y - d)) ELSE 0 END) OVER w AS v FROM r WHERE d > 0 WINDOW w AS (PARTITION BY grp ORDER BY time))
"""


@query("kaplan_meier", _KM + """
SELECT grp, time, at_risk, events, round(s, 6) AS survival, round(greatest(0, s - 1.959963984540054 * s * sqrt(v)), 6) AS lower, round(least(1, s + 1.959963984540054 * s * sqrt(v)), 6) AS upper FROM e
""", uses="survival")
def _km(t):
    return rounded(omics.kaplan_meier(t.survival, ["grp"]), "grp", "time", "at_risk", "events", survival="survival", lower="lower", upper="upper")


@query("median_survival", _KM + "SELECT grp, min(time) FILTER (s <= .5) AS median_survival, sum(events)::BIGINT AS events FROM e GROUP BY grp", uses="survival")
def _median(t):
    return omics.median_survival(omics.kaplan_meier(t.survival, ["grp"]), ["grp"])


def _logrank(first: str) -> str:
    return f"""
, lc AS (SELECT time, count(*) FILTER ({first}) AS a, count(*) FILTER (NOT ({first})) AS b, coalesce(sum(event) FILTER ({first}), 0) AS da, sum(event) AS d FROM survival GROUP BY 1),
lr AS (SELECT *, sum(a) OVER () - sum(a) OVER (ORDER BY time) + a AS na, sum(b) OVER () - sum(b) OVER (ORDER BY time) + b AS nb FROM lc),
lg AS (SELECT sum(da - na * d / (na + nb)) AS o, sum(CASE WHEN na + nb > 1 THEN na * nb * d * (na + nb - d) / ((na + nb) * (na + nb) * (na + nb - 1.0)) ELSE 0 END) AS v FROM lr),
lx AS (SELECT o * o / v AS stat FROM lg)
"""


@query("log_rank", _logrank("grp = 'BUILDING'") + "SELECT round(stat, 5) AS statistic, round(" + S.chi2_p("stat") + ", 5) AS p_value FROM lx", uses="survival")
def _log_rank(t):
    return rounded(omics.log_rank(t.survival, F.col("grp") == "BUILDING"), digits=5, statistic="statistic", p_value="p_value")


@query("median_split_hazard", ", md AS (SELECT median(covariate) AS m FROM survival)" + _logrank("covariate > (SELECT m FROM md)") + """
, me AS (SELECT median(time) FILTER (covariate > (SELECT m FROM md)) AS h, median(time) FILTER (covariate <= (SELECT m FROM md)) AS l FROM survival WHERE event = 1)
SELECT h AS median_high, l AS median_low, round(l / h, 6) AS hazard_ratio, round((SELECT """ + S.chi2_p("stat") + " FROM lx), 5) AS p_value FROM me", uses="survival")
def _hazard(t):
    out = omics.median_split_hazard(t.survival)
    return out.select("median_high", "median_low", F.round("hazard_ratio", 6).alias("hazard_ratio"), F.round("p_value", 5).alias("p_value"))


def chains(t):
    return t.orders.select((F.col("o_orderkey") % 4).alias("chain"), F.floor(F.col("o_orderkey") / 4).alias("step"), F.col("o_totalprice").alias("value"))


_CHAINS = "WITH c AS (SELECT o_orderkey % 4 AS chain, o_orderkey // 4 AS step, o_totalprice AS value FROM orders), m AS (SELECT chain, count(*) AS n, avg(value) AS mu, var_samp(value) AS var FROM c GROUP BY 1)"


@query("effective_sample_size", _CHAINS + """
, l AS (SELECT a.chain, b.step - a.step AS lag, sum((a.value - mu) * (b.value - mu)) / any_value(n * var) AS rho FROM c a JOIN m ON m.chain = a.chain JOIN c b ON a.chain = b.chain AND b.step > a.step AND b.step < a.step + 500 AND b.step - a.step < n // 2 GROUP BY 1, 2),
s AS (SELECT chain, coalesce(min(lag) FILTER (rho <= 0), 500) AS stop FROM l GROUP BY 1)
SELECT m.chain, n, round(CASE WHEN n < 20 THEN n ELSE n / (1 + 2 * coalesce((SELECT sum(rho) FROM l WHERE l.chain = m.chain AND lag < s.stop), 0)) END, 5) AS ess FROM m JOIN s ON s.chain = m.chain
""")
def _ess(t):
    return rounded(omics.effective_sample_size(chains(t)), "chain", "n", digits=5, ess="ess")


@query("scale_reduction", _CHAINS + ", g AS (SELECT avg(n) AS n, var_samp(mu) AS b, avg(var) AS w FROM m) SELECT round(sqrt(((n - 1) / n * w + b) / w), 6) AS psrf FROM g")
def _psrf(t):
    return rounded(omics.scale_reduction(chains(t)), psrf="psrf")


@query("n50_by_source", """
WITH s AS (SELECT source, n_chars AS l, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS c, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i, sum(n_chars) OVER (PARTITION BY source) AS t FROM documents)
SELECT source, max(l) AS n50, min(i) AS l50 FROM s WHERE c >= t / 2.0 GROUP BY source
""")
def _n50(t):
    return ordered.n50(t.documents, "n_chars", ["source"]).select("source", "n50", "l50")


@query("assembly_statistics", """
, s AS (SELECT length(seq) AS l, sum(length(seq)) OVER (ORDER BY length(seq) DESC, seq_id) AS c, row_number() OVER (ORDER BY length(seq) DESC, seq_id) AS i, sum(length(seq)) OVER () AS t,
length(seq) - length(regexp_replace(seq, '[GC]', '', 'g')) AS g FROM dna)
SELECT count(*) AS contigs, sum(l)::BIGINT AS bases, max(l) AS longest, min(l) AS shortest, round(sum(g) * 100.0 / sum(l), 6) AS gc_percent, max(l) FILTER (c >= t / 2.0) AS n50, min(i) FILTER (c >= t / 2.0) AS l50 FROM s
""", uses="dna")
def _assembly(t):


    return rounded(tables.assembly_statistics(t.dna), "contigs", "bases", "longest", "shortest", "n50", "l50", gc_percent="gc_percent")


def trace(t):
    return t.orders.select((F.col("o_orderkey") % 3).alias("sample"), F.floor(F.col("o_orderkey") / 3).alias("scan"), F.col("o_totalprice").alias("intensity"))


_TRACE = "WITH t AS (SELECT o_orderkey % 3 AS sample, o_orderkey // 3 AS scan, o_totalprice AS v FROM orders), n AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM t WINDOW w AS (PARTITION BY sample ORDER BY scan))"


@query("trace_peaks", _TRACE + """
, m AS (SELECT sample, median(abs(v - l)) AS noise FROM n GROUP BY 1) SELECT sample, scan, v AS intensity, round(v / greatest(noise, 1e-10), 6) AS snr FROM n JOIN m USING (sample) WHERE v > l AND v > r AND v >= 3
""")
def _trace_peaks(t):
    return rounded(traces.detect_peaks(trace(t)), "sample", "scan", "intensity", snr="snr")


@query("prominent_peaks", """
WITH t AS (SELECT o_orderkey % 3 AS sample, o_orderkey // 3 AS scan, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) - 1 AS i, abs(o_orderkey // 3 % 40 - 20) * 5000 + o_totalprice / 50 AS v FROM orders),
s AS MATERIALIZED (SELECT sample, i, scan, v FROM t),
n AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM s WINDOW w AS (PARTITION BY sample ORDER BY i)),
k AS (SELECT * FROM n WHERE v > l AND v > r),
h AS (SELECT k.sample, k.i, max(s.i) FILTER (s.i < k.i) AS a, min(s.i) FILTER (s.i > k.i) AS b FROM k LEFT JOIN s ON s.sample = k.sample AND s.v > k.v GROUP BY 1, 2),
m AS (SELECT k.sample, k.i, any_value(k.v) AS v, any_value(k.scan) AS scan, min(s.v) FILTER (s.i < k.i) AS lo, min(s.v) FILTER (s.i > k.i) AS hi
  FROM k JOIN h USING (sample, i) JOIN s ON s.sample = k.sample AND s.i > coalesce(a, -1) AND s.i < coalesce(b, 1e15) GROUP BY 1, 2),
p AS (SELECT *, v - greatest(lo, hi) AS prom FROM m), q AS (SELECT *, v - prom / 2 AS line FROM p JOIN (SELECT sample, stddev_pop(v) AS sd FROM s GROUP BY 1) USING (sample) WHERE prom >= 1.5 * sd AND v >= 3),
c AS (SELECT q.sample, q.i, max(s.i) FILTER (s.i < q.i) AS a, min(s.i) FILTER (s.i > q.i) AS b FROM q JOIN s ON s.sample = q.sample AND s.v <= q.line GROUP BY 1, 2),
w AS (SELECT q.*, (b - (line - y.v) / (y1.v - y.v)) - (a + (line - x.v) / (x1.v - x.v)) AS width FROM q JOIN c USING (sample, i) JOIN s x ON x.sample = q.sample AND x.i = a JOIN s x1 ON x1.sample = q.sample AND x1.i = a + 1
  JOIN s y ON y.sample = q.sample AND y.i = b JOIN s y1 ON y1.sample = q.sample AND y1.i = b - 1),
z AS (SELECT sample, median(abs(v - l)) AS noise FROM n GROUP BY 1)
SELECT sample, scan, round(v, 4) AS intensity, round(prom, 4) AS prominence, round(width, 4) AS width, round(v / greatest(noise, 1e-10), 4) AS snr FROM w JOIN z USING (sample) WHERE width >= 5
""")
def _prominent(t):
    # order prices have no shape of their own: they are the noise on a wave of forty scans
    wave = F.abs(F.col("scan") % 40 - 20) * 5000 + F.col("intensity") / 50
    smooth = trace(t).withColumn("intensity", wave)
    out = traces.prominent_peaks(smooth)
    return rounded(out, "sample", "scan", digits=4, intensity="intensity", prominence="prominence", width="width", snr="snr")


def backbone(t):
    """Three atoms per residue from consecutive vectors."""
    e = F.col("embedding")
    rows = [
        F.struct(F.lit(a).alias("atom"), *[(e[3 * k + i].cast("double") * 10 + k).alias(c) for i, c in enumerate("xyz")]) for k, a in enumerate(("N", "CA", "C"))
    ]
    return t.embeddings.select(F.col("label").alias("structure"), F.lit("A").alias("chain"), F.col("vec_id").alias("resseq"), F.inline(F.array(*rows)))


def _dihedral_sql() -> str:
    def pt(k):
        return ", ".join(f"embedding[{3 * k + i + 1}]::DOUBLE * 10 + {k} AS {'nac'[k]}{c}" for i, c in enumerate("xyz"))

    def angle(p, q, r, s):
        b = [[f"({v}{c} - {u}{c})" for c in "xyz"] for u, v in ((p, q), (q, r), (r, s))]

        def cross(a, d):
            return [f"({a[1]} * {d[2]} - {a[2]} * {d[1]})", f"({a[2]} * {d[0]} - {a[0]} * {d[2]})", f"({a[0]} * {d[1]} - {a[1]} * {d[0]})"]

        def dot(a, d):
            return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, d)) + ")"

        n1, n2 = cross(b[0], b[1]), cross(b[1], b[2])
        return f"degrees(atan2(sqrt({dot(b[1], b[1])}) * {dot(b[0], n2)}, {dot(n1, n2)}))"

    return (
        f"WITH a AS (SELECT label AS structure, vec_id AS resseq, {pt(0)}, {pt(1)}, {pt(2)} FROM embeddings), "
        "w AS (SELECT *, " + ", ".join(f"lag(c{c}) OVER o AS p{c}, lead(n{c}) OVER o AS m{c}" for c in "xyz") + " FROM a WINDOW o AS (PARTITION BY structure ORDER BY resseq)), "
        f"g AS (SELECT structure, resseq, {angle('p', 'n', 'a', 'c')} AS phi, {angle('n', 'a', 'c', 'm')} AS psi FROM w) "
        "SELECT structure, resseq, round(phi, 4) AS phi, round(psi, 4) AS psi, CASE WHEN phi > -150 AND phi < -30 AND psi > -75 AND psi < 50 THEN 'H' "
        "WHEN phi > -180 AND phi < -40 AND psi > 90 AND psi < 180 THEN 'E' ELSE 'C' END AS ss FROM g"
    )


@query("backbone_dihedrals", _dihedral_sql())
def _dihedrals(t):
    return tables.dihedrals(backbone(t)).select("structure", "resseq", F.round("phi", 4).alias("phi"), F.round("psi", 4).alias("psi"), "ss")

"""Registered queries: Spark ML, single cells, streaming, user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, learning, mapping, nearest
from ..session import cut_lineage
from ..streaming import queries as streaming
from . import sql_stats as S
from .catalog import query
from .matrix_queries import rounded


def vectors(t):
    return learning.with_vector(t.embeddings, "embedding").select("vec_id", "label", "features")


@query("forest_classifier")
def _forest(t):
    _, predicted, cv = learning.forest_classifier(vectors(t), "label")
    return learning.accuracy(predicted).withColumn("cv_accuracy", F.lit(cv))


@query("forest_confusion")
def _confusion(t):
    _, predicted, _ = learning.forest_classifier(vectors(t), "label")
    return learning.confusion(predicted)


def two_classes(t):
    return vectors(t).withColumn("label", F.when(F.col("label") < 5, "low").otherwise("high"))


@query("forest_holdout")
def _holdout(t):
    return learning.forest_holdout(two_classes(t), "label", "vec_id")[2]


@query("forest_holdout_confusion")
def _holdout_confusion(t):
    return learning.confusion(learning.forest_holdout(vectors(t), "label", "vec_id")[1])


@query("forest_classifier_importances")
def _classifier_importances(t):
    return learning.importances(learning.forest_holdout(two_classes(t), "label", "vec_id")[0].stages[-1], 20)


@query("linear_svm")
def _svm(t):
    _, predicted = learning.linear_svm(vectors(t), "label")
    return learning.accuracy(predicted)


@query("forest_regressor")
def _regressor(t):
    df = learning.with_vector(t.embeddings, "embedding").withColumn("target", F.col("embedding")[0].cast("double") * 2 + F.col("embedding")[1])
    _, predicted = learning.forest_regressor(df, "target")
    return learning.regression_scores(predicted, "target")


@query("forest_importances")
def _importances(t):
    df = learning.with_vector(t.embeddings, "embedding").withColumn("target", F.col("embedding")[0].cast("double"))
    model, _ = learning.forest_regressor(df, "target")
    return learning.importances(model, 20)


@query("selected_features")
def _selected(t):
    return learning.select_features(vectors(t), "label", 10).select("vec_id", "selected")


@query("principal_components")
def _pca(t):
    out, shares = learning.principal_components(vectors(t), 2)
    return out.select("vec_id", "pc").withColumn("explained", F.array(*[F.lit(s) for s in shares]))


@query("feature_covariance", """
SELECT i, j, round(covar_samp(embedding[i + 1]::DOUBLE, embedding[j + 1]::DOUBLE), 8) AS covariance
FROM embeddings, (SELECT a.range::INT AS i, b.range::INT AS j FROM range(64) a, range(64) b WHERE a.range <= b.range) GROUP BY i, j
""")
def _covariance(t):
    return rounded(learning.feature_covariance(t.embeddings, "embedding"), "i", "j", digits=8, covariance="covariance")


@query("nearest_neighbours", """
SELECT src, dst, round(d, 6) AS distance, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM (
SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 15
""")
def _neighbours(t):
    return rounded(nearest.nearest_neighbours(vectors(t), "vec_id", 15), "src", "dst", "rank", distance="distance")


@query("graph_clusters")
def _graph_clusters(t):
    return learning.graph_clusters(nearest.nearest_neighbours(vectors(t), "vec_id", 15), 10)


@query("kmeans_clusters")
def _kmeans(t):
    return learning.kmeans(vectors(t), 10).select("vec_id", "cluster")


# ---- single cells ------------------------------------------------------------------------------------------------


def cell_counts(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 300).alias("gene")).agg(F.sum("l_quantity").alias("count"))


def cell_clusters(t):
    return t.supplier.select(F.col("s_suppkey").alias("cell"), (F.col("s_nationkey") % 4).alias("cluster"))


_CELLS = """
WITH c AS (SELECT l_suppkey AS cell, l_partkey % 300 AS gene, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2),
v AS (SELECT cell, gene, ln(1 + n / sum(n) OVER (PARTITION BY cell) * 1e4) AS value FROM c)
"""


@query("cell_quality_filter", _CELLS + """
, k1 AS (SELECT * FROM c WHERE cell IN (SELECT cell FROM c GROUP BY 1 HAVING count(*) >= 255)), k2 AS (SELECT * FROM k1 WHERE gene IN (SELECT gene FROM k1 GROUP BY 1 HAVING count(*) >= 50)),
k3 AS (SELECT * FROM k2 WHERE cell IN (SELECT cell FROM k2 GROUP BY 1 HAVING coalesce(sum(n) FILTER (gene::VARCHAR LIKE '7%'), 0) * 100 / sum(n) < 4))
SELECT cell, gene, n AS "count" FROM k3
""")
def _cell_qc(t):
    return cells.quality_filter(cell_counts(t), 255, 50, 4.0, "7")


@query("cell_log_normalized", _CELLS + "SELECT cell, gene, round(value, 6) AS value FROM v")
def _cell_norm(t):
    return rounded(cells.log_normalized(cell_counts(t)), "cell", "gene", value="value")


_HVG = _CELLS + """
, g AS (SELECT gene, sum(exp(value) - 1) / any_value(nc) AS m, sum((exp(value) - 1)**2) AS q, any_value(nc) AS nc FROM v, (SELECT count(DISTINCT cell) AS nc FROM v) GROUP BY gene),
d AS (SELECT gene, ln(1 + m) AS mean, ln((q - nc * m * m) / (nc - 1) / m) AS dispersion FROM g),
b AS (SELECT *, greatest(0, ceil(round((mean - min(mean) OVER ()) / ((max(mean) OVER () - min(mean) OVER ()) / 20), 9)) - 1)::INTEGER AS bin FROM d),
s AS (SELECT bin, avg(dispersion) AS dm, stddev_samp(dispersion) AS ds FROM b GROUP BY 1),
z AS (SELECT gene, mean, dispersion, b.bin, CASE WHEN ds IS NULL THEN dispersion / dm ELSE (dispersion - dm) / ds END AS normalized FROM b JOIN s USING (bin))
"""


@query("highly_variable_genes", _HVG + "SELECT gene, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, bin, round(normalized, 5) AS normalized FROM z")
def _hvg(t):
    out = cells.gene_dispersion(cells.log_normalized(cell_counts(t)))
    return out.select("gene", F.round("mean", 6).alias("mean"), F.round("dispersion", 6).alias("dispersion"), "bin", F.round("normalized", 5).alias("normalized"))


@query("top_variable_genes", _HVG + "SELECT gene FROM z ORDER BY normalized DESC, gene LIMIT 50")
def _hvg_top(t):
    return cells.highly_variable(cells.log_normalized(cell_counts(t)), 50).select("gene")


@query("cell_scaled", _CELLS + """
, g AS (SELECT gene, sum(value) / any_value(nc) AS m, sum(value * value) AS q, any_value(nc) AS nc FROM v, (SELECT count(DISTINCT cell) AS nc FROM v) GROUP BY gene), s AS (SELECT gene, m, sqrt((q - nc * m * m) / (nc - 1)) AS sd FROM g)
SELECT cell, gene, round(least(10, (value - m) / sd), 5) AS scaled, round(-m / sd, 5) AS zero FROM v JOIN s USING (gene)
""")
def _cell_scaled(t):
    return rounded(cells.scaled(cells.log_normalized(cell_counts(t))), "cell", "gene", digits=5, scaled="scaled", zero="zero")


_MARKERS = _CELLS + """
, cl AS (SELECT s_suppkey AS cell, s_nationkey % 4 AS cluster FROM supplier), fl AS (SELECT cl.cell, cluster, g.gene, coalesce(value, 0) AS x FROM cl CROSS JOIN (SELECT DISTINCT gene FROM v) g LEFT JOIN v ON v.cell = cl.cell AND v.gene = g.gene),
rk AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY x) + (count(*) OVER (PARTITION BY gene, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene, x) AS tie FROM fl),
ag AS (SELECT gene, cluster, sum(r) AS r, count(*) AS n1, avg(x) AS mx FROM rk GROUP BY 1, 2), tt AS (SELECT gene, sum(tie * tie - 1.0) AS ties, count(*) AS n FROM rk GROUP BY 1),
z AS (SELECT gene, cluster, mx, (r - n1 * (n1 + 1) / 2.0 - n1 * (n - n1) / 2.0) / sqrt(n1 * (n - n1) / 12.0 * (n + 1 - ties / (n * (n - 1.0)))) AS z FROM ag JOIN tt USING (gene))
"""


@query("marker_genes", _MARKERS + "SELECT gene, cluster, round(mx, 6) AS mean_value, round(z, 5) AS z, round(" + S.normal_p("z") + ", 5) AS p_value FROM z")
def _markers(t):
    out = cells.marker_tests(cells.log_normalized(cell_counts(t)), cell_clusters(t))
    return rounded(out, "gene", "cluster", mean_value="mean_value", z=F.round("z", 5), p_value=F.round("p_value", 5))


@query("top_marker_genes", _MARKERS + "SELECT cluster, gene, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(z, 6) DESC, gene) AS rank FROM z) WHERE rank <= 10")
def _top_markers(t):
    tests = cells.marker_tests(cells.log_normalized(cell_counts(t)), cell_clusters(t)).withColumn("z", F.round("z", 6))
    return cells.top_markers(tests, 10).select("cluster", "gene", "rank")


@query("cell_report", _CELLS + """
, k1 AS (SELECT * FROM c WHERE cell IN (SELECT cell FROM c GROUP BY 1 HAVING count(*) >= 255)), k2 AS (SELECT * FROM k1 WHERE gene IN (SELECT gene FROM k1 GROUP BY 1 HAVING count(*) >= 50)),
k3 AS (SELECT * FROM k2 WHERE cell IN (SELECT cell FROM k2 GROUP BY 1 HAVING coalesce(sum(n) FILTER (gene::VARCHAR LIKE '7%'), 0) * 100 / sum(n) < 4))
SELECT (SELECT count(DISTINCT cell) FROM c) AS cells_before, (SELECT count(DISTINCT gene) FROM c) AS genes_before, (SELECT count(DISTINCT cell) FROM k3) AS cells_after, (SELECT count(DISTINCT gene) FROM k3) AS genes_after,
(SELECT count(DISTINCT s_nationkey % 4) FROM supplier) AS clusters
""")
def _cell_report(t):
    raw = cell_counts(t)
    return cells.report(raw, cells.quality_filter(raw, 255, 50, 4.0, "7"), cell_clusters(t))


@query("cell_workflow")
def _workflow(t):
    values = cut_lineage(cells.log_normalized(cells.quality_filter(cell_counts(t), 100, 3, 5.0, "7")))
    genes = [r["gene"] for r in cells.highly_variable(values, 50).collect()]
    wide = learning.with_vector(cells.cell_vectors(cells.scaled(values), genes), "features", "v")
    features = cut_lineage(wide.select("cell", F.col("v").alias("features")))
    coordinates, _ = learning.principal_components(features, 10)
    return learning.kmeans(coordinates.select("cell", F.col("pc").alias("features")), 4).select("cell", "cluster")


# ---- streams -----------------------------------------------------------------------------------------------------


def event_stream(t, name):
    """The table, one file or a folder of files, as a file stream with its batch schema."""
    # a stream takes the path of one file only as a pattern
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.folder}/{name[:-1]}[{name[-1]}].parquet")


@query("stream_run_log_windows", """
WITH w AS (SELECT date_trunc('hour', ts) AS h, count(*) AS steps, sum(value) AS v, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, steps, round(v, 4) AS total_ms, errors FROM w WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
""")
def _stream(t):
    log = event_stream(t, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("duration_ms"), F.col("event_type").alias("status"))
    out = streaming.drain(streaming.run_log_windows(log), "run-log-windows")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "steps", F.round("total_ms", 4).alias("total_ms"), "errors")


@query("stream_read_quality", """
, s AS (SELECT lang AS sample, unnest(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS q FROM reads JOIN documents ON doc_id = read_id)
SELECT sample, count(*) AS bases, round(avg(q), 6) AS quality_mean, round(count(*) FILTER (q >= 20) * 100.0 / count(*), 6) AS percent_q20, round(count(*) FILTER (q >= 30) * 100.0 / count(*), 6) AS percent_q30 FROM s GROUP BY 1
""", uses="reads")
def _stream_quality(t):
    from .inputs import LETTERS, QUALITIES

    docs = event_stream(t, "documents")
    reads = docs.select(F.col("lang").alias("sample"), F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, QUALITIES).alias("qual"))
    hist = streaming.drain(streaming.quality_histogram(reads), "read-quality", complete=True)
    out = streaming.quality_from_histogram(hist)
    return rounded(out, "sample", "bases", quality_mean="quality_mean", percent_q20="percent_q20", percent_q30="percent_q30")


# ---- user functions ----------------------------------------------------------------------------------------------


@query("map_items_outcome", """
SELECT count(*) AS items, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) <> 0) AS completed, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) = 0) AS failed FROM events
""")
def _map_items(t):
    df = t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return mapping.outcome_counts(mapping.map_items(df, lambda k: 100.0 / int(k), "double", "k"))

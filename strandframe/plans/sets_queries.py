"""Registered queries: sets, enrichment, ontology, networks, record tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered, sets, tables
from . import sql_stats as S
from .catalog import query
from .coordinates_queries import points
from .matrix_queries import rounded


def named(t):
    """Sets of orders by flags, one of orders no other set holds; names hold the sign that joins them in the result."""
    flags = t.lineitem.select(F.concat_ws("&", "l_returnflag", "l_linestatus").alias("set_name"), F.col("l_orderkey").alias("element"))
    return flags.unionByName(t.lineitem.select(F.lit("none & other").alias("set_name"), (-F.col("l_orderkey")).alias("element")))


_SETS = "WITH s AS (SELECT DISTINCT l_returnflag || '&' || l_linestatus AS set_name, l_orderkey AS element FROM lineitem UNION SELECT 'none & other', -l_orderkey FROM lineitem)"


@query("set_memberships", _SETS + ", c AS (SELECT element, string_agg(set_name, '&' ORDER BY set_name) AS combination FROM s GROUP BY 1) SELECT combination, count(*) AS elements FROM c GROUP BY 1")
def _memberships(t):
    return sets.memberships(named(t))


@query("set_pairs", _SETS + """
, n AS (SELECT set_name, count(*) AS n FROM s GROUP BY 1),
q AS (SELECT a.set_name AS set1, b.set_name AS set2, count(*) AS shared FROM s a JOIN s b ON a.element = b.element AND a.set_name < b.set_name GROUP BY 1, 2),
p AS (SELECT a.set_name AS set1, b.set_name AS set2, coalesce(shared, 0) AS shared FROM n a JOIN n b ON a.set_name < b.set_name LEFT JOIN q ON set1 = a.set_name AND set2 = b.set_name)
SELECT set1, set2, shared, x.n + y.n - shared AS "union", round(shared * 1.0 / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN n x ON x.set_name = set1 JOIN n y ON y.set_name = set2
""")
def _pairs(t):
    return rounded(sets.set_pairs(named(t)), "set1", "set2", "shared", "union", jaccard="jaccard")


@query("set_sizes", _SETS + """
, k AS (SELECT element, count(*) AS k FROM s GROUP BY 1) SELECT set_name, count(*) AS size, count(*) FILTER (k = 1) AS "unique" FROM s JOIN k USING (element) GROUP BY 1
""")
def _sizes(t):
    return sets.set_sizes(named(t))


@query("set_intersection", "SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def _intersection(t):
    a, b = (t.lineitem.filter(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("id")) for f in "AR")
    return a.intersect(b)


@query("set_difference", "SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def _difference(t):
    a, b = (t.lineitem.filter(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("id")) for f in "AR")
    return a.subtract(b)


@query("set_union", "SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def _union(t):
    a, b = (t.lineitem.filter(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("id")) for f in "AR")
    return a.unionByName(b).distinct()


def annotations(t):
    return t.part.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene"))


def study(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("q")).filter("q > 850").select("gene")


_ORA = """
WITH st AS (SELECT l_partkey AS gene FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 850), k AS (SELECT count(*) AS n FROM st JOIN part ON p_partkey = gene), b AS (SELECT count(*) AS n FROM part),
t AS (SELECT p_brand AS term, count(*) FILTER (p_partkey IN (SELECT gene FROM st)) AS "count", count(*) AS term_size FROM part GROUP BY 1),
p AS (SELECT t.*, k.n AS sn, b.n AS bn, """ + S.hypergeometric_p('"count"', "term_size", "k.n", "b.n") + """ AS p FROM t, k, b)
"""


@query("over_representation", _ORA + """
, r AS (SELECT *, round(p, 9) * count(*) OVER () / row_number() OVER (ORDER BY round(p, 9), term) AS raw FROM p)
SELECT term, "count", term_size, round("count" * 1.0 / sn / (term_size * 1.0 / bn), 6) AS enrichment, round(p, 6) AS p_value,
round(least(1.0, min(raw) OVER (ORDER BY round(p, 9), term ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 5) AS p_adjusted FROM r
""")
def _ora(t):
    out = sets.over_representation(annotations(t), study(t), annotations(t))
    return rounded(out, "term", "count", "term_size", enrichment="enrichment", p_value="p_value", p_adjusted=F.round("p_adjusted", 5))


@query("over_representation_bonferroni", _ORA + 'SELECT term, round(least(1.0, p * count(*) OVER ()), 5) AS p_adjusted FROM p')
def _ora_bonferroni(t):
    out = sets.over_representation(annotations(t), study(t), annotations(t), correction="bonferroni")
    return rounded(out, "term", digits=5, p_adjusted="p_adjusted")


def ranking(t):
    q = t.lineitem.groupBy(F.col("l_partkey").alias("gene")).agg((F.sum("l_quantity") - 765).alias("score"))
    return ordered.running_score(q, "score", "gene").select("gene", "rank", "score")


_RANKING = "WITH q AS (SELECT l_partkey AS gene, sum(l_quantity) - 765 AS score FROM lineitem GROUP BY 1), rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, gene) AS rank FROM q)"


@query("gene_ranking", _RANKING + " SELECT gene, rank, score FROM rk")
def _ranking(t):
    return ranking(t)


@query("enrichment_score", _RANKING + """
, tm AS (SELECT p_brand AS term, count(*) AS k, sum(abs(score)) AS mass FROM part JOIN q ON gene = p_partkey GROUP BY 1),
w AS (SELECT term, k, sum(CASE WHEN p_brand = term THEN abs(score) / mass ELSE -1.0 / ((SELECT count(*) FROM q) - k) END) OVER (PARTITION BY term ORDER BY rank) AS run FROM rk JOIN part ON p_partkey = gene CROSS JOIN tm),
e AS (SELECT term, k, max(run) AS hi, min(run) AS lo FROM w GROUP BY 1, 2)
SELECT term, k AS size, round(CASE WHEN hi >= -lo THEN hi ELSE lo END, 6) AS es FROM e
""")
def _es(t):
    return rounded(sets.enrichment_score(annotations(t), ranking(t), 1, 1_000_000), "term", "size", es="es")


_GSEA = _RANKING + """
, tm AS (SELECT p_brand AS term, count(*) AS k, sum(abs(score)) AS mass FROM part JOIN q ON gene = p_partkey GROUP BY 1), total AS (SELECT count(*) AS n FROM q),
ow AS (SELECT p_brand AS term, k, rank, row_number() OVER w AS i, abs(score) / mass AS step, sum(abs(score)) OVER w / mass AS up FROM part JOIN rk ON gene = p_partkey JOIN tm ON p_brand = term WINDOW w AS (PARTITION BY p_brand ORDER BY rank)),
oe AS (SELECT term, k, max(up - (rank - i) / (n - k)) AS hi, min(up - step - (rank - i) / (n - k)) AS lo FROM ow, total GROUP BY 1, 2), es AS (SELECT term, k, CASE WHEN hi >= -lo THEN hi ELSE lo END AS es FROM oe),
d AS (SELECT perm, rank, abs(score) AS w, row_number() OVER (PARTITION BY perm ORDER BY md5('42:' || perm || ':' || rank)) AS place FROM rk, range(1, 1001) AS r(perm)),
h AS (SELECT k, perm, rank, w FROM d JOIN (SELECT DISTINCT k FROM tm) ON place <= k),
nw AS (SELECT k, perm, rank, w / sum(w) OVER (PARTITION BY k, perm) AS step, row_number() OVER x AS i, sum(w) OVER x / sum(w) OVER (PARTITION BY k, perm) AS up FROM h WINDOW x AS (PARTITION BY k, perm ORDER BY rank)),
ne AS (SELECT k, perm, max(up - (rank - i) / (n - k)) AS hi, min(up - step - (rank - i) / (n - k)) AS lo FROM nw, total GROUP BY 1, 2), null_es AS (SELECT k, CASE WHEN hi >= -lo THEN hi ELSE lo END AS x FROM ne),
g AS (SELECT term, es.k, es, avg(abs(x)) FILTER (sign(x) = sign(es)) AS m, count(*) FILTER (sign(x) = sign(es)) AS c, count(*) FILTER (sign(x) = sign(es) AND abs(x) >= abs(es)) AS far FROM es JOIN null_es USING (k) GROUP BY 1, 2, 3),
p AS (SELECT term, k, es, es / m AS nes, far / greatest(c, 1) AS p FROM g), f AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM p)
SELECT term, k AS size, round(es, 6) AS es, round(nes, 5) AS nes, round(p, 6) AS p_value, round(least(1.0, min(raw) OVER (ORDER BY p DESC)), 5) AS fdr FROM f
"""


@query("preranked_enrichment", _GSEA)
def _gsea(t):
    out = sets.preranked_gsea(annotations(t), ranking(t), min_size=1, max_size=1_000_000)
    return rounded(out, "term", "size", es="es", nes=F.round("nes", 5), p_value="p_value", fdr=F.round("fdr", 5))


def ontology(t):
    n = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return n.unionByName(c)


_EDGES = "WITH e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


@query("ontology_ancestors", _EDGES.replace("WITH", "WITH RECURSIVE") + ", a AS (SELECT child AS origin, child AS node, 0 AS depth FROM e UNION SELECT origin, parent, depth + 1 FROM a JOIN e ON e.child = a.node) SELECT origin, node, min(depth)::INTEGER AS depth FROM a GROUP BY 1, 2")
def _ancestors(t):
    e = ontology(t)
    return sets.closure(e, e.select(F.col("child").alias("node")))


@query("ontology_descendants", _EDGES.replace("WITH", "WITH RECURSIVE") + ", a AS (SELECT DISTINCT parent AS origin, parent AS node, 0 AS depth FROM e WHERE parent LIKE 'r%' UNION SELECT origin, child, depth + 1 FROM a JOIN e ON e.parent = a.node WHERE depth < 1) SELECT origin, node, min(depth)::INTEGER AS depth FROM a GROUP BY 1, 2")
def _descendants(t):
    e = ontology(t)
    return sets.closure(e, e.filter("parent LIKE 'r%'").select(F.col("parent").alias("node")), max_depth=1, from_col="parent", to_col="child")


@query("term_search", "SELECT p_partkey AS term_id, p_name AS name FROM part WHERE contains(lower(p_name), 'red')")
def _search(t):
    return sets.search_terms(t.part.select(F.col("p_partkey").alias("term_id"), F.col("p_name").alias("name")), "Red")


def graph(t):
    return t.lineitem.select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") % 2000).alias("dst"))


_GRAPH = """
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT least(l_partkey, l_orderkey % 2000) AS a, greatest(l_partkey, l_orderkey % 2000) AS b FROM lineitem WHERE l_partkey <> l_orderkey % 2000),
d AS MATERIALIZED (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1),
tr AS MATERIALIZED (SELECT x.a AS n1, x.b AS n2, y.b AS n3 FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b),
tn AS (SELECT node, count(*) AS triangles FROM (SELECT n1 AS node FROM tr UNION ALL SELECT n2 FROM tr UNION ALL SELECT n3 FROM tr) GROUP BY 1)
"""


@query("degree_distribution", _GRAPH + "SELECT degree, count(*) AS nodes FROM d GROUP BY 1")
def _degrees(t):
    return sets.degree_distribution(graph(t))


@query("triangles", _GRAPH + "SELECT node, triangles FROM tn")
def _triangles(t):
    return sets.triangles(graph(t))


@query("network_summary", _GRAPH + """
, r AS (SELECT min(node) AS n FROM d UNION SELECT CASE WHEN e.a = r.n THEN e.b ELSE e.a END FROM r JOIN e ON e.a = r.n OR e.b = r.n),
c AS (SELECT degree, CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (degree * (degree - 1) / 2.0) ELSE 0 END AS c FROM d LEFT JOIN tn USING (node))
SELECT count(*) AS nodes, (sum(degree) / 2)::BIGINT AS edges, round(sum(degree) * 1.0 / (count(*) * (count(*) - 1.0)), 6) AS density, round(sum(degree) * 1.0 / count(*), 6) AS mean_degree,
(SELECT count(*) FROM r) = count(*) AS connected, round(avg(c), 6) AS clustering FROM c
""")
def _network(t):
    return rounded(sets.network_summary(graph(t)), "nodes", "edges", "connected", density="density", mean_degree="mean_degree", clustering="clustering")


def blocks(t):
    """An edge for every event; its ends lie in the same block of 97 ids, so the graph stays in pieces without leaving rows out."""
    back = F.col("user_id") % (F.col("event_id") % 97 + 1)
    return t.events.select(F.col("event_id").alias("src"), (F.col("event_id") - back).alias("dst"))


_COMPONENTS = """
WITH RECURSIVE e AS MATERIALIZED (SELECT event_id AS a, event_id - user_id % (event_id % 97 + 1) AS b FROM events WHERE user_id % (event_id % 97 + 1) <> 0),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, l) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.l FROM r JOIN u ON u.a = r.n WHERE r.l <= u.b)
SELECT n AS node, min(l) AS component FROM r GROUP BY 1
"""


@query("connected_components", _COMPONENTS)
def _components(t):
    return sets.components(blocks(t))


@query("connected_components_all", _COMPONENTS)
def _components_all(t):
    return sets.components(blocks(t))


@query("pathway_overlay", """
WITH x AS (SELECT l_partkey AS node, sum(l_quantity) / 4000 AS e FROM lineitem GROUP BY 1)
SELECT p_partkey AS node, round(greatest(0, least(1, coalesce(e, 0)))::DOUBLE, 6) AS expression FROM part LEFT JOIN x ON node = p_partkey
""")
def _overlay(t):
    x = t.lineitem.groupBy(F.col("l_partkey").alias("node")).agg((F.sum("l_quantity") / 4000).alias("expression"))
    return rounded(sets.overlay(t.part.select(F.col("p_partkey").alias("node")), x), "node", expression="expression")


@query("synteny_score", """
WITH g AS (SELECT p_partkey AS x, (p_partkey * 7919) % 100003 AS y FROM part), c AS (SELECT count(*) AS c FROM g a JOIN g b ON a.x < b.x AND a.y < b.y), n AS (SELECT count(*) AS n FROM g)
SELECT n AS genes, c AS collinear, round(c / (n * (n - 1) / 2.0), 6) AS score FROM c, n
""")
def _synteny(t):
    a = t.part.select(F.col("p_partkey").alias("gene"), F.col("p_partkey").alias("pos"))
    b = t.part.select(F.col("p_partkey").alias("gene"), (F.col("p_partkey") * 7919 % 100003).alias("pos"))
    return rounded(sets.synteny(a, b), "genes", "collinear", score="score")


# ---- record tables -----------------------------------------------------------------------------------------------


def run_log(t):
    return t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("step_id"), F.col("value").alias("duration_ms"), F.col("event_type").alias("status"), "ts", "props")


@query("run_log_rollup", """
SELECT coalesce(user_id, -1) AS session, count(*) AS steps, round(sum(value), 4) AS total_ms, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ROLLUP (user_id)
""")
def _log(t):
    out = tables.run_log_rollup(run_log(t)).withColumn("session", F.coalesce("session", F.lit(-1)))
    return rounded(out, "session", "steps", "succeeded", "errors", digits=4, total_ms="total_ms")


@query("run_log_params", "SELECT event_id AS step_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour FROM events")
def _params(t):
    return run_log(t).select("step_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"))


@query("annotation_summary", """
, a AS (SELECT chrom, name % 4 AS feature, start, "end" FROM intervals)
SELECT coalesce(feature, -1) AS feature, count(*) AS records, sum("end" - start + 1)::BIGINT AS bases, round(avg("end" - start + 1), 6) AS mean_length, count(DISTINCT chrom) AS chromosomes FROM a GROUP BY ROLLUP (a.feature)
""", uses="intervals")
def _annotation(t):
    df = t.intervals.withColumn("feature", F.col("name") % 4)
    out = tables.annotation_summary(df).withColumn("feature", F.coalesce("feature", F.lit(-1)))
    return rounded(out, "feature", "records", "bases", "chromosomes", mean_length="mean_length")


@query("record_lengths", 'SELECT name, "end" - start AS bed_length, "end" - start + 1 AS gff_length FROM intervals', uses="intervals")
def _lengths(t):
    bed = tables.with_length(t.intervals, closed=False).withColumnRenamed("length", "bed_length")
    return tables.with_length(bed, closed=True).select("name", "bed_length", F.col("length").alias("gff_length"))


@query("structure_rmsd", """
WITH a AS (SELECT label AS structure, sqrt(avg((embedding[1]::DOUBLE * 40 - embedding[4]::DOUBLE * 40)**2 + (embedding[2]::DOUBLE * 40 - embedding[5]::DOUBLE * 40)**2 + (embedding[3]::DOUBLE * 40 - embedding[6]::DOUBLE * 40)**2)) AS r, count(*) AS atoms FROM embeddings GROUP BY 1)
SELECT structure, round(r, 6) AS rmsd, atoms FROM a
""")
def _rmsd(t):
    a, b = (points(t, k).withColumnRenamed("vec_id", "serial") for k in (0, 3))
    return rounded(tables.rmsd(a, b), "structure", "atoms", rmsd="rmsd")


@query("radius_of_gyration", """
WITH a AS (SELECT label AS structure, 1 + vec_id % 3 AS m, embedding[1]::DOUBLE * 40 AS x, embedding[2]::DOUBLE * 40 AS y, embedding[3]::DOUBLE * 40 AS z FROM embeddings),
c AS (SELECT structure, sum(m * x) / sum(m) AS cx, sum(m * y) / sum(m) AS cy, sum(m * z) / sum(m) AS cz FROM a GROUP BY 1)
SELECT structure, round(sqrt(sum(m * ((x - cx)**2 + (y - cy)**2 + (z - cz)**2)) / sum(m)), 6) AS radius FROM a JOIN c USING (structure) GROUP BY 1
""")
def _gyration(t):
    return rounded(tables.radius_of_gyration(points(t, 0).withColumn("mass", 1 + F.col("vec_id") % 3)), "structure", radius="radius")


@query("structure_summary", """
SELECT label AS structure, count(*) AS atoms, count(DISTINCT (vec_id % 3, vec_id // 7)) AS residues, count(DISTINCT vec_id % 3) AS chains, round(avg(embedding[10]::DOUBLE), 6) AS mean_confidence FROM embeddings GROUP BY 1
""")
def _structure(t):
    df = t.embeddings.select(F.col("label").alias("structure"), (F.col("vec_id") % 3).alias("chain"), F.floor(F.col("vec_id") / 7).alias("resseq"), F.col("embedding")[9].cast("double").alias("bfactor"))
    return rounded(tables.structure_summary(df), "structure", "atoms", "residues", "chains", mean_confidence="mean_confidence")


@query("sequence_errors", """
, u AS (SELECT seq_id, upper(letters) AS s FROM letters)
SELECT seq_id, coalesce(array_to_string(list_filter([CASE WHEN length(s) < 20 THEN 'shorter than 20' END, CASE WHEN length(translate(s, 'ATCGN', '')) > 0 THEN
'invalid characters: ' || array_to_string(list_sort(list_distinct(string_split(translate(s, 'ATCGN', ''), ''))), '') END], lambda x: x IS NOT NULL), ';'), '') AS errors FROM u
""", uses="letters")
def _seq_errors(t):
    return t.letters.select("seq_id", F.array_join(tables.sequence_errors("letters", "dna", 20), ";").alias("errors"))


@query("range_errors", "SELECT o_orderkey AS id, CASE WHEN o_totalprice < 1000 THEN 'below 1000' WHEN o_totalprice > 400000 THEN 'above 400000' ELSE '' END AS errors FROM orders")
def _range(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.array_join(tables.range_errors("o_totalprice", 1000, 400000), ";").alias("errors"))


@query("variant_errors", "SELECT id, CASE WHEN regexp_matches(ref, '[^ACGTN]') THEN 'invalid reference allele' ELSE '' END AS errors FROM variants", uses="variants")
def _variant_errors(t):
    return t.variants.select("id", F.array_join(tables.vcf_errors(), ";").alias("errors"))


@query("read_errors", "SELECT read_id, CASE WHEN length(seq) = 0 THEN 'empty sequence' WHEN length(seq) <> length(qual) THEN 'sequence and quality differ in length' ELSE '' END AS errors FROM reads", uses="reads")
def _read_errors(t):
    return t.reads.select("read_id", F.array_join(tables.fastq_errors(), ";").alias("errors"))


_DESCRIBED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("describe_columns", " UNION ALL ".join(
    f"SELECT '{name}' AS summary, " + ", ".join(f"round({f}({c})::DOUBLE, 6) AS {c}" for c in _DESCRIBED) + " FROM lineitem"
    for name, f in (("count", "count"), ("mean", "avg"), ("stddev", "stddev_samp"), ("min", "min"), ("max", "max"))
))
def _describe(t):
    out = t.lineitem.select(*_DESCRIBED).summary("count", "mean", "stddev", "min", "max")
    return out.select("summary", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in _DESCRIBED])


@query("downsample", "SELECT event_id, value FROM events ORDER BY md5(event_id || ':0'), event_id LIMIT 5000")
def _downsample(t):
    return tables.downsample(t.events.select("event_id", "value"), "event_id", 5000)


@query("report_class_counts", "SELECT event_type AS class, count(*) AS n, count(*) FILTER (value > 50) AS high FROM events GROUP BY 1")
def _classes(t):
    return t.events.groupBy(F.col("event_type").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"))

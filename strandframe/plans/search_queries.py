"""Registered queries: k-mer joins, overlaps, distances, aligned columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna as D
from ..functions import pairwise
from ..operators import columns, search
from .catalog import query
from .matrix_queries import rounded


def _words(source: str, id: str, k: int, seq: str = "seq") -> str:
    return f"(SELECT {id}, pos, substr({seq}, pos + 1, {k}) AS word FROM (SELECT {id}, {seq}, unnest(range(0, greatest(length({seq}) - {k - 1}, 0))) AS pos FROM {source}))"


_HITS = f"""
, qw AS MATERIALIZED {_words('probes', 'probe_id', 15)}, sw AS MATERIALIZED {_words('dna', 'seq_id', 15)},
hit AS MATERIALIZED (SELECT probe_id, seq_id, s.pos - q.pos AS diagonal, count(*) AS seeds, min(q.pos) AS first_pos FROM qw q JOIN sw s USING (word) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe_id, seq_id ORDER BY seeds DESC, diagonal) AS rn FROM hit) WHERE rn = 1)
"""


@query("seed_diagonals", _HITS + "SELECT * FROM hit", uses="dna probes")
def _diagonals(t):
    return search.diagonals(t.probes, t.dna, "probe_id", "seq_id")


_SEARCH = _HITS + """
, al AS (SELECT b.*, q.seq AS qs, s.seq AS ss, least(length(q.seq) - first_pos, length(s.seq) - first_pos - diagonal, 500) AS n FROM best b JOIN probes q USING (probe_id) JOIN dna s USING (seq_id)),
sc AS (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN qs[first_pos + i] = ss[first_pos + diagonal + i] THEN 1 ELSE 0 END))::BIGINT AS m FROM al),
ev AS (SELECT *, 2 * m - n AS score, CASE WHEN 2 * m - n <= 0 THEN 1.0 ELSE 0.133 * (SELECT sum(length(seq)) FROM dna) * greatest(length(qs) - 14, 1) * exp(-0.332 * (2 * m - n)) END AS e FROM sc),
res AS (SELECT probe_id, seq_id, seeds, first_pos + 1 AS query_start, first_pos + diagonal + 1 AS subject_start, n AS aligned, m AS matches, score, e, m * 100.0 / n AS identity FROM ev WHERE e <= 1e-5)
"""


@query("seed_search", _SEARCH + "SELECT probe_id, seq_id, seeds, query_start, subject_start, aligned, matches, score, round(e * 1e6, 6) AS e_value, round(identity, 6) AS identity FROM res", uses="dna probes")
def _search(t):
    out = search.search(t.probes, t.dna, "probe_id", "seq_id")
    return out.select("probe_id", "seq_id", "seeds", "query_start", "subject_start", "aligned", "matches", "score", F.round(F.col("e_value") * 1e6, 6).alias("e_value"), F.round("identity", 6).alias("identity"))


@query("top_hits_per_query", _SEARCH + "SELECT probe_id, seq_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, seq_id) AS rank FROM res) WHERE rank <= 5", uses="dna probes")
def _top_hits(t):
    out = search.top_hits(search.search(t.probes, t.dna, "probe_id", "seq_id"), "probe_id", [F.desc("score"), F.col("seq_id")], 5)
    return out.select("probe_id", "seq_id", "score", "rank")


_MAP = f"""
, qw AS MATERIALIZED {_words('probes', 'probe_id', 15)}, sw AS MATERIALIZED {_words('dna', 'seq_id', 15)},
hit AS (SELECT seq_id, probe_id, q.pos - s.pos AS diagonal, count(*) AS seeds, min(s.pos) AS first_pos FROM sw s JOIN qw q USING (word) GROUP BY ALL HAVING count(*) >= 3),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY seeds DESC, probe_id, diagonal) AS rn FROM hit) WHERE rn = 1),
mp AS (SELECT d.seq_id, coalesce(probe_id::VARCHAR, '*') AS reference, CASE WHEN seeds IS NULL THEN 0 ELSE first_pos + diagonal END AS position, CASE WHEN seeds IS NULL THEN '*' ELSE length(seq) || 'M' END AS cigar,
CASE WHEN seeds IS NULL THEN 0 ELSE 60 END AS mapping_quality, CASE WHEN seeds IS NULL THEN 0 ELSE 2 * seeds END AS score FROM dna d LEFT JOIN best b ON b.seq_id = d.seq_id)
"""


@query("map_reads", _MAP + "SELECT * FROM mp", uses="dna probes")
def _map(t):
    return search.map_reads(t.dna, t.probes, "seq_id", "probe_id")


@query("mapping_report", _MAP + """
SELECT count(*) AS total_reads, count(*) FILTER (reference <> '*') AS mapped_reads, round(count(*) FILTER (reference <> '*') * 100.0 / count(*), 6) AS mapping_rate,
avg(mapping_quality) FILTER (reference <> '*') AS mean_mapping_quality FROM mp
""", uses="dna probes")
def _map_report(t):
    return rounded(search.mapping_report(search.map_reads(t.dna, t.probes, "seq_id", "probe_id")), "total_reads", "mapped_reads", "mean_mapping_quality", mapping_rate="mapping_rate")


_TAXA = f"""
, mk AS (SELECT word, taxon, count(*) AS times FROM (SELECT word, 'taxon' || probe_id % 7 AS taxon FROM {_words('probes', 'probe_id', 16)}) GROUP BY 1, 2),
vt AS (SELECT seq_id, taxon, sum(times) AS v FROM {_words('dna', 'seq_id', 16)} JOIN mk USING (word) GROUP BY 1, 2),
bs AS (SELECT seq_id, taxon FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY v DESC, taxon) AS rn FROM vt) WHERE rn = 1)
"""


@query("classify_reads", _TAXA + "SELECT seq_id, coalesce(taxon, 'Unknown') AS taxon FROM dna LEFT JOIN bs USING (seq_id)", uses="dna probes")
def _classify(t):
    labelled = t.probes.select(F.concat(F.lit("taxon"), F.col("probe_id") % 7).alias("taxon"), "seq")
    return search.classify(t.dna, search.marker_words(labelled, "taxon", 16), "seq_id", 16)


_QUANT = f"""
, mk AS (SELECT word, probe_id, count(*) AS times FROM {_words('probes', 'probe_id', 31)} GROUP BY 1, 2),
vt AS (SELECT seq_id, probe_id, sum(times) AS v FROM {_words('dna', 'seq_id', 31)} JOIN mk USING (word) GROUP BY 1, 2),
bs AS (SELECT probe_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY v DESC, probe_id) AS rn FROM vt) WHERE rn = 1 AND v >= 2 GROUP BY 1),
qr AS (SELECT probe_id, coalesce(n, 0) AS num_reads, coalesce(n, 0) * 1.0 / length(seq) AS rate FROM probes LEFT JOIN bs USING (probe_id))
"""


@query("pseudo_alignment", _QUANT + "SELECT probe_id, num_reads, round(rate / sum(rate) OVER () * 1e6, 4) AS tpm FROM qr", uses="dna probes")
def _quantify(t):
    return rounded(search.quantify(t.dna, t.probes, "seq_id", "probe_id"), "probe_id", "num_reads", digits=4, tpm="tpm")


@query("merge_quantifications", """
SELECT feature AS transcript_id, """ + ", ".join(f"coalesce(sum(\"count\") FILTER (sample = '{s}'), 0) AS \"{s}\"" for s in ("AF", "AO", "NF", "NO", "RF", "RO")) + " FROM counts GROUP BY 1", uses="counts")
def _merge(t):
    return search.merge_quantifications(t.counts, ["AF", "AO", "NF", "NO", "RF", "RO"], "feature", value="count").withColumnRenamed("feature", "transcript_id")


@query("dotplot", f"""
SELECT probe_id, seq_id, count(*) AS dots, sum(a.pos)::BIGINT AS sum_i, sum(b.pos)::BIGINT AS sum_j FROM {_words('probes', 'probe_id', 12)} a JOIN {_words('dna', 'seq_id', 12)} b USING (word) GROUP BY 1, 2
""", uses="dna probes")
def _dotplot(t):
    return search.dotplot(t.probes, t.dna, "probe_id", "seq_id", 12).groupBy("probe_id", "seq_id").agg(
        F.count(F.lit(1)).alias("dots"), F.sum("i").alias("sum_i"), F.sum("j").alias("sum_j")
    )


_OVERLAP = f"""
, u AS MATERIALIZED (SELECT min(seq_id) AS id, seq FROM dna WHERE length(seq) >= 15 GROUP BY seq), uw AS MATERIALIZED {_words('u', 'id', 15)},
cand AS MATERIALIZED (SELECT w.id AS src, w.pos, r.id AS dst FROM uw w JOIN u r ON w.word = left(r.seq, 15) AND w.id <> r.id),
ov AS (SELECT src, dst, max(length(a.seq) - pos) AS overlap FROM cand JOIN u a ON a.id = src JOIN u b ON b.id = dst WHERE starts_with(b.seq, substr(a.seq, pos + 1)) GROUP BY 1, 2)
"""


@query("suffix_prefix_overlaps", _OVERLAP + "SELECT src, dst, overlap FROM ov", uses="dna")
def _overlaps(t):
    return search.overlaps(t.dna, "seq_id").select("src", "dst", F.col("overlap").cast("long").alias("overlap"))


@query("unitigs")
def _unitigs(t):
    e = t.events.select(F.col("event_id").alias("src"), (F.col("event_id") + 1 + F.col("user_id") % 2).alias("dst"))
    return search.unitigs(e)


@query("kmer_similarity", f"""
, u AS (SELECT min(seq_id) AS id, seq FROM dna GROUP BY seq), w AS MATERIALIZED (SELECT DISTINCT id, word FROM {_words('u', 'id', 8)}), n AS (SELECT id, count(*) AS n FROM w GROUP BY 1),
p AS (SELECT a.id AS id1, b.id AS id2, count(*) AS s FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY 1, 2)
SELECT id1, id2, round(s * 1.0 / (x.n + y.n - s), 6) AS similarity FROM p JOIN n x ON x.id = id1 JOIN n y ON y.id = id2 WHERE s * 1.0 / (x.n + y.n - s) >= 0.5 - 1e-12
""", uses="dna")
def _jaccard(t):
    return rounded(search.kmer_jaccard(t.dna, "seq_id", 8, 0.5), "id1", "id2", similarity="similarity")


def tags(t):
    return t.events.select(
        F.col("event_id").alias("tag"), F.substring(F.translate(F.md5((F.col("event_id") % 997).cast("string")), "0123456789abcdef", "AAAACCCCGGGGTTTT"), 1, 12).alias("seq")
    )


def edited_tags(t):
    """Tags of 20 letters, the same for three events in a row but for one letter, so that pairs grow with the table."""
    e = F.col("event_id")
    tag = F.substring(F.translate(F.md5(F.floor(e / 3).cast("string")), "0123456789abcdef", "AAAACCCCGGGGTTTT"), 1, 20)
    place = (e % 3 * 6).cast("int")
    return t.events.select(e.alias("tag"), F.concat(F.substring(tag, F.lit(1), place), F.lit("A"), F.substring(tag, place + 2, F.lit(20))).alias("seq"))


_EDITED = """
WITH t AS (SELECT event_id, substr(translate(md5((event_id // 3)::VARCHAR), '0123456789abcdef', 'AAAACCCCGGGGTTTT'), 1, 20) AS s, event_id % 3 * 6 AS p FROM events),
u AS MATERIALIZED (SELECT min(event_id) AS id, substr(s, 1, p) || 'A' || substr(s, p + 2) AS seq FROM t GROUP BY 2)
"""


@query("p_distance_within_all", _EDITED + """
, k AS (SELECT id, seq, unnest([0, 1, 2, 3]) AS k FROM u), g AS (SELECT id, k, substr(seq, k * 5 + 1, 5) AS part FROM k), c AS (SELECT DISTINCT a.id AS id1, b.id AS id2 FROM g a JOIN g b ON a.k = b.k AND a.part = b.part AND a.id < b.id),
p AS (SELECT id1, id2, list_sum(list_transform(range(1, 21), lambda i: CASE WHEN x.seq[i] <> y.seq[i] THEN 1 ELSE 0 END)) AS d FROM c JOIN u x ON x.id = id1 JOIN u y ON y.id = id2)
SELECT id1, id2, round(d / 20.0, 6) AS distance FROM p WHERE d <= 3
""")
def _p_within_all(t):
    return rounded(search.p_distance_within(edited_tags(t), "tag", 3), "id1", "id2", distance="distance")


@query("p_distance_within", """
WITH u AS (SELECT min(event_id) AS id, substr(translate(md5((event_id % 997)::VARCHAR), '0123456789abcdef', 'AAAACCCCGGGGTTTT'), 1, 12) AS seq FROM events GROUP BY 2),
p AS (SELECT a.id AS id1, b.id AS id2, list_sum(list_transform(range(1, 13), lambda i: CASE WHEN a.seq[i] <> b.seq[i] THEN 1 ELSE 0 END)) AS d FROM u a JOIN u b ON a.id < b.id)
SELECT id1, id2, round(d / 12.0, 6) AS distance FROM p WHERE d <= 3
""")
def _p_within(t):
    return rounded(search.p_distance_within(tags(t), "tag", 3), "id1", "id2", distance="distance")


@query("p_distance_pairs", """
, p AS (SELECT probe_id AS id, left(seq, length(seq) // 2) AS x, right(seq, length(seq) // 2) AS y FROM probes)
SELECT id, round(coalesce(list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN x[i] <> y[i] THEN 1 ELSE 0 END)), 0) * 1.0 / greatest(length(x), 1), 6) AS distance FROM p
""", uses="probes")
def _p_pairs(t):
    half = t.probes.withColumn("h", F.floor(F.length("seq") / 2).cast("int"))
    return half.select(F.col("probe_id").alias("id"), F.round(D.p_distance(F.expr("left(seq, h)"), F.expr("right(seq, h)")), 6).alias("distance"))


PRIMERS = [("p1", "ACGTAC", "GTACGT"), ("p2", "TTGCA", "CCATG"), ("p3", "GATTACAG", "CTGTAATC")]


def _pcr_sql() -> str:
    rows = ", ".join(f"('{p}', '{f}', reverse(translate('{r}', 'ACGT', 'TGCA')))" for p, f, r in PRIMERS)
    return f""", pr(pair, f, r) AS (VALUES {rows}),
a AS (SELECT seq_id, pair, instr(seq, f) AS x, instr(seq, r) AS y, length(r) AS l FROM dna, pr),
b AS (SELECT seq_id, pair, x - 1 AS fwd_pos, y - 1 AS rev_pos, CASE WHEN x = 0 THEN 'forward primer not found' WHEN y = 0 THEN 'reverse primer not found' WHEN x >= y THEN 'primer orientation' END AS reason, y - x + l AS n FROM a)
SELECT seq_id, pair, fwd_pos, rev_pos, CASE WHEN reason IS NULL THEN n ELSE -1 END AS size, reason, CASE WHEN reason IS NULL THEN CASE WHEN n < 500 THEN .95 WHEN n < 2000 THEN .9 WHEN n < 5000 THEN .8 ELSE .65 END::DOUBLE END AS efficiency FROM b
"""


@query("amplicons", _pcr_sql(), uses="dna")
def _pcr(t):
    primers = t.spark.createDataFrame(PRIMERS, "pair string, forward string, reverse string")
    wanted = t.dna.select("seq_id", F.explode(F.array(*[F.lit(p) for p, _, _ in PRIMERS])).alias("pair"))
    return search.amplicons(t.dna, primers, "seq_id", wanted).fillna(-1, ["size"])


_PROBE_PCR = """
, pr AS MATERIALIZED (SELECT probe_id::VARCHAR AS pair, left(seq, 6) AS f, right(seq, 6) AS r, reverse(translate(right(seq, 6), 'ACGT', 'TGCA')) AS reverse FROM probes WHERE length(seq) >= 12),
a AS (SELECT seq_id, pair, instr(seq, f) AS x, instr(seq, r) AS y FROM dna, pr)
SELECT seq_id, pair, (x - 1)::BIGINT AS fwd_pos, (y - 1)::BIGINT AS rev_pos, (y - x + 6)::BIGINT AS size FROM a WHERE x > 0 AND y > x
"""


@query("probe_amplicons", _PROBE_PCR, uses="dna probes")
def _probe_pcr(t):
    """A primer pair from the ends of every probe, over every sequence."""
    ends = t.probes.where(F.length("seq") >= 12).select(F.col("probe_id").cast("string").alias("pair"), F.expr("left(seq, 6)").alias("forward"), D.reverse_complement(F.expr("right(seq, 6)")).alias("reverse"))
    return search.amplicons(t.dna, ends, "seq_id").where("reason IS NULL").select("seq_id", "pair", "fwd_pos", "rev_pos", "size")


@query("verify_inserts", """
, p AS (SELECT seq_id, seq AS product, CASE seq_id % 3 WHEN 0 THEN substr(seq, 11, 30) WHEN 1 THEN reverse(translate(substr(seq, 11, 30), 'ACGT', 'TGCA')) ELSE substr(seq, 11, 20) || 'NNNNNNNNNNNN' END AS ins FROM dna),
q AS (SELECT *, reverse(translate(ins, 'ACGTN', 'TGCAN')) AS rc, length(ins) // 2 AS h FROM p), f AS (SELECT *, instr(product, ins) AS x, instr(product, rc) AS y FROM q)
SELECT seq_id, x > 0 OR y > 0 AS insert_found, x > 0 AS forward_orientation, CASE WHEN x > 0 THEN x - 1 WHEN y > 0 THEN y - 1 ELSE -1 END AS insert_start, coalesce(CASE WHEN x > 0 THEN x - 1 WHEN y > 0 THEN y - 1 END + length(ins), -1) AS insert_end,
CASE WHEN x > 0 AND y > 0 THEN 'both orientations' WHEN x = 0 AND y = 0 AND length(ins) > 20 AND contains(product, left(ins, h)) THEN '5'' half only' WHEN x = 0 AND y = 0 AND length(ins) > 20 AND contains(product, substr(ins, h + 1)) THEN '3'' half only'
WHEN x = 0 AND y = 0 THEN 'not found' END AS note FROM f
""", uses="dna")
def _inserts(t):
    part = F.substring("seq", 11, 30)
    k = F.col("seq_id") % 3
    ins = F.when(k == 0, part).when(k == 1, D.reverse_complement(part)).otherwise(F.concat(F.substring("seq", 11, 20), F.lit("NNNNNNNNNNNN")))
    df = t.dna.select("seq_id", F.col("seq").alias("product"), ins.alias("insert"))
    return search.verify_inserts(df).drop("product", "insert").fillna(-1, ["insert_start", "insert_end"])


def aligned_rows(t):
    return t.dna.select("seq_id", F.translate("seq", "T", "-").alias("aligned"))


_COLS = """
, l AS (SELECT pos, letter, count(*) AS n FROM (SELECT unnest(string_split(translate(seq, 'T', '-'), '')) AS letter, generate_subscripts(string_split(seq, ''), 1) - 1 AS pos FROM dna WHERE length(seq) > 0) GROUP BY 1, 2),
c AS (SELECT pos, sum(n) AS total, coalesce(sum(n) FILTER (letter <> '-'), 0) AS used, max(n) FILTER (letter <> '-') AS k FROM l GROUP BY pos),
b AS (SELECT c.*, coalesce(k * 1.0 / nullif(used, 0), 0) AS share, coalesce((SELECT min(letter) FROM l WHERE l.pos = c.pos AND l.n = c.k AND letter <> '-'), '-') AS letter FROM c)
"""


@query("column_conservation", _COLS + """
SELECT pos::INTEGER AS pos, round(share, 6) AS conservation, letter, (total - used)::BIGINT AS gaps, total::BIGINT AS total,
CASE WHEN letter = '-' THEN '-' WHEN share < .5 THEN 'n' WHEN share < 1 THEN lower(letter) ELSE letter END AS consensus FROM b
""", uses="dna")
def _conservation(t):
    return rounded(columns.conservation(aligned_rows(t)), "pos", "letter", "gaps", "total", "consensus", conservation="conservation")


@query("consensus_sequence", _COLS + "SELECT string_agg(CASE WHEN letter = '-' THEN '-' WHEN share < .5 THEN 'n' WHEN share < 1 THEN lower(letter) ELSE letter END, '' ORDER BY pos) AS consensus FROM b", uses="dna")
def _consensus(t):
    return columns.consensus(aligned_rows(t))


@query("alignment_statistics", _COLS + """
SELECT count(*) AS alignment_length, round(sum(total - used) * 100.0 / sum(total), 6) AS gap_percent, round(avg(share), 6) AS mean_conservation, count(*) FILTER (share >= .9) AS highly_conserved, count(*) FILTER (share < .5) AS variable FROM b
""", uses="dna")
def _alignment(t):
    return rounded(columns.alignment_statistics(aligned_rows(t)), "alignment_length", "highly_conserved", "variable", gap_percent="gap_percent", mean_conservation="mean_conservation")


@query("column_profile", _COLS + "SELECT l.pos::INTEGER AS pos, l.letter, round(l.n * 1.0 / c.used, 6) AS frequency FROM l JOIN c USING (pos) WHERE l.letter <> '-'", uses="dna")
def _profile(t):
    return rounded(columns.profile(aligned_rows(t)), "pos", "letter", frequency="frequency")


@query("logo_heights", """
, l AS (SELECT pos, letter, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS letter, generate_subscripts(string_split(seq, ''), 1) - 1 AS pos FROM dna WHERE length(seq) > 0) GROUP BY 1, 2),
t AS (SELECT pos, sum(n) AS t FROM l GROUP BY 1), h AS (SELECT pos, t, greatest(0.0, 2.0 + sum(n * 1.0 / t * log2(n * 1.0 / t)) - 3 / (2 * ln(2.0) * t)) AS bits FROM l JOIN t USING (pos) GROUP BY 1, 2)
SELECT pos::INTEGER AS pos, letter, round(n * 1.0 / t * bits, 6) AS height, round(bits, 6) AS bits, round(bits / 2, 6) AS conservation FROM l JOIN h USING (pos)
""", uses="dna")
def _logo(t):
    df = t.dna.select(F.col("seq").alias("aligned"))
    return rounded(columns.logo(df), "pos", "letter", height="height", bits="bits", conservation="conservation")


@query("aligned_hits")
def _aligned_hits(t):
    hits = search.search(t.probes, t.dna, "probe_id", "seq_id").select("probe_id", "seq_id")
    pairs = hits.join(t.probes.withColumnRenamed("seq", "q"), "probe_id").join(t.dna.withColumnRenamed("seq", "s"), "seq_id")
    return pairs.select("probe_id", "seq_id", pairwise.local_score("q", "s").alias("local_score"), pairwise.global_score("q", "s").alias("global_score"))


@query("sequence_copies", """
SELECT event_id AS id, min(event_id) OVER (PARTITION BY substr(translate(md5((event_id % 997)::VARCHAR), '0123456789abcdef', 'AAAACCCCGGGGTTTT'), 1, 12)) AS representative FROM events
""")
def _copies(t):
    return search.copies(tags(t).withColumnRenamed("tag", "id"), "id")

"""Registered queries over sequences, reads and peptides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna
from ..functions import fixed_values as V
from ..functions.frames import all_frames
from ..operators import scan
from .catalog import query
from .matrix_queries import rounded

RC = "reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan'))"
CODON_MAP = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in dna.CODONS.items()) + "}"


def scaled_round(c, digits: int = 6):
    """Rounded as DuckDB does, the product with the power of ten first: that decides means that lie between two results."""
    return F.round(c * 10.0**digits) / 10.0**digits


def count_sql(chars: str, s: str = "seq") -> str:
    return f"(length({s}) - length(regexp_replace({s}, '[{chars}]', '', 'g')))"


@query("gc_percent", f"SELECT seq_id, round(CASE WHEN length(seq) = 0 THEN 0.0 ELSE {count_sql('GC')} * 100.0 / length(seq) END, 6) AS gc FROM dna", uses="dna")
def _gc(t):
    return rounded(t.dna, "seq_id", gc=dna.gc_percent("seq"))


@query("gc_fraction_of_bases", f"SELECT doc_id AS seq_id, round(coalesce({count_sql('GC', 'upper(text)')} * 1.0 / nullif({count_sql('ACGT', 'upper(text)')}, 0), 0.0), 6) AS gc FROM documents")
def _gcf(t):
    return t.documents.select(F.col("doc_id").alias("seq_id"), F.round(dna.gc_fraction("text"), 6).alias("gc"))


@query("reverse_complement", f"SELECT seq_id, {RC} AS seq FROM dna", uses="dna")
def _rc(t):
    return t.dna.select("seq_id", dna.reverse_complement("seq").alias("seq"))


def _frame_sql(f: int) -> str:
    s = "seq" if f > 0 else RC
    return (
        f"SELECT seq_id, {f} AS frame, array_to_string(list_transform(regexp_extract_all(substr({s}, {abs(f)}), '...'), "
        f"lambda c: coalesce({CODON_MAP}[c], 'X')), '') AS protein FROM dna"
    )


@query("translate_frames", ", f AS (" + " UNION ALL ".join(_frame_sql(f) for f in (1, 2, 3, -1, -2, -3)) + ") SELECT seq_id, frame, md5(protein) AS digest, length(protein) AS residues FROM f", uses="dna")
def _translate(t):
    proteins = t.dna.select("seq_id", F.posexplode(all_frames("seq")).alias("i", "protein"))
    frame = F.get(F.array(*[F.lit(f) for f in (1, 2, 3, -1, -2, -3)]), F.col("i"))
    return proteins.select("seq_id", frame.alias("frame"), F.md5("protein").alias("digest"), F.length("protein").cast("long").alias("residues"))


@query("base_composition", f"""
, u AS (SELECT seq_id, upper(letters) AS seq FROM letters)
SELECT seq_id, length(seq) AS length, {', '.join(f"{count_sql(b)} AS n_{b.lower()}" for b in 'ATGCN')},
round({count_sql('AT')} * 100.0 / greatest(length(seq), 1), 6) AS at_percent, round({count_sql('GC')} * 100.0 / greatest(length(seq), 1), 6) AS gc_percent,
round((length(seq) - {count_sql('ATGC')}) * 100.0 / greatest(length(seq), 1), 6) AS other_percent FROM u
""", uses="letters")
def _composition(t):
    parts = dna.composition("letters")
    return t.letters.select(
        "seq_id", *[(F.round(c, 6) if n.endswith("percent") else c).alias(n) for n, c in parts.items()]
    )


@query("phred_statistics", """
, s AS (SELECT read_id, unnest(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS q FROM reads)
SELECT read_id, round(avg(q), 6) AS mean, min(q) AS low, max(q) AS high, sum(q)::BIGINT AS total FROM s GROUP BY read_id
""", uses="reads")
def _phred(t):
    # as in the SQL, a read without letters has the one score -33 of the empty letter that it splits into
    s = t.reads.where("qual IS NOT NULL").select("read_id", dna.phred_scores("qual").alias("s"))
    s = s.withColumn("total", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x))
    return s.select("read_id", scaled_round(F.col("total") / F.size("s")).alias("mean"), F.array_min("s").alias("low"), F.array_max("s").alias("high"), "total")


@query("melting_temperature", f"""
SELECT probe_id, round(64.9 + 41.0 * ({count_sql('GC')} - 16.4) / length(seq), 6) AS tm, round((2 * {count_sql('AT', 'left(seq, 13)')} + 4 * {count_sql('GC', 'left(seq, 13)')})::DOUBLE, 6) AS tm_short FROM probes
""", uses="probes")
def _tm(t):
    return rounded(t.probes, "probe_id", tm=dna.melting_temperature("seq"), tm_short=dna.melting_temperature(F.substring("seq", 1, 13)))


_CIGARS = """
WITH c AS (SELECT event_id AS id, (5 + event_id % 7) || 'M' || (1 + event_id % 3) || 'I' || (4 + user_id % 5) || 'M2D' || (3 + user_id % 4) || 'M' ||
(1 + event_id % 4) || 'S' AS cigar FROM events)
"""


def cigars(t):
    e, u = F.col("event_id"), F.col("user_id")
    return t.events.select(
        e.alias("id"), F.concat((e % 7 + 5), F.lit("M"), (e % 3 + 1), F.lit("I"), (u % 5 + 4), F.lit("M2D"), (u % 4 + 3), F.lit("M"), (e % 4 + 1), F.lit("S")).alias("cigar")
    )


@query("cigar_span", _CIGARS + """
SELECT id, cigar, list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: x::BIGINT))::BIGINT AS span,
len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'))::BIGINT AS ops FROM c""")
def _cigar(t):
    return cigars(t).select("id", "cigar", dna.reference_span("cigar").alias("span"), F.size(dna.cigar_ops("cigar")).cast("long").alias("ops"))


@query("evalue", "SELECT event_id AS id, CASE WHEN value - 10 <= 0 THEN 1.0 ELSE round(0.133 * 1000000.0 * greatest(user_id - 15 + 1, 1) * exp(-0.332 * (value - 10)), 6) END AS evalue FROM events")
def _evalue(t):
    return t.events.select(F.col("event_id").alias("id"), F.round(dna.evalue(F.col("value") - 10, F.lit(1000000.0), F.col("user_id")), 6).alias("evalue"))


@query("nucleotide_test", """
, h AS (SELECT seq_id, upper(left(letters, 500)) AS l, left(seq, 500) AS s FROM letters JOIN dna USING (seq_id))
SELECT seq_id, length(regexp_replace(l, '[ATCGN]', '', 'g')) * 1.0 / length(l) < 0.1 AS text_is_dna, length(regexp_replace(s, '[ATCGN]', '', 'g')) * 1.0 / length(s) < 0.1 AS seq_is_dna FROM h
""", uses="dna")
def _nuc(t):
    df = t.letters.withColumn("seq", F.translate("letters", "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"))
    return df.select("seq_id", dna.is_nucleotide("letters").alias("text_is_dna"), dna.is_nucleotide("seq").alias("seq_is_dna"))


@query("kmer_composition", """
, k AS (SELECT substr(seq, pos + 1, 3) AS kmer FROM (SELECT seq, unnest(range(0, length(seq) - 2)) AS pos FROM dna))
SELECT kmer, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS frequency FROM k GROUP BY kmer
""", uses="dna")
def _kmers(t):
    return rounded(scan.kmer_composition(t.dna, 3), "kmer", "n", frequency="frequency")


@query("kmer_composition_by_sequence", """
, k AS (SELECT seq_id, substr(seq, pos + 1, 2) AS kmer FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - 1)) AS pos FROM dna))
SELECT seq_id, kmer, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY seq_id), 6) AS frequency FROM k GROUP BY 1, 2
""", uses="dna")
def _kmers_by(t):
    return rounded(scan.kmer_composition(t.dna, 2, ["seq_id"]), "seq_id", "kmer", "n", frequency="frequency")


@query("codon_usage", f"""
, c AS (SELECT unnest(regexp_extract_all(seq, '...')) AS codon FROM dna), n AS (SELECT codon, {CODON_MAP}[codon] AS residue, count(*) AS n FROM c GROUP BY codon)
SELECT codon, residue, n, round(n * 100.0 / sum(n) OVER (), 6) AS percent, round(n * 100.0 / sum(n) OVER (PARTITION BY residue), 6) AS percent_of_residue FROM n
""", uses="dna")
def _codons(t):
    return rounded(scan.codon_usage(t.dna), "codon", "residue", "n", percent="percent", percent_of_residue="percent_of_residue")


@query("sequence_complexity", """
, w AS (SELECT seq_id, substr(seq, pos + 1, 20) AS w FROM (SELECT seq_id, seq, unnest(range(0, greatest(length(seq) - 19, 0), 10)) AS pos FROM dna)),
c AS (SELECT seq_id, len(list_distinct(list_transform(range(1, 20), lambda i: substr(w, i, 2)))) / 16.0 AS c FROM w),
m AS (SELECT seq_id, count(*) AS windows, avg(c) AS mc FROM c GROUP BY seq_id)
SELECT seq_id, coalesce(windows, 0) AS windows, round(coalesce(mc, 0.0), 6) AS mean_complexity, coalesce(mc, 0.0) < 0.3 AS low_complexity FROM dna LEFT JOIN m USING (seq_id)
""", uses="dna")
def _complexity(t):
    return rounded(scan.sequence_complexity(t.dna), "seq_id", "windows", "low_complexity", mean_complexity="mean_complexity")


@query("window_gc", """
, b AS (SELECT seq_id, length(seq) AS n, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) AS i FROM dna),
w AS (SELECT seq_id, n, i, sum(CASE WHEN c IN ('G', 'C') THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) * 100.0 / least(100, n) AS gc FROM b)
SELECT seq_id, count(*) AS windows, round(avg(gc), 6) AS mean_gc, round(min(gc), 6) AS low_gc, round(max(gc), 6) AS high_gc, sum(i - 1)::BIGINT AS positions FROM w WHERE i >= least(100, n) GROUP BY seq_id
""", uses="dna")
def _window_gc(t):
    return scan.window_gc(t.dna).groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("windows"), scaled_round(F.avg("gc")).alias("mean_gc"), F.round(F.min("gc"), 6).alias("low_gc"),
        F.round(F.max("gc"), 6).alias("high_gc"), F.sum("pos").alias("positions"),
    )


_LOW = "".join(chr(33 + q) for q in range(20)).replace("'", "''")
ADAPTER = "GAGACT"


def _trim_sql(source: str) -> str:
    return f"""
a AS (SELECT *, instr(seq, '{ADAPTER}') AS cp FROM {source}),
q AS (SELECT *, left(qual, CASE WHEN cp > 0 THEN cp - 1 ELSE length(seq) END) AS q1 FROM a),
z AS (SELECT *, rtrim(q1, '{_LOW}') AS q2 FROM q)
"""


_TRIM = ", " + _trim_sql("reads")
_SCORE = "coalesce(list_sum(list_transform(string_split({0}, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE ascii(c) - 33 END)), 0)::BIGINT"


def trimmed(t):
    return scan.trim_reads(t.reads, adapter=ADAPTER)


@query("trim_reads", _TRIM + f"""
SELECT read_id, left(seq, length(q2)) AS seq, q2 AS qual, cp > 0 AS adapter_hit, length(q2) < length(q1) AS quality_trimmed, length(q2) >= 36 AS passed,
{_SCORE.format('q2')} AS score_after FROM z
""", uses="reads")
def _trim(t):
    return trimmed(t).select("read_id", "seq", "qual", "adapter_hit", "quality_trimmed", "passed", "score_after")


@query("trim_report", _TRIM + f"""
SELECT count(*) AS total_reads, count(*) FILTER (length(q2) < length(q1)) AS reads_trimmed, count(*) FILTER (length(q2) < 36) AS reads_removed,
count(*) FILTER (cp > 0) AS adapter_trimmed, round(sum({_SCORE.format('q1')}) * 1.0 / sum(length(q1)), 6) AS mean_quality_before,
round(sum({_SCORE.format('q2')}) * 1.0 / sum(length(q2)), 6) AS mean_quality_after FROM z
""", uses="reads")
def _trim_report(t):
    return rounded(scan.trim_report(trimmed(t)), "total_reads", "reads_trimmed", "reads_removed", "adapter_trimmed", mean_quality_before="mean_quality_before", mean_quality_after="mean_quality_after")


@query("trim_pairs", ", m AS (SELECT read_id, 1 AS mate, seq, qual FROM reads UNION ALL SELECT read_id, 2, " + RC + ", reverse(qual) FROM reads), "
       + _trim_sql("m") + """
SELECT read_id, mate, length(q2) AS bases_after FROM z WHERE read_id IN (SELECT read_id FROM z GROUP BY read_id HAVING count(*) FILTER (length(q2) >= 36) = 2)
""", uses="reads")
def _trim_pairs(t):
    mate = t.reads.select("read_id", dna.reverse_complement("seq").alias("seq"), F.reverse("qual").alias("qual"))
    return scan.trim_pairs(t.reads, mate, both_pass=True, adapter=ADAPTER).select("read_id", "mate", "bases_after")


@query("read_quality", """
, s AS (SELECT unnest(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS q FROM reads)
SELECT (SELECT count(*) FROM reads) AS total_reads, round((SELECT avg(length(seq)) FROM reads), 6) AS read_length_mean, round(avg(q), 6) AS quality_mean,
median(q)::DOUBLE AS quality_median, round(count(*) FILTER (q >= 20) * 100.0 / count(*), 6) AS percent_q20, round(count(*) FILTER (q >= 30) * 100.0 / count(*), 6) AS percent_q30 FROM s
""", uses="reads")
def _quality(t):
    out = scan.read_quality(t.reads)
    return rounded(out, "total_reads", "quality_median", read_length_mean="read_length_mean", quality_mean="quality_mean", percent_q20="percent_q20", percent_q30="percent_q30")


def _orf_sql() -> str:
    parts = []
    for strand, s in (("+", "seq"), ("-", RC)):
        for f in (1, 2, 3):
            parts.append(
                f"SELECT seq_id, length(seq) AS n, '{strand}' AS strand, {f} AS frame, array_to_string(list_transform(regexp_extract_all(substr({s}, {f}), '...'), "
                f"lambda c: {CODON_MAP}[c]), '') AS p FROM dna"
            )
    return ", f AS (" + " UNION ALL ".join(parts) + r""")
, m AS (SELECT seq_id, n, strand, frame, unnest(regexp_extract_all(p, '([^M]*)(M[^*]*\*?)', 1)) AS skip, unnest(regexp_extract_all(p, '([^M]*)(M[^*]*\*?)', 2)) AS orf,
 generate_subscripts(regexp_extract_all(p, '([^M]*)(M[^*]*\*?)', 2), 1) AS i FROM f),
c AS (SELECT *, sum(length(skip) + length(orf)) OVER (PARTITION BY seq_id, strand, frame ORDER BY i) AS upto FROM m),
d AS (SELECT *, (upto - length(orf)) * 3 + frame - 1 AS s, rtrim(orf, '*') AS protein, orf LIKE '%*' AS has_stop FROM c),
e AS (SELECT *, CASE WHEN has_stop THEN s + 3 * length(protein) ELSE n END AS t FROM d WHERE length(protein) >= 30)
SELECT seq_id, strand, frame, (CASE strand WHEN '-' THEN n - t ELSE s END)::BIGINT AS start, (CASE strand WHEN '-' THEN n - s ELSE t END)::BIGINT AS "end", length(protein) AS length, protein, has_stop FROM e
"""


@query("open_reading_frames", _orf_sql(), uses="dna")
def _orfs(t):
    return scan.orfs(t.dna, 30, reverse=True)


def _site_sql() -> str:
    branches = []
    for name, strand, site, _, pattern in scan.site_table():
        test = f"w LIKE '{site}%'" if pattern == site else f"regexp_matches(w, '^{pattern}')"
        branches.append(f"SELECT '{name}' AS enzyme, '{strand}' AS strand, count(*) AS sites, count(DISTINCT seq_id) AS sequences, coalesce(sum(pos), 0)::BIGINT AS positions FROM w WHERE {test}")
    return (
        ", w AS MATERIALIZED (SELECT seq_id, pos, substr(seq, pos + 1, 13) AS w FROM (SELECT seq_id, seq, unnest(range(0, length(seq))) AS pos FROM dna)), u AS ("
        + " UNION ALL ".join(branches) + ") SELECT * FROM u WHERE sites > 0"
    )


@query("restriction_sites", _site_sql(), uses="dna")
def _sites(t):
    return scan.restriction_sites(t.dna).groupBy("enzyme", "strand").agg(
        F.count(F.lit(1)).alias("sites"), F.countDistinct("seq_id").alias("sequences"), F.sum("pos").alias("positions")
    )


_CUTS = """
, s AS MATERIALIZED (SELECT seq_id, length(seq) AS n, pos, substr(seq, pos + 1, 6) AS w FROM (SELECT seq_id, seq, unnest(range(0, length(seq))) AS pos FROM dna)),
c AS MATERIALIZED (SELECT DISTINCT seq_id, n, pos + 1 AS cp FROM s WHERE w IN ('GAATTC', 'GGATCC', 'AAGCTT'))
"""


@query("digest_circular", _CUTS + """
, f AS (SELECT seq_id, n, cp, coalesce(lead(cp) OVER w, first_value(cp) OVER w) AS nx FROM c WINDOW w AS (PARTITION BY seq_id ORDER BY cp))
SELECT seq_id, cp AS start, nx AS "end", CASE WHEN nx > cp THEN nx - cp ELSE n - cp + nx END AS size FROM f
UNION ALL SELECT seq_id, 0, length(seq), length(seq) FROM dna WHERE seq_id NOT IN (SELECT seq_id FROM c)
""", uses="dna")
def _circular(t):
    return scan.digest(t.dna, ["EcoRI", "BamHI", "HindIII"])


@query("digest_linear", _CUTS + """
, p AS (SELECT seq_id, cp FROM c UNION SELECT seq_id, 0 FROM dna UNION SELECT seq_id, length(seq) FROM dna),
f AS (SELECT seq_id, cp AS start, lead(cp) OVER (PARTITION BY seq_id ORDER BY cp) AS "end" FROM p)
SELECT seq_id, start, "end", "end" - start AS size FROM f WHERE "end" > start
""", uses="dna")
def _linear(t):
    return scan.digest(t.dna, ["EcoRI", "BamHI", "HindIII"], circular=False)


_GUIDE = """
, w AS (SELECT seq_id, pos, substr(seq, pos + 1, 23) AS w FROM (SELECT seq_id, seq, unnest(range(0, greatest(length(seq) - 22, 0))) AS pos FROM dna)),
g AS (SELECT seq_id, pos, '+' AS strand, left(w, 20) AS guide, right(w, 3) AS pam FROM w WHERE w LIKE '%GG'
UNION ALL SELECT seq_id, pos, '-', right(w, 20), reverse(translate(left(w, 3), 'ACGT', 'TGCA')) FROM w WHERE w LIKE 'CC%'),
""" + f"""
x AS (SELECT *, {count_sql('GC', 'guide')} * 5.0 AS gc, coalesce(list_max(list_transform(regexp_extract_all(guide, 'A{{4,}}|C{{4,}}|G{{4,}}|T{{4,}}'), lambda r: length(r))), 0) AS run,
len(regexp_extract_all(guide, '[GC]{{5,}}')) AS runs FROM g),
sc AS (SELECT *, round(greatest(0.0, least(1.0, 1 - abs(gc - 50) / 50 - 0.1 * run - 0.05 * runs)), 3) AS score FROM x)
"""


@query("pam_sites", _GUIDE + "SELECT seq_id, strand, count(*) AS sites, sum(pos)::BIGINT AS positions, round(avg(score), 6) AS mean_score FROM sc GROUP BY 1, 2", uses="dna")
def _pam(t):
    return scan.guides(t.dna).groupBy("seq_id", "strand").agg(
        F.count(F.lit(1)).alias("sites"), F.sum("pos").alias("positions"), F.round(F.avg("score"), 6).alias("mean_score")
    )


@query("top_guides", _GUIDE + """
, r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, pos, strand) AS rank FROM sc)
SELECT seq_id, pos, strand, guide, pam, score, rank FROM r WHERE rank <= 20
""", uses="dna")
def _guides(t):
    out = scan.top_per_group(scan.guides(t.dna), ["seq_id"], [F.desc("score"), F.col("pos"), F.col("strand")], 20)
    return out.select("seq_id", "pos", "strand", "guide", "pam", "score", "rank")


@query("best_primer", """
, w AS (SELECT seq_id, length(seq) AS n, pos, substr(seq, pos + 1, 20) AS w FROM (SELECT seq_id, seq, unnest(range(0, greatest(length(seq) - 19, 0))) AS pos FROM dna)),
""" + f"""
g AS (SELECT *, {count_sql('GC', 'w')} AS k FROM w), x AS (SELECT *, k * 5.0 AS gc, 64.9 + 41.0 * (k - 16.4) / 20 AS tm FROM g),
sc AS (SELECT *, round((1 - abs(pos - n / 2.0) / (n / 2.0)) + (1 - abs(gc - 55) / 45) + (1 - abs(tm - 60) / 10), 9) AS score FROM x WHERE gc BETWEEN 40 AND 70 AND tm BETWEEN 55 AND 65),
r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, pos) AS rn FROM sc WHERE score > -1)
SELECT seq_id, pos, w AS forward, reverse(translate(w, 'ACGT', 'TGCA')) AS reverse, round(gc, 1) AS gc, round(tm, 1) AS tm, score FROM r WHERE rn = 1
""", uses="dna")
def _primer(t):
    return scan.best_primer(t.dna)


@query("end_primers", """
, p AS (SELECT seq_id, length(seq) AS n, left(seq, 20) AS f, reverse(translate(right(seq, 20), 'ACGT', 'TGCA')) AS r FROM dna WHERE length(seq) >= 20),
""" + f"""
g AS (SELECT *, {count_sql('GC', 'f')} AS a, {count_sql('GC', 'r')} AS b FROM p)
SELECT seq_id, f AS forward, r AS reverse, round(64.9 + 41.0 * (a - 16.4) / 20, 1) AS fwd_tm, round(64.9 + 41.0 * (b - 16.4) / 20, 1) AS rev_tm, round(a * 5.0, 1) AS fwd_gc, round(b * 5.0, 1) AS rev_gc,
array_to_string(list_filter([CASE WHEN n < 40 THEN 'short' END, CASE WHEN a < 8 OR a > 12 THEN 'forward_gc' END, CASE WHEN b < 8 OR b > 12 THEN 'reverse_gc' END,
CASE WHEN abs(a - b) * 41.0 / 20 > 5 THEN 'tm_difference' END], lambda x: x IS NOT NULL), ';') AS warnings FROM g
""", uses="dna")
def _end_primers(t):
    return scan.end_primers(t.dna)


MOTIFS = ("ATG", "TATAAA", "GAATTC", "GGATCC", "CCCGGG", "TTTTTT")


@query("motif_presence", " UNION ALL ".join(f"SELECT '{m}' AS motif, count(*) FILTER (contains(seq, '{m}')) AS n FROM dna" for m in MOTIFS), uses="dna")
def _motifs(t):
    return scan.motif_presence(t.dna, MOTIFS)


def _scale_cte(**tables) -> str:
    rows = ", ".join(f"('{r}', " + ", ".join(repr(float(tb[r])) for tb in tables.values()) + ")" for r in V.RESIDUES)
    return f"sc(aa, {', '.join(tables)}) AS (VALUES {rows})"


_AA = ", " + _scale_cte(h=V.HYDROPATHY, sa=V.ACCESSIBILITY, fl=V.FLEXIBILITY, bp=V.PROPENSITY, an=V.ANCHOR) + """,
r0 AS (SELECT seq_id, length(seq) AS n, unnest(string_split(seq, '')) AS aa, generate_subscripts(string_split(seq, ''), 1) - 1 AS i FROM protein WHERE length(seq) > 0),
r AS (SELECT * FROM r0 JOIN sc USING (aa))
"""


def _sum(expr: str, w: int) -> str:
    return f"sum({expr}) OVER (PARTITION BY seq_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)"


def _at(expr: str, k: int) -> str:
    return f"lead({expr}, {k}) OVER (PARTITION BY seq_id ORDER BY i)"


_TCELL = _AA + ", e AS (" + " UNION ALL ".join(
    f"SELECT seq_id, i AS start, {w} AS w, n, {_sum('h', w)} / {w} AS hm, {_at('aa', 1)} AS p2, {_at('aa', w - 1)} AS p9, {_at('an', 1)} AS s2, {_at('an', w - 1)} AS s9 FROM r"
    for w in (8, 9, 10, 11)
) + """),
f AS (SELECT seq_id, start, w, round(0.3 * s2 + 0.3 * s9 + 0.2 * greatest(0, least(1, (hm + 4.5) / 9)) + 0.2 * ((CASE WHEN contains('AVLIM', p2) THEN 0.3 ELSE 0 END) + (CASE WHEN contains('VILM', p9) THEN 0.3 ELSE 0 END)), 9) AS score
FROM e WHERE start + w <= n)
"""


def _top_epitopes(df):
    out = scan.top_per_group(df, ["seq_id"], [F.desc(F.round("score", 6)), F.col("start"), F.col("end")], 50)
    return out.select("seq_id", "peptide", "start", "end", F.round("score", 6).alias("score"), "rank")


_TOP = """
, k AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY round(score, 6) DESC, start, w) AS rank FROM f WHERE score >= {0})
SELECT k.seq_id, substr(seq, start + 1, w) AS peptide, start, start + w AS "end", round(score, 6) AS score, rank FROM k JOIN protein USING (seq_id) WHERE rank <= 50
"""


@query("t_cell_epitopes", _TCELL + _TOP.format("0.5"), uses="protein")
def _tcell(t):
    return _top_epitopes(scan.t_cell_epitopes(t.protein, best=50))


@query("b_cell_epitopes", _AA + f""", e AS (SELECT seq_id, i AS start, 7 AS w, n, {_sum('h', 7)} / 7 AS h, {_sum('sa', 7)} / 7 AS sa, {_sum('fl', 7)} / 7 AS fl, {_sum('bp', 7)} / 7 AS bp FROM r),
f AS (SELECT seq_id, start, w, round(0.3 * sa + 0.2 * fl + 0.3 * bp + 0.2 * greatest(0, -h / 4.5), 9) AS score FROM e WHERE start + w <= n)
""" + _TOP.format("1.0"), uses="protein")
def _bcell(t):
    return _top_epitopes(scan.b_cell_epitopes(t.protein, best=50))


@query("linear_epitopes", _AA + ", e AS (" + " UNION ALL ".join(
    f"SELECT seq_id, i AS start, {w} AS w, n, {_sum('(-h / 4.5 + sa + bp) / 3', w)} / {w} AS score FROM r" for w in (10, 12, 15)
) + "), f AS (SELECT seq_id, start, w, round(score, 9) AS score FROM e WHERE start + w <= n)" + _TOP.format("0.6"), uses="protein")
def _linear_ep(t):
    return _top_epitopes(scan.linear_epitopes(t.protein, best=50))


@query("cleavage_sites", """
, r AS (SELECT seq_id, unnest(string_split(seq, '')) AS aa, generate_subscripts(string_split(seq, ''), 1) - 1 AS pos FROM protein WHERE length(seq) > 0),
n AS (SELECT *, lead(aa) OVER (PARTITION BY seq_id ORDER BY pos) AS nx FROM r),
""" + f"""
c AS (SELECT seq_id, pos, aa, CASE WHEN contains('{V.CLEAVAGE_FAVOURABLE}', aa) AND NOT contains('{V.CLEAVAGE_UNFAVOURABLE}', nx) THEN 'favorable' WHEN contains('{V.CLEAVAGE_UNFAVOURABLE}', aa) THEN 'unfavorable' END AS preference FROM n WHERE nx IS NOT NULL)
SELECT seq_id, preference, aa AS residue, count(*) AS n, sum(pos)::BIGINT AS positions FROM c WHERE preference IS NOT NULL GROUP BY ALL
""", uses="protein")
def _cleavage(t):
    return scan.cleavage_sites(t.protein).groupBy("seq_id", "preference", "residue").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("positions"))

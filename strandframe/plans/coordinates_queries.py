"""Registered queries over intervals, coverage and variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, intervals, variants
from .catalog import query
from .inputs import _base, _minutes
from .matrix_queries import rounded
from .sequences_queries import _CIGARS, cigars


def regions(t):
    return t.variants.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), "id")


@query("interval_overlap_counts", """
, b AS (SELECT name, i.chrom, i.start, i."end", count(v.id) AS overlaps FROM intervals i LEFT JOIN variants v ON v.chrom = i.chrom AND v.pos - 1 < i."end" AND v.pos > i.start GROUP BY ALL)
SELECT * FROM b
""", uses="intervals variants")
def _overlaps(t):
    return intervals.count_overlaps(t.intervals, regions(t)).select("name", "chrom", "start", "end", "overlaps")


@query("interval_overlap_pairs", """
SELECT name, v.id, i.chrom, i.start, i."end", v.pos FROM intervals i JOIN variants v ON v.chrom = i.chrom AND v.pos - 1 < i."end" AND v.pos > i.start
""", uses="intervals variants")
def _pairs(t):
    # the intervals are 10 to some 500 long
    return intervals.overlap_pairs(t.intervals, regions(t), bin_size=256).select("name", F.col("r_id").alias("id"), "chrom", "start", "end", F.col("r_end").alias("pos"))


@query("interval_mean_coverage", """
SELECT name, round(coalesce(sum(least(i."end", a."end") - greatest(i.start, a.start)) FILTER (a.start IS NOT NULL), 0) * 1.0 / (i."end" - i.start), 6) AS mean_coverage
FROM intervals i LEFT JOIN aligned a ON a.chrom = i.chrom AND a.start < i."end" AND a."end" > i.start GROUP BY name, i.start, i."end"
""", uses="intervals aligned")
def _mean_cov(t):
    return rounded(intervals.mean_coverage(t.intervals, t.aligned), "name", mean_coverage="mean_coverage")


@query("nearest_feature", """
, d AS (SELECT a.read_id, i.name, least(abs(a.start - i.start), abs(a."end" - i."end")) AS d FROM aligned a JOIN intervals i USING (chrom)),
m AS (SELECT read_id, min(d) AS distance FROM d GROUP BY read_id)
SELECT read_id, min(name)::VARCHAR AS gene, distance FROM m JOIN d USING (read_id) WHERE d = distance GROUP BY read_id, distance
""", uses="aligned intervals")
def _nearest(t):
    return intervals.nearest(t.aligned, t.intervals).select("read_id", "gene", "distance")


@query("interval_summary", """
SELECT count(*) AS records, sum("end" - start)::BIGINT AS bases, round(avg("end" - start), 6) AS mean_length, count(DISTINCT chrom) AS chromosomes, median("end" - start)::DOUBLE AS median_length FROM intervals
""", uses="intervals")
def _isum(t):
    return rounded(intervals.interval_summary(t.intervals), "records", "bases", "chromosomes", mean_length="mean_length", median_length="median_length")


@query("usable_reads", """
SELECT read_id FROM aligned WHERE flag & 4 = 0 AND flag & 256 = 0 AND mapq >= 20
""", uses="aligned")
def _usable(t):
    return coverage.usable(t.aligned).select("read_id")


_DELTA = """
, e AS (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, start AS pos, 1 AS d FROM aligned UNION ALL SELECT chrom, "end", -1 FROM aligned) GROUP BY 1, 2 HAVING sum(d) <> 0),
r AS (SELECT chrom, pos AS start, lead(pos) OVER w AS "end", sum(d) OVER w AS depth FROM e WINDOW w AS (PARTITION BY chrom ORDER BY pos))
"""


@query("depth_runs", _DELTA + 'SELECT chrom, start, "end", depth::BIGINT AS depth FROM r WHERE depth > 0', uses="aligned")
def _depth(t):
    return coverage.depth_runs(depth=t.aligned).select("chrom", "start", "end", "depth")


_BASES = """
, size AS (SELECT chrom, max("end") AS n FROM aligned GROUP BY 1), axis AS (SELECT chrom, n, unnest(range(0, n)) AS pos FROM size),
d AS (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, start AS pos, 1 AS d FROM aligned UNION ALL SELECT chrom, "end", -1 FROM aligned) GROUP BY 1, 2),
cov AS (SELECT a.chrom, a.n, a.pos, sum(coalesce(d, 0)) OVER (PARTITION BY a.chrom ORDER BY a.pos) AS depth FROM axis a LEFT JOIN d ON d.chrom = a.chrom AND d.pos = a.pos)
"""


@query("window_mean_depth", _BASES + """
SELECT chrom, pos // 1000 * 1000 AS start, round(sum(depth) / 1000.0, 6) AS mean_depth FROM cov WHERE pos < n // 1000 * 1000 GROUP BY 1, 2
""", uses="aligned")
def _wmean(t):
    a = t.aligned
    return rounded(coverage.window_means(coverage.depth_runs(depth=a), coverage.chrom_sizes(a), 1000), "chrom", "start", mean_depth="mean_depth")


@query("bin_read_counts", """
, size AS (SELECT chrom, max("end") AS n FROM aligned GROUP BY 1), g AS (SELECT chrom, unnest(range(0, (n + 499) // 500)) * 500 AS start FROM size)
SELECT g.chrom, g.start, count(a.read_id) AS reads FROM g LEFT JOIN aligned a ON a.chrom = g.chrom AND a.start < g.start + 500 AND a."end" > g.start GROUP BY 1, 2
""", uses="aligned")
def _bins(t):
    return coverage.bin_counts(t.aligned, coverage.chrom_sizes(t.aligned), 500)


@query("signal_bins", """
SELECT chrom, (pos // 1000) * 1000 AS start, round(avg(qual), 6) AS mean_value, max(qual) AS max_value, count(*) AS n FROM variants GROUP BY 1, 2
""", uses="variants")
def _signal(t):
    return rounded(coverage.signal_bins(t.variants, 1000, "qual"), "chrom", "start", "max_value", "n", mean_value="mean_value")


def alignments(t):
    seqs = t.events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("chrom"), (_minutes("ts") + 1).alias("pos"),
        F.translate(F.md5(F.col("event_id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"),
    )
    return seqs.join(cigars(t), "id")


_PILE = _CIGARS.rstrip() + """,
s AS (SELECT event_id AS id, event_type AS chrom, CAST(floor((epoch_us(ts) - 1704067200000000) / 60000000) AS BIGINT) + 1 AS pos,
translate(md5(event_id::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM events),
o AS (SELECT id, unnest(regexp_extract_all(cigar, '([0-9]+)[MIDS]', 1))::BIGINT AS n, unnest(regexp_extract_all(cigar, '[0-9]+([MIDS])', 1)) AS op,
generate_subscripts(regexp_extract_all(cigar, '[0-9]+([MIDS])', 1), 1) AS i FROM c),
b AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'D') THEN n ELSE 0 END) OVER w, 0) AS r, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN n ELSE 0 END) OVER w, 0) AS q
FROM o WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT id, r, q, unnest(range(0, n)) AS k FROM b WHERE op = 'M'),
pile AS (SELECT chrom, (pos + r + k)::BIGINT AS pos, substr(seq, (q + k + 1)::BIGINT, 1) AS base, count(*) AS n FROM x JOIN s USING (id) WHERE q + k < length(seq) GROUP BY ALL)
"""


@query("pileup", _PILE + "SELECT * FROM pile")
def _pileup(t):
    return coverage.pileup(alignments(t))


@query("variant_calls", _PILE + """,
d AS (SELECT *, sum(n) OVER (PARTITION BY chrom, pos) AS depth, first_value(base) OVER (PARTITION BY chrom, pos ORDER BY n DESC, base) AS ref FROM pile)
SELECT chrom, pos, ref, base AS alt, least(99, floor(n * 1.0 / depth * 60))::BIGINT AS quality, depth::BIGINT AS depth, n AS alt_count,
CASE WHEN n * 1.0 / depth < .75 THEN '0/1' ELSE '1/1' END AS genotype FROM d WHERE depth >= 4 AND base <> ref AND n * 1.0 / depth >= .25
""")
def _calls(t):
    return coverage.call_variants(coverage.pileup(alignments(t)))


_SMOOTH = """
, u AS (SELECT * FROM aligned WHERE flag & 4 = 0 AND flag & 256 = 0 AND mapq >= 20),
size AS (SELECT chrom, max(start) + 200 AS n FROM u GROUP BY 1), axis AS (SELECT chrom, unnest(range(0, n)) AS pos FROM size),
d AS (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, start AS pos, 1 AS d FROM u UNION ALL SELECT chrom, start + 200, -1 FROM u) GROUP BY 1, 2),
cov AS (SELECT a.chrom, a.pos, sum(coalesce(d, 0)) OVER (PARTITION BY a.chrom ORDER BY a.pos) AS depth FROM axis a LEFT JOIN d ON d.chrom = a.chrom AND d.pos = a.pos),
sm AS (SELECT chrom, pos, (sum(depth) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING))::BIGINT AS total FROM cov)
"""


@query("smoothed_depth", _SMOOTH + "SELECT chrom, pos // 200 AS tile, sum(total)::BIGINT AS total, count(*) AS positions FROM sm WHERE total > 0 GROUP BY 1, 2", uses="aligned")
def _smooth(t):
    s = coverage.smoothed_depth(coverage.extended(coverage.usable(t.aligned)))
    return s.groupBy("chrom", F.floor(F.col("pos") / 200).alias("tile")).agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("positions"))


@query("peaks", _SMOOTH + """
, cut AS (SELECT chrom, quantile_cont(total, .95) AS c FROM sm WHERE total > 0 GROUP BY 1),
a AS (SELECT chrom, pos, total, c, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS g FROM sm JOIN cut USING (chrom) WHERE total > c),
p AS (SELECT chrom, g, min(pos) AS start, max(pos) + 1 AS "end", max(total) AS m, min(c) AS c FROM a GROUP BY 1, 2)
SELECT p.chrom, start, "end", min(a.pos) AS summit, round(m / 50.0, 6) AS score, round(m / 50.0 / greatest(p.c / 50.0, 1), 6) AS fold_enrichment, "end" - start AS length
FROM p JOIN a ON a.chrom = p.chrom AND a.g = p.g AND a.total = m WHERE m / 50.0 >= 5 GROUP BY ALL
""", uses="aligned")
def _peaks(t):
    out = coverage.call_peaks(coverage.extended(coverage.usable(t.aligned)))
    return rounded(out, "chrom", "start", "end", "summit", "length", score="score", fold_enrichment="fold_enrichment")


def control(t):
    return t.intervals.select("chrom", "start", "end")


_REF = """
, rd AS (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, start AS pos, 1 AS d FROM intervals UNION ALL SELECT chrom, "end", -1 FROM intervals) GROUP BY 1, 2),
rpos AS (SELECT chrom, pos FROM axis UNION SELECT chrom, pos FROM rd),
rcov AS (SELECT a.chrom, a.pos, sum(coalesce(d, 0)) OVER (PARTITION BY a.chrom ORDER BY a.pos) AS ref FROM rpos a LEFT JOIN rd ON rd.chrom = a.chrom AND rd.pos = a.pos),
bth AS (SELECT cov.*, ref FROM cov JOIN rcov USING (chrom, pos))
"""
_CN = """round(CASE WHEN r > 0 THEN log2((c + 1) / (r + 1)) ELSE 0 END, 6) AS log2_ratio, round(c, 6) AS coverage,
CASE WHEN r > 0 THEN greatest(0, round_even(2 * c / greatest(r, 1.0), 0))::BIGINT ELSE 2 END AS cn"""


@query("copy_number_vs_reference", _BASES + _REF + """
, b AS (SELECT chrom, pos // 1000 * 1000 AS start, sum(depth) / 1000.0 AS c, sum(ref) / 1000.0 AS r FROM bth WHERE pos < n // 1000 * 1000 GROUP BY 1, 2)
SELECT chrom, start, """ + _CN + " FROM b", uses="aligned intervals")
def _cnv(t):
    out = coverage.copy_number(t.aligned, control(t))
    return rounded(out, "chrom", "start", "cn", log2_ratio="log2_ratio", coverage="coverage")


@query("copy_number_vs_median", _BASES + """
, m AS (SELECT chrom, median(depth) AS r FROM cov GROUP BY 1),
b AS (SELECT chrom, pos // 1000 * 1000 AS start, sum(depth) / 1000.0 AS c FROM cov WHERE pos < n // 1000 * 1000 GROUP BY 1, 2)
SELECT chrom, start, """ + _CN + " FROM b JOIN m USING (chrom)", uses="aligned")
def _cnv_median(t):
    return rounded(coverage.copy_number(t.aligned), "chrom", "start", "cn", log2_ratio="log2_ratio", coverage="coverage")


@query("structural_variants", _BASES + _REF + """
, mc AS (SELECT chrom, greatest(median(depth), 1.0) AS m FROM bth WHERE depth > 0 GROUP BY 1),
mr AS (SELECT chrom, greatest(median(ref), 1.0) AS m FROM rcov WHERE ref > 0 GROUP BY 1),
q AS (SELECT chrom, pos, n, depth, (depth / mc.m) / (ref / mr.m + 1e-10) AS ratio FROM bth JOIN mc USING (chrom) JOIN mr USING (chrom)),
w AS (SELECT chrom, n, pos, avg(ratio) OVER v AS r, sum(depth) OVER v AS support FROM q WINDOW v AS (PARTITION BY chrom ORDER BY pos ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING)),
k AS (SELECT chrom, pos AS start, pos + 100 AS "end", CASE WHEN r < .5 THEN 'DEL' WHEN r > 1.5 THEN 'DUP' END AS kind,
least(1.0, CASE WHEN r < .5 THEN (.5 - r) / .5 ELSE (r - 1.5) / 1.5 END) AS conf, support FROM w WHERE pos % 50 = 0 AND pos < n - 100),
f AS (SELECT *, CASE WHEN lag(kind) OVER o = kind AND start <= lag("end") OVER o + 1000 THEN 0 ELSE 1 END AS brk FROM k WHERE kind IS NOT NULL WINDOW o AS (PARTITION BY chrom ORDER BY start)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY chrom ORDER BY start) AS island FROM f)
SELECT chrom, min(start) AS start, max("end") AS "end", kind AS sv_type, max("end") - min(start) AS size, round(max(conf), 5) AS confidence, sum(support)::BIGINT AS support_reads
FROM g GROUP BY chrom, island, kind
""", uses="aligned intervals")
def _sv(t):
    out = coverage.structural_variants(t.aligned, control(t))
    return rounded(out, "chrom", "start", "end", "sv_type", "size", "support_reads", digits=5, confidence="confidence")


@query("copy_number_classes", _BASES + """
, m AS (SELECT chrom, median(depth) AS r FROM cov GROUP BY 1),
b AS (SELECT chrom, pos // 1000 AS k, sum(depth) / 1000.0 AS c FROM cov WHERE pos < n // 1000 * 1000 GROUP BY 1, 2)
SELECT CASE WHEN r > 0 THEN greatest(0, round_even(2 * c / greatest(r, 1.0), 0))::BIGINT ELSE 2 END AS cn, count(*) AS bins FROM b JOIN m USING (chrom) GROUP BY 1
""", uses="aligned")
def _cn_classes(t):
    return coverage.copy_number(t.aligned).groupBy("cn").agg(F.count(F.lit(1)).alias("bins"))


@query("filter_variants", "SELECT id FROM variants WHERE qual >= 20 AND depth >= 5 AND CASE WHEN depth > 0 THEN alt_count * 1.0 / depth ELSE 0 END <= .95", uses="variants")
def _vfilter(t):
    return variants.filter_variants(t.variants).select("id")


_ALLELES = """
, a AS (SELECT chrom, ref, unnest(string_split(alt, ',')) AS allele FROM variants),
k AS (SELECT *, length(ref) = 1 AND length(allele) = 1 AND ref <> allele AS snp, length(ref) = 1 AND length(allele) = 1 AND ref || allele IN ('AG', 'GA', 'CT', 'TC') AS ti FROM a)
"""


@query("variant_summary", _ALLELES + """
, p AS (SELECT chrom, count(*) FILTER (snp) AS snps, count(*) FILTER (length(ref) <> length(allele)) AS indels, count(*) FILTER (ti) AS transitions, count(*) FILTER (snp AND NOT ti) AS transversions FROM k GROUP BY ROLLUP (chrom)),
r AS (SELECT chrom, count(*) AS records, count(*) FILTER (contains(alt, ',')) AS multi_allelic, avg(qual) AS qm, count(*) FILTER (qual > 20) AS qual_above_20 FROM variants GROUP BY ROLLUP (chrom))
SELECT r.chrom, records, multi_allelic, round(qm, 6) AS qual_mean, qual_above_20, snps, indels, transitions, transversions, round(transitions / nullif(transversions, 0), 6) AS ts_tv
FROM r JOIN p ON r.chrom IS NOT DISTINCT FROM p.chrom
""", uses="variants")
def _vsum(t):
    out = variants.variant_summary(t.variants)
    return rounded(out, *[c for c in out.columns if c not in ("qual_mean", "ts_tv")], qual_mean="qual_mean", ts_tv="ts_tv")


@query("variant_quality_median", "SELECT median(qual) AS qual_median FROM variants", uses="variants")
def _vmedian(t):
    return variants.quality_median(t.variants)


@query("transition_transversion", _ALLELES + "SELECT count(*) FILTER (ti) AS transitions, count(*) FILTER (NOT ti) AS transversions, round(count(*) FILTER (ti) / nullif(count(*) FILTER (NOT ti), 0), 6) AS ts_tv FROM k WHERE snp", uses="variants")
def _tstv(t):
    return rounded(variants.ts_tv(t.variants), "transitions", "transversions", ts_tv="ts_tv")


@query("manhattan_positions", """
, v AS (SELECT id, chrom, pos, qual / 1000 AS p FROM variants), m AS (SELECT chrom, max(pos) AS m FROM v GROUP BY 1),
o AS (SELECT chrom, coalesce(sum(m + 1000000) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM m)
SELECT id, chrom, pos + off AS genome_pos, round(-log10(p + 1e-300), 6) AS neg_log10 FROM v JOIN o USING (chrom)
""", uses="variants")
def _manhattan(t):
    df = t.variants.withColumn("chrom", F.concat(F.lit("chr"), "chrom")).withColumn("p", F.col("qual") / 1000)
    return rounded(variants.manhattan(df, "p", gap=1_000_000), "id", "chrom", "genome_pos", neg_log10="neg_log10")


@query("lead_snps", """
, h AS (SELECT chrom, pos, min(id) AS snp_id FROM variants WHERE qual < 20 GROUP BY 1, 2)


SELECT chrom, pos, snp_id FROM (SELECT chrom, unnest(list_reduce(list_transform(list_sort(list(pos)), lambda x: [x]), lambda a, x: CASE WHEN x[1] > a[len(a)] + 500 THEN a || x ELSE a END)) AS pos FROM h GROUP BY chrom) JOIN h USING (chrom, pos)
""", uses="variants")
def _leads(t):
    df = t.variants.select("chrom", "pos", F.col("id").alias("snp_id"), F.col("qual").alias("p_value"))
    return variants.lead_snps(df, 20.0, 500).select("chrom", "pos", "snp_id")


@query("point_contacts", """
WITH a AS (SELECT vec_id, label, embedding[1]::DOUBLE * 40 AS x, embedding[2]::DOUBLE * 40 AS y, embedding[3]::DOUBLE * 40 AS z FROM embeddings),
b AS (SELECT vec_id, label, embedding[4]::DOUBLE * 40 AS x, embedding[5]::DOUBLE * 40 AS y, embedding[6]::DOUBLE * 40 AS z FROM embeddings),
p AS (SELECT a.label AS structure, a.vec_id AS l, b.vec_id AS r, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d FROM a JOIN b USING (label))
SELECT structure, l AS left_id, r AS right_id, round(d, 5) AS distance FROM p WHERE d <= 5
""")
def _contacts(t):
    out = intervals.radius_pairs(points(t, 0), points(t, 3), 5.0)
    return rounded(out, "structure", F.col("vec_id").alias("left_id"), F.col("r_vec_id").alias("right_id"), digits=5, distance="distance")


def points(t, first):
    e = F.col("embedding")
    return t.embeddings.select(
        "vec_id", F.col("label").alias("structure"), *[(e[first + i].cast("double") * 40).alias(c) for i, c in enumerate("xyz")]
    )


@query("contact_energy", """
WITH a AS (SELECT vec_id, label, embedding[1]::DOUBLE * 40 AS x, embedding[2]::DOUBLE * 40 AS y, embedding[3]::DOUBLE * 40 AS z FROM embeddings),
b AS (SELECT vec_id, label, embedding[4]::DOUBLE * 40 AS x, embedding[5]::DOUBLE * 40 AS y, embedding[6]::DOUBLE * 40 AS z FROM embeddings),
p AS (SELECT a.label AS structure, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d FROM a JOIN b USING (label))
SELECT structure, count(*) AS contacts, round(-0.5 * sum(1 / (d + 0.1)), 4) AS energy FROM p WHERE d < 5 GROUP BY 1
""")
def _energy(t):
    return rounded(intervals.contact_energy(points(t, 0), points(t, 3)), "structure", "contacts", digits=4, energy="energy")

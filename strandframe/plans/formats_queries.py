"""Registered queries: parsers of text formats, over lines made from the events table.

A tenth of the lines are comments and an eleventh are too short, so that what the formats leave out is compared too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pieces
from ..sources import formats
from .catalog import query
from .sequences_queries import _orf_sql

_KEPT = "FROM events WHERE event_id % 10 <> 0 AND event_id % 11 <> 0"


def _lines(t, comment: str, *fields: str):
    line = F.concat_ws("\t", *[F.expr(f).cast("string") for f in fields])
    return t.events.select(F.when(F.col("event_id") % 10 == 0, f"{comment} note").when(F.col("event_id") % 11 == 0, "x").otherwise(line).alias("line"))


@query("parse_vcf", f"SELECT 'chr' || (user_id % 5) AS chrom, event_id AS pos, 'rs' || event_id AS id, 'A' AS ref, 'C' AS alt, CASE WHEN event_id % 7 > 0 THEN (event_id % 97)::DOUBLE END AS qual, event_type AS filter, 'U=' || user_id AS info {_KEPT}")
def _vcf(t):
    return formats.parse_vcf(_lines(t, "#", "concat('chr', user_id % 5)", "event_id", "concat('rs', event_id)", "'A'", "'C'", "if(event_id % 7 > 0, string(event_id % 97), '.')", "event_type", "concat('U=', user_id)"))


@query("parse_sam", f"SELECT 'r' || event_id AS qname, (event_id % 4096)::INT AS flag, event_id AS pos, '4M' AS cigar, event_type AS seq, CASE WHEN event_id % 3 > 0 THEN (user_id % 9)::VARCHAR END AS nm {_KEPT}")
def _sam(t):
    lines = _lines(t, "@CO", "concat('r', event_id)", "event_id % 4096", "'chr1'", "event_id", "60", "'4M'", "'*'", "0", "0", "event_type", "'IIII'", "if(event_id % 3 > 0, 'NM:i:77', 'x')", "if(event_id % 3 > 0, concat('NM:i:', user_id % 9), 'x')")
    out = formats.parse_sam(lines)
    return out.select("qname", "flag", "pos", "cigar", "seq", F.col("tags")["NM"].alias("nm"))


@query("parse_sam_header", "SELECT 'SQ' AS record, 'chr' || event_id AS sn, (user_id * 10)::VARCHAR AS ln, 2::BIGINT AS fields FROM events WHERE event_id % 10 <> 0 AND event_id % 11 <> 0")
def _sam_header(t):
    out = formats.parse_sam_header(_lines(t, "@CO", "'@SQ'", "concat('SN:chr', event_id)", "concat('LN:', user_id * 10)"))
    return out.select("record", F.col("fields")["SN"].alias("sn"), F.col("fields")["LN"].alias("ln"), F.size("fields").cast("long").alias("fields"))


@query("parse_bed", f"SELECT 'chr' || (user_id % 5) AS chrom, event_id AS \"start\", event_id + 9 AS \"end\", event_type AS name, CASE WHEN event_id % 7 > 0 THEN (event_id % 97)::DOUBLE END AS score, '+' AS strand {_KEPT}")
def _bed(t):
    return formats.parse_bed(_lines(t, "#", "concat('chr', user_id % 5)", "event_id", "event_id + 9", "event_type", "if(event_id % 7 > 0, string(event_id % 97), '.')", "'+'")).select("chrom", "start", "end", "name", "score", "strand")


@query("parse_gff", f"SELECT 'chr1' AS chrom, event_type AS feature, event_id AS \"start\", event_id + 5 AS \"end\", 'g' || user_id AS id, 'a=b' AS note {_KEPT}")
def _gff(t):
    out = formats.parse_gff(_lines(t, "#", "'chr1'", "'src'", "event_type", "event_id", "event_id + 5", "'.'", "'+'", "'.'", "concat('ID=earlier;Note=n; ID=g', user_id, '; Note=a=b;')"))
    return out.select("chrom", "feature", "start", "end", F.col("attributes")["ID"].alias("id"), F.col("attributes")["Note"].alias("note"))


@query("parse_gtf", f"SELECT event_type AS feature, event_id AS \"start\", 'G' || user_id AS gene_id, 'first' AS tag {_KEPT}")
def _gtf(t):
    out = formats.parse_gtf(_lines(t, "#", "'chr1'", "'src'", "event_type", "event_id", "event_id + 5", "'.'", "'+'", "'.'", "concat('gene_id \"G', user_id, '\"; tag \"first\"; tag \"second\";')"))
    return out.select("feature", "start", F.col("attributes")["gene_id"].alias("gene_id"), F.col("attributes")["tag"].alias("tag"))


@query("parse_bisulfite", f"SELECT 'chr1' AS chrom, event_id AS pos, event_type AS context, (event_id % 5)::INT AS methylated, (event_id % 8)::INT AS coverage, round((event_id % 5) / greatest(event_id % 8, 1), 8) AS level {_KEPT}")
def _bisulfite(t):
    out = formats.parse_bisulfite(_lines(t, "#", "'chr1'", "event_id", "event_id + 1", "event_id % 5", "event_id % 8", "event_type"))
    return out.withColumn("level", F.round("level", 8))


@query("parse_kraken", f"SELECT CASE WHEN event_id % 2 = 0 THEN 'C' ELSE 'U' END AS status, 'r' || event_id AS read_id, user_id::VARCHAR AS taxon {_KEPT}")
def _kraken(t):
    return formats.parse_kraken(_lines(t, "#", "if(event_id % 2 = 0, 'C', 'U')", "concat('r', event_id)", "user_id", "100"))


@query("parse_associations", f"SELECT DISTINCT 'g' || user_id AS gene, event_type AS term {_KEPT}")
def _associations(t):
    return formats.parse_associations(_lines(t, "#", "concat('g', user_id)", "event_type"))


@query("parse_fastq", "SELECT 'r' || event_id AS read_id, event_type AS seq, 'q' || user_id AS qual FROM events")
def _fastq(t):
    lines = t.events.select(F.posexplode(F.array(F.concat(F.lit("@r"), "event_id"), "event_type", F.lit("+"), F.concat(F.lit("q"), "user_id"))).alias("k", "line"), "event_id")
    return formats.parse_fastq(lines.select("line", (F.col("event_id") * 4 + F.col("k")).alias("n")))


def _fasta_lines(t):
    """The sequences as FASTA: a header line, then lines of 60 letters."""
    lines = F.concat(F.array(F.concat(F.lit(">"), "seq_id")), F.regexp_extract_all("seq", F.lit(".{1,60}"), F.lit(0)))
    return t.dna.select("seq_id", F.posexplode(lines).alias("i", "line")).select(F.lit("f").alias("file"), (F.col("seq_id") * 1_000_000 + F.col("i")).alias("n"), "line")


@query("parse_fasta_pieces", """
, p AS (SELECT seq_id, seq, unnest(range(0, length(seq), 6144)) AS o FROM dna)
SELECT seq_id::VARCHAR AS seq_id, o // 6144 AS piece, o AS "offset", least(6144, length(seq) - o)::BIGINT AS size, length(seq)::BIGINT AS seq_len, md5(substr(seq, o + 1, 6144)) AS digest FROM p
""", uses="dna")
def _fasta(t):
    out = formats.fasta_pieces(_fasta_lines(t), pieces.SIZE)
    return out.select("seq_id", "piece", "offset", F.col("size").cast("long").alias("size"), "seq_len", F.md5("text").alias("digest"))


@query("fasta_open_reading_frames", _orf_sql(), uses="dna")
def _fasta_orfs(t):
    long = pieces.with_ahead(formats.fasta_pieces(_fasta_lines(t), pieces.SIZE), "seq_id", 2)
    return pieces.orfs(long.withColumn("seq_id", F.col("seq_id").cast("long")), 30, reverse=True)

"""Registered queries: readers and writers of files, over text made from the driver tables and written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tables
from ..session import shared_base
from ..sources import formats, sinks
from .catalog import query
from .matrix_queries import rounded


def _path(t, name: str) -> str:
    return f"{shared_base(t.spark)}/{uuid.uuid4().hex}/{name}"


def _text(t, df: DataFrame, value, name: str) -> str:
    """``value``, of one line or several, as text; the rows of ``df`` keep their order within and over the files."""
    path = _path(t, name)
    df.select(value.alias("value")).write.text(path)
    return path


def _lined(seq: str, width: int):
    return F.array_join(F.regexp_extract_all(seq, F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")


def _fasta(t) -> str:
    return _text(t, t.dna, F.concat(F.lit(">seq"), "seq_id", F.lit(" of text\n"), _lined("seq", 70)), "x.fa")


@query("read_fasta", "SELECT 'seq' || seq_id || ' of text' AS seq_id, md5(seq) AS digest, length(seq) AS length FROM dna", uses="dna")
def _read_fasta(t):
    return formats.read_fasta(t.spark, _fasta(t)).select("seq_id", F.md5("seq").alias("digest"), F.length("seq").cast("long").alias("length"))


@query("read_fasta_tokens", "SELECT 'seq' || seq_id AS seq_id, md5(seq) AS digest FROM dna", uses="dna")
def _read_tokens(t):
    return formats.read_fasta(t.spark, _fasta(t), first_token=True).select("seq_id", F.md5("seq").alias("digest"))


@query("read_genbank", """
SELECT 'V' || seq_id || '.1' AS id, md5(seq) AS digest, 'gene' AS type, '1..' || length(seq) AS location, 'g' || seq_id AS gene, 'two words' AS note FROM dna
""", uses="dna")
def _genbank(t):
    head = F.concat(F.lit("LOCUS       L"), "seq_id", F.lit("\nVERSION     V"), "seq_id", F.lit(".1\nFEATURES             Location/Qualifiers\n     gene            1.."), F.length("seq"))
    body = F.concat(F.lit('\n                     /gene="g'), "seq_id", F.lit('"\n                     /note="two\n                     words"\nORIGIN\n        1 '), F.lower("seq"), F.lit("\n//"))
    out = formats.read_genbank(t.spark, _text(t, t.dna, F.concat(head, body), "x.gb")).select("id", F.md5("seq").alias("digest"), F.inline("features"))
    return out.select("id", "digest", "type", "location", F.col("qualifiers")["gene"][0].alias("gene"), F.col("qualifiers")["note"][0].alias("note"))


@query("read_saf", "SELECT 'g' || event_id AS gene_id, event_type AS chrom, event_id AS \"start\", event_id + user_id AS \"end\", CASE WHEN event_id % 3 = 0 THEN '-' ELSE '+' END AS strand FROM events")
def _saf(t):
    line = F.concat_ws("\t", F.concat(F.lit("g"), "event_id"), "event_type", F.col("event_id").cast("string"), (F.col("event_id") + F.col("user_id")).cast("string"), F.when(F.col("event_id") % 3 == 0, "-"))
    return formats.read_saf(t.spark, _text(t, t.events, line, "x.saf"))


@query("parse_stockholm", "SELECT 's' || seq_id AS name, md5(seq) AS digest FROM dna WHERE length(seq) > 0", uses="dna")
def _stockholm(t):
    half = F.ceil(F.length("seq") / 2).cast("int")
    blocks = F.array(F.lit("# STOCKHOLM 1.0"), F.concat(F.lit("s"), "seq_id", F.lit("  "), F.substring("seq", F.lit(1), half)), F.lit(""), F.concat(F.lit("s"), "seq_id", F.lit(" "), F.substring("seq", half + 1, F.length("seq"))), F.lit("//"))
    lines = t.dna.select("seq_id", F.posexplode(blocks).alias("k", "line")).select((F.col("k").cast("long") * 1_000_000_000_000 + F.col("seq_id")).alias("n"), "line")
    return formats.parse_stockholm(lines).select("name", F.md5("aligned").alias("digest"))


@query("newick_nodes", """
SELECT event_id AS tree_id, unnest([0, 1, 2, 3, 4]) AS node_id, unnest([-1, 0, 0, 2, 2]) AS parent_id, unnest(['r', 'u' || user_id, 'x', 'v' || event_id, 'w']) AS name, unnest([NULL, 1.5, 0.5, 2.0, NULL])::DOUBLE AS branch_length, unnest([false, true, false, true, true]) AS is_leaf FROM events
""")
def _newick(t):
    tree = F.concat(F.lit("(u"), "user_id", F.lit(":1.5,(v"), "event_id", F.lit(":2,w)x:0.5)r;"))
    return formats.newick_nodes(t.events.select(F.col("event_id").alias("tree_id"), tree.alias("tree"))).fillna(-1, ["parent_id"])


@query("read_peaks", "SELECT chrom, \"start\", \"end\", name::VARCHAR AS name, (name % 97)::DOUBLE AS score FROM intervals", uses="intervals")
def _peaks(t):
    line = F.concat_ws("\t", "chrom", *[F.col(c).cast("string") for c in ("start", "end", "name")], (F.col("name") % 97).cast("string"))
    return formats.read_peaks(t.spark, _text(t, t.intervals, line, "x.bed"))


_SAMPLES = ("AF", "NF", "NO", "RF")


@query("read_counts", """
, s(sample) AS (VALUES ('AF'), ('NF'), ('NO'), ('RF')) SELECT f.feature::VARCHAR AS feature, s.sample, c."count"::DOUBLE AS "count" FROM (SELECT DISTINCT feature FROM counts) f, s LEFT JOIN counts c ON c.feature = f.feature AND c.sample = s.sample
""", uses="counts")
def _counts(t):
    path = _path(t, "x.tsv")
    t.counts.groupBy("feature").pivot("sample", list(_SAMPLES)).agg(F.sum("count")).write.option("header", True).csv(path, sep="\t")
    return formats.read_counts(t.spark, path)


@query("read_table", "SELECT o_orderkey::INTEGER AS o_orderkey, o_orderstatus, o_totalprice::DOUBLE AS o_totalprice FROM orders")
def _table(t):
    path = _path(t, "x.csv")
    t.orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice")).write.option("header", True).csv(path)
    return formats.read_table(t.spark, path)


@query("load_by_extension", "SELECT chrom, pos, ref, alt, qual FROM variants", uses="variants")
def _load(t):
    path = _path(t, "x.vcf")
    sinks.write_vcf(t.variants, path)
    return formats.load(t.spark, path).select("chrom", "pos", "ref", "alt", "qual")


@query("write_bed", "SELECT chrom, \"start\", \"end\", name::VARCHAR AS name FROM intervals", uses="intervals")
def _write_bed(t):
    path = _path(t, "x.bed")
    sinks.write_bed(t.intervals, path)
    return formats.read_bed(t.spark, path).select("chrom", "start", "end", "name")


@query("write_fastq", "SELECT 'r' || read_id AS read_id, md5(seq) AS seq, md5(qual) AS qual FROM reads WHERE seq <> ''", uses="reads")
def _write_fastq(t):
    path = _path(t, "x.fq")
    sinks.write_fastq(t.reads.where("seq <> ''").withColumn("read_id", F.concat(F.lit("r"), "read_id")), path)
    return formats.read_fastq(t.spark, path).select("read_id", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"))


@query("read_quantification", "SELECT 't' || event_id AS transcript_id, value AS tpm, user_id::DOUBLE AS num_reads FROM events")
def _quantification(t):
    path = _path(t, "quant.sf")
    t.events.select(F.concat(F.lit("t"), "event_id").alias("Name"), F.col("value").alias("TPM"), F.col("user_id").alias("NumReads")).write.option("header", True).csv(path, sep="\t")
    return formats.read_quantification(t.spark, path)


def _obo(t) -> str:
    obsolete = F.when(F.col("c_custkey") % 10 == 0, F.lit("is_obsolete: true\n")).otherwise("")
    record = F.concat(
        F.lit("\n[Term]\nid: c"), "c_custkey", F.lit("\nname: "), "c_name", F.lit("\nnamespace: "), "c_mktsegment", F.lit('\ndef: "a customer" [x]\n'), obsolete,
        F.lit("is_a: n"), "c_nationkey", F.lit(" ! nation\nis_a: root\n\n[Typedef]\nid: part_of"),
    )
    return _text(t, t.customer, record, "x.obo")


@query("read_obo_terms", "SELECT 'c' || c_custkey AS term_id, c_name AS name, c_mktsegment AS namespace, 'a customer' AS definition FROM customer WHERE c_custkey % 10 <> 0")
def _obo_terms(t):
    return formats.read_obo(t.spark, _obo(t))[0]


@query("read_obo_edges", "SELECT 'c' || c_custkey AS child, unnest(['n' || c_nationkey, 'root']) AS parent FROM customer WHERE c_custkey % 10 <> 0")
def _obo_edges(t):
    return formats.read_obo(t.spark, _obo(t))[1]


@query("read_pdb", """
SELECT (vec_id % 100000)::INTEGER AS serial, 'CA' AS atom, 'GLY' AS res, chr(65 + label % 26) AS chain, (vec_id % 10000)::INTEGER AS resseq, (vec_id % 977) / 8 AS x, -(vec_id % 89) / 4 AS y, label / 2 AS z, 0.5::DOUBLE AS occupancy, (vec_id % 50)::DOUBLE AS bfactor FROM embeddings
""")
def _pdb(t):
    v, label = F.col("vec_id"), F.col("label")
    line = F.format_string(
        "ATOM  %5d  CA  GLY %s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", v % 100000, F.char(label % 26 + 65), v % 10000, v % 977 / 8, -(v % 89) / 4, label / 2, F.lit(0.5), (v % 50).cast("double")
    )
    return formats.read_pdb(t.spark, _text(t, t.embeddings, line, "x.pdb")).drop("structure")


@query("run_log_steps", "SELECT event_id AS step_id, event_type AS step, CASE WHEN value > 50 THEN 'ok' ELSE 'error' END AS status, round(value, 6) AS duration_ms FROM events WHERE user_id % 2 = 0")
def _steps(t):
    path = _path(t, "log.parquet")
    status = F.when(F.col("value") > 50, "ok").otherwise("error")
    rows = t.events.select(F.col("event_id").alias("step_id"), (F.col("user_id") % 2).cast("string").alias("session"), F.col("event_type").alias("step"), status.alias("status"), F.col("value").alias("duration_ms"))
    for half in (0, 1):  # appended in two parts
        sinks.append_steps(rows.where(F.col("step_id") % 2 == half), path)
    return rounded(sinks.read_steps(t.spark, path, "0"), "step_id", "step", "status", duration_ms="duration_ms")


@query("cell_matrix", "SELECT l_suppkey::VARCHAR AS cell, 'g' || (l_partkey % 300) AS gene, sum(l_quantity)::DOUBLE AS \"count\" FROM lineitem GROUP BY 1, 2")
def _cells(t):
    folder = _path(t, "tenx")
    counts = t.lineitem.groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 300).alias("gene")).agg(F.sum("l_quantity").alias("n"))
    # suppliers and genes are numbered from 0, so the line of a cell or gene follows from its number
    t.supplier.orderBy("s_suppkey").select(F.col("s_suppkey").cast("string")).write.text(f"{folder}/barcodes.tsv")
    t.spark.range(300).orderBy("id").select(F.concat(F.lit("g"), "id", F.lit("\tname"))).write.text(f"{folder}/features.tsv")
    head = t.spark.createDataFrame([(0, "%%MatrixMarket"), (1, "300 1 1")], "k int, value string").select("k", F.lit(None).cast("long").alias("cell"), F.lit(None).cast("long").alias("gene"), "value")
    body = counts.select(F.lit(2).alias("k"), "cell", "gene", F.concat_ws(" ", (F.col("gene") + 1).cast("string"), (F.col("cell") + 1).cast("string"), F.col("n").cast("string")).alias("value"))
    # after the head, entries go by cell and gene: ordered by "k" alone they would all be one task and one file
    head.unionByName(body).orderBy("k", "cell", "gene").select("value").write.text(f"{folder}/matrix.mtx")
    return formats.read_mtx(t.spark, folder)


@query("fasta_errors", "SELECT seq_id, concat_ws(';', CASE WHEN seq_id % 7 = 0 THEN 'empty header' END, CASE WHEN seq_id % 5 = 0 OR seq = '' THEN 'empty sequence' END) AS errors FROM dna", uses="dna")
def _fasta_errors(t):
    df = t.dna.select("seq_id", F.when(F.col("seq_id") % 7 == 0, " ").otherwise("x").alias("name"), F.when(F.col("seq_id") % 5 == 0, "").otherwise(F.col("seq")).alias("seq"))
    return df.select("seq_id", F.array_join(tables.fasta_errors("name"), ";").alias("errors"))

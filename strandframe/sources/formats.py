"""Readers of genomics text formats into typed tables.

Records that a separator marks (FASTA, GenBank, OBO) are read with that separator, so files stay splittable. Only
formats whose records are counted lines (FASTQ, Stockholm) number their lines. Compressed files are read as they are.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# The tree reader travels to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "\\r$", "").alias("line"))


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(F.regexp_replace("value", "\\r", "").alias("record"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a running number in file order.

    Lines are counted per split; a split is known by its file and offset, and only its count takes part in the running sum.
    """
    rows = spark.read.text(path).select(
        F.regexp_replace("value", "\\r$", "").alias("line"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"),
    )
    splits = rows.groupBy("_f", "_b").agg(F.min("_i").alias("_low"), F.count(F.lit(1)).alias("_lines"))
    before = F.coalesce(F.sum("_lines").over(W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(splits.withColumn("_before", before), ["_f", "_b"]).select(
        "line", (F.col("_before") + F.col("_i") - F.col("_low")).alias("n"), F.col("_f").alias("file")
    )


def _fields(lines: DataFrame, least: int, sep: str = "\t", comment: str = "#") -> DataFrame:
    """Split lines, leaving out blank and comment lines and lines of fewer than ``least`` fields."""
    body = lines.filter((F.trim("line") != "") & ~F.col("line").startswith(comment))
    return body.select(F.split("line", sep, -1).alias("f")).filter(F.size("f") >= least)


def _at(i: int) -> Column:
    return F.get("f", F.lit(i))


def _number(i: int, kind: str) -> Column:
    return _at(i).try_cast(kind)


# ---- sequences ---------------------------------------------------------------------------------------------------


def read_fasta(spark: SparkSession, path: str, first_token: bool = False) -> DataFrame:
    """``seq_id, seq``; the header is the whole line, or its first word with ``first_token``."""
    rec = _records(spark, path, "\n>").select(F.regexp_replace("record", "^>", "").alias("record")).filter(F.trim("record") != "")
    head = F.trim(F.substring_index("record", "\n", 1))
    body = F.when(F.instr("record", "\n") > 0, F.expr("substring(record, instr(record, '\n') + 1)")).otherwise("")
    return rec.select((F.substring_index(head, " ", 1) if first_token else head).alias("seq_id"), F.regexp_replace(body, "\\s", "").alias("seq"))


LINE_TILE = 1 << 16


def fasta_pieces(lines: DataFrame, size: int, first_token: bool = False) -> DataFrame:
    """``record, seq_id, piece, offset, size, seq_len, text``: sequences of any length in pieces of ``size`` letters, from single lines.

    ``lines`` has ``file, n, line``, ``n`` rising in file order. The number of the record, its name and the place where it begins
    are carried from line to line: running values inside tiles of lines, and one row for each tile along the whole input. A
    line is cut where pieces meet and sent to its (record, piece), so no row is longer than a piece or a line. Letters before the
    first header of a file belong to no record; a record without letters has no piece (``read_fasta`` lists it). ``record`` tells
    sequences of one name apart. ``operators.pieces`` scans the result.
    """
    head = F.col("line").startswith(">")
    name = F.trim(F.substring("line", 2, 2147483647))
    letters = F.when(head, F.lit("")).otherwise(F.regexp_replace("line", "\\s", ""))
    rows = lines.select(
        "file", "n", F.floor(F.col("n") / LINE_TILE).alias("_tile"), letters.alias("_letters"), F.length(letters).cast("long").alias("_len"),
        F.when(head, F.substring_index(name, " ", 1) if first_token else name).alias("_name"), head.alias("_head"),
    )
    inside = W.partitionBy("_tile").orderBy("n")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    # a file begins a record without a name, so that a record never goes on from the file before
    opens = F.col("_head") | (F.lag("file").over(inside) != F.col("file"))
    summed = rows.withColumn("_opens", F.coalesce(opens, F.col("_head"))).withColumn("_in", F.sum("_len").over(upto))
    last = F.last(F.when(F.col("_opens"), F.struct((F.col("_in") - F.col("_len")).alias("start"), F.col("_name").alias("name"))), ignorenulls=True)
    local = summed.select("file", "n", "_tile", "_letters", "_len", "_in", last.over(upto).alias("_own"), F.sum(F.col("_opens").cast("long")).over(upto).alias("_records"))

    tiles = local.groupBy("_tile").agg(
        F.max("_in").alias("_letters_in"), F.max("_records").alias("_records_in"), F.max_by("_own", "n").alias("_last"), F.min_by("file", "n").alias("_first_file"), F.max_by("file", "n").alias("_last_file")
    )
    before = W.orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    counted = tiles.select(
        "_tile", "_last", F.coalesce(F.sum("_letters_in").over(before), F.lit(0)).alias("_at"), F.coalesce(F.sum("_records_in").over(before), F.lit(0)).alias("_no"),
        (F.lag("_last_file").over(W.orderBy("_tile")) == F.col("_first_file")).alias("_same"),
    )
    ended = F.when(F.col("_last").isNotNull(), F.struct((F.col("_at") + F.col("_last.start")).alias("start"), F.col("_last.name").alias("name"))).when(
        ~F.col("_same"), F.struct(F.col("_at").alias("start"), F.lit(None).cast("string").alias("name"))
    )
    carried = counted.withColumn("_carry", F.last(ended, ignorenulls=True).over(before)).select("_tile", "_at", "_no", F.when(F.col("_same"), F.col("_carry")).alias("_carry"))

    start = F.coalesce(F.col("_at") + F.col("_own.start"), F.col("_carry.start"))
    placed = local.join(carried, "_tile").select(
        (F.col("_no") + F.col("_records")).alias("record"), F.when(F.col("_own").isNotNull(), F.col("_own.name")).otherwise(F.col("_carry.name")).alias("seq_id"),
        "_letters", "_len", (F.col("_at") + F.col("_in") - F.col("_len") - start).alias("_offset"),
    ).where("seq_id IS NOT NULL AND _len > 0")
    lengths = placed.groupBy("record").agg(F.sum("_len").alias("seq_len"))
    cut = placed.select("*", F.explode(F.sequence(F.floor(F.col("_offset") / size), F.floor((F.col("_offset") + F.col("_len") - 1) / size))).alias("piece"))
    low = F.greatest(F.col("_offset"), F.col("piece") * size)
    high = F.least(F.col("_offset") + F.col("_len"), (F.col("piece") + 1) * size)
    part = F.struct(low.alias("at"), F.substring("_letters", (low - F.col("_offset")).cast("int") + 1, (high - low).cast("int")).alias("text"))
    joined = cut.groupBy("record", "seq_id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "").alias("text"))
    return joined.join(lengths, "record").select("record", "seq_id", "piece", (F.col("piece") * size).alias("offset"), F.length("text").alias("size"), "seq_len", "text")


def read_fasta_pieces(spark: SparkSession, path: str, size: int, first_token: bool = False) -> DataFrame:
    """``fasta_pieces`` of the lines of files."""
    return fasta_pieces(_numbered(spark, path), size, first_token)


def parse_fastq(lines: DataFrame) -> DataFrame:
    """``read_id, seq, qual`` of four-line records."""
    lines = lines.filter("line <> ''").select(F.floor(F.col("n") / 4).alias("rec"), (F.col("n") % 4).alias("role"), "line")

    def role(k: int) -> Column:
        return F.max(F.when(F.col("role") == k, F.col("line")))

    return lines.groupBy("rec").agg(F.regexp_replace(role(0), "^@", "").alias("read_id"), role(1).alias("seq"), role(3).alias("qual")).filter(
        "read_id IS NOT NULL AND seq IS NOT NULL AND qual IS NOT NULL"
    ).drop("rec")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``parse_fastq`` of the lines of files."""
    return parse_fastq(_numbered(spark, path))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """``id, seq, features`` with type, location and qualifiers per feature."""
    rec = _records(spark, path, "\n//").filter(F.col("record").contains("LOCUS"))
    found = [F.nullif(F.regexp_extract("record", f"(?m)^{k}\\s+(\\S+)", 1), F.lit("")) for k in ("VERSION", "ACCESSION", "LOCUS")]
    seq = F.upper(F.regexp_replace(F.regexp_extract("record", "(?s)\\nORIGIN[^\\n]*(.*)$", 1), "[^A-Za-z]", ""))
    block = F.regexp_extract("record", "(?s)\\nFEATURES[^\\n]*\\n(.*?)(?=\\n[A-Z]|$)", 1)
    parts = F.filter(F.split(block, "(?m)^ {5}(?=\\S)"), lambda p: F.trim(p) != "")

    def feature(p: Column) -> Column:
        pattern = F.lit("(?s)\\n\\s+/(\\w+)=(\"[^\"]*\"|[^\\n]*)")
        keys = F.regexp_extract_all(p, pattern, F.lit(1))
        values = F.transform(F.regexp_extract_all(p, pattern, F.lit(2)), lambda v: F.regexp_replace(F.regexp_replace(v, "\"", ""), "\\n\\s+", " "))
        pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
        grouped = F.transform(
            F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.transform(F.filter(pairs, lambda x: x["k"] == k), lambda x: x["v"]).alias("value"))
        )
        location = F.regexp_replace(F.regexp_extract(p, "(?s)^\\S+\\s+(.*?)(?=\\n\\s+/|\\s*$)", 1), "\\s", "")
        return F.struct(F.regexp_extract(p, "^(\\S+)", 1).alias("type"), location.alias("location"), F.map_from_entries(grouped).alias("qualifiers"))

    return rec.select(F.coalesce(*found).alias("id"), seq.alias("seq"), F.transform(parts, feature).alias("features"))


def parse_stockholm(lines: DataFrame) -> DataFrame:
    """``name, aligned`` with the blocks of a name joined in file order."""
    rows = lines.filter("line <> '' AND line NOT LIKE '#%' AND line NOT LIKE '//%'").select(
        "n", F.split(F.trim("line"), "\\s+").alias("f")
    ).filter("size(f) >= 2")
    parts = rows.groupBy(F.col("f")[0].alias("name")).agg(F.array_sort(F.collect_list(F.struct("n", F.col("f")[1].alias("t")))).alias("p"))
    return parts.select("name", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("aligned"))


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """``parse_stockholm`` of the lines of files."""
    return parse_stockholm(_numbered(spark, path))


def stockholm_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of the #=GF lines."""
    gf = _lines(spark, path).filter("line LIKE '#=GF%'")
    return gf.select(F.regexp_extract("line", "^#=GF\\s+(\\S+)", 1).alias("key"), F.regexp_extract("line", "^#=GF\\s+\\S+\\s+(.*)$", 1).alias("value"))


# ---- alignments and variants -------------------------------------------------------------------------------------


def parse_vcf(lines: DataFrame, max_variants: int | None = None) -> DataFrame:
    """Eight VCF columns; lines of fewer fields are dropped and an unreadable QUAL is NULL."""
    out = _fields(lines, 8).select(
        _at(0).alias("chrom"), _number(1, "bigint").alias("pos"), _at(2).alias("id"), _at(3).alias("ref"), _at(4).alias("alt"),
        _number(5, "double").alias("qual"), _at(6).alias("filter"), _at(7).alias("info"),
    )
    return out if max_variants is None else out.limit(max_variants)


def read_vcf(spark: SparkSession, path: str, max_variants: int | None = None) -> DataFrame:
    """``parse_vcf`` of the lines of files."""
    return parse_vcf(_lines(spark, path), max_variants)


def variant_intervals(vcf: DataFrame) -> DataFrame:
    """0-based intervals of one base."""
    return vcf.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), "id")


def _last_of_each(pairs: Column) -> Column:
    """A map from an array of (key, value) structs; of a repeated key the last is kept."""
    keys = F.transform(pairs, lambda x: x["key"])
    lasts = F.filter(pairs, lambda x, i: F.array_position(F.reverse(keys), x["key"]) == F.size(pairs) - i)
    return F.map_from_entries(lasts)


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


SAM_COLUMNS = (
    ("qname", "string"), ("flag", "bigint"), ("rname", "string"), ("pos", "bigint"), ("mapq", "bigint"), ("cigar", "string"),
    ("rnext", "string"), ("pnext", "bigint"), ("tlen", "bigint"), ("seq", "string"), ("qual", "string"),
)


def parse_sam(lines: DataFrame) -> DataFrame:
    """Eleven typed SAM columns and ``tags``, a map from tag to value; of a repeated tag the last is kept."""
    f = _fields(lines, 11, comment="@")
    tags = _last_of_each(
        F.transform(F.filter(F.slice("f", F.lit(12), F.size("f")), lambda x: F.length(x) >= 5), lambda x: _pair(F.substring(x, 1, 2), F.substring(x, 6, 1 << 30)))
    )
    return f.select(*[(_at(i) if t == "string" else _number(i, t)).alias(n) for i, (n, t) in enumerate(SAM_COLUMNS)], tags.alias("tags"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """``parse_sam`` of the lines of files."""
    return parse_sam(_lines(spark, path))


def parse_sam_header(lines: DataFrame) -> DataFrame:
    """``record`` (HD, SQ, RG, PG) and its ``fields`` map."""
    head = lines.filter(F.col("line").rlike("^@(HD|SQ|RG|PG)\t"))
    pairs = F.transform(F.slice(F.split("line", "\t"), F.lit(2), F.size(F.split("line", "\t"))), lambda x: _pair(F.substring_index(x, ":", 1), F.regexp_replace(x, "^[^:]*:", "")))
    return head.select(F.substring("line", 2, 2).alias("record"), _last_of_each(pairs).alias("fields"))


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """``parse_sam_header`` of the lines of files."""
    return parse_sam_header(_lines(spark, path))


# ---- intervals and annotations -----------------------------------------------------------------------------------


def parse_bed(lines: DataFrame, max_regions: int | None = None) -> DataFrame:
    """BED3 to BED9: absent columns are NULL; track and browser lines are left out."""
    lines = lines.filter(~F.col("line").rlike("^(track|browser)"))
    out = _fields(lines, 3).select(
        _at(0).alias("chrom"), _number(1, "bigint").alias("start"), _number(2, "bigint").alias("end"), _at(3).alias("name"), _number(4, "double").alias("score"),
        _at(5).alias("strand"), _number(6, "bigint").alias("thick_start"), _number(7, "bigint").alias("thick_end"), _at(8).alias("item_rgb"),
    ).filter("start IS NOT NULL AND `end` IS NOT NULL")
    return out if max_regions is None else out.limit(max_regions)


def read_bed(spark: SparkSession, path: str, max_regions: int | None = None) -> DataFrame:
    """``parse_bed`` of the lines of files."""
    return parse_bed(_lines(spark, path), max_regions)


def _annotation(lines: DataFrame, attributes: Column) -> DataFrame:
    return _fields(lines, 9).select(
        _at(0).alias("chrom"), _at(1).alias("source"), _at(2).alias("feature"), _number(3, "bigint").alias("start"), _number(4, "bigint").alias("end"),
        _number(5, "double").alias("score"), _at(6).alias("strand"), _at(7).alias("phase"), attributes.alias("attributes"),
    )


def parse_gff(lines: DataFrame) -> DataFrame:
    """GFF3 with its ``key=value;`` attributes as a map; of a repeated key the last is kept."""
    items = F.filter(F.transform(F.split(_at(8), ";"), lambda x: F.trim(x)), lambda x: x.contains("="))
    return _annotation(lines, _last_of_each(F.transform(items, lambda x: _pair(F.substring_index(x, "=", 1), F.regexp_replace(x, "^[^=]*=", "")))))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """``parse_gff`` of the lines of files."""
    return parse_gff(_lines(spark, path))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """GTF with its ``key "value";`` attributes as a map; of a repeated key the first is kept."""
    pattern = F.lit('(\\w+) "([^"]*)"')
    keys, values = (F.regexp_extract_all(_at(8), pattern, F.lit(k)) for k in (1, 2))
    firsts = F.filter(F.transform(keys, lambda k, i: F.when(F.array_position(keys, k) == i + 1, F.struct(k.alias("key"), F.get(values, i).alias("value")))), lambda x: x.isNotNull())
    return _annotation(lines, F.map_from_entries(firsts))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """``parse_gtf`` of the lines of files."""
    return parse_gtf(_lines(spark, path))


def parse_saf(lines: DataFrame) -> DataFrame:
    """SAF regions; the strand defaults to '+' and the header line is left out."""
    out = _fields(lines, 4).select(
        _at(0).alias("gene_id"), _at(1).alias("chrom"), _number(2, "bigint").alias("start"), _number(3, "bigint").alias("end"), F.coalesce(_at(4), F.lit("+")).alias("strand")
    )
    return out.filter("start IS NOT NULL")


def read_saf(spark: SparkSession, path: str) -> DataFrame:
    """``parse_saf`` of the lines of files."""
    return parse_saf(_lines(spark, path))


def parse_bisulfite(lines: DataFrame) -> DataFrame:
    """``chrom, pos, context, methylated, coverage, level`` of lines chrom, start, end, methylated, total, context."""
    out = _fields(lines, 6).select(
        _at(0).alias("chrom"), _number(1, "bigint").alias("pos"), _at(5).alias("context"), _number(3, "int").alias("methylated"), _number(4, "int").alias("coverage")
    )
    return out.filter("pos IS NOT NULL").withColumn("level", F.col("methylated") / F.greatest("coverage", F.lit(1)))


def read_bisulfite(spark: SparkSession, path: str) -> DataFrame:
    """``parse_bisulfite`` of the lines of files."""
    return parse_bisulfite(_lines(spark, path))


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    return read_bed(spark, path).select("chrom", "start", "end", "name", "score")


# ---- tables ------------------------------------------------------------------------------------------------------


def read_counts(spark: SparkSession, path: str, sep: str | None = None, feature: str = "feature") -> DataFrame:
    """Count matrix in long form ``feature, sample, count``; sample names are those of the header."""
    if sep is None:
        head = _lines(spark, path).filter((F.trim("line") != "") & ~F.col("line").startswith("#")).first()
        sep = max("\t,; ", key=head["line"].count) if head else ","
    wide = spark.read.option("comment", "#").csv(path, sep=sep, header=True)
    first, *samples = wide.columns
    typed = wide.select(F.col(f"`{first}`").alias(feature), *[F.col(f"`{s}`").try_cast("double").alias(s) for s in samples])
    return typed.unpivot(feature, samples, "sample", "count")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, tab-separated text, JSON or Parquet table by extension."""
    name = path.rstrip("/").removesuffix(".gz")
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith(".json"):
        return spark.read.json(path)
    return spark.read.csv(path, header=True, sep="," if name.endswith(".csv") else "\t", inferSchema=True)


def parse_kraken(lines: DataFrame) -> DataFrame:
    """Per-read classification ``status, read_id, taxon``."""
    return _fields(lines, 3).select(_at(0).alias("status"), _at(1).alias("read_id"), _at(2).alias("taxon"))


def read_kraken(spark: SparkSession, path: str) -> DataFrame:
    """``parse_kraken`` of the lines of files."""
    return parse_kraken(_lines(spark, path))


def read_quantification(spark: SparkSession, path: str) -> DataFrame:
    """Salmon quant.sf or Kallisto abundance.tsv as ``transcript_id, tpm, num_reads``."""
    df = spark.read.csv(path, header=True, sep="\t")
    name, tpm, reads = ("Name", "TPM", "NumReads") if "Name" in df.columns else ("target_id", "tpm", "est_counts")
    return df.select(F.col(name).alias("transcript_id"), F.col(tpm).try_cast("double").alias("tpm"), F.col(reads).try_cast("double").alias("num_reads"))


def parse_associations(lines: DataFrame, taxon: int | None = None) -> DataFrame:
    """``gene, term`` of a two-column table, or of a gene2go table cut to one taxon."""
    if taxon is None:
        return _fields(lines, 2).select(_at(0).alias("gene"), _at(1).alias("term")).distinct()
    return _fields(lines, 3).filter(_number(0, "int") == taxon).select(_at(1).alias("gene"), _at(2).alias("term")).distinct()


def read_associations(spark: SparkSession, path: str, taxon: int | None = None) -> DataFrame:
    """``parse_associations`` of the lines of files."""
    return parse_associations(_lines(spark, path), taxon)


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms ``term_id, name, namespace, definition`` and edges ``child, parent``."""
    rec = _records(spark, path, "\n[Term]").filter(F.col("record").rlike("(?m)^id: ") & ~F.col("record").rlike("^(format-version|\\[Typedef\\])"))
    rec = rec.withColumn("record", F.substring_index("record", "\n[Typedef]", 1)).filter(~F.col("record").rlike("(?m)^is_obsolete: true"))

    def field(k: str) -> Column:
        return F.regexp_extract("record", f"(?m)^{k}: (.*)$", 1)

    terms = rec.select(field("id").alias("term_id"), field("name").alias("name"), field("namespace").alias("namespace"), F.regexp_extract("record", '(?m)^def: "([^"]*)"', 1).alias("definition"))
    edges = rec.select(field("id").alias("child"), F.explode(F.regexp_extract_all("record", F.lit("(?m)^is_a: (\\S+)"), F.lit(1))).alias("parent"))
    return terms, edges


def read_pdb(spark: SparkSession, path: str, chain: str | None = None) -> DataFrame:
    """Atoms of fixed-width PDB lines, ``structure`` being the file; of alternate places the fullest is kept."""
    text = spark.read.text(path).select(F.col("_metadata.file_name").alias("structure"), F.col("value").alias("line"))
    atoms = text.filter(F.col("line").rlike("^(ATOM|HETATM)"))

    def cut(a: int, n: int) -> Column:
        return F.trim(F.substring("line", a, n))

    out = atoms.select(
        "structure", cut(7, 5).try_cast("int").alias("serial"), cut(13, 4).alias("atom"), cut(18, 3).alias("res"), F.substring("line", 22, 1).alias("chain"),
        cut(23, 4).try_cast("int").alias("resseq"), *[cut(31 + 8 * i, 8).try_cast("double").alias(c) for i, c in enumerate("xyz")],
        F.coalesce(cut(55, 6).try_cast("double"), F.lit(1.0)).alias("occupancy"), cut(61, 6).try_cast("double").alias("bfactor"), F.substring("line", 17, 1).alias("altloc"),
    ).filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    if chain is not None:
        out = out.filter(F.col("chain") == chain)
    w = W.partitionBy("structure", "chain", "resseq", "res", "atom", F.when(F.col("altloc") == " ", F.col("serial"))).orderBy(F.desc("occupancy"), "altloc", "serial")
    return out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "altloc")


_SPECIES = "struct<speciesReference:array<struct<_species:string,_stoichiometry:double>>>"


def read_sbml(spark: SparkSession, path: str) -> DataFrame:
    """Reactions ``reaction, name, reversible`` with arrays of reactants and products."""
    schema = f"_id string, _name string, _reversible boolean, listOfReactants {_SPECIES}, listOfProducts {_SPECIES}"
    df = spark.read.format("xml").option("rowTag", "reaction").schema(schema).load(path)
    return df.select(
        F.col("_id").alias("reaction"), F.coalesce("_name", "_id").alias("name"), F.coalesce("_reversible", F.lit(False)).alias("reversible"),
        F.col("listOfReactants.speciesReference").alias("reactants"), F.col("listOfProducts.speciesReference").alias("products"),
    )


def stoichiometry(reactions: DataFrame) -> DataFrame:
    """Sparse matrix ``metabolite, reaction, coefficient``: reactants negative, products positive."""
    def side(name: str, sign: int) -> DataFrame:
        return reactions.select("reaction", F.explode(name).alias("s")).select(
            F.col("s._species").alias("metabolite"), "reaction", (sign * F.abs(F.coalesce("s._stoichiometry", F.lit(1.0)))).alias("coefficient")
        )

    return side("reactants", -1).unionByName(side("products", 1)).groupBy("metabolite", "reaction").agg(F.sum("coefficient").alias("coefficient"))


def read_mtx(spark: SparkSession, folder: str) -> DataFrame:
    """10x directory (matrix.mtx, barcodes.tsv, features.tsv, plain or .gz) as ``cell, gene, count``."""
    def names(kind: str, column: int) -> DataFrame:
        rows = _numbered(spark, f"{folder}/{kind}.tsv*")
        return rows.select((F.col("n") + 1).alias(f"_{kind}"), F.get(F.split("line", "\t"), F.lit(column)).alias(kind))

    # the first line that is no comment holds the dimensions; it is known by its place, as an entry may look the same
    lines = _numbered(spark, f"{folder}/matrix.mtx*").filter(~F.col("line").startswith("%") & (F.trim("line") != ""))
    triplets = _fields(lines.filter(F.col("n") > lines.agg(F.min("n")).scalar()), 3, sep="\\s+", comment="%")
    entries = triplets.select(_number(0, "bigint").alias("_features"), _number(1, "bigint").alias("_barcodes"), _number(2, "double").alias("count"))
    out = entries.join(names("features", 0), "_features").join(names("barcodes", 0), "_barcodes")
    return out.select(F.col("barcodes").alias("cell"), F.col("features").alias("gene"), "count")


# ---- trees -------------------------------------------------------------------------------------------------------


@F.udtf(returnType="node_id int, parent_id int, name string, branch_length double, is_leaf boolean")
class NewickNodes:
    """Node rows of one Newick tree, parents before children."""

    def eval(self, tree: str):
        import re

        nodes = [[0, None, "", None, True]]
        current = 0
        for mark, label in re.findall(r"([(),;])|([^(),;]+)", tree or ""):
            if mark == "(" or mark == ",":
                parent = current if mark == "(" else nodes[current][1]
                if mark == "(":
                    nodes[current][4] = False
                nodes.append([len(nodes), parent, "", None, True])
                current = len(nodes) - 1
            elif mark == ")":
                current = nodes[current][1]
            elif label.strip():
                name, _, length = label.strip().partition(":")
                nodes[current][2] = name.strip()
                try:
                    nodes[current][3] = float(length) if length else None
                except ValueError:
                    nodes[current][3] = None
        for node in nodes:
            yield tuple(node)


def newick_nodes(trees: DataFrame, id: str = "tree_id", tree: str = "tree") -> DataFrame:
    """Node table of a table of Newick strings by a lateral join."""
    spark = trees.sparkSession
    spark.udtf.register("newick_nodes", NewickNodes)
    return spark.sql(f"SELECT t.{id}, n.* FROM {{trees}} t, LATERAL newick_nodes(t.{tree}) n", trees=trees)


# ---- dispatch ----------------------------------------------------------------------------------------------------

READERS = {
    "fa": read_fasta, "fasta": read_fasta, "fna": read_fasta, "faa": read_fasta, "fq": read_fastq, "fastq": read_fastq, "gb": read_genbank, "gbk": read_genbank,
    "genbank": read_genbank, "vcf": read_vcf, "sam": read_sam, "bed": read_bed, "gff": read_gff, "gff3": read_gff, "gtf": read_gtf, "saf": read_saf,
    "sto": read_stockholm, "stockholm": read_stockholm, "pdb": read_pdb, "xml": read_sbml, "sbml": read_sbml, "csv": read_table, "tsv": read_table,
    "txt": read_table, "json": read_table, "parquet": read_table,
}


def detect_format(path: str) -> str | None:
    """Extension of a known format, seen through .gz; None when unknown."""
    ext = path.rstrip("/").lower().removesuffix(".gz").rsplit(".", 1)[-1]
    return ext if ext in READERS else None


def load(spark: SparkSession, path: str) -> DataFrame:
    kind = detect_format(path)
    if kind is None:
        raise ValueError(f"unknown format: {path}")
    return READERS[kind](spark, path)

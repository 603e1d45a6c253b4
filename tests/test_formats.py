import gzip

import pytest
from pyspark.sql import functions as F

from strandframe.sources import formats, sinks


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">seq1 test seq\nATCG\nATCG\n\n>seq2 another\nGCGCGCGC\n")
    assert rows(formats.read_fasta(spark, path), "seq_id", "seq") == [("seq1 test seq", "ATCGATCG"), ("seq2 another", "GCGCGCGC")]
    assert rows(formats.read_fasta(spark, path, first_token=True), "seq_id") == [("seq1",), ("seq2",)]


def test_fasta_empty_and_gz(spark, tmp_path):
    assert formats.read_fasta(spark, put(tmp_path, "e.fa", "")).count() == 0
    path = str(tmp_path / "b.fa.gz")
    with gzip.open(path, "wt") as f:
        f.write(">x\nAC\nGT\n")
    assert rows(formats.load(spark, path), "seq_id", "seq") == [("x", "ACGT")]


def test_fastq_quality_may_start_with_at(spark, tmp_path):
    path = put(tmp_path, "r.fq", "@r1\nACGT\n+\n@III\n@r2\nGGGG\n+\n!!!!\n")
    assert rows(formats.read_fastq(spark, path), "read_id", "seq", "qual") == [("r1", "ACGT", "@III"), ("r2", "GGGG", "!!!!")]


def test_genbank(spark, tmp_path):
    text = (
        "LOCUS       AB1 12 bp DNA\nDEFINITION  x\nACCESSION   AB1\nVERSION     AB1.1\nFEATURES             Location/Qualifiers\n"
        "     gene            1..6\n                     /gene=\"abc\"\n                     /note=\"two\n                     lines\"\n"
        "     CDS             complement(7..12)\n                     /codon_start=1\nORIGIN\n        1 acgtacgtac gt\n//\n"
    )
    r = formats.read_genbank(spark, put(tmp_path, "g.gb", text)).collect()
    assert len(r) == 1 and r[0].id == "AB1.1" and r[0].seq == "ACGTACGTACGT"
    assert [(f.type, f.location) for f in r[0].features] == [("gene", "1..6"), ("CDS", "complement(7..12)")]
    assert r[0].features[0].qualifiers["gene"] == ["abc"] and r[0].features[0].qualifiers["note"] == ["two lines"]


def test_vcf(spark, tmp_path):
    path = put(tmp_path, "v.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nchr1\t100\t.\tA\tG\t30\tPASS\t.\nchr1\t200\t.\tC\tT\t.\tPASS\t.\nbad\t1\n")
    assert rows(formats.read_vcf(spark, path).fillna(-1.0), "chrom", "pos", "ref", "alt", "qual") == [("chr1", 100, "A", "G", 30.0), ("chr1", 200, "C", "T", -1.0)]
    assert formats.read_vcf(spark, path, max_variants=1).count() == 1


def test_sam(spark, tmp_path):
    path = put(tmp_path, "s.sam", "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\nr1\t0\tchr1\t100\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\tXX:Z:a:b\n")
    r = formats.read_sam(spark, path).collect()[0]
    assert (r.qname, r.pos, r.tags) == ("r1", 100, {"NM": "0", "XX": "a:b"})
    h = {x.record: x.fields for x in formats.read_sam_header(spark, path).collect()}
    assert h["SQ"] == {"SN": "chr1", "LN": "1000"}


def test_bed_gff_gtf_saf(spark, tmp_path):
    bed = put(tmp_path, "b.bed", "track x\nchr1\t100\t200\tgeneA\t0\t+\nchr2\t5\t9\n")
    assert rows(formats.read_bed(spark, bed), "chrom", "start", "end") == [("chr1", 100, 200), ("chr2", 5, 9)]
    gff = put(tmp_path, "g.gff3", "##gff\nchr1\ts\tgene\t100\t500\t.\t+\t.\tID=gene1;Name=TP53\n")
    r = formats.read_gff(spark, gff).collect()[0]
    assert r.attributes == {"ID": "gene1", "Name": "TP53"} and r.score is None
    gtf = put(tmp_path, "g.gtf", 'chr1\ts\tgene\t1\t5\t.\t+\t.\tgene_id "G1"; gene_name "TP53"; gene_id "G2";\n')
    assert formats.load(spark, gtf).collect()[0].attributes == {"gene_id": "G1", "gene_name": "TP53"}
    saf = put(tmp_path, "g.saf", "GeneID\tChr\tStart\tEnd\tStrand\ngene1\tchr1\t100\t500\t-\ngene2\tchr2\t200\t600\n")
    assert rows(formats.read_saf(spark, saf), "gene_id", "strand") == [("gene1", "-"), ("gene2", "+")]


def test_stockholm(spark, tmp_path):
    path = put(tmp_path, "a.sto", "# STOCKHOLM 1.0\n#=GF AC PF1\ns1 ATCG\ns2 AT-G\n\ns1 GG\ns2 CC\n//\n")
    assert rows(formats.read_stockholm(spark, path), "name", "aligned") == [("s1", "ATCGGG"), ("s2", "AT-GCC")]
    assert rows(formats.stockholm_metadata(spark, path), "key", "value") == [("AC", "PF1")]


def test_bisulfite_and_counts(spark, tmp_path):
    path = put(tmp_path, "m.bed", "#c\nchr1\t10\t11\t8\t10\tCpG\nchr1\t20\t21\t0\t0\tCHG\n")
    assert rows(formats.read_bisulfite(spark, path), "pos", "context", "level") == [(10, "CpG", 0.8), (20, "CHG", 0.0)]
    counts = put(tmp_path, "c.csv", "#note\ngene,S1,S2\nG1,10,20\nG2,30,40\n")
    assert rows(formats.read_counts(spark, counts), "feature", "sample", "count") == [("G1", "S1", 10.0), ("G1", "S2", 20.0), ("G2", "S1", 30.0), ("G2", "S2", 40.0)]
    for sign in (" ", ";", "\t"):
        other = put(tmp_path, f"c{ord(sign)}.txt", "gene,S1,S2\nG1,10,20\n".replace(",", sign))
        assert rows(formats.read_counts(spark, other), "feature", "sample", "count") == [("G1", "S1", 10.0), ("G1", "S2", 20.0)]


def test_tables(spark, tmp_path):
    quant = put(tmp_path, "quant.sf", "Name\tLength\tEffectiveLength\tTPM\tNumReads\nt1\t10\t9\t2.5\t4\n")
    assert rows(formats.read_quantification(spark, quant), "transcript_id", "tpm", "num_reads") == [("t1", 2.5, 4.0)]
    kallisto = put(tmp_path, "abundance.tsv", "target_id\tlength\teff_length\test_counts\ttpm\nt1\t10\t9\t4\t2.5\n")
    assert rows(formats.read_quantification(spark, kallisto), "tpm", "num_reads") == [(2.5, 4.0)]
    assoc = put(tmp_path, "a.txt", "g1\tGO:1\ng1\tGO:1\ng2\tGO:2\n")
    assert rows(formats.read_associations(spark, assoc), "gene", "term") == [("g1", "GO:1"), ("g2", "GO:2")]
    kraken = put(tmp_path, "k.out", "C\tr1\t562\t100\tx\nU\tr2\t0\t100\tx\n")
    assert rows(formats.read_kraken(spark, kraken), "status", "read_id", "taxon") == [("C", "r1", "562"), ("U", "r2", "0")]


def test_obo(spark, tmp_path):
    path = put(tmp_path, "g.obo", 'format-version: 1.2\n\n[Term]\nid: GO:1\nname: root\nnamespace: bp\ndef: "top" [x]\n\n[Term]\nid: GO:2\nname: leaf\nnamespace: bp\nis_a: GO:1 ! root\n\n[Typedef]\nid: part_of\n')
    terms, edges = formats.read_obo(spark, path)
    assert rows(terms, "term_id", "name", "definition") == [("GO:1", "root", "top"), ("GO:2", "leaf", "")]
    assert rows(edges, "child", "parent") == [("GO:2", "GO:1")]


def test_pdb(spark, tmp_path):
    line = "ATOM  {:5d}  {:<3s}{}{} {}{:4d}    {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}\n"
    text = line.format(1, "N", " ", "ALA", "A", 1, 1.0, 2.0, 3.0, 1.0, 10.0) + line.format(2, "CA", "A", "ALA", "A", 1, 1.5, 2.0, 3.0, 0.4, 10.0) + line.format(3, "CA", "B", "ALA", "A", 1, 1.6, 2.0, 3.0, 0.6, 20.0)
    out = formats.read_pdb(spark, put(tmp_path, "p.pdb", text))
    assert rows(out, "atom", "res", "chain", "resseq", "x", "bfactor") == [("CA", "ALA", "A", 1, 1.6, 20.0), ("N", "ALA", "A", 1, 1.0, 10.0)]


def test_sbml(spark, tmp_path):
    text = (
        '<sbml><model><listOfReactions><reaction id="R1" name="one" reversible="true"><listOfReactants><speciesReference species="A" stoichiometry="2"/>'
        '</listOfReactants><listOfProducts><speciesReference species="B"/></listOfProducts></reaction></listOfReactions></model></sbml>'
    )
    r = formats.read_sbml(spark, put(tmp_path, "m.xml", text))
    assert rows(formats.stoichiometry(r), "metabolite", "reaction", "coefficient") == [("A", "R1", -2.0), ("B", "R1", 1.0)]


def test_mtx(spark, tmp_path):
    put(tmp_path, "matrix.mtx", "%%MatrixMarket\n%x\n2 2 3\n1 1 5\n2 1 1\n2 2 3\n")
    put(tmp_path, "barcodes.tsv", "c1\nc2\n")
    put(tmp_path, "features.tsv", "g1\tG1\ng2\tG2\n")
    assert rows(formats.read_mtx(spark, str(tmp_path)), "cell", "gene", "count") == [("c1", "g1", 5.0), ("c1", "g2", 1.0), ("c2", "g2", 3.0)]


def test_newick(spark):
    trees = spark.createDataFrame([(1, "((A:0.1,B:0.2)n1:0.3,C);")], "tree_id int, tree string")
    out = formats.newick_nodes(trees)
    assert rows(out.filter("is_leaf"), "name") == [("A",), ("B",), ("C",)]
    byname = {r.name: r for r in out.collect()}
    assert byname["A"].parent_id == byname["n1"].node_id and byname["n1"].branch_length == 0.3 and byname["C"].branch_length is None


def test_dispatch():
    assert formats.detect_format("x/y.VCF.gz") == "vcf" and formats.detect_format("a.unknown") is None
    with pytest.raises(ValueError):
        formats.load(None, "a.unknown")


def test_sinks_round_trip(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "ACGTACGT"), ("b", "GG")], "seq_id string, seq string")
    sinks.write_fasta(seqs, str(tmp_path / "o.fa"), width=3)
    assert rows(formats.read_fasta(spark, str(tmp_path / "o.fa")), "seq_id", "seq") == [("a", "ACGTACGT"), ("b", "GG")]
    reads = spark.createDataFrame([("r1", "ACGT", "IIII")], "read_id string, seq string, qual string")
    sinks.write_fastq(reads, str(tmp_path / "o.fq"))
    assert rows(formats.read_fastq(spark, str(tmp_path / "o.fq")), "read_id", "seq", "qual") == [("r1", "ACGT", "IIII")]
    v = spark.createDataFrame([("chr1", 5, "A", "G", 30.0)], "chrom string, pos long, ref string, alt string, qual double")
    sinks.write_vcf(v, str(tmp_path / "o.vcf"))
    assert rows(formats.read_vcf(spark, str(tmp_path / "o.vcf")), "chrom", "pos", "id", "qual") == [("chr1", 5, ".", 30.0)]
    b = spark.createDataFrame([("chr1", 5, 9)], "chrom string, start long, end long")
    sinks.write_bed(b, str(tmp_path / "o.bed"))
    assert rows(formats.read_bed(spark, str(tmp_path / "o.bed")), "chrom", "start", "end") == [("chr1", 5, 9)]
    sam = spark.createDataFrame([("q", 0, "chr1", 1, 60, "4M", "*", 0, 0, "ACGT", "IIII")], ", ".join(f"{n} {t}" for n, t in formats.SAM_COLUMNS))
    sinks.write_sam(sam, [("chr1", 100)], str(tmp_path / "o.sam"))
    assert formats.read_sam(spark, str(tmp_path / "o.sam")).count() == 1 and formats.read_sam_header(spark, str(tmp_path / "o.sam")).count() == 2


def test_run_log(spark, tmp_path):
    df = spark.createDataFrame([(1, "s1", '{"k": "2"}'), (2, "s2", "{}")], "step_id long, session string, params string")
    full = df.select(*[F.col(c.split()[0]) if c.split()[0] in df.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in sinks.LOG_SCHEMA.split(", ")])
    path = str(tmp_path / "log")
    sinks.append_steps(full, path)
    sinks.append_steps(full.filter("step_id = 1").withColumn("step_id", F.lit(3).cast("long")), path)
    assert [r.step_id for r in sinks.read_steps(spark, path, "s1").collect()] == [1, 3]
    sinks.export_steps(sinks.read_steps(spark, path), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).filter("params.k = '2'").count() == 2


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    for name, low, high in (("a.txt", 0, 400), ("b.txt", 400, 700)):
        put(tmp_path, name, "".join(f"line {i}\n" for i in range(low, high)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = {r.n: r.line for r in formats._numbered(spark, str(tmp_path / "*.txt")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: f"line {i}" for i in range(700)}


def test_long_sam_header(spark, tmp_path):
    path = put(tmp_path, "h.sam", "@RG\t" + "\t".join(f"k{i}:v{i}" for i in range(1500)) + "\n")
    assert len(formats.read_sam_header(spark, path).first().fields) == 1500

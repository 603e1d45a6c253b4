"""Summaries of record tables: sequences, annotations, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import dna
from . import ordered


def assembly_statistics(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Contigs, bases, longest, shortest, GC and N50 / L50."""
    lengths = df.select(F.length(seq).cast("long").alias("len"), dna.count_of(F.upper(seq), "GC").alias("gc"))
    n50 = ordered.n50(lengths.filter("len > 0"), "len")
    return lengths.agg(
        F.count(F.lit(1)).alias("contigs"), F.sum("len").alias("bases"), F.max("len").alias("longest"), F.min("len").alias("shortest"),
        (F.sum("gc") / F.sum("len") * 100).alias("gc_percent"),
    ).select("*", n50.select("n50").scalar().alias("n50"), n50.select("l50").scalar().alias("l50"))


def annotation_summary(df: DataFrame, kind: str = "feature") -> DataFrame:
    """Records, bases and mean length of closed 1-based ranges per feature type, with a total row."""
    length = F.col("end") - F.col("start") + 1
    return df.rollup(kind).agg(
        F.count(F.lit(1)).alias("records"), F.sum(length).alias("bases"), F.avg(length).alias("mean_length"), F.countDistinct("chrom").alias("chromosomes")
    )


def with_length(df: DataFrame, closed: bool, keys=(), attributes: str = "attributes") -> DataFrame:
    """``length`` of half-open (BED) or closed (GFF) ranges and the asked attribute keys as columns."""
    out = df.withColumn("length", F.col("end") - F.col("start") + (1 if closed else 0))
    return out.select("*", *[F.element_at(attributes, k).alias(k) for k in keys])


def run_log_rollup(log: DataFrame, session: str = "session") -> DataFrame:
    """Steps, total milliseconds, successes and errors per session, with a total row."""
    return log.rollup(session).agg(
        F.count(F.lit(1)).alias("steps"), F.sum("duration_ms").alias("total_ms"), F.count_if(F.col("status") != "error").alias("succeeded"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def structure_summary(atoms: DataFrame) -> DataFrame:
    """Atoms, residues and chains per structure, and the mean temperature factor where there is one."""
    mean_b = [F.avg("bfactor").alias("mean_confidence")] if "bfactor" in atoms.columns else []
    return atoms.groupBy("structure").agg(
        F.count(F.lit(1)).alias("atoms"), F.countDistinct("chain", "resseq").alias("residues"), F.countDistinct("chain").alias("chains"), *mean_b
    )


def rmsd(first: DataFrame, second: DataFrame) -> DataFrame:
    """Root mean square distance per structure over atoms paired by serial."""
    b = second.select("structure", "serial", *[F.col(c).alias(f"_{c}") for c in "xyz"])
    sq = sum((F.col(c) - F.col(f"_{c}")) ** 2 for c in "xyz")
    return first.join(b, ["structure", "serial"]).groupBy("structure").agg(F.sqrt(F.avg(sq)).alias("rmsd"), F.count(F.lit(1)).alias("atoms"))


def radius_of_gyration(atoms: DataFrame, mass: str = "mass") -> DataFrame:
    """Mass-weighted radius of gyration per structure, from one pass of weighted first and second moments."""
    m = F.col(mass)
    moments = atoms.groupBy("structure").agg(
        F.sum(m).alias("m"), *[F.sum(m * F.col(c)).alias(f"s{c}") for c in "xyz"], F.sum(m * sum(F.col(c) ** 2 for c in "xyz")).alias("q")
    )
    centre = sum((F.col(f"s{c}") / F.col("m")) ** 2 for c in "xyz")
    return moments.select("structure", F.sqrt(F.greatest(F.col("q") / F.col("m") - centre, F.lit(0.0))).alias("radius"))


def dihedrals(atoms: DataFrame) -> DataFrame:
    """Backbone phi and psi in degrees per residue from N, CA and C atoms, and the H / E / C class.

    A chain is walked by lag and lead over its residues.
    """
    bb = atoms.filter(F.col("atom").isin("N", "CA", "C")).groupBy("structure", "chain", "resseq").agg(
        *[F.max(F.when(F.col("atom") == a, F.struct("x", "y", "z"))).alias(a.lower()) for a in ("N", "CA", "C")]
    )
    w = W.partitionBy("structure", "chain").orderBy("resseq")
    near = bb.select("*", F.lag("c").over(w).alias("pc"), F.lead("n").over(w).alias("nn"))

    def angle(p, q, r, s):
        b0, b1, b2 = ([F.col(v)[k] - F.col(u)[k] for k in "xyz"] for u, v in ((p, q), (q, r), (r, s)))
        n1, n2 = _cross(b0, b1), _cross(b1, b2)
        size = F.sqrt(_dot(b1, b1))
        m = _cross(n1, [x / size for x in b1])
        return F.degrees(-F.atan2(_dot(m, n2), _dot(n1, n2)))

    out = near.select("structure", "chain", "resseq", angle("pc", "n", "ca", "c").alias("phi"), angle("n", "ca", "c", "nn").alias("psi"))
    phi, psi = F.col("phi"), F.col("psi")
    helix = (phi > -150) & (phi < -30) & (psi > -75) & (psi < 50)
    sheet = (phi > -180) & (phi < -40) & (psi > 90) & (psi < 180)
    return out.withColumn("ss", F.when(helix, "H").when(sheet, "E").otherwise("C"))


def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


# ---- record checks: an array of error texts per row ---------------------------------------------------------------

# Letters allowed in each kind of sequence.
ALPHABETS = {"dna": "ATCGN", "rna": "ACGNU", "amino_acid": "ACDEFGHIKLMNPQRSTVWY*"}


def errors(*checks) -> Column:
    """Texts of the checks that hold."""
    return F.array_compact(F.array(*[F.when(condition, text) for condition, text in checks]))


def sequence_errors(seq: str, kind: str = "dna", min_length: int = 1) -> Column:
    clean = F.upper(F.regexp_replace(seq, "[ \\n\\r]", ""))
    bad = F.array_join(F.array_sort(F.array_distinct(F.split(F.translate(clean, ALPHABETS[kind], ""), ""))), "")
    return errors(
        (F.length(clean) < min_length, F.lit(f"shorter than {min_length}")), (bad != "", F.concat(F.lit("invalid characters: "), bad))
    )


def fasta_errors(name: str = "seq_id", seq: str = "seq") -> Column:
    return errors((F.trim(name) == "", F.lit("empty header")), (F.length(seq) == 0, F.lit("empty sequence")))


def fastq_errors(seq: str = "seq", qual: str = "qual") -> Column:
    return errors(
        (F.length(seq) == 0, F.lit("empty sequence")), (F.length(seq) != F.length(qual), F.lit("sequence and quality differ in length")),
        (F.col(qual).rlike("[^!-~]"), F.lit("quality outside printable range")),
    )


def vcf_errors() -> Column:
    return errors(
        (F.col("chrom") == "", F.lit("empty chromosome")), (F.col("pos").isNull() | (F.col("pos") < 1), F.lit("position below 1")),
        (F.col("ref").rlike("[^ACGTNacgtn]"), F.lit("invalid reference allele")), (F.col("alt") == "", F.lit("empty alternate allele")),
    )


def range_errors(value: str, low: float, high: float) -> Column:
    return errors((F.col(value) < low, F.lit(f"below {low}")), (F.col(value) > high, F.lit(f"above {high}")))


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def downsample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in the order of the MD5 of ``key:seed``: the same rows on every run, and in any engine."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)

"""Writers of text formats. A header is one extra first partition, so only the first part file carries it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _write(lines: DataFrame, header: list[str], path: str) -> None:
    if header:
        top = lines.sparkSession.createDataFrame([(h,) for h in header], "line string").coalesce(1)
        lines = top.unionByName(lines)
    lines.write.mode("overwrite").text(path)


def _tabbed(*columns) -> Column:
    return F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(".")) for c in columns]).alias("line")


def write_fasta(df: DataFrame, path: str, id: str = "seq_id", seq: str = "seq", width: int = 0) -> None:
    """Records of a header and the sequence, wrapped at ``width`` when it is set."""
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else F.col(seq)
    _write(df.select(F.concat(F.lit(">"), id, F.lit("\n"), body).alias("line")), [], path)


def write_fastq(df: DataFrame, path: str, id: str = "read_id", seq: str = "seq", qual: str = "qual") -> None:
    _write(df.select(F.concat(F.lit("@"), id, F.lit("\n"), seq, F.lit("\n+\n"), qual).alias("line")), [], path)


def write_vcf(df: DataFrame, path: str) -> None:
    """VCF of a table with chrom, pos, ref and alt; other columns are '.' where absent."""
    def or_dot(c: str):
        return c if c in df.columns else F.lit(".")

    header = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    _write(df.select(_tabbed("chrom", "pos", or_dot("id"), "ref", "alt", or_dot("qual"), or_dot("filter"), or_dot("info"))), header, path)


def write_bed(df: DataFrame, path: str) -> None:
    _write(df.select(_tabbed(*[c for c in ("chrom", "start", "end", "name", "score", "strand") if c in df.columns])), [], path)


def write_sam(df: DataFrame, references: list[tuple[str, int]], path: str) -> None:
    """SAM of a table with the eleven columns; ``references`` gives the @SQ lines."""
    header = ["@HD\tVN:1.6\tSO:unsorted"] + [f"@SQ\tSN:{n}\tLN:{size}" for n, size in references]
    columns = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    _write(df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("line")), header, path)


LOG_SCHEMA = (
    "step_id long, session string, step string, module string, func string, params string, status string, "
    "duration_ms double, error string, ts timestamp, version string"
)


def append_steps(df: DataFrame, path: str) -> None:
    """Append run-log rows to a Parquet table."""
    df.write.mode("append").parquet(path)


def read_steps(spark, path: str, session: str | None = None) -> DataFrame:
    log = spark.read.schema(LOG_SCHEMA).parquet(path)
    return (log if session is None else log.filter(F.col("session") == session)).orderBy("step_id")


def export_steps(df: DataFrame, path: str) -> None:
    """Run log as JSON lines with the parameters as an object."""
    df.withColumn("params", F.from_json("params", "map<string,string>")).write.mode("overwrite").json(path)

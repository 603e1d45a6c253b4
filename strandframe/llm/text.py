"""Column expressions and storage helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: the six ASCII white-space characters
BLANKS = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row, also where ``body`` reads it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(x: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII strings take the fast path."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _UPPER.lower()))


def strip_blanks(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def words(x: Column) -> Column:
    """Maximal runs of characters outside ``BLANKS``; an empty array where there are none."""
    stripped = strip_blanks(F.coalesce(x, F.lit("")))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, r"[\x20\x09-\x0D]+"))


def crc_of_id(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def pieces(docs: DataFrame, bytes_each: int) -> int:
    """How many pieces of about ``bytes_each`` the texts of ``docs`` make; counted, so it grows with the table."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // bytes_each))


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the storage named by ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent (tests on a local master) a temporary folder is made; on any other master that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read by several later steps, safe against lost executors."""
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

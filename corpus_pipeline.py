"""From raw documents to token files: quality rules, near duplicates, benchmark leaks, mixing, encoding.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; ``run`` writes each
one as Parquet to the shared folder and hands the table read again to the next. The mixture is the order of rows in the files
of its stage, and the token files keep that order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import decontamination, ngram_join, quality_rules, source_mixing, token_store
from strandframe.llm.queries import BLOCK_CHARS, END_ID, OTHER_SHARE, SHARES, TOKENIZER
from strandframe.llm.text import shared_folder, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.mixed_rows(docs, SHARES, OTHER_SHARE, BLOCK_CHARS)


def _file_order(docs: DataFrame) -> Column:
    """Place of a row in the files it was read from; by ``doc_id`` where ``docs`` are not read from files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return F.col("doc_id")
    return F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids are: file, frame, ``start`` in the whole sequence, their number and checksum as read back."""
    import public_tokenizers

    target = shared_folder(spark)
    index = written(token_store.write_tokens(docs, target, public_tokenizers.path(TOKENIZER), END_ID, order=_file_order(docs)))
    read = written(token_store.read_tokens(index, target, "n_tokens long, ids_crc32 long", token_store.size_and_crc))
    return token_store.starts(read).select("doc_id", "file", "frame", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_rules", good_documents),
    ("ngram_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("source_mixing", mixed),
    ("token_files", token_files),
]

#: shingle joins, alignments and token ids are beyond SQL; the tests compare every stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

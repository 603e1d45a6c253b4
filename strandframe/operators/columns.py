"""Column statistics of aligned sequences ``name, aligned``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letters(df: DataFrame, seq: str = "aligned") -> DataFrame:
    """Counts per (0-based pos, letter), combined before the shuffle."""
    return (
        df.select(F.posexplode(F.split(F.upper(seq), "")).alias("pos", "letter")).filter("letter <> ''").groupBy("pos", "letter").agg(F.count(F.lit(1)).alias("n"))
    )


def conservation(df: DataFrame, threshold: float = 0.5, seq: str = "aligned") -> DataFrame:
    """Share of the most frequent letter among non-gaps, that letter (ties to the lowest) and the consensus call."""
    best = F.min(F.when(F.col("letter") != "-", F.struct((-F.col("n")).alias("k"), F.col("letter")))).alias("b")
    used = F.sum(F.when(F.col("letter") != "-", F.col("n")).otherwise(0))
    g = letters(df, seq).groupBy("pos").agg(best, used.alias("used"), F.sum("n").alias("total"))
    share = F.when(F.col("used") > 0, -F.col("b.k") / F.col("used")).otherwise(0.0)
    return g.select("pos", share.alias("conservation"), F.coalesce("b.letter", F.lit("-")).alias("letter"), (F.col("total") - F.col("used")).alias("gaps"), "total").withColumn(
        "consensus", consensus_letter(F.col("conservation"), F.col("letter"), threshold)
    )


def consensus_letter(share: Column, letter: Column, threshold: float = 0.5) -> Column:
    """The letter when unanimous, in lower case above the threshold, 'n' below it and '-' for an all-gap column."""
    return F.when(letter == "-", "-").when(share < threshold, "n").when(share < 1, F.lower(letter)).otherwise(letter)


def consensus(df: DataFrame, threshold: float = 0.5, seq: str = "aligned") -> DataFrame:
    """The consensus text of one alignment: as long as one aligned row."""
    calls = conservation(df, threshold, seq).agg(F.array_sort(F.collect_list(F.struct("pos", "consensus"))).alias("c"))
    return calls.select(F.array_join(F.transform("c", lambda x: x["consensus"]), "").alias("consensus"))


def profile(df: DataFrame, seq: str = "aligned") -> DataFrame:
    """Letter frequencies per column, gaps left out."""
    n = letters(df, seq).filter("letter <> '-'")
    total = n.groupBy("pos").agg(F.sum("n").alias("_t"))
    return n.join(total, "pos").select("pos", "letter", (F.col("n") / F.col("_t")).alias("frequency"))


def alignment_statistics(df: DataFrame, seq: str = "aligned") -> DataFrame:
    """Columns, gap percentage, mean conservation and numbers of conserved and variable columns."""
    c = F.col("conservation")
    return conservation(df, 0.5, seq).agg(
        F.count(F.lit(1)).alias("alignment_length"), (F.sum("gaps") / F.sum("total") * 100).alias("gap_percent"), F.avg(c).alias("mean_conservation"),
        F.count_if(c >= 0.9).alias("highly_conserved"), F.count_if(c < 0.5).alias("variable"),
    )


def logo(df: DataFrame, alphabet: str = "ACGT", seq: str = "aligned") -> DataFrame:
    """Letter heights and column information in bits with the small-sample correction, and information over its maximum."""
    k = len(alphabet)
    n = letters(df, seq).filter(F.col("letter").isin(*alphabet))
    column = n.groupBy("pos").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    most = F.log2(F.lit(float(k)))
    bits = F.greatest(F.lit(0.0), most - (F.log2("t") - F.col("s") / F.col("t")) - (k - 1) / (2 * F.log(F.lit(2.0)) * F.col("t")))
    return n.join(column.select("pos", "t", bits.alias("bits")), "pos").select(
        "pos", "letter", (F.col("n") / F.col("t") * F.col("bits")).alias("height"), "bits", (F.col("bits") / most).alias("conservation")
    )

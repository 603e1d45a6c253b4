"""Odd rows and large counts: empty texts, tables in a folder, products beyond whole numbers."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strandframe.operators import omics


def test_log_rank_of_many_subjects(spark):
    """Counts of a million subjects, whose products do not fit 64 bits."""
    rows = spark.range(1_000_000).select(
        (F.col("id") % 4).cast("double").alias("time"), (F.col("id") % 3 == 0).cast("long").alias("event"), (F.col("id") % 2 == 0).alias("first"), (F.col("id") % 10).cast("double").alias("covariate")
    )
    got = omics.log_rank(rows, F.col("first")).first()
    small = omics.log_rank(rows.where("id < 12000"), F.col("first")).first()
    assert got.statistic > 50 * small.statistic > 0 and got.p_value < 1e-6
    assert 0 <= omics.median_split_hazard(rows).first().p_value <= 1


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables whose documents are two files, some texts without letters, empty or missing."""
    import os

    from compare import SMALL

    folder = tmp_path_factory.mktemp("odd")
    for name in os.listdir(SMALL):
        if name != "documents.parquet":
            os.symlink(f"{SMALL}/{name}", folder / name)
    (folder / "documents.parquet").mkdir()
    text = "CASE doc_id % 17 WHEN 3 THEN '12 34!' WHEN 5 THEN '' WHEN 7 THEN NULL ELSE text END"
    for part in (0, 1):
        duckdb.sql(f"COPY (SELECT * REPLACE ({text} AS text) FROM '{SMALL}/documents.parquet' WHERE doc_id % 2 = {part}) TO '{folder}/documents.parquet/part-{part}.parquet' (FORMAT parquet)")
    return str(folder)


def same_as_sql(spark, folder, name):
    import __spark_entry__ as entry
    from compare import canonical

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()[name]).df()
    assert canonical(entry.queries()[name](spark, folder).toPandas()) == canonical(want)


def test_scores_of_reads_without_letters(spark, odd):
    same_as_sql(spark, odd, "phred_statistics")


def test_gc_of_a_sequence_without_letters(spark, odd):
    same_as_sql(spark, odd, "window_gc")


@pytest.mark.parametrize("name", ["trim_reads", "trim_report"])
def test_reads_trimmed_to_nothing(spark, odd, name):
    same_as_sql(spark, odd, name)


def test_stream_over_a_folder_of_files(spark, odd, tmp_path):
    import __spark_entry__ as entry
    from strandframe.streaming import queries as streaming

    got = entry.queries()["stream_read_quality"](spark, odd).collect()
    letters = duckdb.sql(f"SELECT sum(length(regexp_replace(lower(text), '[^a-z]', '', 'g'))) FROM '{odd}/documents.parquet/*.parquet'").fetchall()[0][0]
    assert sum(r.bases for r in got) == letters
    # no file at all: no batch runs, and the result has no rows
    stream = spark.readStream.schema("sample string, qual string").parquet(str(tmp_path))
    assert streaming.drain(streaming.quality_histogram(stream), "empty", complete=True).count() == 0


@pytest.mark.parametrize("t, df", [(2.1, 10.0), (3.4, 15_538.0), (0.7, 400_000.0), (35.0, 5_000.0)])
def test_sql_of_student_p_for_many_rows(t, df):
    """The thousand terms of the SQL's series once fell short with many degrees of freedom."""
    import numpy as np

    from strandframe.functions.stats import incomplete_beta
    from strandframe.plans import sql_stats

    got = duckdb.sql(f"SELECT {sql_stats.student_p('t', 'df')} FROM (SELECT {t}::DOUBLE AS t, {df}::DOUBLE AS df)").fetchall()[0][0]
    want = incomplete_beta(np.array([df / 2]), 0.5, np.array([df / (df + t * t)]))[0]
    assert abs(got - want) < 1e-8


def test_epitopes_come_in_small_batches_and_the_best_are_exact(spark):
    import random

    import pyarrow as pa

    from strandframe.functions import peptides
    from strandframe.functions.fixed_values import RESIDUES
    from strandframe.operators import scan

    letters = random.Random(5)
    texts = ["".join(letters.choice(RESIDUES) for _ in range(6000)) for _ in range(40)]
    scales = {"x": peptides.per_residue({r: i % 3 for i, r in enumerate(RESIDUES)}, 0.0)}
    rows = peptides.window_rows([3, 5], 0.0, scales, lambda mean, value: mean("x"), ["id"])
    batch = pa.RecordBatch.from_pydict({"id": list(range(40)), "text": texts, "offset": [0] * 40, "size": [6000] * 40})
    sizes = [b.num_rows for b in rows(iter([batch]))]
    assert sum(sizes) == 40 * (5998 + 5996) and max(sizes) < 2 * peptides.ROWS
    df = spark.createDataFrame(list(enumerate([*texts[:3], "", texts[3] * 3])), "seq_id long, seq string")
    order = [F.desc(F.round("score", 6)), F.col("start"), F.col("end")]
    for scan_of in (scan.t_cell_epitopes, scan.b_cell_epitopes, scan.linear_epitopes):
        every, best = (sorted(map(tuple, scan.top_per_group(scan_of(df, threshold=0.2, best=n), ["seq_id"], order, 20).collect())) for n in (None, 20))
        assert every == best and len(best) == 80


def test_best_primer_over_piece_edges(spark, monkeypatch):
    import random

    from strandframe.functions import dna
    from strandframe.operators import pieces, scan

    letters = random.Random(6)
    rows = [(i, "".join(letters.choice("ACGTN" if i % 3 == 0 else "ACGGCT") for _ in range(n))) for i, n in enumerate([0, 5, 20, 21, 300, 7000, 13000])]
    monkeypatch.setattr(scan, "words", lambda *a, **b: pytest.fail("a row for every place"))
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    got = {r.seq_id: (r.pos, r.forward, r.score) for r in scan.best_primer(df).collect()}
    monkeypatch.undo()
    sites = scan.words(df.withColumn("n", F.length("seq")), 20).withColumn("gc", dna.gc_percent("word")).withColumn("tm", dna.melting_temperature("word"))
    half = F.col("n") / 2
    score = F.round((1 - F.abs(F.col("pos") - half) / half) + (1 - F.abs(F.col("gc") - 55) / 45) + (1 - F.abs(F.col("tm") - 60) / 10), 9)
    kept = sites.where("gc BETWEEN 40 AND 70 AND tm BETWEEN 55 AND 65").withColumn("score", score).where("score > -1")
    want = {r.seq_id: (r.pos, r.word, r.score) for r in scan.top_per_group(kept, ["seq_id"], [F.desc("score"), F.col("pos")], 1).collect()}
    assert got == want and len(want) >= 3 and pieces.SIZE < 7000


def test_near_texts_for_any_number_of_mismatches(spark):
    import itertools
    import random

    from strandframe.operators import search

    letters = random.Random(7)
    seqs = {"".join(letters.choice("AC") for _ in range(n)) for n in (5, 6, 9) for _ in range(25)}
    df = spark.createDataFrame(list(enumerate(sorted(seqs))), "id long, seq string")
    rows = {r.id: r.seq for r in df.collect()}
    for most in (0, 2):
        got = sorted((r.id1, r.id2) for r in search.p_distance_within(df, "id", most).collect())
        want = [(a, b) for a, b in itertools.combinations(sorted(rows), 2) if len(rows[a]) == len(rows[b]) and sum(x != y for x, y in zip(rows[a], rows[b])) <= most]
        assert got == want


def test_interval_pairs_meet_in_bins_of_their_length(spark, monkeypatch):
    import __spark_entry__ as entry
    from compare import SMALL
    from strandframe.operators import intervals

    plain, sizes = intervals.overlap_pairs, []
    monkeypatch.setattr(intervals, "overlap_pairs", lambda a, b, bin_size=1 << 12, **more: sizes.append(bin_size) or plain(a, b, bin_size, **more))
    n = entry.queries()["interval_overlap_pairs"](spark, SMALL).count()
    assert sizes[0] <= 512 and n > 0

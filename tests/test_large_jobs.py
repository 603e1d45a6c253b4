"""Jobs that failed on large tables: the same results without the step that grew."""

import itertools
import random

from pyspark.sql import functions as F

from strandframe.operators import search


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_similar_word_sets_without_rows_for_shared_words(spark, monkeypatch):
    """in long texts nearly all pairs share a word, and each meeting was a row."""
    draw = random.Random(5)
    texts = ["".join(draw.choices("ACGT", k=draw.choice((3, 8, 60, 90)))) for _ in range(60)]
    for text in texts[:30]:
        copy = list(text)
        for _ in range(draw.randrange(6)):
            copy[draw.randrange(len(copy))] = draw.choice("ACGTN")
        texts.append("".join(copy) + "".join(draw.choices("ACGT", k=draw.randrange(20))))
    rows = [(f"s{i:03d}", t) for i, t in enumerate(texts)] + [("t1", texts[0]), ("t2", None), ("t3", "")]
    df = spark.createDataFrame(rows, "name string, seq string").repartition(3)
    first = {}
    for name, text in rows:
        if text:
            first[text] = min(name, first.get(text, name))
    sets = {name: {t[i : i + 4] for i in range(len(t) - 3)} for t, name in first.items()}
    for t, indexed in ((0.3, 200), (0.5, search.INDEXED)):
        want = {}
        for a, b in itertools.combinations(sorted(x for x in sets if sets[x]), 2):
            similarity = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if similarity >= t - 1e-12:
                want[a, b] = similarity
        monkeypatch.setattr(search, "INDEXED", indexed)
        out = search.kmer_jaccard(df, "name", 4, t)
        assert {(r.id1, r.id2): r.similarity for r in out.collect()} == want
        assert "Join" not in plan(out) and len(want) > 10
    assert search.kmer_jaccard(df.where(F.lit(False)), "name", 4, 0.5).count() == 0


def test_words_are_looked_up_before_they_are_rows(spark, monkeypatch):
    """F27, F32: every word of every read was a row, and few of them are markers."""
    monkeypatch.setattr(search, "STRETCH", 7)
    reads = spark.createDataFrame([(1, "acgtacgtnacéß\U0001f600acgtac"), (2, None), (3, ""), (4, "ACG"), (5, "TTTTTTTTTTTTTTTTTTTTT")], "read int, seq string")
    markers = spark.createDataFrame([("ACGTA", "x", 2), ("TACGT", "y", 3), ("CÉSS\U0001f600", "y", 1), ("GGGGG", "z", 1)], "word string, taxon string, times long")
    upper = reads.select("read", F.upper("seq").alias("seq"))
    wanted = {r.word for r in markers.collect()}
    plain = {tuple(r) for r in search.words(upper, 5).select("read", "pos", "word").collect() if r.word in wanted}
    held = [tuple(r) for r in search._held_words(upper, "read", 5, markers).collect()]
    assert len(held) == len(set(held)) < 6 and {r for r in held if r[2] in wanted} == plain
    got = {(r.read, r.taxon): r.votes for r in search.votes(reads, markers, "read", "taxon", 5).collect()}
    monkeypatch.setattr(search, "LOOKED_UP", 0)
    assert got == {(r.read, r.taxon): r.votes for r in search.votes(reads, markers, "read", "taxon", 5).collect()} and got[1, "x"] == 4


def test_matrix_entries_are_written_by_many_tasks(spark, monkeypatch, tmp_path):
    """all entries were sorted by one task and written as one file."""
    from strandframe.plans import files_queries
    from strandframe.plans.catalog import Tables

    monkeypatch.setattr(files_queries, "_path", lambda t, name: f"{tmp_path}/{name}")
    assert files_queries._cells(Tables(spark, "/root/testdata/sf0.1")).count() > 0
    sizes = [x.stat().st_size for x in (tmp_path / "tenx" / "matrix.mtx").glob("part-*")]
    assert max(sizes) < 0.7 * sum(sizes)


def test_near_texts_are_not_sent_whole_to_every_task(spark):
    """twenty rows of keys a sequence, taken for as few bytes as the sequences, were broadcast."""
    draw = random.Random(8)
    rows = [(i, "".join(draw.choices("AC", k=9))) for i in range(60)]
    out = search.p_distance_within(spark.createDataFrame(rows, "id long, seq string"), "id", 3)
    got = sorted((r.id1, r.id2) for r in out.collect())
    first = {}
    for i, text in rows:
        first.setdefault(text, i)
    want = sorted((a, b) for (s, a), (t, b) in itertools.permutations(first.items(), 2) if a < b and sum(x != y for x, y in zip(s, t)) <= 3)
    assert got == want and len(want) > 10
    assert "SortMergeJoin" in plan(out) and "Broadcast" not in plan(out)


def test_triangles_without_rows_for_pairs_of_neighbours(spark, monkeypatch):
    """every pair of out-neighbours was a row of a shuffle."""
    from strandframe.operators import sets

    draw = random.Random(9)
    pairs = [(draw.randrange(60), draw.randrange(12)) for _ in range(400)] + [(100 + i, 101 + i) for i in range(5)] + [(7, 7)]
    e = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    near = {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {n: sum((a, b) in e for a, b in itertools.combinations(sorted(x), 2)) for n, x in near.items()}
    for kind, name in (("long", int), ("string", str)):
        df = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"src {kind}, dst {kind}").repartition(3)
        for indexed, marked, tried, hubs in ((1 << 21, 1 << 25, 1 << 22, 1 << 17), (30, 40, 5, 3), (1 << 21, 40, 5, 0)):
            for k, v in (("INDEXED", indexed), ("MARKED", marked), ("TRIED", tried), ("HUBS", hubs), ("JOINED", tried)):
                monkeypatch.setattr(sets, k, v)
            out = sets.triangles(df)
            assert {r.node: r.triangles for r in out.collect()} == {name(n): t for n, t in want.items() if t}
            assert "MapInArrow" in plan(out) and "SortMergeJoin" not in plan(out)
        got = sets.network_summary(df).first()
        assert (got.nodes, got.edges, got.connected) == (len(near), len(e), False)
    assert sets.triangles(df.where(F.lit(False))).count() == 0
    assert sets.network_summary(df.where("length(src) < 3 AND length(dst) < 3")).first().connected


def test_blocks_of_samples_meet_without_a_shuffle_of_copies(spark, monkeypatch):
    """F5, F8: every sample was shuffled once for each block, so disk grew with the square of the table."""
    from strandframe.operators import omics

    draw = random.Random(10)
    rows = [(f"s{i}", draw.randrange(6), draw.randrange(1, 4)) for i in range(50) for _ in range(3)] + [("none", None, 2), ("zero", 1, 0), (None, 1, 3)]
    df = spark.createDataFrame(rows, "sample string, taxon long, count long")
    per = {}
    for s, t, c in rows:
        if s is not None:
            per.setdefault(s, {}).setdefault(t, 0)
            per[s][t] += c
    want = {}
    for a, b in itertools.combinations(sorted(per), 2):
        shared = sum(min(c, per[b].get(t, 0)) for t, c in per[a].items() if t is not None)
        want[a, b] = 1 - 2 * shared / (sum(per[a].values()) + sum(per[b].values()))
    for block, parts, counts in ((1024, 20, 1 << 21), (7, 3, 1 << 21), (7, 20, 1 << 21), (4, 1, 20)):
        for k, v in (("BLOCK", block), ("LEAST_PARTS", parts), ("PART_COUNTS", counts)):
            monkeypatch.setattr(omics, k, v)
        out = omics.beta_diversity(df)
        got = out.collect()
        assert len(got) == len(want) and {(r.sample1, r.sample2): round(r.distance, 9) for r in got} == {p: round(d, 9) for p, d in want.items()}
        assert "CartesianProduct" in plan(out) and "Exchange" not in plan(out)


def test_overlap_tables_are_stored_compressed(spark, monkeypatch):
    """texts, ends and prefixes were kept as plain rows on disk."""
    monkeypatch.setattr(search, "cut_lineage", lambda df: df.this_table_is_kept_as_plain_rows)
    draw = random.Random(12)
    seqs = sorted({"".join(draw.choices("AC", k=draw.randrange(4, 9))) for _ in range(40)})
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    want = {}
    for (i, a), (j, b) in itertools.permutations(enumerate(seqs), 2):
        sizes = [n for n in range(4, min(len(a), len(b)) + 1) if a.endswith(b[:n])]
        if sizes:
            want[i, j] = max(sizes)
    assert {(r.src, r.dst): r.overlap for r in search.overlaps(df, "id", 4).collect()} == want and len(want) > 10

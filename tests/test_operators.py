"""Hand-computed fixtures and brute-force comparisons on small tables."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions import dna, pairwise, stats
from strandframe.operators import coverage, genetics, intervals, learning, mapping, matrix, omics, ordered, scan, search, sets, tables, traces, variants


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scalar_sequences(spark):
    lit = F.lit
    r = one(
        spark, gc=dna.gc_percent(lit("GCGCATAT")), empty=dna.gc_percent(lit("")), rc=dna.reverse_complement(lit("AaCGTN")), p=dna.translate(lit("ATGTTCAAA")),
        stop=dna.translate(lit("ATGTAA")), back=dna.translate(lit("TTTGAACAT"), -1), unknown=dna.translate(lit("ATGNNN")),
        tm=dna.melting_temperature(lit("ACGTACGT")), span=dna.reference_span(lit("3M2I4D1X")), d=dna.p_distance(lit("AC-T"), lit("AGGT")), nuc=dna.is_nucleotide(lit("ACGTN")),
    )
    assert (r.gc, r.empty, r.rc) == (50.0, 0.0, "NACGtT")
    assert (r.p, r.stop, r.back, r.unknown) == ("MFK", "M*", "MFK", "MX")
    assert (r.tm, r.span, r.nuc) == (24.0, 8, True) and abs(r.d - 1 / 3) < 1e-12


def test_p_distance_rejects_unequal_lengths(spark):
    with pytest.raises(Exception, match="differ in length"):
        spark.range(1).select(dna.p_distance(F.lit("AC"), F.lit("A"))).collect()


def test_tail_probabilities(spark):
    lit = F.lit
    r = one(
        spark, z=stats.normal_p(lit(1.959963984540054)), c=stats.chi2_p(lit(3.841458820694124)), t=stats.student_p(lit(2.0), lit(10)), f=stats.f_p(lit(4.0), lit(2), lit(10)),
        h=stats.hypergeometric_p(lit(3), lit(5), lit(4), lit(20)), x=stats.fisher_exact_p(lit(3), lit(1), lit(1), lit(3)), q=stats.normal_quantile(lit(0.975)), n=stats.normal_p(lit(None).cast("double")),
    )
    exact = sum(math.comb(5, k) * math.comb(15, 4 - k) for k in (3, 4)) / math.comb(20, 4)
    assert abs(r.z - 0.05) < 1e-9 and abs(r.c - 0.05) < 1e-9 and abs(r.t - 0.0733880) < 1e-6 and abs(r.f - 1.8**-5) < 1e-12  # closed form for two numerator degrees of freedom
    assert abs(r.h - exact) < 1e-12 and abs(r.x - 0.4857142857) < 1e-9 and abs(r.q - 1.959964) < 1e-6 and r.n is None


def test_cpm_and_tpm(spark):
    df = table(spark, [("G1", "S1", 10.0), ("G2", "S1", 30.0), ("G1", "S2", 20.0), ("G2", "S2", 40.0), ("G1", "S3", 0.0)], "feature string, sample string, count double")
    out = {(r.feature, r.sample): r.cpm for r in matrix.cpm(df).collect()}
    assert out["G1", "S1"] == 250000 and abs(out["G1", "S2"] - 333333.3333) < 1e-3 and out["G1", "S3"] == 0
    t = table(spark, [("G1", "S1", 10.0), ("G2", "S1", 20.0)], "feature string, sample string, count double")
    lengths = table(spark, [("G1", 1000.0), ("G2", 2000.0)], "feature string, length double")
    assert {r.feature: r.tpm for r in matrix.tpm(t, lengths).collect()} == pytest.approx({"G1": 500000.0, "G2": 500000.0})


def test_size_factors_fall_back_to_library_size(spark):
    df = table(spark, [("a", "s1", 10.0), ("b", "s1", 20.0), ("a", "s2", 30.0), ("b", "s2", 60.0)], "feature string, sample string, count double")
    assert {r.sample: round(r.size_factor, 6) for r in matrix.size_factors(df).collect()} == {"s1": 0.5, "s2": 1.5}


@pytest.mark.parametrize("kind", ["uniform", "hot", "nulls"])
def test_benjamini_hochberg(spark, kind):
    rng = random.Random(3)
    p = [rng.random() for _ in range(300)]
    if kind == "hot":
        p[:100] = [0.04] * 100
    if kind == "nulls":
        p[:50] = [None] * 50
    got = {r.id: r.p_adjusted for r in ordered.benjamini_hochberg(table(spark, list(enumerate(p)), "id int, p_value double")).collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    low, want = 1.0, {}
    for rank in range(len(known), 0, -1):
        v, i = known[rank - 1]
        low = min(low, v * len(known) / rank)
        want[i] = low
    for i, v in enumerate(p):
        assert (got[i] is None) == (v is None) and (v is None or abs(got[i] - want[i]) < 1e-12)


def test_ranks_and_quantiles_with_a_hot_value(spark):
    values = [5.0] * 200 + [float(i) for i in range(400)]
    df = table(spark, [(v,) for v in values], "v double")
    q = ordered.exact_quantiles(df, "v", [0.1, 0.5, 0.9]).first()
    assert [q.q0, q.q1, q.q2] == pytest.approx(list(np.percentile(values, [10, 50, 90])))
    ranks = {r.v: r.avg_rank for r in ordered.average_ranks(df, "v").collect()}
    assert ranks[5.0] == 6 + 100 and ranks[399.0] == 600


def ranges(rng, n, chroms="ab", span=3000):
    out = []
    for i in range(n):
        s = rng.randrange(span)
        out.append((i, rng.choice(chroms), s, s + rng.randrange(1, 400)))
    return out


def test_interval_joins_equal_nested_loops(spark, monkeypatch):
    monkeypatch.setattr(ordered, "POSITION_TILE", 128)
    rng = random.Random(5)
    a, b = ranges(rng, 60), ranges(rng, 80)
    left, right = (table(spark, rows, "id int, chrom string, start long, end long") for rows in (a, b))
    pairs = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and y[2] < x[3] and y[3] > x[2]}
    got = intervals.overlap_pairs(left, right, bin_size=64).select("id", "r_id").collect()
    assert len(got) == len(pairs) and {tuple(r) for r in got} == pairs
    counts = {r.id: r.overlaps for r in intervals.count_overlaps(left, right).collect()}
    assert counts == {x[0]: sum((x[0], y[0]) in pairs for y in b) for x in a}
    cov = {r.id: r.mean_coverage for r in intervals.mean_coverage(left, right).collect()}
    for x in a:
        bases = sum(max(0, min(x[3], y[3]) - max(x[2], y[2])) for y in b if y[1] == x[1])
        assert abs(cov[x[0]] - bases / (x[3] - x[2])) < 1e-9
    lonely = table(spark, [(0, "z", 5, 9)], "id int, chrom string, start long, end long")
    assert [(r.gene, r.distance) for r in intervals.nearest(lonely, right, "id").collect()] == [("intergenic", None)]


def test_depth_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ordered, "POSITION_TILE", 100)
    reads = ranges(random.Random(8), 120)
    runs = coverage.depth_runs(depth=table(spark, reads, "id int, chrom string, start long, end long")).collect()
    got = {(r.chrom, p): r.depth for r in runs for p in range(r.start, r.end)}
    want = {}
    for _, c, s, e in reads:
        for p in range(s, e):
            want[c, p] = want.get((c, p), 0) + 1
    assert got == want


def test_lead_snps(spark):
    schema = "chrom string, pos long, snp_id string, p_value double"
    near = table(spark, [("1", 100, "a", 1e-10), ("1", 200, "b", 1e-8)], schema)
    assert [r.snp_id for r in variants.lead_snps(near).collect()] == ["a"]
    chain = table(spark, [("1", p, str(p), 1e-9) for p in (0, 400_000, 800_000, 1_200_000)], schema)
    assert sorted(r.pos for r in variants.lead_snps(chain).collect()) == [0, 800_000]
    assert variants.lead_snps(table(spark, [("1", 1, "a", 0.5)], schema)).count() == 0


def test_lead_snps_of_long_loci(spark):
    rng = np.random.default_rng(3)
    rows = [(c, int(p), f"{c}{i}", float(rng.choice([1e-9, 1e-3], p=[0.8, 0.2]))) for c in "ab" for i, p in enumerate(rng.choice(np.concatenate([np.arange(0, 3000), np.arange(50_000, 50_100)]), 700))]
    want = []
    for c in "ab":
        lead = None
        for p in sorted({r[1] for r in rows if r[0] == c and r[3] < 5e-8}):
            if lead is None or p > lead + 25:
                lead = p
                want.append((c, p, min(r[2] for r in rows if r[:2] == (c, p) and r[3] < 5e-8)))
    got = variants.lead_snps(table(spark, rows, "chrom string, pos long, snp_id string, p_value double"), window=25).select("chrom", "pos", "snp_id").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_case_control_direction(spark):
    df = table(spark, [("1", 1, "rs1", 80, 120, 50, 150), ("1", 2, "rs2", 50, 150, 50, 150), ("1", 3, "rs3", 0, 0, 5, 5)], "chrom string, pos long, snp_id string, case_alt long, case_ref long, ctrl_alt long, ctrl_ref long")
    r = {x.snp_id: x for x in genetics.case_control(df).collect()}
    assert set(r) == {"rs1", "rs2"} and abs(r["rs1"].odds_ratio - 2.0) < 1e-12 and r["rs1"].p_value < 0.01 and r["rs2"].p_value == 1.0


def test_diversity_edges(spark):
    df = table(spark, [("one", "x", 100)] + [("many", f"t{i}", 1) for i in range(100)], "sample string, taxon string, count long")
    r = {x.sample: x for x in omics.alpha_diversity(df).collect()}
    assert r["one"].chao1 == 1 and r["one"].shannon == 0 and r["many"].simpson == 1
    wanted = table(spark, [("many", "one")], "sample1 string, sample2 string")
    assert [(x.sample1, x.sample2, x.distance) for x in omics.beta_diversity(df, pairs=wanted).collect()] == [("many", "one", 1.0)]
    assert omics.beta_diversity(df).count() == 1


def test_beta_diversity_has_no_limit_on_samples(spark):
    df = table(spark, [(f"s{i}", f"t{i % 2}", 1) for i in range(5000)], "sample string, taxon string, count long")
    wanted = df.selectExpr("sample AS sample1", "'s0' AS sample2")
    assert {x.distance: x["count"] for x in omics.beta_diversity(df, pairs=wanted).groupBy("distance").count().collect()} == {0.0: 2500, 1.0: 2500}


def test_fst_has_no_limit_on_populations(spark):
    df = table(spark, [(s, f"p{i:04d}", f"p{i}.{s}", (i + s) % 3) for i in range(600) for s in (1, 2)], "site int, pop string, sample string, gt int")
    assert genetics.fst(df).count() == 600 * 599 // 2
    wanted = table(spark, [("p0001", "p0002")], "pop1 string, pop2 string")
    whole = genetics.fst(df).filter("pop1 = 'p0001' AND pop2 = 'p0002'").first().fst
    assert [x.fst for x in genetics.fst(df, wanted).collect()] == [whole]


def test_nan_p_values_are_not_counted(spark):
    df = table(spark, [(1, 0.01), (2, 0.02), (3, float("nan")), (4, float("nan")), (5, None)], "id int, p_value double")
    for adjust, want in ((ordered.benjamini_hochberg, (0.02, 0.02)), (ordered.bonferroni, (0.02, 0.04))):
        got = {r.id: r.p_adjusted for r in adjust(df).collect()}
        assert (got[1], got[2]) == want and got[3] != got[3] and got[4] != got[4] and got[5] is None
    ranks = {r.p_value: r.avg_rank for r in ordered.average_ranks(df, "p_value").collect()}
    assert ranks == {0.01: 1.0, 0.02: 2.0}


def test_tajima_over_many_samples(spark):
    gt = spark.range(30_000).selectExpr("concat('s', id) AS sample", "1 AS site", "CAST(id % 3 AS INT) AS gt", "'p' AS pop")
    n = 60_000
    a1, a2 = sum(1 / i for i in range(1, n)), sum(1 / i**2 for i in range(1, n))
    e1 = ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1
    k = 2 * 0.5 * 0.5 * n / (n - 1)
    assert abs(genetics.tajimas_d(gt).first().tajimas_d - (k - 1 / a1) / e1**0.5) < 1e-9 and a2 > 1


def test_sets_with_joining_signs_and_without_shared_elements(spark):
    df = table(spark, [("R&D", 1), ("R&D", 2), ("X", 2), ("R", 3), ("D", 4)], "set_name string, element int")
    got = {(r.set1, r.set2): (r.shared, r.union, r.jaccard) for r in sets.set_pairs(df).collect()}
    assert len(got) == 6 and got[("R&D", "X")] == (1, 2, 0.5) and got[("D", "R")] == (0, 2, 0.0)
    assert {r.set_name: (r.size, r.unique) for r in sets.set_sizes(df).collect()} == {"R&D": (2, 1), "X": (1, 0), "R": (1, 1), "D": (1, 1)}


def test_copies_name_their_representative(spark):
    df = table(spark, [(1, "ACGT"), (2, "ACGT"), (3, "ACGA"), (4, None)], "id int, seq string")
    assert {(r.id, r.representative) for r in search.copies(df, "id").collect()} == {(1, 1), (2, 1), (3, 3)}


def test_short_chains_count_whole(spark):
    df = table(spark, [("c", i, float(i % 2)) for i in range(19)], "chain string, step int, value double")
    assert omics.effective_sample_size(df).first().ess == 19


def test_n50(spark):
    assert ordered.n50(table(spark, [(1000,)] * 100, "len long"), "len").first().n50 == 1000
    assert ordered.n50(table(spark, [(5000,)], "len long"), "len").first().l50 == 1


def test_scan_positions_cross_piece_edges(spark):
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(9000))
    df = table(spark, [(1, seq)], "seq_id long, seq string")
    words = {r.pos: r.word for r in scan.words(df, 31).collect()}
    assert words == {i: seq[i : i + 31] for i in range(len(seq) - 30)}
    sites = {(r.enzyme, r.strand, r.pos) for r in scan.restriction_sites(df, ["EcoRI", "HinfI", "BslI", "BsaI"]).collect()}
    import re

    want = set()
    for name, strand, _, _, pattern in scan.site_table(["EcoRI", "HinfI", "BslI", "BsaI"]):
        want |= {(name, strand, m.start()) for m in re.finditer(f"(?={pattern})", seq)}
    assert sites == want and any(p > 128 for _, _, p in want)
    gc = {r.pos: r.gc for r in scan.window_gc(df, window=100).collect()}
    assert len(gc) == len(seq) - 99 and abs(gc[5000] - sum(c in "GC" for c in seq[4901:5001])) < 1e-9


def test_digest_topologies(spark):
    df = table(spark, [(1, "AAGAATTCAAAA"), (2, "ACGT")], "seq_id long, seq string")
    ring = sorted((r.seq_id, r.start, r.end, r.size) for r in scan.digest(df, ["EcoRI"]).collect())
    line = sorted((r.seq_id, r.start, r.end, r.size) for r in scan.digest(df, ["EcoRI"], circular=False).collect())
    assert ring == [(1, 3, 3, 12), (2, 0, 4, 4)] and line == [(1, 0, 3, 3), (1, 3, 12, 9), (2, 0, 4, 4)]
    assert scan.overhang("SmaI") == "blunt" and scan.overhang("EcoRI") == "5prime"


def test_trimming(spark):
    df = table(spark, [(1, "ACGTACGT", "IIIIII!!"), (2, "ACGT", "!!!!")], "read_id long, seq string, qual string")
    r = {x.read_id: x for x in scan.trim_reads(df, min_length=3).collect()}
    assert (r[1].seq, r[1].quality_trimmed, r[1].passed) == ("ACGTAC", True, True) and (r[2].seq, r[2].passed) == ("", False)
    cut = scan.trim_reads(df, min_length=1, adapter="TAC").filter("read_id = 1").first()
    assert cut.seq == "ACG" and cut.adapter_hit


def brute_score(a, b, local):
    h = [[0 if local else -2 * (i + j) if not (i and j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    top = 0
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i][j] = max(h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 2, h[i][j - 1] - 2, *([0] if local else []))
        top = max(top, h[i][j])
    return top if local else h[-1][-1]


def test_pairwise_scores(spark):
    rng = random.Random(4)
    pairs = [("XXXXATCGXXXX", "ATCG"), ("ATCG" * 40, "ATCG" * 40), ("ATCGATCG", "ATCGGTCG")] + [
        tuple("".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 30))) for _ in range(2)) for _ in range(20)
    ]
    df = table(spark, pairs, "a string, b string")
    out = df.select("a", "b", pairwise.global_score("a", "b").alias("g"), pairwise.local_score("a", "b").alias("l"), pairwise.global_alignment("a", "b").alias("x")).collect()
    for r in out:
        assert (r.g, r.l) == (brute_score(r.a, r.b, False), brute_score(r.a, r.b, True)) and r.x.score == r.g
        assert r.x.aligned1.replace("-", "") == r.a and r.x.aligned2.replace("-", "") == r.b
    assert out[0].l == 4 and out[1].g == 160


def test_similarity_joins_equal_all_pairs(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(6)]
    seqs = []
    for s in base:
        for _ in range(4):
            t = list(s)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(40)] = rng.choice("ACGT")
            seqs.append("".join(t))
    rows = list(enumerate(seqs))
    first = {s: min(i for i, t in rows if t == s) for s in seqs}
    df = table(spark, rows, "id int, seq string")

    def grams(s):
        return {s[i : i + 5] for i in range(36)}

    for cut in (0.4, 0.7):
        want = {tuple(sorted((first[a], first[b]))) for a, b in itertools.combinations(set(seqs), 2) if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= cut}
        assert {(r.id1, r.id2) for r in search.kmer_jaccard(df, "id", 5, cut).collect()} == want
    want = {tuple(sorted((first[a], first[b]))) for a, b in itertools.combinations(set(seqs), 2) if sum(x != y for x, y in zip(a, b)) <= 3}
    assert {(r.id1, r.id2) for r in search.p_distance_within(df, "id", 3).collect()} == want


def test_unitigs(spark):
    edges = [(1, 2), (2, 3), (3, 4), (3, 9), (5, 6), (6, 7), (7, 5)]
    got = {r.node: (r.unitig, r.place) for r in search.unitigs(table(spark, edges, "src long, dst long")).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 9: (9, 0), 5: (5, 0), 6: (5, 1), 7: (5, 2)}


def test_overlaps_reach_the_join_by_their_longest_run(spark, monkeypatch):
    """Texts with a common beginning meet at an end of equal letters only, and rows are made for such ends alone, not for every place."""
    random.seed(3)
    letters = lambda n: "".join(random.choice("ACGT") for _ in range(n))
    common = letters(15)
    rows = [(i, letters(400) + common + letters(85)) for i in range(60)] + [(100 + i, common + letters(300)) for i in range(60)]
    rows += [(200, letters(50) + rows[70][1][:40]), (201, letters(50) + common), (202, rows[71][1][:200]), (203, None), (204, "ACG")]
    met = []
    join = search.word_join
    monkeypatch.setattr(search, "word_join", lambda a, b, key: met.append((a.count(), b.count())) or join(a, b, key))
    got = {(r.src, r.dst): r.overlap for r in search.overlaps(table(spark, rows, "id long, seq string"), "id").collect()}
    texts = {i: s for i, s in rows if s and len(s) >= 15}
    want = {}
    for i, s in texts.items():
        for j, u in texts.items():
            sizes = [n for n in range(15, min(len(s), len(u)) + 1) if i != j and u.startswith(s[-n:])]
            if sizes:
                want[i, j] = max(sizes)
    assert got == want and len(want) > 60
    assert max(b for _, b in met) < 1000


def test_beta_diversity_in_cells(spark, monkeypatch):
    """Several blocks give the distances of all pairs, and the names of all samples are never in one row."""
    monkeypatch.setattr(omics, "BLOCK", 7)
    random.seed(5)
    rows = [(f"s{i}", f"t{random.randrange(6)}", random.randrange(4)) for i in range(40) for _ in range(3)] + [("none", "t0", 0), ("nil", None, 0)]
    df = table(spark, rows, "sample string, taxon string, count long")
    found = omics.beta_diversity(df)
    assert "explode(slice" not in found._jdf.queryExecution().analyzed().toString() and "slice(" not in found._jdf.queryExecution().analyzed().toString()
    per = {}
    for s, t, c in rows:
        per.setdefault(s, {}).setdefault(t, 0)
        per[s][t] += c
    want = {}
    for a, b in itertools.combinations(sorted(per), 2):
        whole = sum(per[a].values()) + sum(per[b].values())
        want[a, b] = 1 - 2 * sum(min(per[a][t], per[b][t]) for t in per[a] if t in per[b]) / whole if whole else 0.0
    assert {(r.sample1, r.sample2): r.distance for r in found.collect()} == pytest.approx(want)


def test_beta_diversity_within_without_a_join_of_dense_taxa(spark, monkeypatch):
    """Few taxa make no pairs to be shuffled; rare ones still meet by their prefixes. Both give the same pairs."""
    random.seed(8)
    df = table(spark, [(i, random.randrange(4), random.randrange(1, 5)) for i in range(30) for _ in range(3)], "sample long, taxon long, count long")
    joined = []
    join = omics.word_join
    monkeypatch.setattr(omics, "word_join", lambda *args: joined.append(1) or join(*args))
    dense = {(r.sample1, r.sample2): r.distance for r in omics.beta_diversity_within(df, 0.4).collect()}
    assert not joined
    monkeypatch.setattr(omics, "DENSE", 0)
    by_prefix = {(r.sample1, r.sample2): r.distance for r in omics.beta_diversity_within(df, 0.4).collect()}
    assert joined and dense == pytest.approx(by_prefix) and len(dense) > 10


def test_enrichment_null_is_seeded(spark):
    ranking = table(spark, [(i, i + 1, float(50 - i)) for i in range(100)], "gene int, rank long, score double")
    ann = table(spark, [("top", i) for i in range(20)] + [("mixed", i) for i in range(0, 100, 5)], "term string, gene int")
    first, second = (sorted(map(tuple, sets.preranked_gsea(ann, ranking, permutations=30).collect())) for _ in range(2))
    assert first == second
    r = {x[0]: x for x in first}
    assert r["top"][2] > 0.9 and r["top"][4] <= 0.1 and all(0 <= x[4] <= 1 for x in first)


def test_enrichment_null_shuffles_only_the_sets(spark):
    """The draws that are shuffled are about as many as the largest set holds; without a bound there were 2,000 for each permutation."""
    ranking = table(spark, [(i + 1, float(1000 - i)) for i in range(2000)], "rank long, score double")
    seen = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: seen.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    before = stages().size()
    got = {r.size: r.null for r in sets.null_scores(ranking, table(spark, [(1,), (20,)], "size long"), 50).collect()}
    new = stages()
    assert max(new.apply(i).shuffleWriteRecords() for i in range(new.size() - before)) < 50 * 200 + 2000
    order = lambda perm: sorted(range(1, 2001), key=lambda r: hashlib.md5(f"42:{perm}:{r}".encode()).hexdigest())

    def es(ranks):
        w, high, low, run = {r: abs(1001.0 - r) for r in ranks}, 0.0, 0.0, 0.0
        for i, r in enumerate(sorted(ranks)):
            low = min(low, run - (r - i - 1) / (2000 - len(ranks)))
            run += w[r] / sum(w.values())
            high = max(high, run - (r - i - 1) / (2000 - len(ranks)))
        return high if high >= -low else low

    for k in (1, 20):
        assert sorted(got[k]) == pytest.approx(sorted(es(order(p)[:k]) for p in range(1, 51)))


def test_closure_with_a_diamond_and_a_ring(spark):
    edges = table(spark, [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("a", "d")], "child string, parent string")
    got = {(r.node): r.depth for r in sets.closure(edges, table(spark, [("d",)], "node string")).collect()}
    assert got == {"d": 0, "b": 1, "c": 1, "a": 2}


def test_mapping_keeps_failures(spark):
    df = table(spark, [(1, "2"), (2, "x")], "id int, v string")
    out = {r.id: (r.result, r.error) for r in mapping.map_items(df, lambda v: float(int(v)), "double", "v").collect()}
    assert out[1] == (2.0, None) and out[2][0] is None and out[2][1].startswith("ValueError")


def test_trace_prominence(spark):
    y = [0, 3, 1, 5, 2, 4, 0]
    tops = table(spark, [("s", i, float(y[i])) for i in (1, 3, 5)], "sample string, scan long, intensity double")
    lows = table(spark, [("s", i, float(y[i])) for i in (0, 2, 4, 6)], "sample string, scan long, intensity double")
    assert {r.scan: r.prominence for r in traces.prominences(tops, lows).collect()} == {1: 2.0, 3: 5.0, 5: 2.0}


def test_record_checks(spark):
    df = table(spark, [("ACGX", "III"), ("ACGT", "IIII")], "seq string, qual string")
    out = df.select(tables.sequence_errors("seq").alias("s"), tables.fastq_errors().alias("q")).collect()
    assert out[0].s == ["invalid characters: X"] and out[0].q == ["sequence and quality differ in length"] and out[1].s == [] and out[1].q == []
    with pytest.raises(ValueError, match="missing columns: z"):
        tables.require_columns(df, ["seq", "z"])
    assert tables.downsample(spark.range(100), "id", 7).collect() == tables.downsample(spark.range(100), "id", 7).collect()


def test_near_samples_without_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(f"s{i}", "everywhere", int(rng.integers(1, 30))) for i in range(60)]
    rows += [(f"s{i}", f"t{int(x)}", int(rng.integers(1, 9))) for i in range(60) for x in set(rng.integers(0, 12, 1 + i % 9))] + [("none", "t1", 0)]
    df = table(spark, rows, "sample string, taxon string, count long")
    every = {(r.sample1, r.sample2): r.distance for r in omics.beta_diversity(df.where("count > 0")).collect()}
    for most in (0.0, 0.2, 0.45, 0.8):
        got = {(r.sample1, r.sample2): r.distance for r in omics.beta_diversity_within(df, most).collect()}
        want = {p: d for p, d in every.items() if d <= most + 1e-12}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want), most
    assert len(want) > len(got) / 2 and len(every) > len(want)


def test_lags_over_block_edges(spark, monkeypatch):
    monkeypatch.setattr(omics, "LAG_BLOCK", 16)
    rng = np.random.default_rng(9)
    x = {"a": rng.normal(size=100), "b": rng.normal(size=37)}
    df = table(spark, [(c, i - 20, float(v)) for c, xs in x.items() for i, v in enumerate(xs)], "chain string, step long, x double")
    for lags in (3, 50):
        got = {(r.chain, r.lag): r["product"] for r in omics.lag_products(df, lags).collect()}
        assert set(got) == {(c, k) for c in x for k in range(1, lags)}
        assert all(abs(got[c, k] - float(x[c][:-k] @ x[c][k:] if k < len(x[c]) else 0)) < 1e-9 for c, k in got)


def test_held_out_rows_judge_the_forest(spark):
    rng = np.random.default_rng(10)
    rows = [(i, "yes" if v[0] + 0.2 * v[1] > 0 else "no", [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(400, 4)))]
    df = learning.with_vector(table(spark, rows, "id int, label string, v array<double>"), "v")
    model, predicted, figures = learning.forest_holdout(df, "label", "id", trees=30)
    r = figures.first()
    assert r.n_train + r.n_test == 400 and 50 < r.n_test < 110 and predicted.count() == r.n_test
    assert r.accuracy > 0.85 and r.auc > 0.93
    assert learning.importances(model.stages[-1], 1).first().feature == 0 and learning.confusion(predicted).agg({"n": "sum"}).first()[0] == r.n_test
    three = df.withColumn("label", F.when(F.col("id") % 3 == 0, "other").otherwise(F.col("label")))
    assert learning.forest_holdout(three, "label", "id", trees=5)[2].first().auc is None

"""N-gram join, decontamination and the language model against brute force."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from fixtures import AWKWARD, frame, sentences
from strandframe.llm import decontamination, lm_scoring, ngram_join


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if None not in (a, b) and s and t and 100 * len(s & t) >= 80 * len(s | t):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=str)


def edited(text, rng, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


def documents():
    rng = random.Random(3)
    rows, at = [], 0
    for text in sentences(7, 12, 120, 5000):
        for k in range(6):
            rows.append((at, edited(text, rng, k // 2)))
            at += 1
    passage = sentences(8, 1, 60, 5000)[0]
    rows += [(at + i, passage + " " + t) for i, t in enumerate(sentences(9, 30, 12, 5000))]
    rows += [(300 + i, "the very same text of several words") for i in range(20)] + [(2, rows[2][1]), (5, "another text of document five with words"), *AWKWARD]
    return rows


def test_words_of_a_text_are_hashed_together():
    """each word was looked up and hashed by itself, in every block that its text is in."""
    from strandframe.llm.shingles import word_hashes

    rng = random.Random(11)
    words = [bytes(rng.choices(b"ab\0\x1c\xc3\xa9", k=n)).decode("utf-8", "replace") for n in [*range(1, 40), 255, 256, 257, 300, 4000] for _ in range(12)]
    words += [w.upper() for w in words] + ["\ud800", "\ud801", "\xa0", "\u2003x", "\0", "\0\0"]
    text = "".join(w + rng.choice((" ", "\t\n", "\x0b", "\x0c\r ")) for w in rng.choices(words, k=6000))
    seen = collections.defaultdict(set)
    for t in (text, " " + text, "", " \n", "one", text + "\0"):
        split, hashes = t.encode("utf-8", "surrogatepass").lower().split(), word_hashes(t)
        assert len(split) == len(hashes)
        for w, h in zip(split, hashes.tolist()):
            seen[w].add(h)
    assert all(len(hs) == 1 for hs in seen.values()) and len({h for hs in seen.values() for h in hs}) == len(seen) > 400


@pytest.mark.parametrize("block_docs", [512, 3])
def test_ngram_join_matches_brute_force(spark, block_docs):
    rows = documents()
    got = sorted([tuple(r) for r in ngram_join.similar_groups(frame(spark, rows), block_docs=block_docs).collect()], key=str)
    assert got == brute_groups(rows)


def test_ngram_join_chains_and_thresholds(spark):
    # chains of sets at exactly 80 percent and just under it
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + 40])) for i in range(0, 60, 2)] + [(100 + i, " ".join(words[200 + 5 * i : 250 + 5 * i])) for i in range(8)]
    got = sorted([tuple(r) for r in ngram_join.similar_groups(frame(spark, rows)).collect()], key=str)
    assert got == brute_groups(rows)


def test_ngram_join_keeps_the_first_of_each_group(spark):
    rows = documents()
    docs = frame(spark, rows)
    kept = ngram_join.keep_one_of_each(docs)
    want = collections.Counter(d for d, _, c in brute_groups(rows) if d is None or d == c)
    assert kept.columns == docs.columns and collections.Counter(r.doc_id for r in kept.collect()) == want
    assert ngram_join.similar_groups(docs.where("doc_id < 0")).count() == 0


def test_divide_skip_finds_all(spark):
    rng = random.Random(4)
    for _ in range(50):
        lists = [sorted(rng.sample(range(40), rng.randrange(0, 30))) for _ in range(12)]
        counts = collections.Counter(d for x in lists for d in x)
        for needed in (1, 4, 9):
            found = {d for d, c, rest in ngram_join.divide_skip(lists, needed) if ngram_join.probe(d, c, rest, needed)}
            assert found == {d for d, c in counts.items() if c >= needed}


def brute_align(a, b):
    table, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_matches_the_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 25))
        assert decontamination.align(a, b) == brute_align(a.tolist(), b.tolist())


def test_decontamination_finds_copies_and_leaves_the_rest(spark):
    rng = random.Random(6)
    items = sentences(10, 8, 40, 4000)
    fill = sentences(11, 60, 80, 4000)
    rows, leaks = [], set()
    for i in range(60):
        item = i % 8
        body = {0: items[item], 1: edited(items[item], rng, 4), 2: items[item].upper().replace(" ", " , "), 3: " ".join(items[item].split()[:20] + ["put", "in"] + items[item].split()[20:])}.get(i % 5)
        rows.append((i, fill[i] if body is None else f"{fill[i][:200]} {body} {fill[i][200:]}"))
        if body is not None:
            leaks.add((i, item))
    rows += [*AWKWARD, (0, rows[0][1]), *[(500 + i, items[7] + f" tail {i}") for i in range(200)]]
    leaks |= {(500 + i, 7) for i in range(200)}
    bench = spark.createDataFrame([*enumerate(items), (8, None), (9, ""), (10, "two words"), (None, "an item without id"), (1, items[1])], "item_id long, text string")
    docs = frame(spark, rows)
    found = decontamination.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaks
    words = decontamination.Words()
    text = dict(rows)
    for r in found:
        own = words.of(items[r.item_id])[1]
        assert r.score == pytest.approx(decontamination.align(own, words.of(text[r.doc_id])[1]) / (2 * len(own)))
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in leaks}
    assert decontamination.contaminated(docs, bench.where("item_id < 0")).count() == 0
    assert decontamination.contaminated(docs.where("doc_id < 0"), bench).count() == 0


def test_decontamination_finds_every_kth_word_replaced(spark):
    edits = [(every, at) for every in (4, 5, 6) for at in range(every)]
    items, fill, rows = sentences(40, len(edits), 48, 4000), sentences(41, len(edits), 120, 4000), []
    for i, (every, at) in enumerate(edits):  # one edited copy an item, so that no other copy counts for its runs
        body = [f"new{i}" if i % every == at else w for i, w in enumerate(items[i].split())]
        rows.append((i, " ".join([*fill[i].split()[:60], *body, *fill[i].split()[60:]])))
    rows += [(500 + i, text) for i, text in enumerate(items[::2])]  # exact copies, by which the runs left intact are the more frequent ones
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(frame(spark, rows), bench).collect()}
    words, want = decontamination.Words(), {}
    for doc_id, text in rows:
        for item, own in enumerate(words.of(text)[1] for text in items):
            score = brute_align(own.tolist(), words.of(text)[1].tolist()) / (2 * len(own))
            if score >= 0.5:
                want[doc_id, item] = score
    assert len(want) == len(rows) and found == pytest.approx(want)


def test_ceiling_is_never_under_the_alignment():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = rng.integers(0, 9, rng.integers(1, 12)), rng.integers(0, 9, rng.integers(1, 25))
        assert decontamination.ceiling(a, b) >= decontamination.align(a, b)


def brute_scores(rows, order, smoothing):
    learn = [d is not None and zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in rows]
    tokens = [["<s>", *(t or "").encode().lower().split(), "</s>"] for _, t in rows]
    counts = collections.Counter()
    for w, yes in zip(tokens, learn):
        if yes:
            counts.update(tuple(w[i - n + 1 : i + 1]) for i in range(len(w)) for n in range(1, order + 1) if i - n + 1 >= 0)
    n_train = sum(c for g, c in counts.items() if len(g) == 1 and g != ("<s>",))
    known = sum(1 for g in counts if len(g) == 1 and g != ("<s>",))
    out = []
    for (d, _), w in zip(rows, tokens):
        base = score = 0.0
        for i in range(1, len(w)):
            p = (counts[(w[i],)] + 0.1) / (n_train + 0.1 * (known + 1))
            base += math.log10(p)
            for n in range(2, order + 1):
                if i - n + 1 >= 0:
                    gram = tuple(w[i - n + 1 : i + 1])
                    p = (counts[gram] + smoothing * p) / (counts[gram[:-1]] + smoothing)
            score += math.log10(p)
        out.append((str(d), len(w) - 1, sum(counts[(x,)] > 0 for x in w[1:]), n_train, base, score))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_matches_brute_force(spark, order):
    rows = [(i, t) for i, t in enumerate(sentences(12, 60, 25, 40))] + [(3, "w1 w2 W3"), *AWKWARD[:6]]
    scored = lm_scoring.score_texts(frame(spark, rows), "crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0", order=order, smoothing=2.0)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scored.collect())
    want = brute_scores(rows, order, 2.0)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4]) and g[5] == pytest.approx(w[5])


def test_language_model_with_nothing_to_learn(spark):
    rows = frame(spark, [(1, "a b"), (2, None)])
    got = {r.doc_id: r for r in lm_scoring.score_texts(rows, "doc_id < 0").collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == pytest.approx(0.0)
    assert lm_scoring.score_texts(rows.where("doc_id < 0"), "true").count() == 0

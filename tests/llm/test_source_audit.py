"""Source audit against exact arithmetic over all terms and pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest
from fixtures import AWKWARD, frame
from strandframe.llm import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, ranks):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = {s: Counter({t: c[t] for t in kept if c[t]}) for (k, s), c in counts.items() if k == lang}
        whole = sum(groups.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(kept))  # noqa: B023, E731
        for s, own in groups.items():
            pairs = [(-sum(abs(share(own, t) - share(other, t)) for t in kept), o.encode(), o) for o, other in groups.items() if o != s]
            out += [(lang, s, "pair", name, -v, k) for k, (v, _, name) in enumerate(sorted(pairs), 1)]
            terms = [(share(whole, t) - share(own, t), t.encode(), t) for t in kept if own[t] and share(own, t) > share(whole, t)]
            out += [(lang, s, "term", name, -v, k) for k, (v, _, name) in enumerate(sorted(terms)[:ranks], 1)]
    return sorted(out)


def corpus(seed, n, sources=6, vocabulary=60):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Sea", "sEa", "ö", "日本", "x", "é") for b in "abcdefghij"][:vocabulary]
    rows = []
    for _ in range(n):
        source = rng.choice([f"s{i}" for i in range(sources)] + [None])
        mine = words[: 10 + hash_of(source) % vocabulary]
        rows.append((rng.choice(["en", "de", None]), source, rng.choice(["", "12 [", "!"]) + " ".join(rng.choice(mine) for _ in range(rng.randrange(40)))))
    return rows


def hash_of(source):
    return sum(map(ord, source or "none")) * 7


def got(docs, min_docs, ranks):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in source_audit.audit_sources(docs, min_docs, ranks).collect())


@pytest.mark.parametrize(("min_docs", "ranks", "block"), [(30, 50, 1 << 21), (3, 5, 64), (10**6, 50, 64)])
def test_ranks_and_distances(spark, monkeypatch, min_docs, ranks, block):
    monkeypatch.setattr(source_audit, "_BLOCK", block)
    monkeypatch.setattr(source_audit, "_HELD", 100)
    rows = corpus(1, 400) + [("en", "s0", t) for _, t in AWKWARD] + [("zz", "only", None), ("yy", "a", "word"), ("yy", "b", "")] + [("en", "s1", "Twice twice")] * 40
    docs = frame(spark, [(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)])
    # ``frame`` fills in a language and a source only where the row leaves them out
    assert got(docs, min_docs, ranks) == brute(rows, min_docs, ranks)


def test_ties_beyond_the_ranks_are_cut_in_utf8_order(spark):
    rows = [("en", "a", " ".join(f"w{c}" for c in "zyxwvutsrqponmé日")), ("en", "b", "other words")] * 30
    docs = frame(spark, [(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)])
    out = got(docs, 30, 4)
    assert out == brute(rows, 30, 4) and [r[3] for r in out if r[1:3] == ("a", "term")] == ["wm", "wn", "wo", "wp"]


def test_large_counts_divide_exactly(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    pairs = [(c := rng.randrange(10**14), c + 5 + rng.randrange(10**14)) for _ in range(200)]
    table = spark.createDataFrame(pairs, "c long, d long")
    want = [1 + 10**9 * (c + 5) // d for c, d in pairs]
    assert [r[0] for r in table.select(source_audit._share(F.col("c"), F.col("d"))).collect()] == want
    import numpy as np

    assert source_audit._shares(np.array([c for c, _ in pairs]), np.array([d for _, d in pairs])).tolist() == want


def test_empty_table(spark):
    assert got(frame(spark, [(1, "x")]).where("doc_id < 0"), 30, 50) == []

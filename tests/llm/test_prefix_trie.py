"""The trie of rebuilt conversations against sequences put together in full."""

import hashlib
import random
import zlib
from collections import defaultdict

from strandframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, pos string, h1 long, base string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 3, "y") for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2]), rebuilt, own


def got(spark, rows):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()), key=lambda r: r[:2])


def talk(seed, convs, most, texts):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for turn in rng.sample(range(100), rng.randrange(1, most + 1)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(texts)))
    return rows


def check(spark, rows):
    want, rebuilt, own = brute(rows)
    out = got(spark, rows)
    assert [r[:8] for r in out] == want
    for r in out:  # the turn referred to is the last one of the prefix
        if r[1]:
            assert own[r[8]][r[9] - 1] == rebuilt[r[0]][r[1] - 1]


def test_nodes_of_random_talks(spark):
    check(spark, talk(1, [*range(0, 60), *range(95, 130), *range(205, 260), 1000, 1001], 8, ["a", "bb", "", "ccc", "é日\U0001f600"]))


def test_copies_long_talks_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TILE", 4)
    monkeypatch.setattr(prefix_trie, "_PIECE", 3)
    rows = [(c, t, "user", f"the same {t}") for c in range(300, 340) for t in range(3)]
    rows += [(7, t, "user", f"turn {t % 5}") for t in range(200)] + [(8, t, "user", f"turn {t % 5}") for t in range(201)]
    rows += [(9, None, None, None), (9, 1, None, "x" * 50_000), (9, 2, "user", None), (None, 1, "user", "lost"), (11, 5, "user", "one")]
    rows += [(12, 1, "user", "again"), (12, 1, "user", "again"), (13, 1, "user", "again"), (13, 1, "user", "again")]
    check(spark, rows)


def test_few_texts_make_deep_shared_prefixes(spark):
    check(spark, talk(2, range(100, 190), 12, ["x"]) + talk(3, range(400, 440), 3, ["x", "y"]))


def test_weak_hashes_are_found_out_and_drawn_again(spark, monkeypatch):
    rows = talk(4, range(0, 80), 6, ["a", "b", "c", "d"])
    drawn, hashed = [], prefix_trie._hashed

    def weak(conversations, attempt):
        drawn.append(attempt)
        out = hashed(conversations, attempt)
        return out.selectExpr("conv_id", "turn", "role", "text", "pmod(h1, 2) AS h1", "pmod(h2, 2) AS h2") if attempt == 0 else out

    monkeypatch.setattr(prefix_trie, "_hashed", weak)
    bases = prefix_trie._bases
    # the second attempt has bases for which order does not count
    monkeypatch.setattr(prefix_trie, "_bases", lambda attempt: [1, 1, 1] if attempt == 1 else bases(attempt))
    check(spark, rows)
    assert drawn == [0, 1, 2]


def test_no_conversations(spark):
    assert got(spark, [(None, 1, "user", "x")]) == []

"""Line dedup, quality rules and personal data against plain Python."""

import re

import pytest
from fixtures import AWKWARD, frame, sentences
from pyspark.sql import functions as F
from strandframe.llm import line_dedup, pii, quality_rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\f\r"


def brute_lines(rows):
    holders = {}
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(spark):
    shared = sentences(1, 6)
    rows = [(i, "\n".join([shared[i % 6], f"own line number {i} here", shared[(i * 5) % 6].upper(), "short", shared[i % 6] + " \t"])) for i in range(40)]
    rows += [(3, "\n".join([shared[3], "a second row of document three"])), (41, "\n\n"), (42, "Éa accented line\néa accented line"), (43, "Éa accented line"), (7, rows[7][1]), *AWKWARD]
    got = sorted([tuple(r) for r in line_dedup.drop_repeated_lines(frame(spark, rows)).select("doc_id", "text", "n_lines", "n_dropped").collect()], key=str)
    assert got == brute_lines(rows)


def test_line_dedup_of_a_line_in_every_document(spark):
    rows = [(i, "the same line everywhere\n" * 3 + f"own text of {i}") for i in range(300)]
    got = line_dedup.drop_repeated_lines(frame(spark, rows)).where("n_dropped = 3").count()
    assert got == 299


@pytest.mark.parametrize("operator", [line_dedup.drop_repeated_lines, quality_rules.quality_figures, quality_rules.keep_good, pii.find_personal_data])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [(1, "x")]).where("doc_id < 0")).count() == 0


def brute_quality(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_figures_match_brute_force(spark):
    base = sentences(2, 5, 25)
    texts = ["\n".join(base), base[0] + "\n" + base[0] + "\n" + base[1], (base[2] + " ") * 3, "a b c d e f g h " * 2, "w " * 40, "# a | b > c\n\n x", *[t for _, t in AWKWARD[:6]]]
    rows = [(i, t) for i, t in enumerate(texts)]
    for r in quality_rules.quality_figures(frame(spark, rows)).collect():
        want = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_rules_by_line(spark):
    clean = "\n".join(sentences(3, 4))
    menu = "Home\nLogin\n" + "a | b | c | d\n" * 8
    rows = [(1, clean), (2, clean + "\nHome\nAll rights reserved by us."), (3, sentences(4, 1, 22)[0] + "\n" + menu * 2), (4, " ".join(["word###"] * 60))]
    frame_ = frame(spark, rows)
    kept = {r.doc_id: (r.kept, r.words_lost) for r in quality_rules.quality_figures(frame_).collect()}
    assert kept[1] == (True, 0) and kept[2] == (True, 6) and not kept[3][0] and not kept[4][0]
    stay = quality_rules.keep_good(frame_)
    assert stay.columns == frame_.columns and sorted(r.doc_id for r in stay.collect()) == [1, 2]


def brute_spans(text):
    text, found = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ):
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m.group(0))]
    return found


def test_base_spans_match_brute_force(spark):
    import random

    rng = random.Random(5)
    pieces = ["a.b@c.de", "x@y", "@", ".", "-", "_", " ", "1.2.3.4", "256.1.1.1", "0000001.2.3.4", "4539 1488 0343 6467", "4539148803436467", "79927398713", "+1 (017) 555-7713", "+49", "1", "22", "é", "\U0001f600", "a@b.c-", "@d.e", "+12345678901234567", "--1", "5500-0000-0000-0004"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(400)] + [t for _, t in AWKWARD[:6]] + ["a" * 30_000 + "@", "1" * 30_000, "1.2.3." * 3000, "a@b" + ".c" * 20_000]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] for r in pii.find_personal_data(frame(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute_spans(text), text[:200]


def test_added_spans(spark):
    texts = ["Our IBAN is GB82 WEST 1234 5698 7654 32 today", "code GB82 WEST 1234 5698 7654 33 is wrong", "my ssn: 219-09-9999", "part 219-09-9999 of it", "call me (020) 555-1234", "+1 (020) 555-1234 call"]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_personal_data(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {0: ["iban"], 1: [], 2: ["national_id"], 3: [], 4: ["local_phone"], 5: ["phone"]}


def test_joined_spans(spark):
    r = pii.find_personal_data(frame(spark, [(1, "a@b.cd and 1.2.3.4")])).select(pii.joined(F.col("spans")).alias("s")).first()
    assert r.s == "email:0:6,ip:11:18"

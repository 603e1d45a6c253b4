"""SentencePiece ids against the library, against a search for the best pair in every step, and through the query."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from fixtures import AWKWARD, frame, sentences
from strandframe.llm import sentence_pieces
from strandframe.llm.queries import op11_sentence_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ATOMS = ["a", "the", " ", "  ", "\n", "\t", "é", "日", "\U0001f600", "▁", "<s>", "</s>", "<0x0A>", "\x00", "ing", "x" * 20, "�", ".", "'s", "12", "\r\n", "　", "́", "ﬁ", "<unk>", "tion"]


@pytest.fixture(scope="module")
def vocabulary():
    return sentence_pieces.Vocabulary(MODEL)


def best_pair_merges(vocabulary, text):
    """Merge the best pair of the whole text, leftmost of equals, until none is a piece."""
    symbols = list(text)
    while True:
        pairs = [(vocabulary.ranks[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in vocabulary.ranks]
        if not pairs:
            return symbols
        i = min(pairs)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def random_texts(seed, n, size):
    rng = random.Random(seed)
    return ["".join(rng.choice(ATOMS) for _ in range(rng.randrange(size))) for _ in range(n)]


def test_ids_and_texts_are_the_librarys(vocabulary):
    texts = random_texts(1, 4000, 14) + [t or "" for _, t in AWKWARD] + ["ab" * 60_000, "é" * 500 + " " * 500]
    ids = vocabulary.encode(texts)
    assert [x.tolist() for x in ids] == vocabulary.library.encode(texts, add_bos=True, add_eos=True)
    assert [vocabulary.decode(x.tolist()) for x in ids] == [vocabulary.library.decode(x.tolist()) for x in ids]


def test_any_ids_decode_as_the_library_does(vocabulary):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 28705, rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3, 259)]) for _ in range(rng.randrange(8))]
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids), ids


def test_both_agendas_find_the_best_pair_in_every_step(vocabulary):
    for text in random_texts(3, 300, 10) + sentences(4, 5, 8):
        whole = vocabulary.normalized(text)
        want = best_pair_merges(vocabulary, whole)
        assert vocabulary.merged(whole) == want
        assert [s for part in vocabulary.stretches(whole) for s in vocabulary.merged(part)] == want
    alone = sentence_pieces.Vocabulary(MODEL)
    for text in random_texts(5, 300, 6):
        for part in filter(None, alone.stretches(alone.normalized(text))):
            alone._learn([part])
            assert alone.known[part] == alone._ids_of(alone.merged(part)), repr(part)


def test_a_full_memory_of_stretches_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "_CACHED", 50)
    small, texts = sentence_pieces.Vocabulary(MODEL), sentences(6, 60, 30, 4000)
    for t in texts:
        assert np.array_equal(small.encode([t])[0], vocabulary.encode([t])[0])


def test_rows_and_digests(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate(random_texts(7, 60, 30))] + [*AWKWARD, (5, "a second row of five"), (5, "a second row of five")]
    got = sentence_pieces.encode_pieces(frame(spark, rows), MODEL).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    want = [(d, vocabulary.library.encode(t or "", add_bos=True, add_eos=True)) for d, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    assert {r.doc_id: r.decoded for r in got}[901] == ""
    assert sentence_pieces.encode_pieces(frame(spark, rows).where("doc_id < 0"), MODEL).count() == 0


def test_a_difference_from_the_library_ends_the_job(spark, monkeypatch):
    docs = frame(spark, [(7, "some words")])
    wrong = sentence_pieces.Vocabulary.decode
    assert sentence_pieces.encode_pieces(docs, MODEL).count() == 1
    monkeypatch.setattr(sentence_pieces.Vocabulary, "decode", lambda self, ids: wrong(self, ids) + "!")
    with pytest.raises(Exception, match="doc_id 7 differ"):
        sentence_pieces.encode_pieces(docs, MODEL).collect()


def test_query_on_whole_texts(spark, vocabulary, tmp_path):
    rows = [(1, "Größe und Ünïcode 日本"), (2, None), (3, "word " * 20_000)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op11_sentence_pieces(spark, str(tmp_path)).collect()}
    for doc_id, text in rows:
        ids = vocabulary.library.encode(text or "", add_bos=True, add_eos=True)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(vocabulary.library.decode(ids).encode()).hexdigest()

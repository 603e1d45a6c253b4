"""Classifiers by held-out accuracy, mixing by its bound, token files by exact round trip, and the pipeline by brute force."""

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import zstandard
from fixtures import AWKWARD, frame, sentences
from strandframe.llm import language_id, source_mixing, token_store, toxicity
from strandframe.llm.text import shared_folder, written


def language_rows(n=240):
    rng = random.Random(1)
    parts = {"xx": ["tha", "ing", "er", "on"], "yy": ["ción", "ar", "os", "que"], "zz": ["ung", "sch", "ein", "ö"]}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(20)), lang) for i in range(n) for lang in [rng.choice(list(parts))]]


def test_language_is_told_on_held_out_texts(spark):
    rows = language_rows() + [(t[0], t[1], None) for t in AWKWARD] + [(950, "12 34 !?", "xx"), (3, language_rows()[3][1], "xx")]
    got = language_id.identify_language(frame(spark, rows)).collect()
    truth = {r[0]: r[2] for r in rows[:240]}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (901, 902, 903, 950)} == dict.fromkeys((901, 902, 903, 950), "und")
    nothing = language_id.identify_language(frame(spark, [(1, "abc", None)])).collect()
    assert nothing[0].lang_pred == "und" and nothing[0].score == 0
    assert language_id.identify_language(frame(spark, rows).where("doc_id < 0")).count() == 0


def test_nystroem_with_all_landmarks_is_kernel_ridge():
    texts = [t for _, t, _ in language_rows(40)]
    langs = [x for _, _, x in language_rows(40)]
    model = language_id.fit(texts, langs, 40, 1e-6)
    names, scores = model.predict(texts, language_id.letter_table())
    assert names == langs and scores.min() > 0.8


def toxic_rows():
    rng = random.Random(2)
    rows, labels = [], []
    for i, text in enumerate(sentences(3, 400, 30, 2000)):
        bad = i % 4 == 0
        words = text.split()
        for _ in range(3 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["grumblefool", "grumblefoool", "grumblfool", "snarkbeast", "snarkbeasts"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_texts_and_misspellings(spark):
    rows, labels = toxic_rows()
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    extra = [*AWKWARD, (990, "w1 w2 w3 grummblefool w4 w5 snarkbeest grumblefol w6"), (991, sentences(77, 1, 30, 2000)[0])]
    got = toxicity.score_toxicity(frame(spark, rows + extra), table).collect()
    assert len(got) == len(rows + extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    by = {r.doc_id: r.score for r in got}
    assert by[990] > 0.5 > by[991]
    none = toxicity.score_toxicity(frame(spark, extra), table.where("doc_id < 0")).collect()
    assert len({r.score for r in none}) == 1
    assert toxicity.score_toxicity(frame(spark, rows).where("doc_id < 0"), table).count() == 0


def test_toxic_words_count_where_toxic_texts_are_scarce():
    rng, clean = random.Random(9), sentences(50, 2060, 20, 500)
    toxic, words = clean[2000:], ["grumblefool", "snarkbeast", "blitherskunk", "dolthump", "vexgoblin"]
    for i, text in enumerate(toxic):
        own = text.split()
        for at in rng.sample(range(20), 4):
            own[at] = words[i % 5]
        toxic[i] = " ".join(own)
    model = toxicity.fit(clean[:2000] + toxic, [0] * 2000 + [1] * 60, 8, 10, 0.3)
    for word in words:  # each in 12 of 2,060 texts
        buckets, _ = toxicity.subwords([word])
        assert np.count_nonzero(model.table[buckets]) == len(buckets)
    plain = model.scores(sentences(51, 100, 20, 500), {})
    marked = model.scores([f"{words[i % 5]} " * 4 + t for i, t in enumerate(sentences(51, 100, 20, 500))], {})
    assert np.mean(marked[:, None] > plain) > 0.7


@pytest.mark.parametrize("shares", [{"a": 5, "b": 3, "c": 1}, {f"s{i}": 1 + i % 4 for i in range(20)}, {"one": 7}])
def test_schedule_deviates_by_less_than_a_block(shares):
    slots, q = source_mixing.schedule(shares), sum(shares.values())
    done = dict.fromkeys(shares, 0)
    for n, (slot, name, block, release, deadline) in enumerate(slots, 1):
        assert block == done[name] and release <= slot < deadline
        done[name] += 1
        assert all(abs(done[s] - n * a / q) < 1 for s, a in shares.items())
    assert done == shares


def test_mixing_places_every_row(spark):
    texts = sentences(4, 90, 40)
    rows = [(i, t, "en", ["a", "a", "b", None, "unknown"][i % 5]) for i, t in enumerate(texts)] + [(r[0], r[1], "en", "a") for r in AWKWARD] + [(4, texts[4], "en", "unknown")]
    docs = frame(spark, rows)
    got = source_mixing.mix(docs, {"a": 3, "b": 2}, 1, 500).collect()
    assert len(got) == len(rows)
    first = {r.doc_id: r for r in got}
    share = {"a": (3, 6), "b": (2, 6)}
    for name in ("a", "b"):
        before = 0
        for doc_id, text in sorted((r[0], r[1] or "") for r in rows if r[3] == name and r[0] is not None):
            r = first[doc_id]
            start = before + (len(AWKWARD[4][1]) if name == "a" else 0)  # the row without an id comes first
            assert (r.at, r.block) == (start, start // 500)
            assert r.release == start // 500 * 6 // share[name][0] and r.release <= r.slot < r.deadline
            before += len(text)
    ordered = written(source_mixing.mixed_rows(docs, {"a": 3, "b": 2}, 1, 500))
    seen = [(r.doc_id, r.file_name, r.row_index) for r in ordered.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    want = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.at, r.doc_id is not None, r.doc_id or 0))]
    place = {d: i for i, d in enumerate(want)}
    assert len(seen) == len(rows) and [place[d] for d, _, _ in seen] == sorted(place[d] for d, _, _ in seen)
    assert source_mixing.mix(docs.where("doc_id < 0"), {"a": 1}).count() == 0
    with pytest.raises(ValueError):
        source_mixing.mix(docs, {"a": 0})


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_stretches_encode_like_whole_texts():
    rng, whole = random.Random(5), tokenizer()
    pieces = ["a", "word", " ", "  ", "\n", "\t", "'s", "é", "\xa0", "\x1c", "1", "!", ".", ",", "<|endoftext|>", "日", " ", "\r\n", "'LL", "\x85", "_"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(3000)] + [t or "" for _, t in AWKWARD]
    encoder = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text, ids in zip(texts, encoder.encode(texts, 2)):
        assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_token_files_round_trip(spark):
    rows = [(i * 7 % 101, t) for i, t in enumerate(sentences(6, 101, 30))] + [*AWKWARD, (5, "a second row of five")]
    docs, target, whole = frame(spark, rows), shared_folder(spark), tokenizer()
    index = written(token_store.write_tokens(docs, target, public_tokenizers.path("byte_bpe_50k.json"), frame_tokens=500, files=4))
    read = token_store.read_tokens(index, target, "n_tokens long, ids array<long>", lambda d, x: (len(x), x.tolist()))
    want = sorted((d, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows if d is not None)
    assert sorted((r.doc_id, r.ids) for r in read.collect()) == want
    at = 0
    placed = sorted((r.start, r.doc_id, r.n_tokens) for r in token_store.starts(written(read.drop("ids"))).collect())
    for start, _, size in placed:
        assert start == at
        at += size
    assert [d for _, d, _ in placed] == sorted(d for d, _ in want)
    few = token_store.read_tokens(index.where("doc_id IN (3, 906)"), target, "n_tokens long", lambda d, x: (len(x),))
    assert sorted(r.doc_id for r in few.collect()) == [3, 906]
    assert token_store.write_tokens(docs.where("doc_id < 0"), shared_folder(spark), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_any_reader_decodes_the_frames_and_damage_is_noticed(tmp_path):
    path = tmp_path / "x.zst"
    writer = token_store.FrameWriter(path.open("wb"))
    frames = [token_store.pack_frame([1, 2], [np.arange(5, dtype="<u4"), np.arange(0, dtype="<u4")]), token_store.pack_frame([3], [np.arange(9, dtype="<u4")])]
    for raw in frames:
        writer.write(raw)
    writer.close()
    assert zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read() == b"".join(frames)
    from pyarrow import fs

    reader = token_store.FrameReader(fs.LocalFileSystem().open_input_file(str(path)))
    assert len(reader) == 2 and [d for d, _ in token_store.unpack_frame(reader.frame(1))] == [3]
    data = bytearray(path.read_bytes())
    data[-12] ^= 1  # the checksum of the last frame
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError):
        token_store.FrameReader(fs.LocalFileSystem().open_input_file(str(path))).frame(1)


def test_pipeline_stages(spark, tmp_path):
    items = sentences(20, 3, 30, 3000)
    clean = ["\n".join(sentences(30 + i, 3, 25, 3000)) for i in range(40)]
    rows = [(i, t, "en", f"src{i % 7}") for i, t in enumerate(clean)]
    rows += [(100, clean[3], "en", "src1"), (101, clean[4] + " and one more.", "de", None), (102, "too short.", "en", "src2"), (103, clean[5] + "\n" + items[1], "en", "src3"), (104, None, None, None), (None, clean[39] + " " + clean[38], "en", "src1")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, str(tmp_path)))
        if name != "token_files":
            assert out.columns == docs.columns
        kept.append({r.doc_id for r in out.collect()})
        docs = out
    every = {r[0] for r in rows}
    assert kept[0] == every - {102, 104} and kept[1] == kept[0] - {100, 101} and kept[2] == kept[1] - {103} and kept[3] == kept[2]
    assert kept[4] == kept[3] - {None} and corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])


def test_stages_keep_columns_of_any_name(spark):
    from pyspark.sql import functions as F
    from strandframe.llm import decontamination

    items = sentences(20, 2, 30, 3000)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(sentences(31, 12, 40, 3000))] + [(50, items[1], "en", "s1"), (None, "no id", "en", None), (51, None, None, None)]
    docs = frame(spark, rows)
    for name in ("found_id", "found_row", "mix_id", "mix_row", "mix_place", "whole_row"):
        docs = docs.withColumn(name, F.lit(7))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] != 50)
    mixed = source_mixing.mixed_rows(docs, {"s0": 2, "s1": 1}, 1, 300)
    assert mixed.columns == docs.columns and sorted(str(r.doc_id) for r in mixed.collect()) == sorted(str(r[0]) for r in rows)


def test_new_words_are_asked_of_the_model():
    """op9: words not seen before took most of the time, in the tokenizer's own cutting of lines."""
    import public_tokenizers

    encoder = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole = encoder.tokenizer

    class Without:
        encode = whole.encode

    encoder.tokenizer = Without()
    texts = ["Zuzuch haingatwh, ciónboquerr.\nÈoué ÿß", "é" * 40 + " " + "x" * 33 + "!?"]
    assert [x.tolist() for x in encoder.encode(texts, 2)] == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]

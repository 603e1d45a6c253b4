"""Token files: independent zstandard frames, a checksum per frame and a seek table at the end.

A file is a sequence of zstandard frames followed by a skippable frame that any zstandard reader passes over. That last frame
holds one entry per data frame and a fixed footer, so a reader fetches the end of the file first and then only the frames
that hold the documents it wants. A frame holds whole documents: a header (count), per document its id and number of token
ids, then all token ids, everything little-endian.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .text import pieces

# Fixed values of the seekable zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

# Stretches of white space and what follows it; U+001C to U+001F are no white space for the tokenizer. ``_PLAIN`` does for
# texts without other white space than single blanks and line ends.
_STRETCH = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_PLAIN = re.compile(r" ?[^ \n]+|\n")
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Letters that are letters in every version of Unicode, and marks that are a piece of their own behind them
_WORD = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:]*)")
# How byte-level models write bytes: visible characters of Latin-1 as they are, others in order from U+0100 on
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in _VISIBLE)}
_BLANK = _BYTE_LETTERS[0x20]
_CACHED = 700_000
#: text that goes to one file, and so to one task
FILE_BYTES = 32 << 20


def _plain(text: str) -> bool:
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] in (" ", "\n") or _OTHER_SPACE.search(text))


class Encoder:
    """Byte-level BPE ids of whole texts, with a bounded cache of the ids of stretches between blanks.

    The tokenizer cuts a text before white space that follows another character, and between a letter or digit and a mark
    like a full stop, so stretches can be encoded apart. New words go to the tokenizer's model, which takes half the time; other
    new stretches are encoded together, one to a line.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.model, cutter = self.tokenizer.model, self.tokenizer.pre_tokenizer
        rule = json.loads(cutter.__getstate__()) if cutter is not None else {}
        bytewise = rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space")
        added = any(_WORD.fullmatch(x.content) for x in self.tokenizer.get_added_tokens_decoder().values())
        self.by_model = bool(bytewise) and self.tokenizer.normalizer is None and not added
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(65)]
        self.line_end = np.frombuffer(self._ids("\n"), dtype="<u4")

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of letters behind at most one blank: the tokenizer takes them as one piece, so only its model is asked."""
        if len(word) > 32 or not self.by_model:
            return self._ids(word)
        found = self.model.tokenize(word.replace(" ", _BLANK) if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS))
        return self.pack[len(found)](*[x.id for x in found])

    def _learn(self, new: set[str]) -> None:
        cache, wanted = self.cache, []
        for x in new:
            parts = _WORD.fullmatch(x)
            if parts is None:
                wanted.append(x)
                continue
            body, marks = parts.groups()
            ids = cache.get(body)
            if ids is None:
                ids = cache[body] = self._word(body)
            if marks:
                tail = cache.get(marks)
                if tail is None:
                    tail = cache[marks] = self._ids(marks)
                ids = cache[x] = ids + tail
        lined = [x for x in wanted if "\n" not in x and (x[0] == " " or not x[0].isspace()) and not x[1:2].isspace() and not x[-1].isspace()]
        if lined and len(self.line_end) == 1:
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(lined)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = 4 * np.flatnonzero(ids == self.line_end[0])
            raw = ids.tobytes()
            if len(cuts) == len(lined) - 1:
                cache.update((x, raw[i:j]) for x, i, j in zip(lined, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]))
        for x in wanted:
            if x not in cache:
                cache[x] = self._ids(x)

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        stretches = [(_PLAIN if _plain(t) else _STRETCH).findall(t) for t in texts]
        if len(self.cache) > _CACHED:
            self.cache.clear()
        # the stretches of some texts are looked up once each; a small table then serves the texts
        held = set().union(*stretches)
        self._learn(held.difference(self.cache))
        last, get = np.array([end], dtype="<u4").tobytes(), dict(zip(held, map(self.cache.__getitem__, held))).__getitem__
        return [np.frombuffer(b"".join(map(get, doc)) + last, dtype="<u4") for doc in stretches]


def pack_frame(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    head = np.array([len(doc_ids)], dtype="<u4").tobytes() + np.array(doc_ids, dtype="<i8").tobytes()
    return head + np.array([len(x) for x in ids], dtype="<u8").tobytes() + b"".join(x.tobytes() for x in ids)


def unpack_frame(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    doc_ids = np.frombuffer(raw, "<i8", n, 4)
    sizes = np.frombuffer(raw, "<u8", n, 4 + 8 * n)
    at = 4 + 16 * n
    for doc_id, size in zip(doc_ids.tolist(), sizes.tolist()):
        yield doc_id, np.frombuffer(raw, "<u4", size, at)
        at += 4 * size


class FrameWriter:
    """Writes frames to an open file and the seek table on ``close``."""

    def __init__(self, out, level: int = 3):
        self.out, self.level, self.entries = out, level, []

    def write(self, raw: bytes) -> None:
        import xxhash

        # a frame states its size and carries zstandard's own checksum; the table has one too, to check before decoding further
        packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True, write_content_size=True).compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class FrameReader:
    """Reads single frames of a file with random access; every frame's checksum is verified."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        source.seek(size - 9 - 12 * count)
        table = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3)
        self.sizes, self.checksums = table[:, :2].astype(np.int64), table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])

    def __len__(self) -> int:
        return len(self.checksums)

    def frame(self, k: int) -> bytes:
        import xxhash

        self.source.seek(int(self.starts[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.sizes[k, 0])), max_output_size=int(self.sizes[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.checksums[k]):
            raise ValueError(f"frame {k} fails its checksum")
        return raw


def _filesystem(folder: str):
    return pafs.FileSystem.from_uri(folder)


WRITTEN = "file string, frame int, place int, doc_id long, n_tokens long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 2, frame_tokens: int = 1 << 18, files: int | None = None, order: Column | None = None) -> DataFrame:
    """Write the token ids of all texts below ``folder``; returns the index: one row per document with its file and frame.

    Documents are ordered by ``order`` (``doc_id`` unless given) over the files, whose names sort in that order, and inside
    them. Each document is its ids followed by ``end``; a null text is an empty one. Rows without ``doc_id`` cannot be
    addressed and are left out; repeated rows are written as often as they come. A frame takes documents until it holds
    ``frame_tokens`` ids, a longer document has a frame of its own, and only one frame is in memory.

    ``folder`` is any URI that pyarrow's file systems open. A file is written under a name of its own attempt and renamed when
    whole, so a task that is run again, or twice at a time, leaves one whole file.
    """
    ordered = docs.select((F.col("doc_id") if order is None else order).alias("_order"), F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    n = files or pieces(docs, FILE_BYTES)
    parts = ordered.repartitionByRange(n, "_order", "doc_id").sortWithinPartitions("_order", "doc_id", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        filesystem, base = _filesystem(folder)
        part = TaskContext.get().partitionId()
        name, attempt = f"{base}/tokens-{part:06d}.zst", f"{base}/.attempt-{part:06d}-{uuid.uuid4().hex}"
        encoder, writer = Encoder(tokenizer), None
        held_ids: list[int] = []
        held: list[np.ndarray] = []
        index: list[tuple[int, int, int, int]] = []

        def flush() -> None:
            if held_ids:
                index.extend((len(writer.entries), i, d, len(x)) for i, (d, x) in enumerate(zip(held_ids, held)))
                writer.write(pack_frame(held_ids, held))
                held_ids.clear()
                held.clear()

        def rows() -> pa.RecordBatch:
            frames, places, doc_ids, sizes = map(list, zip(*index)) if index else ([], [], [], [])
            index.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([name[len(base) + 1 :]] * len(frames), pa.string()), pa.array(frames, pa.int32()), pa.array(places, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64())],
                names=["file", "frame", "place", "doc_id", "n_tokens"],
            )

        size = 0
        for batch in batches:
            if writer is None and batch.num_rows:
                filesystem.create_dir(base, recursive=True)
                writer = FrameWriter(filesystem.open_output_stream(attempt))
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist(), end)):
                    if size and size + len(ids) > frame_tokens:
                        flush()
                        size = 0
                    held_ids.append(doc_id)
                    held.append(ids)
                    size += len(ids)
            yield rows()
        if writer is not None:
            flush()
            writer.close()
            filesystem.move(attempt, name)
            yield rows()

    return parts.mapInArrow(write, WRITTEN)


def read_tokens(index: DataFrame, folder: str, columns: str, each: Callable[[int, np.ndarray], tuple]) -> DataFrame:
    """``each(doc_id, ids)`` for the documents of ``index``: a tuple of ``columns`` after file, frame, place and doc_id.

    Only frames named in ``index`` are fetched and decompressed, one at a time; filter ``index`` to read few documents. Pass a
    materialised ``index`` (a written table), so that reading does not start the writing again. Each file is a task of its own.
    """
    # a frame and the ids wanted of it: bounded by what a frame holds
    wanted = index.groupBy("file", "frame").agg(F.collect_set("doc_id").alias("ids"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = _filesystem(folder)
        name, reader = None, None
        for batch in batches:
            for file, frame, ids in zip(batch["file"], batch["frame"], batch["ids"]):
                if file != name:
                    name, reader = file, FrameReader(filesystem.open_input_file(f"{base}/{file}"))
                keep = set(ids.tolist())
                rows = [(file, frame, i, d, *each(d, x)) for i, (d, x) in enumerate(unpack_frame(reader.frame(frame))) if d in keep]
                yield pd.DataFrame(rows, columns=["file", "frame", "place", "doc_id", *[c.split()[0] for c in columns.split(",")]])

    # a task for each file: rows of the index are few bytes, so a number that is left open would be lowered to one task
    files = max(1, index.agg(F.count_distinct("file")).first()[0])
    return wanted.repartitionByRange(files, "file").sortWithinPartitions("file", "frame").mapInPandas(read, f"file string, frame int, place int, doc_id long, {columns}")


def starts(sizes: DataFrame) -> DataFrame:
    """Add ``start``, the token ids of all documents before, to rows of (file, frame, doc_id, n_tokens) by running sums per file.

    Files are ordered by name; what they hold is summed first, and only those sums (one row per file) are scanned as a whole.
    """
    per_file = sizes.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    carry = per_file.select("file", (F.sum("held").over(W.orderBy("file")) - F.col("held")).alias("carry"))
    before = W.partitionBy("file").orderBy("frame", "place").rowsBetween(W.unboundedPreceding, -1)
    return sizes.join(carry, "file").withColumn("start", (F.col("carry") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).cast("long")).drop("carry")


def size_and_crc(_: int, ids: np.ndarray) -> tuple[int, int]:
    return len(ids), zlib.crc32(ids.tobytes())

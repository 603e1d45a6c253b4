"""SentencePiece encoding and decoding with merge-type vocabularies, checked against the sentencepiece library.

A text starts as single characters. An agenda holds the adjacent pairs of symbols that make a piece of the vocabulary, the best
score first and the leftmost of equal scores; the top pair becomes one symbol and its new neighbours enter the agenda. Pairs
that an earlier merge has taken apart are found out when they come up. What is no piece in the end is written as UTF-8 bytes
where the vocabulary has them, else as the unknown id.

Long stretches have a heap for their agenda. Those of short ones lie side by side in arrays, and each round takes the top pair
of every stretch at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SPACE = "▁"
#: stretches that are remembered: of so many characters at most, so many entries, hence a bounded share of a worker's memory
_CACHED_CHARS, _CACHED = 48, 400_000
#: texts of so many bytes, or one longer text, are worked on at a time
_STEP_BYTES = 1 << 20
_UNKNOWN_TEXT = " ⁇ "
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Pieces, scores and normalisation of a merge-type model file, with ``encode`` and ``decode`` of whole texts."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece.Type
        of = {kind: [i for i, p in enumerate(model.pieces) if p.type == kind] for kind in kinds.values()}
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or of[kinds.Value("USER_DEFINED")] or of[kinds.Value("UNUSED")]:
            raise ValueError("only merge-type vocabularies without user-defined and unused pieces")
        spec = model.normalizer_spec
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.prefix, self.strips = spec.add_dummy_prefix, spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self.strips_all = spec.remove_extra_whitespaces
        self.ids = {model.pieces[i].piece: i for i in of[kinds.Value("NORMAL")]}
        scores = sorted({model.pieces[i].score for i in self.ids.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.ranks = {p: place[model.pieces[i].score] << 32 for p, i in self.ids.items() if len(p) > 1}
        self.unknown, self.begin, self.end = self.library.unk_id(), self.library.bos_id(), self.library.eos_id()
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if of[kinds.Value("BYTE")] else None
        self.silent = set(of[kinds.Value("CONTROL")])
        self.shown = [p.piece.replace(SPACE, " ") for p in model.pieces]
        self.shown[self.unknown] = model.trainer_spec.unk_surface or _UNKNOWN_TEXT
        for i in self.silent:
            self.shown[i] = ""
        self.value = {i: bytes([b]) for b, i in enumerate(self.bytes)} if self.bytes else {}
        # A text can be cut where no piece reaches over: around ASCII characters that no longer piece holds and, if no piece has a
        # space after another character, before spaces.
        inside = set("".join(self.ranks))
        alone = re.escape("".join(chr(i) for i in range(128) if chr(i) not in inside))
        crosses = any(SPACE in p.lstrip(SPACE) for p in self.ranks)
        self.stretches = re.compile(f"[{alone}]|[^{alone}]+" if crosses else f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+").findall
        self.known: dict[str, bytes] = {}
        self._tables()

    def _tables(self) -> None:
        """Numbers for all symbols that merges can meet, and the rank and result of each pair that makes a piece."""
        names = sorted(set("".join(self.ids))) + sorted(self.ranks)
        number = {s: k for k, s in enumerate(names, 1)}  # 0: a character of no piece
        self.of_char = np.zeros(0x110000, np.int32)
        for s, k in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k
        pairs = sorted((number[p[:c]] * (len(names) + 1) + number[p[c:]], r >> 32, number[p]) for p, r in self.ranks.items() for c in range(1, len(p)) if p[:c] in number and p[c:] in number)
        columns = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        self.pairs, self.pair_rank, self.pair_makes = columns[0].copy(), columns[1].astype(np.int32), columns[2].astype(np.int32)
        self.base, self.piece_of = len(names) + 1, np.array([-1] + [self.ids.get(s, -1) for s in names], dtype=np.int64)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; ``_NONE`` where it makes no piece."""
        keys = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        there = self.pairs[at] == keys
        return np.where(there, self.pair_rank[at], _NONE), self.pair_makes[at]

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of short stretches, whose agendas are worked off together."""
        sizes = np.array([len(s) for s in new])
        text = "".join(new)
        symbol = self.of_char[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
        owner, start = np.repeat(np.arange(len(new)), sizes), np.arange(len(text))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        same = np.append(owner[1:] == owner[:-1], False)
        rank, makes = self._ranked(symbol, np.append(symbol[1:], 0))
        rank = np.where(same, rank, _NONE)
        while len(symbol):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, first)
            width = np.diff(np.append(first, len(owner)))
            ended = np.repeat(best == _NONE, width)
            if ended.any():
                done.append((owner[ended], start[ended], symbol[ended]))
                symbol, owner, start, rank, makes = (x[~ended] for x in (symbol, owner, start, rank, makes))
                best, width = best[best != _NONE], width[best != _NONE]
                if not len(symbol):
                    break
            top = np.flatnonzero(rank == np.repeat(best, width))
            top = top[np.append(True, owner[top][1:] != owner[top][:-1])]  # the leftmost of each stretch
            symbol[top] = makes[top]
            stay = np.ones(len(symbol), bool)
            stay[top + 1] = False
            symbol, owner, start, rank, makes = (x[stay] for x in (symbol, owner, start, rank, makes))
            at = top - np.arange(len(top))
            last = np.append(owner[1:] != owner[:-1], True)
            for changed in (at, at[at > 0] - 1):
                r, m = self._ranked(symbol[changed], symbol[np.minimum(changed + 1, len(symbol) - 1)])
                rank[changed], makes[changed] = np.where(last[changed], _NONE, r), m
        owner, start, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(start)
        owner, start, symbol = owner[order], start[order], symbol[order]
        ids = self.piece_of[symbol]
        raw, ends = ids.astype("<u4").tobytes(), 4 * np.searchsorted(owner, np.arange(len(new) + 1))
        packed = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for k in np.unique(owner[ids < 0]).tolist():
            symbols = np.arange(ends[k] // 4, ends[k + 1] // 4)
            cuts = [*start[symbols].tolist(), int(start[symbols[0]]) + len(new[k])]
            packed[k] = self._ids_of([text[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
        self.known.update(zip(new, packed))

    def merged(self, text: str) -> list[str]:
        """The symbols that the agenda leaves of ``text``."""
        rank, n = self.ranks.get, len(text)
        symbols: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [r + i for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            top = heappop(agenda)
            i = top & 0xFFFFFFFF
            left, j = symbols[i], after[i]
            if left is None or j == n:
                continue
            both = left + symbols[j]
            if rank(both) != top - i:
                continue
            symbols[i], symbols[j] = both, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(both + symbols[k])) is not None:
                    heappush(agenda, r + i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] + both)) is not None:
                heappush(agenda, r + h)
        return [s for s in symbols if s is not None]

    def _ids_of(self, symbols: list[str]) -> bytes:
        ids: list[int] = []
        for symbol in symbols:
            if (i := self.ids.get(symbol)) is not None:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in symbol.encode()]
            else:
                ids.append(self.unknown)
        return np.array(ids, dtype="<u4").tobytes()

    def normalized(self, text: str) -> str:
        """``text`` as the vocabulary sees it: spaces as their mark, one mark before the first character."""
        if not self.plain:
            return self.library.normalize(text)
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text between the begin and the end id."""
        cut = [self.stretches(self.normalized(t)) for t in texts]
        every = set().union(*cut)
        known = self.known
        fresh = every.difference(known)
        if len(known) + len(fresh) > _CACHED:
            known.clear()
            fresh = every
        long = [s for s in fresh if len(s) > _CACHED_CHARS]
        if len(long) < len(fresh):
            self._learn(list(fresh.difference(long)))
        for s in long:
            known[s] = self._ids_of(self.merged(s))
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (self.begin, self.end))
        out = [np.frombuffer(begin + b"".join(map(known.__getitem__, stretches)) + end, dtype="<u4") for stretches in cut]
        for s in long:  # only short stretches are remembered
            del known[s]
        if not self.bytes:  # neighbouring unknown symbols are one
            out = [x[~((x == self.unknown) & np.append(False, x[:-1] == self.unknown))] for x in out]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: byte ids as UTF-8, each byte that is none as U+FFFD, without the mark before the first character."""
        shown, value = self.shown, self.value
        first = next((i for i in ids if i in value or shown[i]), None)
        if value.keys().isdisjoint(ids):
            text = "".join([shown[i] for i in ids])
        else:
            parts, run = [], bytearray()
            for i in ids:
                if i in value:
                    run += value[i]
                else:
                    if run:
                        parts.append(_utf8(run))
                        run = bytearray()
                    parts.append(shown[i])
            text = "".join(parts) + _utf8(run)
        if not self.strips or first is None or first in value or first == self.unknown or not shown[first].startswith(" "):
            return text
        return text.lstrip(" ") if self.strips_all else text[1:]


def _utf8(run: bytes) -> str:
    """UTF-8 text of ``run``; a byte that starts no whole character counts as one U+FFFD."""
    out, at = [], 0
    while at < len(run):
        try:
            out.append(bytes(run[at:]).decode())
            break
        except UnicodeDecodeError as e:
            out.append(bytes(run[at : at + e.start]).decode() + "�")
            at += e.start + 1
    return "".join(out)


def _steps(doc_ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, list[str]]]:
    """Neighbouring texts of up to ``_STEP_BYTES`` together, a longer one by itself."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at = 0
    while at < len(texts):
        end, held = at + 1, sizes[at]
        while end < len(texts) and held + sizes[end] <= _STEP_BYTES:
            held += sizes[end]
            end += 1
        yield doc_ids.slice(at, end - at), [t or "" for t in texts.slice(at, end - at).to_pylist()]
        at = end


def whole(ids: np.ndarray, text: str) -> tuple:
    return ids.tolist(), text


def digest(ids: np.ndarray, text: str) -> tuple[int, str, str]:
    """Number of ids, and SHA-256 of the ids as little-endian 32-bit integers and of the decoded text in UTF-8."""
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def encode_pieces(docs: DataFrame, model: str, columns: str = "ids array<long>, decoded string", each: Callable[[np.ndarray, str], tuple] = whole, check: bool = True) -> DataFrame:
    """``doc_id`` and ``columns`` for every row of ``docs``: what ``each`` makes of the ids of its whole text and of the text decoded from them.

    ``model`` is the path of a merge-type model file that every executor can read. Begin and end id are included. Null texts are
    empty and become the two ids alone; texts of any length, blanks and characters outside the vocabulary are taken as they are.
    Rows without ``doc_id`` and repeated rows are encoded as they come, an empty table gives none; other columns are not looked
    at. With ``check`` the library encodes and decodes each batch as well, and a difference in any text ends the job, naming its
    ``doc_id``.

    Work: no exchange; a task holds about a megabyte of text at a time, or one longer text, and the remembered stretches are
    bounded in number and length.
    """
    schema = T._parse_datatype_string(f"doc_id long, {columns}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = to_arrow_schema(schema).types, schema.names
        vocabulary = Vocabulary(model)
        library = vocabulary.library
        for batch in batches:
            for doc_ids, texts in _steps(batch.column(0), batch.column(1)):
                ids = vocabulary.encode(texts)
                lists = [x.tolist() for x in ids]
                decoded = [vocabulary.decode(x) for x in lists]
                if check:
                    theirs = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
                    if theirs != lists or library.decode(lists, num_threads=1) != decoded:
                        bad = next(i for i, x in enumerate(lists) if x != theirs[i] or library.decode(x) != decoded[i])
                        raise ValueError(f"ids or text of doc_id {doc_ids[bad].as_py()} differ from the library's")
                made = zip(*(each(x, t) for x, t in zip(ids, decoded)))
                yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(x, k) for x, k in zip(made, kinds[1:]))], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)

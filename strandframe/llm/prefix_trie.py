"""Trie of conversation prefixes, by fingerprints that compose.

A sequence of turns t_1 .. t_n has the fingerprint sum of t_i * B^(i - 1) modulo a prime. Sequences form a monoid under
joining, and fingerprints follow it: F(xy) = F(x) + B^|x| F(y), and a suffix is F(y) = B^-|x| (F(xy) - F(x)). So the fingerprint
of every prefix of a rebuilt conversation comes from prefix sums of the base conversation and of its own, and the texts of
rebuilt conversations are never put together. Stored turns are referred to by conversation and position.

Fingerprints only propose groups. Groups are accepted once all turns with the same hash are found to hold the same role and
text, and all members of each prefix group to end in the same turn: then the rest of the prefix has one fingerprint too, and by
induction the prefixes are equal. If a check fails, everything is done again with other hashes and other bases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .text import written

#: a prime under 2^31, so that products stay within 64 bits, and its primitive root, of which bases are powers
PRIME, ROOT = 2_147_483_647, 7
LANES = ("f1", "f2", "f3")
#: turn numbers of one tile: a conversation of any length is many tasks
TILE = 1 << 10
#: conversation ids in one piece of a list
_PIECE = 4096
HEADS = 6
_KEY = ["depth", *LANES]


def _bases(attempt: int) -> list[int]:
    return [pow(ROOT, int.from_bytes(hashlib.sha256(f"{attempt}:{lane}".encode()).digest()[:8], "big"), PRIME) for lane in LANES]


def _times(a: Column, b: Column | int) -> Column:
    return a * b % PRIME


def _power(base: int, exponent: Column) -> Column:
    """``base`` to a whole exponent under 2^40, bit by bit."""
    out = F.lit(1).cast("long")
    for bit in range(40):
        out = _times(out, F.when(F.getbit(exponent, F.lit(bit)) == 1, F.lit(pow(base, 1 << bit, PRIME))).otherwise(F.lit(1)))
    return out


def _hashed(conversations: DataFrame, attempt: int) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.select("*", *[F.xxhash64(F.lit(2 * attempt + i), "role", "text").alias(h) for i, h in enumerate(("h1", "h2"))])


def positioned(turns: DataFrame, bases: list[int]) -> DataFrame:
    """``conv_id, pos, h1, h2, chars`` and, over the turns up to this one, ``f1, f2, f3`` and ``sum_chars``; ``pos`` counts from 1.

    Turns are ordered by number, null first, and by hash where numbers repeat. Tiles are summed up alone and composed along the
    conversation; only tiles after the first look up what is before them.
    """
    tile = F.coalesce(F.floor(F.col("turn") / TILE), F.lit(-(2**62))).alias("tile")
    symbols = [(F.pmod(F.shiftright(F.col(h), s), F.lit(PRIME - 1)) + 1) for h, s in (("h1", 0), ("h2", 0), ("h1", 17))]
    rows = turns.select("conv_id", "turn", "h1", "h2", F.char_length("text").cast("long").alias("chars"), tile)
    inside = W.partitionBy("conv_id", "tile").orderBy(F.asc_nulls_first("turn"), "h1", "h2").rowsBetween(W.unboundedPreceding, 0)
    numbered = rows.withColumn("at", F.count(F.lit(1)).over(inside))
    terms = numbered.select("*", *[_times(s, _power(b, F.col("at") - 1)).alias(f"t_{f}") for f, b, s in zip(LANES, bases, symbols)])
    local = terms.select(
        "conv_id", "tile", "at", "h1", "h2", "chars", *[(F.sum(f"t_{f}").over(inside) % PRIME).alias(f"l_{f}") for f in LANES], F.sum("chars").over(inside).alias("l_chars")
    )
    tiles = local.groupBy("conv_id", "tile").agg(F.max("at").alias("n"), *[F.max_by(f"l_{f}", "at").alias(f"s_{f}") for f in LANES], F.max("l_chars").alias("s_chars"))
    before = W.partitionBy("conv_id").orderBy("tile").rowsBetween(W.unboundedPreceding, -1)
    counted = tiles.withColumn("c_at", F.sum("n").over(before))
    moved = counted.select("conv_id", "tile", "c_at", "s_chars", *[_times(F.col(f"s_{f}"), _power(b, F.coalesce("c_at", F.lit(0)))).alias(f"m_{f}") for f, b in zip(LANES, bases)])
    carry = moved.select(
        "conv_id", "tile", "c_at", F.sum("s_chars").over(before).alias("c_chars"), *[(F.sum(f"m_{f}").over(before) % PRIME).alias(f"c_{f}") for f in LANES]
    ).where("c_at IS NOT NULL")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return local.join(carry, ["conv_id", "tile"], "left").select(
        "conv_id",
        (zero("c_at") + F.col("at")).alias("pos"),
        "h1", "h2", "chars",
        *[((zero(f"c_{f}") + _times(F.col(f"l_{f}"), _power(b, zero("c_at")))) % PRIME).alias(f) for f, b in zip(LANES, bases)],
        (zero("c_chars") + F.col("l_chars")).alias("sum_chars"),
    )


def rebuilt_prefixes(own: DataFrame, bases: list[int]) -> DataFrame:
    """One row per rebuilt conversation and depth, the root included, with the fingerprint of the prefix and a reference to its last turn.

    ``conv_id, depth, f1, f2, f3, chars, sum_chars, length, h1, h2, turn_conv, turn_pos``. Conversation c takes the first h turns of
    the one at c - pmod(c, 100), or all if there are fewer, and its own after its first h; h = crc32(c) mod 6.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    head = F.struct("pos", "h1", "h2", "chars", *LANES, "sum_chars")
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") < HEADS, head))).alias("first"))
    convs = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(100)))
    theirs = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("head"))
    joined = convs.join(theirs, "base", "left").withColumn("head", F.filter("head", lambda x: x.pos <= F.col("h")))
    joined = joined.withColumn("k", F.coalesce(F.size("head"), F.lit(0)).cast("long")).withColumn("length", F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    last = F.try_element_at("head", F.col("k").cast("int"))
    skipped = F.try_element_at("first", F.greatest(F.lit(1), F.least(F.col("h"), F.col("n"))).cast("int"))
    zero = F.lit(0).cast("long")
    value = lambda s, c, there: F.when(there, s[c]).otherwise(zero)
    plan = joined.select(
        "conv_id", "base", "h", "k", "length", "head",
        *[value(last, f, F.col("k") > 0).alias(f"a_{f}") for f in LANES], value(last, "sum_chars", F.col("k") > 0).alias("a_chars"),
        *[value(skipped, f, F.col("h") > 0).alias(f"b_{f}") for f in LANES], value(skipped, "sum_chars", F.col("h") > 0).alias("b_chars"),
    )
    columns = ["conv_id", "depth", *LANES, "chars", "sum_chars", "length", "h1", "h2", "turn_conv", "turn_pos"]
    roots = plan.select("conv_id", zero.alias("depth"), *[zero.alias(f) for f in LANES], zero.alias("chars"), zero.alias("sum_chars"), "length", zero.alias("h1"), zero.alias("h2"), F.lit(None).cast("long").alias("turn_conv"), F.lit(None).cast("long").alias("turn_pos"))
    heads = plan.select("conv_id", "base", "length", F.inline("head")).select("conv_id", F.col("pos").alias("depth"), *LANES, "chars", "sum_chars", "length", "h1", "h2", F.col("base").alias("turn_conv"), F.col("pos").alias("turn_pos"))
    # B^(k - h) takes the place of the h turns left out before the suffix by the k turns put in
    moves = [F.array(*[F.lit(pow(pow(b, -1, PRIME), i, PRIME)) for i in range(HEADS)]) for b in bases]
    shift = lambda i: moves[i][(F.col("h") - F.col("k")).cast("int")]
    own_part = own.join(plan.drop("head", "base"), "conv_id").where("pos > h")
    suffixes = own_part.select(
        "conv_id",
        (F.col("pos") - F.col("h") + F.col("k")).alias("depth"),
        *[((F.col(f"a_{f}") + _times(F.pmod(F.col(f) - F.col(f"b_{f}"), F.lit(PRIME)), shift(i))) % PRIME).alias(f) for i, f in enumerate(LANES)],
        "chars", (F.col("a_chars") + F.col("sum_chars") - F.col("b_chars")).alias("sum_chars"),
        "length", "h1", "h2", F.col("conv_id").alias("turn_conv"), F.col("pos").alias("turn_pos"),
    )
    return roots.select(columns).unionAll(heads.select(columns)).unionAll(suffixes.select(columns))


def _same_texts(turns: DataFrame) -> bool:
    """Whether all turns that share both hashes hold the same role and text."""
    content = F.struct("role", "text")
    return turns.groupBy("h1", "h2").agg(F.min(content).alias("low"), F.max(content).alias("high")).where("low <> high").isEmpty()


def _ends(paths: DataFrame) -> DataFrame:
    """Per node at which rebuilt conversations end, SHA-256 of their ids in ascending order, joined by commas.

    Ids are sorted over the partitions by node and id, each partition writes them in pieces of bounded length, and a node's few
    pieces are then hashed one after another: nothing holds more than a piece.
    """
    ids = paths.where("depth = length").select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, out = None, [], []

        def full() -> None:
            if held:
                out.append((*node, held[0], ",".join(map(str, held))))
                held.clear()

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 6
            out.clear()
            kinds = [pa.int64()] * 5 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*_KEY, "first", "ids"])

        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node or len(held) == _PIECE:
                    full()
                    node = key
                held.append(conv)
            yield rows()
        full()
        yield rows()

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield hashed(out)
        yield hashed([] if node is None else [(*node, digest.hexdigest())])

    def hashed(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 5, kinds)], names=[*_KEY, "ends_sha256"])

    key = ", ".join(f"{c} long" for c in _KEY)
    in_pieces = ids.mapInArrow(pieces, f"{key}, first long, ids string")
    return in_pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(chained, f"{key}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see ``rebuilt_prefixes``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over the subtree, (members - 1) times the code points of the last text), ``ends_sha256``, and the last
    turn as ``turn_conv, turn_pos``: conversation and position of a stored turn, null for the root. ``conv_id`` and ``depth``
    name a node.

    Turns are ordered by ``turn``, null first; turns of one number by a hash of role and text, so repeated rows are turns of
    their own, side by side. Null roles and texts are empty. Rows without ``conv_id`` belong to no conversation and are left
    out. No conversations give no rows, not even a root. Other columns are not looked at.

    Work: texts are read to be hashed and once to compare those of equal hash; everything else moves hashes and numbers. The
    smallest member of a node owns it, and the nodes that a conversation owns are the lower end of its path, so sums over
    subtrees are sums over the members, whose own contribution depends on the depth where ownership begins: no step goes level by
    level, and a node of any size is added up in the tasks first.
    """
    for attempt in range(16):
        bases = _bases(attempt)
        turns = _hashed(conversations, attempt)
        if not _same_texts(turns):
            continue
        own = written(positioned(turns, bases))
        paths = written(rebuilt_prefixes(own, bases))
        ends_here = F.count_if(F.col("depth") == F.col("length"))
        groups = paths.groupBy(*_KEY).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), ends_here.alias("n_ends"), *[g(x).alias(f"{g.__name__}_{x}") for g in (F.min, F.max) for x in ("h1", "h2")])
        nodes = written(groups)
        if nodes.where("min_h1 <> max_h1 OR min_h2 <> max_h2").isEmpty():
            break
    else:
        raise RuntimeError("no set of hashes tells the turns apart")
    # where a conversation is not the owner: it owns all below the deepest such node, and that node is the parent of its first own
    shared = nodes.where("n_convs > 1").select(*_KEY, "owner", (F.col("n_convs") == F.col("n_ends")).alias("leaf"))
    met = paths.select("conv_id", "length", "sum_chars", *_KEY).join(shared, _KEY, "left")
    other = F.coalesce(F.col("owner") != F.col("conv_id"), F.lit(False))
    last = F.col("depth") == F.col("length")
    convs = met.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(other, F.col("depth"))), F.lit(-1)).alias("lent"),
        F.coalesce(F.max(F.when(other, F.col("sum_chars"))), F.lit(0)).alias("lent_chars"),
        F.max_by("owner", F.when(other, F.col("depth"))).alias("above"),
        F.max(F.when(last & ~other & F.coalesce("leaf", F.lit(True)), 1).otherwise(0)).alias("leaf"),
    )
    part = paths.join(convs, "conv_id")
    before = F.col("sum_chars") - F.col("chars")
    top = F.min_by(F.struct("lent", "above", "turn_conv", "turn_pos"), "conv_id").alias("top")
    summed = part.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if((F.col("length") > F.col("depth")) & (F.col("lent") <= F.col("depth"))).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.lit(0), F.col("lent_chars") - before)).alias("saved_tokens"),
        top,
    )
    parent = F.when(F.col("depth") > 0, F.when(F.col("top.lent") < F.col("depth") - 1, F.col("conv_id")).otherwise(F.col("top.above")))
    return summed.join(_ends(paths), _KEY, "left").select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "top.turn_conv", "top.turn_pos",
    )

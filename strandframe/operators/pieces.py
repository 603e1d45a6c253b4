"""Long sequences as pieces: split, scan and stitch.

A table of pieces has a row for each stretch of ``size`` letters of a sequence: ``piece`` (its number), ``offset`` (0-based place of
its first letter), ``size`` (its own letters), ``seq_len`` (letters of the whole sequence) and ``text``, which goes on for some
letters of the next piece so that what begins in a piece can be read there. Pieces come from ``cut`` or, for files with
sequences of any length, from ``formats.read_fasta_pieces``, where no row ever holds a whole sequence.

Scans work on each piece alone. What goes on beyond a piece is a boundary state (phase of the codons, an open frame, the last
cut), and states are put together along a sequence by tiled running sums, so one sequence is many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.frames import all_frames
from ..session import cut_lineage
from . import ordered

#: letters of a piece: whole codons, and few enough that lists inside a row stay short
SIZE = 6144
#: pieces of one tile of the running sums
_TILE = 4096
_STOP = "TAA|TAG|TGA"
OWN = ("piece", "offset", "size", "seq_len", "text")


def cut(df: DataFrame, seq: str = "seq", ahead: int = 0, size: int = SIZE) -> DataFrame:
    """Pieces of the sequences of ``df``; other columns are kept. An empty sequence has no piece."""
    keep = [c for c in df.columns if c != seq]
    parts = df.select(*keep, F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("_p"), F.length(seq).cast("long").alias("seq_len"))
    rows = F.transform(
        F.col("_p"),
        lambda p, i: F.struct(
            i.cast("long").alias("piece"), (i.cast("long") * size).alias("offset"), F.length(p).alias("size"),
            F.concat(p, F.substring(F.coalesce(F.get(F.col("_p"), i + 1), F.lit("")), 1, ahead)).alias("text"),
        ),
    )
    return parts.select(*keep, "seq_len", F.inline(rows)).select(*keep, *OWN)


def with_ahead(pieces: DataFrame, id: str, ahead: int) -> DataFrame:
    """Let the ``text`` of each piece go on for ``ahead`` letters of the next one, which sends them to it."""
    own = pieces.select(id, "piece", F.struct("offset", "size", "seq_len", "text").alias("_own"), F.lit(None).cast("string").alias("_next"))
    heads = pieces.where("piece > 0").select(id, (F.col("piece") - 1).alias("piece"), F.lit(None).cast(own.schema["_own"].dataType).alias("_own"), F.substring("text", 1, ahead).alias("_next"))
    both = own.unionAll(heads).groupBy(id, "piece").agg(F.any_value("_own", F.lit(True)).alias("o"), F.any_value("_next", F.lit(True)).alias("_next"))
    return both.select(id, "piece", "o.offset", "o.size", "o.seq_len", F.concat("o.text", F.coalesce("_next", F.lit(""))).alias("text"))


# ---- reading frames ----------------------------------------------------------------------------------------------


def _frames(pieces: DataFrame, keep: Sequence[str], reverse: bool) -> DataFrame:
    """Codons that begin in each piece, per strand and phase: ``strand, frame, at, order, codons``.

    ``at`` is the place of the first codon on its strand, and ``order`` numbers the pieces along the strand. A codon of the
    minus strand belongs to the piece of its lowest letter on the forward axis.
    """
    text, starts = F.col("text"), F.least(F.col("size"), F.length("text") - 2)
    back = dna.reverse_complement(text)
    rows = []
    for phase in range(3):
        letters = F.greatest(F.lit(0), F.ceil((starts - phase) / 3)).cast("int") * 3
        strands = [("+", text, F.col("offset"), F.col("piece"))]
        if reverse:
            strands.append(("-", back, F.col("seq_len") - F.col("offset") - F.length("text"), -F.col("piece")))
        for strand, s, first, order in strands:
            at = first + phase
            rows.append(
                F.struct(F.lit(strand).alias("strand"), (F.pmod(at, F.lit(3)) + 1).cast("int").alias("frame"), at.cast("long").alias("at"), order.alias("order"), F.substring(s, F.lit(phase + 1), letters).alias("codons"))
            )
    return pieces.select(*keep, "seq_len", F.inline(F.array(*rows))).where("codons <> ''")


def _leading(codons: Column, unlike: str) -> Column:
    """Letters before the first codon that is one of ``unlike``."""
    return F.length(F.regexp_extract(codons, f"(?s)^(?:(?!{unlike})...)*+", 0))


def _rest(text: Column, letters: Column) -> Column:
    return F.substring(text, letters + 1, F.lit(2147483647))


def orfs(pieces: DataFrame, min_aa: int = 30, reverse: bool = False, id: str = "seq_id") -> DataFrame:
    """Open reading frames ATG..stop of three frames, and of the reverse strand with forward coordinates.

    ``pieces`` go on for 2 letters. ``start`` is 0-based and ``end`` is where the stop codon begins (or the sequence end); on the
    minus strand the same range is given on the forward axis. A frame's tail without a stop is kept once.

    Between the first and the last stop of a piece and frame, frames are found by one expression, which passes over all that is
    too short. What comes before the first stop and after the last one is kept as a part; parts between two stops that follow
    each other, however many pieces apart, are put together by the number of stops before them.
    """
    frames = _frames(pieces, [id], reverse)
    codons, part = F.col("codons"), [id, "strand", "frame"]
    first = frames.withColumn("_first", _leading(codons, _STOP)).withColumn("_open", F.col("_first") == F.length("codons"))
    # letters up to the end of the last stop: codons are taken as long as possible, then given back
    last = F.length(F.regexp_extract(codons, f"(?s)^(?:...)*(?:{_STOP})", 0))
    ended = first.withColumn("_last", F.when(F.col("_open"), F.lit(0)).otherwise(last))

    long = f"ATG(?:(?!{_STOP})...){{{max(0, min_aa - 1)}}}"
    middle = F.substring(codons, F.col("_first") + 4, F.col("_last") - F.col("_first") - 3)
    found = F.regexp_extract_all(middle, F.lit(f"(?s)\\G(?:(?!{long})...)*+ATG(?:(?!{_STOP})...)*+..."), F.lit(0))
    # what is kept of a piece: frames of the wanted length and the two ends, read once here and several times below
    scanned = cut_lineage(
        ended.select(
            *part, "seq_len", "order", "at", "_first", (~F.col("_open")).cast("long").alias("_has"), F.when(~F.col("_open"), found).alias("_m"),
            F.substring(codons, F.lit(1), F.col("_first")).alias("_head"), (F.col("at") + F.col("_last")).alias("_tail_at"), F.when(~F.col("_open"), _rest(codons, F.col("_last"))).alias("_tail"),
        )
    )
    inner = scanned.where("size(_m) > 0").select(*part, "seq_len", (F.col("at") + F.col("_first") + 3).alias("_from"), "_m")
    skips = F.transform("_m", lambda m: F.length(F.regexp_extract(m, f"(?s)^(?:(?!{long})...)*+", 0)))
    placed = inner.withColumn("_skip", skips).select("*", F.posexplode("_m").alias("_i", "_text"))
    before = F.aggregate(F.slice("_m", F.lit(1), F.col("_i")), F.lit(0), lambda a, m: a + F.length(m))
    skip = F.get("_skip", F.col("_i"))
    whole = placed.select(
        *part, "seq_len", (F.col("_from") + before + skip).alias("_start"), F.substring("_text", skip + 1, F.length("_text") - skip - 3).alias("_dna"), F.lit(True).alias("has_stop")
    )

    # parts at the edges of pieces, by the number of pieces with a stop before them
    edges = scanned.drop("_m", "_first")
    counted = ordered.prefix_sums(edges, "order", ["_has"], part, F.floor(F.col("order") / _TILE))
    stop = F.when(F.col("_has") == 1, F.col("at") + F.length("_head"))
    sides = counted.select(
        *part, "seq_len", "order",
        F.explode(F.array_compact(F.array(
            F.struct(F.col("_has_before").alias("run"), F.col("at").alias("at"), F.col("_head").alias("text"), stop.alias("stop")),
            F.when(F.col("_has") == 1, F.struct((F.col("_has_before") + 1).alias("run"), F.col("_tail_at").alias("at"), F.col("_tail").alias("text"), F.lit(None).cast("long").alias("stop"))),
        ))).alias("s"),
    ).select(*part, "seq_len", "order", "s.*")
    skipped = _leading(F.col("text"), "ATG")
    begun = sides.withColumn("atg", F.when(skipped < F.length("text"), F.col("at") + skipped))
    runs = begun.groupBy(*part, "run").agg(
        F.any_value("seq_len").alias("seq_len"), F.min("atg").alias("_start"), F.min("stop").alias("_stop"), F.min("at").alias("_at"), F.collect_list(F.struct("at", "text")).alias("_parts")
    ).where("_start IS NOT NULL")
    letters = (F.coalesce("_stop", F.col("seq_len")) - F.col("_start")).cast("int")
    joined = F.array_join(F.transform(F.array_sort("_parts"), lambda p: p["text"]), "")
    stitched = runs.where(F.floor(letters / 3) >= min_aa).select(
        id, "seq_len", "strand", "frame", "_start", F.substring(joined, (F.col("_start") - F.col("_at")).cast("int") + 1, letters).alias("_dna"), F.col("_stop").isNotNull().alias("has_stop")
    )

    every = whole.unionByName(stitched).withColumn("protein", dna.translate("_dna")).withColumn("length", F.length("protein").cast("long"))
    end = F.when(F.col("has_stop"), F.col("_start") + F.col("length") * 3).otherwise(F.col("seq_len"))
    minus = F.col("strand") == "-"
    return every.where(F.col("length") >= min_aa).select(
        id, "strand", "frame",
        F.when(minus, F.col("seq_len") - end).otherwise(F.col("_start")).cast("long").alias("start"),
        F.when(minus, F.col("seq_len") - F.col("_start")).otherwise(end).cast("long").alias("end"),
        "length", "protein", "has_stop",
    )


def translated(pieces: DataFrame, id: str = "seq_id", reverse: bool = True) -> DataFrame:
    """``id, frame, order, protein``: residues of the codons that begin in each piece, for frames 1 to 3 and -1 to -3.

    ``pieces`` go on for 2 letters. Proteins of a frame in ``order`` are the translation of the whole sequence.
    """
    sign = F.when(F.col("strand") == "-", -F.col("frame")).otherwise(F.col("frame"))
    return _frames(pieces, [id], reverse).select(id, sign.alias("frame"), "order", F.get(all_frames("codons"), F.lit(0)).alias("protein"))


def codons(pieces: DataFrame, keep: Sequence[str] = (), frame: int = 1) -> DataFrame:
    """One row per codon of a reading frame +-1..3; ``pieces`` go on for 2 letters."""
    if frame not in (1, 2, 3, -1, -2, -3):
        raise ValueError("frame must be one of 1, 2, 3, -1, -2, -3")
    frames = _frames(pieces, list(keep), frame < 0)
    mine = frames.where((F.col("frame") == abs(frame)) & (F.col("strand") == ("-" if frame < 0 else "+")))
    return mine.select(*keep, F.explode(F.regexp_extract_all("codons", F.lit("(?s)..."), F.lit(0))).alias("codon"))


# ---- sites and fragments -----------------------------------------------------------------------------------------


def _alternatives(patterns: Sequence[str], depth: int = 4) -> str:
    """One expression for all patterns, branching letter by letter, so that most places are left after a few looks."""
    rests: dict[str, set[str]] = {}
    for p in patterns:
        if not p or not depth:
            return "|".join(sorted(set(patterns)))
        head = re.match(r"\[[A-Z]+\]|.", p).group()
        for letter in head.strip("[]"):
            rests.setdefault(letter, set()).add(p[len(head) :])
    return "|".join(f"{letter}(?:{_alternatives(sorted(rest), depth - 1)})" for letter, rest in sorted(rests.items()))


def places(pieces: DataFrame, patterns: Sequence[str], width: int) -> DataFrame:
    """0-based ``pos`` in the sequence and the ``width`` letters from there, wherever one of the patterns begins.

    ``pieces`` go on for ``width - 1`` letters. A line end is put before each match, also where matches overlap, and the text is
    cut there: an expression to cut by would be compiled anew for every piece.
    """
    keep = [c for c in pieces.columns if c not in OWN]
    cuts = F.split(F.concat(F.lit("^"), F.regexp_replace("text", f"(?={_alternatives(patterns)})", "\n")), "\n", -1)
    hits = pieces.select(*keep, "offset", "size", "text", F.transform(cuts, lambda p: F.length(p)).alias("_l")).where("size(_l) > 1")
    # the list of places grows by one for each match, so it costs copies but no sum over all that is before
    ends = F.aggregate("_l", F.array(F.lit(-1)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    at = hits.select(*keep, "offset", "size", "text", F.explode(F.slice(ends, F.lit(2), F.size("_l") - 1)).alias("_p")).where("_p < size")
    return at.select(*keep, (F.col("offset") + F.col("_p")).alias("pos"), F.substring("text", F.col("_p") + 1, F.lit(width)).alias("word"))


def fragments(cuts: DataFrame, lengths: DataFrame, circular: bool = True, id: str = "seq_id") -> DataFrame:
    """Fragments ``start, end, size`` between distinct cuts (``id, at``); a sequence without a cut is one fragment.

    ``lengths`` has ``id, seq_len`` of every sequence. Each cut looks for the one before it in tiles of positions; the ends of
    a sequence come from its first and last cut.
    """
    distinct = cut_lineage(cuts.select(id, "at").distinct())  # few beside the letters they were found in, and read three times
    inner = ordered.previous_row(distinct, "at", ["at"], [id], ordered.position_tile("at")).where("prev_at IS NOT NULL").select(id, F.col("prev_at").alias("start"), F.col("at").alias("end"))
    ends = lengths.select(id, "seq_len").join(distinct.groupBy(id).agg(F.min("at").alias("_low"), F.max("at").alias("_high")), id, "left")
    none = F.col("_low").isNull()
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    zero, size = F.lit(0), F.col("seq_len")
    if circular:
        outer = F.array(F.when(none, span(zero, size)).otherwise(span(F.col("_high"), F.col("_low"))))
    else:
        outer = F.when(none, F.array(span(zero, size))).otherwise(F.array(span(zero, F.col("_low")), span(F.col("_high"), size)))
    every = ends.select(id, "seq_len", F.inline(outer)).unionByName(inner.withColumn("seq_len", F.lit(None).cast("long")), allowMissingColumns=True)
    if not circular:
        every = every.where("end > start")
    length = F.when(F.col("end") > F.col("start"), F.col("end") - F.col("start")).otherwise(F.col("seq_len") - F.col("start") + F.col("end"))
    return every.select(id, "start", "end", length.alias("size"))

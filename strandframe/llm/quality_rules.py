"""Quality rules: lines are judged first, then the document by what its lines lost."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BLANKS, ascii_lower, let, strip_blanks, words

# Fixed values of the base figures.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Fixed values of the line rules.
CLOSING = r"""[.!?…。！？:;,"'”’»)\]]$"""
NAVIGATION = r"^(home|menu|next|previous|prev|back|login|log in|sign in|sign up|register|search|share|contact( us)?|about( us)?|read more|skip to content|sitemap|subscribe)$"
BOILERPLATE = r"cookie policy|uses? cookies|terms of (use|service)|privacy policy|all rights reserved|enable javascript|lorem ipsum|powered by wordpress"

#: every match of ``BOILERPLATE`` holds one of these
HINTS = ("cookie", "terms of ", "privacy policy", "all rights reserved", "enable javascript", "lorem ipsum", "powered by wordpress")


def _removed(x: Column, characters: str) -> Column:
    for c in characters:
        x = F.replace(x, F.lit(c), F.lit(""))
    return x


def _joined_hashes(hashes: Column, size: int) -> Column:
    """Hashes of runs twice as long as those of ``hashes``, which stand for ``size`` words each."""
    rest = F.slice(hashes, F.lit(size + 1), F.greatest(F.size(hashes) - size, F.lit(0)))
    return F.zip_with(F.slice(hashes, F.lit(1), F.size(rest)), rest, lambda a, b: F.xxhash64(a, b))


def _repeated_words(words_: Column) -> Column:
    """Words inside 8-word windows that are found twice or more in the text, the first find included.

    Window hashes are made by doubling: words, pairs, fours, eights. A repeated window repeats five runs of four words, so
    texts with fewer repeated fours are done early.
    """

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def repeats(p: Column) -> Column:
            same = lambda x, k: F.coalesce(x.g == F.get(p, k - 1).g, F.lit(False)) | F.coalesce(x.g == F.get(p, k + 1).g, F.lit(False))
            return F.sort_array(F.transform(F.filter(p, same), lambda x: x.i))

        def total(starts_: Column) -> Column:
            steps = F.transform(starts_, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts_, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(placed, repeats), total)

    def fours_judged(fours: Column) -> Column:
        few = F.size(fours) - F.size(F.array_distinct(fours)) < WINDOW - 3
        return F.when(few, 0).otherwise(let(_joined_hashes(fours, 4), covered))

    pairs = let(F.transform(words_, lambda w: F.xxhash64(w)), lambda h: _joined_hashes(h, 1))
    return F.when(F.size(words_) <= WINDOW, 0).otherwise(let(let(pairs, lambda h: _joined_hashes(h, 2)), fours_judged))


def _line_fails(line: Column, words_: Column, marked: Column, phrased: Column) -> Column:
    """Navigation bars and menu entries, boilerplate phrases, lines of symbols, and short lines without closing punctuation.

    ``marked`` and ``phrased`` say whether the text holds any symbol or phrase at all; most texts hold none.
    """

    def crowded(s: Column) -> Column:
        return ((F.char_length(line) - F.char_length(s.b)) * 2 > words_) | ((F.char_length(s.a) - F.char_length(_removed(s.b, "»"))) * 4 > words_)

    a = _removed(line, "#*$%&")
    bars = let(a, lambda a: let(F.struct(a.alias("a"), _removed(a, "|<>").alias("b")), crowded))
    low = ascii_lower(line)
    return (
        F.when(marked, bars).otherwise(False)
        | (F.char_length(line) < 40) & low.rlike(NAVIGATION)
        | phrased & (F.char_length(line) < 200) & low.rlike(BOILERPLATE)
        | (words_ < 3) & ~F.right(line, F.lit(1)).rlike(CLOSING)
    )


def _spaces(line: Column) -> Column:
    """Words of a stripped line, counted by its runs of blanks."""
    return F.regexp_count(line, F.lit(r"[\x20\x09-\x0D]+")) + 1


def quality_figures(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """Line-first verdict with its figures, one row per input row.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words_lost, base_failed, kept``.
    Every line that holds a word is judged by the punctuation, navigation and boilerplate rules; lines that fail are
    removed, and the document is rejected if the removed lines held more than ``max_lost`` of its words. Documents below
    the base figures (under 20 words, or over 30 % of the words in repeated 8-word windows) are rejected as well.

    Null, empty and blank texts have no words and fail. Repeated rows are judged alike; other columns are not looked at.
    All work stays within the row, so there is no shuffle whatever the length or frequency of texts.
    """
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: strip_blanks(x) != "")

    marked = F.char_length(_removed(F.col("text"), SYMBOLS + "»")) < F.char_length("text")
    phrased = let(F.lower("text"), lambda t: reduce(or_, [F.contains(t, F.lit(p)) for p in HINTS]))

    def judged(kept: Column) -> Column:
        fails = lambda s: F.transform(F.transform(kept, strip_blanks), lambda x: let(_spaces(x), lambda n: F.when(_line_fails(x, n, s.marked, s.phrased), n).otherwise(0)))
        lost = let(F.struct(marked.alias("marked"), phrased.alias("phrased")), fails)
        return F.struct(
            (F.size(kept) - F.size(F.array_distinct(kept))).alias("dup"),
            F.aggregate(lost, F.lit(0), lambda a, b: a + b).alias("lost"),
        )

    figures = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(_removed(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(_removed(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        _repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        let(lines, judged).alias("line"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.coalesce(F.col("line.lost"), F.lit(0)).cast("long")
    return figures.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.coalesce("line.dup", F.lit(0)).cast("long").alias("n_dup_lines"), "n_repeat_words",
        lost.alias("words_lost"), failed.alias("base_failed"), (~failed & (lost <= max_lost * F.col("n_words"))).alias("kept"),
    )


def keep_good(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that ``quality_figures`` keeps."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    carried = docs.select(whole.alias("doc_id"), F.col("text"))
    return quality_figures(carried, max_lost).where("kept").select("doc_id.*")

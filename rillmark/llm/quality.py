"""Line-first cleaning and quality rules.

Each line is judged by itself: symbols (more than a third as many as words), navigation (a separator for every two words or fewer), shouting
(capitals in most words), missing punctuation (many words without a sentence end), boilerplate (stock phrases that
fill a quarter of a short line), and repetition (equal to an earlier line). Lines that fail are removed, blank lines stay; a document that loses more than ``LOSS`` of
the characters in its words is rejected, and so is one that fails the base rules: fewer than 50 words, or more than half of its
words in three-word windows that occur twice or more.

Defined results: a null or blank text has no words and is rejected; lines without a word count for nothing and
stay; rows are independent, so ties, repeated rows and empty tables need nothing special; only columns named like an output column
are replaced.

Everything is a row expression without a shuffle. Windows are found by sorting, per text, their hashes with their places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import WORD, quoted

SYMBOLS = "[#*$%&|<>]"
#: A slash within a word (an address, a date, a path) separates nothing.
SEPARATORS = r"[|»›•·>]|[\x20\x09-\x0D]/[\x20\x09-\x0D]"
#: A run of capitals within a word.
CAPITALS = r"\p{Lu}{2,}"
#: A sentence end anywhere in the line.
STOPS = r"[.!?…:;。！？،؟]"
#: Phrases of page furniture, for lines of at most ``SHORT`` words that they fill to a quarter or more.
PHRASES = ("cookie", "javascript", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here",
           "read more", "sign in", "log in", "subscribe", "newsletter", "skip to content", "share this", "lorem ipsum")
SHORT = 12
LOSS = 0.3
MIN_WORDS = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def repeat_words(words: Column) -> Column:
    """Number of ``words`` within three-word windows found twice or more."""

    def starts(w: Column, low: Column) -> Column:
        """Places of these windows, ascending."""
        # Hash in the high bits, place in the low ones: one plain array of numbers to sort.
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(
            F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
        place = lambda key: key.bitwiseAND(low).cast("int")

        def same(i: Column, j: Column) -> Column:
            return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

        def neighbours(s: Column) -> Column:
            alike = F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda at: F.get(s, at).bitwiseOR(low) == F.get(s, at + 1).bitwiseOR(low))
            pairs = F.transform(alike, lambda at: F.array(place(F.get(s, at)), place(F.get(s, at + 1))))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: same(p[0], p[1])))))

        return let(F.sort_array(keys), neighbours)

    def covered(d: Column) -> Column:
        """Words of windows that start at these places."""
        return F.aggregate(F.transform(d, lambda at, n: F.coalesce(F.least(F.lit(3), F.get(d, n + 1) - at), F.lit(3))),
                           F.lit(0), lambda total, more: total + more)

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(
        (F.pow(F.lit(2.0), F.length(F.bin(F.size(w)))) - 1).cast("long"), lambda low: let(starts(w, low), covered))))


def bad_line(line: Column) -> Column:
    """Whether a line fails by itself."""

    def judged(words: Column) -> Column:
        symbols = count(line, SYMBOLS) * 3 > words
        navigation = (words >= 3) & (count(line, SEPARATORS) * 3 > words)
        shouting = (words >= 3) & (count(line, CAPITALS) * 2 > words)
        unpunctuated = (words >= 10) & ~F.rlike(line, F.lit(STOPS))
        rest = F.regexp_replace(F.lower(line), "|".join(PHRASES), "")
        boilerplate = (words <= SHORT) & (4 * (F.length(F.lower(line)) - F.length(rest)) >= F.length(F.lower(line)))
        return symbols | navigation | shouting | unpunctuated | boilerplate

    return let(count(line, WORD), judged)


def assess(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``clean_text``, ``clean_chars``,
    ``base_failed``, ``kept``."""
    content = F.coalesce(quoted(text).cast("string"), F.lit(""))
    lines = F.transform(F.split(content, "\n"), lambda line, at: F.struct(line.alias("line"), at.alias("at")))
    blank = lambda x: ~F.rlike(x["line"], F.lit(WORD))
    chars = lambda value: F.length(F.translate(value, " \t\n\x0b\x0c\r", ""))

    def by_line(ordered: Column) -> Column:
        """From lines with their places, equal ones next to each other in order of places."""
        again = lambda x, i: (i > 0) & (F.get(ordered, i - 1)["line"] == x["line"])
        stays = F.filter(ordered, lambda x, i: blank(x) | ~again(x, i) & ~bad_line(x["line"]))
        in_text = F.sort_array(F.transform(stays, lambda x: F.struct(x["at"], x["line"])))
        return F.struct(F.size(F.filter(ordered, lambda x, i: again(x, i) & ~blank(x))).cast("long").alias("dup"),
                        F.array_join(F.transform(in_text, lambda x: x["line"]), "\n").alias("clean"))

    found = let(words_of(content), lambda w: F.struct(F.size(w).cast("long").alias("words"),
                                                      F.length(F.array_join(w, "")).cast("long").alias("chars"),
                                                      repeat_words(w).cast("long").alias("repeat")))
    facts = df.withColumns({"quality_words": found, "quality_lines": let(F.sort_array(lines), by_line)})
    n, repeated = F.col("quality_words.words"), F.col("quality_words.repeat")
    out = facts.withColumns({
        "n_words": n, "word_chars": F.col("quality_words.chars"), "n_symbols": count(content, SYMBOLS).cast("long"),
        "n_dup_lines": F.col("quality_lines.dup"), "n_repeat_words": repeated, "clean_text": F.col("quality_lines.clean"),
        "clean_chars": chars(F.col("quality_lines.clean")).cast("long"),
        "base_failed": (n < MIN_WORDS) | (100 * repeated > 50 * n)})
    kept = ~F.col("base_failed") & (F.col("clean_chars") >= (1 - LOSS) * F.col("word_chars"))
    return out.withColumn("kept", kept).drop("quality_words", "quality_lines")


def keep(df: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows of ``df`` that are kept, with the cleaned text and, if there is such a column, its ``length``.

    All other columns stay as they are, whatever their names.
    """
    rows = df.select(F.struct(*[quoted(name).alias(name) for name in df.columns]).alias("row"), quoted(text).alias("content"))
    kept = assess(rows, "content").where("kept")
    changed = {text: F.col("clean_text"), length: F.length("clean_text").cast(dict(df.dtypes).get(length, "long"))}
    return kept.select(*[changed.get(name, F.col("row").getField(name)).alias(name) for name in df.columns])

"""Document fingerprints from closed syncmers.

A text is a sequence of words. A run of ``K`` words is an anchor if the smallest hash among its inner runs of ``S`` words stands
first or last: whether it is depends on the run alone, so equal passages give equal anchors wherever they stand, and their places
tell how two texts align. The fingerprint is the ``SIZE`` smallest distinct anchor hashes; the likeness of two fingerprints is
the share of common anchors among the smallest of their union, which estimates the Jaccard similarity of all anchors.

Defined results: a null text is an empty one; a text with words but no closed syncmer (fewer than ``K`` words, or a few more) has its whole
sequence as one anchor, and one without words has none; two empty fingerprints have likeness 1, an empty and another 0; equal ids are ordered by a hash of their texts;
null ids come last in descending order; a single document is its own next; an empty table gives an empty result. Columns named
like an output column are replaced.

Everything is DataFrame expressions. For the text that follows each document, texts move once: to cells of the id range,
whose edges come from approximate quantiles, and each cell also gets the first document of the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rillmark.llm.common import id_cell, quoted
from rillmark.llm.quality import let, words_of
from rillmark.session import materialise

K, S, SIZE = 5, 2, 128


def anchors(text: Column) -> Column:
    """array<struct<place int, hash int>>: the closed syncmers of a text, in order."""

    def chosen(w: Column, h: Column) -> Column:
        inner = K - S + 1
        places = F.filter(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.array_min(F.slice(h, i + 1, inner)) == F.least(
            F.get(h, i), F.get(h, i + inner - 1)))
        # Inner runs that cover the anchor stand for its words.
        parts = [*range(0, K - S, S), K - S]
        return F.transform(places, lambda i: F.struct(i.alias("place"), F.shiftright(F.xxhash64(
            *[F.get(h, i + part) for part in parts]), 32).cast("int").alias("hash")))

    def hashed(w: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(w) - S), lambda i: F.xxhash64(*[F.get(w, i + at) for at in range(S)]))
        whole = F.array(F.struct(F.lit(0).alias("place"), F.shiftright(F.xxhash64(F.array_join(w, " ")), 32).cast("int").alias("hash")))
        none = F.array().cast("array<struct<place:int,hash:int>>")
        found = F.when(F.size(w) >= K, let(inner, lambda h: chosen(w, h))).otherwise(none)
        return let(found, lambda a: F.when((F.size(a) > 0) | (F.size(w) == 0), a).otherwise(whole))

    return let(words_of(F.coalesce(text.cast("string"), F.lit(""))), hashed)


def fingerprint(text: Column, size: int = SIZE) -> Column:
    """array<int>: the ``size`` smallest distinct anchor hashes of a text, ascending."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(anchors(text), lambda a: a["hash"]))), 1, size)


def digest(sketch: Column) -> Column:
    """A fingerprint as text, 8 hex digits per hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), ""))


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity, 0 to 1, of the anchors behind two fingerprints."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    common = F.array_intersect(a, b)
    share = let(least, lambda u: F.size(F.array_intersect(u, common)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(share)


def matches(a: Column, b: Column) -> Column:
    """array<struct<shift int, place int>>: the anchors that occur once in each of two texts, by shift and place.

    ``place`` is where the anchor stands in ``a``, ``shift`` how many words further on it stands in ``b``. Both lists of
    anchors are sorted together by hash, so the work grows with their length and not with its square.
    """

    def tagged(own: Column, side: int) -> Column:
        return F.transform(own, lambda x: F.struct(x["hash"].alias("hash"), F.lit(side).alias("side"), x["place"].alias("place")))

    def paired(x: Column) -> Column:
        def alone(i: Column) -> Column:
            here, there = F.get(x, i), F.get(x, i + 1)
            same = (here["hash"] == there["hash"]) & (here["side"] != there["side"])
            return same & ~here["hash"].eqNullSafe(F.get(x, i - 1)["hash"]) & ~here["hash"].eqNullSafe(F.get(x, i + 2)["hash"])

        found = F.filter(F.sequence(F.lit(0), F.size(x) - 2), alone)
        return F.sort_array(F.transform(found, lambda i: F.struct(
            (F.get(x, i + 1)["place"] - F.get(x, i)["place"]).alias("shift"), F.get(x, i)["place"].alias("place"))))

    none = F.array().cast("array<struct<shift:int,place:int>>")
    return let(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))), lambda x: F.when(F.size(x) >= 2, paired(x)).otherwise(none))


def passages(a: Column, b: Column) -> Column:
    """array<struct<shift int, first int, last int, anchors int>>: what two texts share, one entry per shift.

    ``first`` and ``last`` are words of ``a``, the latter included; a passage moved as a whole keeps one shift, however
    short it is beside its texts.
    """

    def grouped(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: ~F.get(m, i)["shift"].eqNullSafe(F.get(m, i - 1)["shift"]))

        def entry(start: Column, end: Column) -> Column:
            return F.struct(F.get(m, start)["shift"].alias("shift"), F.get(m, start)["place"].alias("first"),
                            (F.get(m, end - 1)["place"] + (K - 1)).alias("last"), (end - start).cast("int").alias("anchors"))

        return let(starts, lambda s: F.transform(s, lambda start, n: entry(start, F.coalesce(F.get(s, n + 1), F.size(m)))))

    none = F.array().cast("array<struct<shift:int,first:int,last:int,anchors:int>>")
    return let(matches(a, b), lambda m: F.when(F.size(m) > 0, grouped(m)).otherwise(none))


def offset(a: Column, b: Column) -> Column:
    """Words by which most common anchors stand further on in ``b`` than in ``a``; null without one."""
    ranked = F.transform(passages(a, b), lambda p: F.struct(p["anchors"], -F.abs(p["shift"]), p["shift"]))
    return let(F.array_max(ranked), lambda best: best["shift"])


def with_next(df: DataFrame, doc_id: str, *columns: str) -> DataFrame:
    """``df`` with ``next_<column>`` of the next document in descending order of ``doc_id``; after the last comes the first.

    Equal ids are ordered by a hash of the first of ``columns``; the others should follow from it.
    """
    key, tie = quoted(doc_id), F.xxhash64(quoted(columns[0]))
    # Counts down with the id, nulls last.
    cell = -id_cell(df, doc_id, key)
    placed = df.select("*", cell.alias("syncmer_cell"), tie.alias("syncmer_tie"))
    order = F.struct(F.col("id").isNull(), -F.col("id"), F.col("tie"))
    ids = df.select(key.alias("id"), tie.alias("tie"), cell.alias("cell"))
    first = ids.groupBy("cell").agg(F.min(order).alias("o"), F.min_by(F.struct("id", "tie"), order).alias("head"))
    # One row per cell: the cell that each head also goes to is the one before, and the first head closes the last cell.
    before, last = F.lag("cell").over(Window.orderBy("cell")), F.max("cell").over(Window.partitionBy())
    goes = materialise(first.select(F.col("head.id").alias("id"), F.col("head.tie").alias("tie"),
                                    F.coalesce(before, last).alias("to")), "syncmer-heads")
    copies = placed.join(goes, key.eqNullSafe(F.col("id")) & (F.col("syncmer_tie") == F.col("tie"))).dropDuplicates(["id", "tie"])
    copies = copies.withColumn("syncmer_cell", F.col("to")).select(*placed.columns)
    both = placed.withColumn("syncmer_copy", F.lit(False)).unionByName(copies.withColumn("syncmer_copy", F.lit(True)))
    window = Window.partitionBy("syncmer_cell").orderBy("syncmer_copy", key.desc_nulls_last(), "syncmer_tie")
    following = [F.lead(quoted(name)).over(window).alias(f"next_{name}") for name in columns]
    return both.select("*", *following).where("not syncmer_copy").drop("syncmer_cell", "syncmer_tie", "syncmer_copy")


def compare_with_edited(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text``, ``edited_text``, ``sketch``, ``edited_sketch``, ``near_edited``, ``near_next``.

    The edited text has its last third replaced by the beginning of the next document.
    """
    docs = df.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("sketch", fingerprint(F.col("text"))), "doc_id", "text", "sketch")
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"),
                      F.substring(F.col("next_text"), F.lit(1), third))
    done = rows.withColumn("edited_text", edited).withColumn("edited_sketch", fingerprint(F.col("edited_text")))
    return done.select("doc_id", "text", "edited_text", "sketch", "edited_sketch",
                       likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))

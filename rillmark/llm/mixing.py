"""Mixing sources to target weights.

Words are summed per source. The mix is to hold ``share`` times all words; sources get it by weight, but none more than
``most`` times its own words: what is above is dealt again by weight among the others until none is above. A source's rate is
its target over its words. Each document is taken floor(rate) times, and once more if a draw from its hash with the seed falls
below the fraction, so reruns agree and the expected words of a source are its target.

Defined results: a null text has no words; documents of a null source are a source of their own, last in order; a null id
draws by the text alone; repeated rows draw alike; a source without words has rate 0 (its documents are taken 0 times); an
empty table gives an empty mix. Columns are added under names that the input does not have, or replace those named in the call.

Scale: one pass counts words and sums per source with partial aggregates, so a hot source costs one row per task. Targets take
a few passes over the table of sources, which is written first; only three sums per pass reach the driver. The rate is joined
back by source, and Spark broadcasts the written table only if its measured size is below the threshold, else it splits the
hot source's side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rillmark.llm.common import count_words, free_name, quoted, without
from rillmark.session import materialise

#: Weights of the sources in order of code point, repeating.
WEIGHTS = (5, 2, 1)


def source_sizes(df: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """``mix_source``, ``source_size``: one row per source, null included."""
    return df.groupBy(quoted(source).alias("mix_source")).agg(
        F.coalesce(F.sum(quoted(size)), F.lit(0)).cast("long").alias("source_size"))


def cyclic_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` with ``weight``: the weights in order of the sources' code points, repeating, null last."""
    # Binary order is the order of code points. One row per source, so the one ordered task holds names and sums only.
    place = F.row_number().over(Window.orderBy(F.col("mix_source").cast("binary").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, len(weights)) + 1).cast("int")))


def targets(sizes: DataFrame, numerator: int = 3, denominator: int = 2, most: int = 2) -> DataFrame:
    """``sizes`` with ``target`` (double): numerator / denominator of all words by weight, at most ``most`` times the own words.

    ``sizes`` (mix_source, source_size, weight) should be stored, as it is read once per pass. All sums are integers.
    """
    sizes = sizes.withColumn("weight", F.col("weight").cast("decimal(20,0)")).withColumn(
        "source_size", F.col("source_size").cast("decimal(20,0)"))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    # A source is at its limit when level * weight reaches most * size; level = above / below.
    above, below = 0, 1
    while True:
        limited = F.col("source_size") * F.lit(denominator * most) * F.lit(below) < F.col("weight") * F.lit(above)
        full, open_weight = sizes.agg(
            F.sum(F.when(limited, F.col("source_size"))), F.sum(F.when(~limited, F.col("weight")))).first()
        rest = (numerator * int(total) - denominator * most * int(full or 0), int(open_weight or 0))
        if not rest[1] or rest == (above, below):
            break
        above, below = rest
    level = above / below / denominator
    return sizes.select("mix_source", F.col("source_size").cast("long").alias("source_size"), F.col("weight").cast("long").alias("weight"),
                        F.when(limited, F.col("source_size").cast("double") * most)
                        .otherwise(F.col("weight").cast("double") * F.lit(level)).alias("target"))


def draw(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the MD5 of seed and keys."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(key.cast("string"), F.lit("")) for key in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def rates(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix",
          weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``: how often the mix takes each document."""
    docs = materialise(df.select(
        quoted(doc_id).alias("doc_id"), quoted(source).alias("source"), count_words(quoted(text)).alias("size"),
        draw(seed, quoted(doc_id), F.when(quoted(doc_id).isNull(), F.md5(quoted(text).cast("binary")))).alias("draw")), "mix-sizes")
    sizes = materialise(cyclic_weights(source_sizes(docs), weights), "mix-sources")
    mix = materialise(targets(sizes), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")
    return docs.join(mix, F.col("source").eqNullSafe(F.col("mix_source"))).select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix",
        weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixed rows of ``df``, each as often as it is taken, with the columns of ``df``.

    ``df`` is read twice, once to count and once to emit.
    """
    sizes = df.select(quoted(source).alias("source"), count_words(quoted(text)).alias("size"))
    sources = materialise(cyclic_weights(source_sizes(sizes), weights), "mix-sources")
    goal = targets(sources).select("mix_source", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                                   .otherwise(F.lit(0.0)).alias("mix_rate"))
    names = {name: free_name(df, name) for name in ("mix_source", "mix_rate", "mix_copy")}
    goal = materialise(goal.withColumnsRenamed(names), "mix-rates")
    rate = F.col(names["mix_rate"])
    chance = draw(seed, quoted(doc_id), F.when(quoted(doc_id).isNull(), F.md5(quoted(text).cast("binary"))))
    copies = (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")
    rows = df.join(goal, quoted(source).eqNullSafe(F.col(names["mix_source"])))
    taken = rows.withColumn(names["mix_copy"], F.explode(F.array_repeat(F.lit(True), copies)))
    return without(taken, *names.values()).select(*map(quoted, df.columns))

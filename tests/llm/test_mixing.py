"""Mixing: targets by exact water filling, draws that agree between runs."""

from fractions import Fraction

from rillmark.llm import mixing


def water_fill(sizes, weights, total, most):
    """Shares by weight, capped, the excess dealt again, in exact fractions."""
    target, open_sources = {}, set(sizes)
    while True:
        rest = total - sum(target.values())
        weight = sum(weights[s] for s in open_sources)
        share = {s: rest * weights[s] / weight for s in open_sources}
        above = {s for s in open_sources if share[s] > most * sizes[s]}
        if not above:
            return target | share
        target |= {s: Fraction(most * sizes[s]) for s in above}
        open_sources -= above


def documents(spark):
    rows, n = [], 0
    for source, count, words in [("a", 40, 30), ("b", 3, 5), (None, 20, 7), ("é", 300, 4), ("B", 1, 900), ("z", 5, 0)]:
        for _ in range(count):
            rows.append((n, source, "w " * words if words else None, 1))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, source string, text string, mix_rate int")


def test_targets_and_copies(spark):
    rows = mixing.rates(documents(spark)).collect()
    sizes, order = {}, ["B", "a", "b", "z", "é", None]  # code points, null last
    for row in rows:
        sizes[row["source"]] = sizes.get(row["source"], 0) + row["size"]
    weights = {source: Fraction(mixing.WEIGHTS[at % 3]) for at, source in enumerate(order)}
    goal = water_fill(sizes, weights, Fraction(3 * sum(sizes.values()), 2), 2)
    taken = dict.fromkeys(order, 0)
    for row in rows:
        assert row["source_size"] == sizes[row["source"]]
        assert abs(row["target"] - float(goal[row["source"]])) < 1e-6
        assert 0 <= row["copies"] <= 2
        taken[row["source"]] += row["size"] * row["copies"]
    assert abs(taken["é"] - float(goal["é"])) < 0.15 * float(goal["é"])
    assert taken["z"] == 0


def test_reruns_agree_whatever_the_partitions(spark):
    df = documents(spark)
    first = sorted((row["doc_id"], row["copies"]) for row in mixing.rates(df).collect())
    again = sorted((row["doc_id"], row["copies"]) for row in mixing.rates(df.repartition(7)).collect())
    assert first == again


def test_mix_emits_the_copies_and_keeps_columns(spark):
    df = documents(spark)
    copies = {row["doc_id"]: row["copies"] for row in mixing.rates(df).collect()}
    out = mixing.mix(df)
    assert out.columns == df.columns
    counts = {}
    for row in out.collect():
        counts[row["doc_id"]] = counts.get(row["doc_id"], 0) + 1
    assert counts == {doc: n for doc, n in copies.items() if n}


def test_null_ids_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a", "x y"), (None, "a", "x y"), (None, "a", "z"), (1, "a", None), (1, None, "q")],
                               "doc_id long, source string, text string")
    rows = mixing.rates(df).collect()
    assert len(rows) == 5 and len({row["copies"] for row in rows if row["doc_id"] is None and row["size"] == 2}) == 1
    assert mixing.rates(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0

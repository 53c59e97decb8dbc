"""Line rules and base counts against plain Python, the query against SQL."""

from collections import Counter

from rillmark.llm import quality
from rillmark.llm.queries import op6_quality

GOOD = "The quick{0} brown{0} fox{0} number{0} jumps{0} over{0} a{0} lazy dog today."


def base_counts(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + at for i, window in enumerate(windows) if counts[window] > 1 for at in range(3)}
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    return len(words), sum(len(word.decode()) for word in words), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "one", "a b c", "a b c d", "a a a a a", "x y z x y z", "x y z q x y z", "é ñ\x0bü\x1cß\x0c|&", "l\nl\n l\nl",
         "\n".join(GOOD.format(n) for n in range(8)), " ".join(["Und"] * 300), "k " * 20_000]


def test_base_counts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for row in quality.assess(df).collect():
        text = TEXTS[row["doc_id"]]
        assert (row["n_words"], row["word_chars"], row["n_dup_lines"], row["n_repeat_words"]) == base_counts(text)
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")


def test_lines(spark):
    body = [GOOD.format(n) for n in range(10)]
    junk = ["Home | News | Sport | Contact", "BUY NOW!! CHEAP!! OFFER!!", "$$$ ### &&& win", "this line has more than ten words but it never stops at all",
            "We use cookies. Accept?", body[0]]
    df = spark.createDataFrame([(1, "\n".join(body[:5] + junk + body[5:])), (2, "\n".join(body[:6] + [f"Home{n} | News{n} | Sport{n} | Contact{n}" for n in range(12)])),
                                (3, "\n".join(["A B | C D | E F | G H"] * 30))], "doc_id long, text string")
    rows = {row["doc_id"]: row for row in quality.assess(df).collect()}
    assert rows[1]["kept"] and rows[1]["clean_text"].split("\n") == body
    assert rows[1]["n_dup_lines"] == 1
    assert not rows[2]["kept"] and not rows[2]["base_failed"]
    assert not rows[3]["kept"] and rows[3]["base_failed"]


def test_clashing_columns_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 5)], "doc_id long, text string, kept int")
    out = quality.assess(df)
    assert out.count() == 2 and not any(row["kept"] for row in out.collect())
    assert quality.assess(df.limit(0)).count() == 0
    text = "\n".join([GOOD.format(n) for n in range(10)] + ["Home | News | Sport | Contact"])
    rows = spark.createDataFrame([(1, text, 5, 7, 9), (2, "x", 5, 7, 9)], "doc_id long, text string, kept int, `n.words` int, n_chars int")
    out = quality.keep(rows)
    clean = text.rpartition("\n")[0]
    assert out.columns == rows.columns and [tuple(row) for row in out.collect()] == [(1, clean, 5, 7, len(clean))]


def test_query_equals_sql(equals_sql):
    equals_sql(op6_quality)


def test_labelled_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = op6_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    assert all(row["kept"] for row in rows if row["quality"] == 1 and not row["base_failed"])
    assert not any(row["kept"] for row in rows if row["quality"] == 0)


def test_clean_lines_stay_as_they_are(spark):
    body = "\n\n".join([GOOD.format(n) for n in range(6)] + ["see https://example.org/a/b/c here", "born 03/04/1920 died 05/06/1990 in Rome.",
                                                             "Readers subscribe to the theory of gravity today."])
    furniture = ["Sign in / Register / Help / Contact", "Subscribe to our newsletter", "Home > Shop > Shoes"]
    df = spark.createDataFrame([(1, body), (2, "\n".join([body, *furniture])), (3, "\n" + body + "\n")], "doc_id long, text string")
    rows = {row["doc_id"]: row["clean_text"] for row in quality.assess(df).collect()}
    assert rows == {1: body, 2: body, 3: "\n" + body + "\n"}

"""License scans against plain containment."""

import random

from pyspark.sql import functions as F

from rillmark.llm import licenses
from rillmark.llm.queries import op4_licenses


def words(text):
    table = str.maketrans(licenses.UPPER + licenses.PUNCTUATION, licenses.UPPER.lower() + " " * len(licenses.PUNCTUATION))
    return [word for word in (text or "").translate(table).split(" ") if word]


def shingles(text):
    own = words(text)
    return [tuple(own[i:i + 5]) for i in range(len(own) - 4)]


def brute(text):
    own = shingles(text)
    for name, template in licenses.TEMPLATES.items():
        wanted = set(shingles(template))
        matched = wanted & set(own)
        if len(matched) >= 0.8 * len(wanted):
            yield name, len(matched), len(wanted), min(own.index(one) for one in matched)


def test_placed_anywhere_and_damaged(spark):
    random.seed(5)
    filler = lambda n: " ".join(random.choice("abcdefgh") + str(random.randint(0, 99)) for _ in range(n))
    texts = [None, "", "a b c d", "released under the mit"]
    for template in licenses.TEMPLATES.values():
        for before in (0, 1, 2, 3, 60):
            texts.append(f"{filler(before)}\n{template.upper()} {filler(random.randint(0, 40))}")
        own = template.split()
        own[len(own) // 2] = "changed"
        texts.append(f"{filler(9)} {' '.join(own)} {filler(9)}")
    df = spark.createDataFrame([(n, text, "x") for n, text in enumerate(texts)], "doc_id long, text string, license string")
    found = sorted((row["doc_id"], row["license"], row["matched"], row["shingles"], row["first_word"]) for row in licenses.scan(df).collect())
    assert found == sorted((n, *match) for n, text in enumerate(texts) for match in brute(text))
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df.unionByName(df)).count() == 2 * len(found)


def test_no_python_on_the_executors(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query(equals_sql):
    equals_sql(op4_licenses, "/root/testdata/sf0.01")


def test_common_notices_are_told_apart(spark):
    lines = {"This is under the GNU Lesser General Public License.": {"LGPL notice"}, "# SPDX-License-Identifier: GPL-2.0-only": {"GPL-2.0 SPDX"},
             "Text: CC BY-SA 4.0, see below": {"CC-BY-SA-4.0 short"}, "Mozilla Public License Version 2.0 applies": {"MPL-2.0 short"},
             "GNU Affero General Public License": {"AGPL notice"}, "the general public may license a mozilla": set()}
    df = spark.createDataFrame([(number, "word " * 3000 + line) for number, line in enumerate(lines)], "doc_id long, text string")
    found = {number: set() for number in range(len(lines))}
    for row in licenses.scan(df).collect():
        found[row["doc_id"]].add(row["license"])
    assert [*found.values()] == [*lines.values()]

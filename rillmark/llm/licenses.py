"""License scans: MinHash bands over overlapping windows of a text retrieve templates, exact shingle containment verifies them.

Texts are lower-cased (A-Z), ASCII punctuation is white space, and runs of five words are shingles. Windows of ``WINDOW`` shingles
start at every ``STRIDE`` of them; templates are cut at every one. A band is the smallest or the largest shingle of a window under
one of ``PERMUTATIONS`` hash orders. A window that a template's window equals always meets it; a template of a single shingle is the
smallest or largest of its window in one order with probability 1/2, so six orders and two overlapping windows find it with
probability 1 - (1/2)^12 = 0.9998, and longer ones more surely. A retrieved template is reported if at least ``CONTAINED`` of its distinct
shingles occur in the text.

Defined results: null and empty texts, and those of fewer than five words, match nothing; repeated rows are reported once each; a
template of fewer than five words is refused; an empty table gives an empty result. Only the id and the text are used.

Scale: bands are taken of the windows that hold a shingle of some template, since no other can meet one. Row expressions up to the candidates; only texts with a candidate window go on. The templates are a list in the query, bounded by
``MOST`` shingles in all, so what goes to every task does not grow with the data.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import quoted
from rillmark.llm.quality import let

SHINGLE, WINDOW, STRIDE, PERMUTATIONS = 5, 4, 2, 6
CONTAINED = 0.8
MOST = 20_000
UPPER, PUNCTUATION = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\t\n\x0b\x0c\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Wording of public licences and of common notices.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
           "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
           "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
           "Software is furnished to do so, subject to the following conditions",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
           "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
           "following disclaimer.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                  "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
               "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                 "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                 "commercial or non-commercial, and by any means.",
    "LGPL notice": "GNU Lesser General Public License",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL notice": "GNU Affero General Public License",
    "MPL-2.0 short": "Mozilla Public License Version 2.0",
    "EPL-2.0 short": "Eclipse Public License Version 2.0",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
               "available at https://www.eclipse.org/legal/epl-2.0/",
    "CC-BY-SA-4.0 short": "CC BY-SA 4.0",
    "CC-BY-ND-4.0 short": "CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0 short": "CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0 short": "CC BY-NC-ND 4.0",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission.",
    "Apache-2.0 SPDX": "SPDX-License-Identifier: Apache-2.0",
    "GPL-2.0 SPDX": "SPDX-License-Identifier: GPL-2.0",
    "GPL-3.0 SPDX": "SPDX-License-Identifier: GPL-3.0",
    "BSD-3-Clause SPDX": "SPDX-License-Identifier: BSD-3-Clause",
    "BSD-2-Clause SPDX": "SPDX-License-Identifier: BSD-2-Clause",
    "MPL-2.0 SPDX": "SPDX-License-Identifier: MPL-2.0",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def words_of(text: Column) -> Column:
    spaced = F.translate(text, UPPER + PUNCTUATION, UPPER.lower() + " " * len(PUNCTUATION))
    return F.array_remove(F.split(spaced, " "), "")


def shingles(words: Column) -> Column:
    """Hash of each five words; none for fewer."""
    places = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(0), F.size(words) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + at) for at in range(SHINGLE)]))


def _bands(hashes: Column, start: Column) -> list[Column]:
    """Smallest and largest shingle of a window under each hash order."""
    # The first window of a text begins before it, so that every shingle lies in two.
    window = F.slice(hashes, F.greatest(start, F.lit(0)) + 1, F.least(start, F.lit(0)) + WINDOW)

    def salted(number: int) -> Column:
        return F.transform(window, lambda x: F.xxhash64(x, F.lit(number)))

    ordered = [window, *map(salted, range(1, PERMUTATIONS))]
    return [band for values in ordered for band in (F.array_min(values), F.array_max(values))]


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """``license``, ``distinct_shingles``, ``bands`` (one array per band) of the templates."""
    rows = spark.createDataFrame(list(templates.items()), "license string, template string")
    hashed = rows.withColumn("shingles", shingles(words_of(F.col("template"))))
    starts = F.sequence(F.lit(0), F.greatest(F.size("shingles") - WINDOW, F.lit(0)))
    bands = F.transform(starts, lambda start: F.array(*_bands(F.col("shingles"), start)))
    return hashed.select("license", F.array_distinct("shingles").alias("distinct_shingles"), bands.alias("bands"))


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text",
         contained: float = CONTAINED) -> DataFrame:
    """``doc_id``, ``license``, ``matched``, ``shingles`` (distinct ones of the template), ``containment``, ``first_word``."""
    # The templates are part of the query: a bounded list.
    known = template_table(df.sparkSession, templates).collect()
    short = [row["license"] for row in known if not row["distinct_shingles"]]
    if short or sum(len(row["distinct_shingles"]) for row in known) > MOST:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}" if short else f"more than {MOST} shingles of templates")
    sets = [sorted({window[band] for row in known for window in row["bands"]}) for band in range(2 * PERMUTATIONS)]

    own = sorted({shingle for row in known for shingle in row["distinct_shingles"]})

    def candidates(h: Column) -> Column:
        # A band is a shingle of its window, so only windows that hold a shingle of some template can meet one.
        places = F.filter(F.transform(h, lambda x, i: F.when(x.isin(own), i)), lambda i: i.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(
            *[i - F.pmod(i, F.lit(STRIDE)) - back for back in range(0, WINDOW, STRIDE)]))))
        hit = lambda start: reduce(or_, [band.isin(values) for band, values in zip(_bands(h, start), sets)])
        return F.flatten(F.transform(F.filter(starts, hit), lambda start: F.array(*_bands(h, start))))

    hashes = shingles_of(quoted(text))
    found = df.select(quoted(doc_id).alias("doc_id"), quoted(text).cast("string").alias("text"),
                      let(hashes, candidates).alias("bands"))
    texts = found.where(F.size("bands") > 0).withColumn("hashes", shingles_of(F.col("text"))).drop("text")
    # A template is retrieved if one of its bands is among those of a candidate window.
    whole = F.array(*[F.struct(F.lit(row["license"]).alias("license"), F.lit(row["distinct_shingles"]).alias("own"),
                               F.lit(sorted({band for window in row["bands"] for band in window})).alias("wanted")) for row in known])
    retrieved = texts.withColumn("template", F.explode(F.filter(whole, lambda t: F.arrays_overlap(t["wanted"], F.col("bands")))))
    matched = F.array_intersect("template.own", "hashes")
    verified = retrieved.select("doc_id", F.col("template.license").alias("license"), F.size(matched).cast("long").alias("matched"),
                                F.size("template.own").cast("long").alias("shingles"), matched.alias("common"), "hashes")
    share = F.col("matched") / F.col("shingles")
    first = F.array_min(F.transform("common", lambda x: F.array_position("hashes", x))) - 1
    return verified.where(share >= contained).select("doc_id", "license", "matched", "shingles", share.alias("containment"),
                                                     first.cast("long").alias("first_word"))


def shingles_of(text: Column) -> Column:
    return let(words_of(F.coalesce(text.cast("string"), F.lit(""))), shingles)

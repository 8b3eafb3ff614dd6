r"""Licence scan: Dice coefficient over word bigrams, in DataFrame functions only.

The units compared are the lines of a text, its paragraphs (parts between blank lines) and
the whole text.  A unit is lower-cased, every run of other ASCII characters than letters and
digits becomes one space, and its word bigrams (a bag: repeats count) are compared with those
of each template: 2 * common / (unit + template).

Sizes prune before anything is compared: a coefficient of t needs a bigram count within
t / (2 - t) and (2 - t) / t times the template's, so a unit whose number of words fits no
template is dropped before its bigrams are made (a unit of w words has w - 1), and a pair of unit and template whose sizes do
not fit is dropped before its common bigrams are counted.  The bigrams of the templates (a
fixed list) are broadcast; documents are shuffled only by the few bigrams that they share with
a template.

Defined results: null and empty texts, and texts of no template, have no licence and a
coefficient of 0; of equal coefficients the first licence by name wins; repeated rows each have
their own result; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DICE = 0.8
OTHER = r"[^0-9a-z\x{80}-\x{10FFFF}]+"

# Short notices and notice paragraphs of public licences, as their stewards word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def _normal(c):
    return F.trim(F.regexp_replace(C.lower_ascii(c), OTHER, " "))


def _bigrams(words):
    n = F.size(words)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    """(t, license, size, gram, times): the bag of bigrams of each template."""
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "t int, license string, text string")
    t = t.withColumn("b", _bigrams(F.split(_normal(F.col("text")), " ")))
    return t.select("t", "license", F.size("b").alias("size"), F.explode("b").alias("gram")).groupBy("t", "license", "size", "gram").agg(F.count(F.lit(1)).alias("times"))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows=TEMPLATES, dice: float = DICE) -> DataFrame:
    """(dk, rk, license, dice): each licence that a unit of a row of docs matches, with its best coefficient."""
    lo, hi = dice / (2 - dice), (2 - dice) / dice
    grams = templates(docs.sparkSession, rows)
    # the templates are a fixed list: their sizes are part of the plan
    sizes = sorted({r["size"] for r in grams.select("size").distinct().collect()})
    spans = []
    for s in sizes:
        if spans and s * lo <= spans[-1][1]:
            spans[-1][1] = s * hi
        else:
            spans.append([s * lo, s * hi])
    fits = lambda n: reduce(Column.__or__, [n.between(F.lit(a), F.lit(b)) for a, b in spans])
    # rows of one doc_id and text are counted apart: the bag of a unit is that of one row
    base = C.keyed(docs, id_col, text_col, F.monotonically_increasing_id().alias("row"))
    units = F.array_distinct(F.concat(F.split("text", r"\n"), F.split("text", r"\n[\x20\x09-\x0D]*\n"), F.array("text")))
    # made into words and pruned inside the array, so that each unit is normalised once
    kept = F.filter(F.transform(F.filter(units, lambda x: F.length(x) > 2), lambda x: F.split(_normal(x), " ")), lambda w: fits(F.size(w) - 1))
    u = base.select("dk", "rk", "row", F.posexplode(kept).alias("unit", "w")).withColumn("n", F.size("w") - 1)
    own = u.select("dk", "rk", "row", "unit", "n", F.explode(_bigrams(F.col("w"))).alias("gram"))
    met = own.join(F.broadcast(grams), "gram").where(F.col("n").between(F.col("size") * lo, F.col("size") * hi))
    common = met.groupBy("dk", "rk", "row", "unit", "t", "license", "size", "n", "gram", "times").agg(F.count(F.lit(1)).alias("k"))
    pairs = common.groupBy("dk", "rk", "row", "unit", "t", "license", "size", "n").agg(F.sum(F.least("k", "times")).alias("common"))
    scored = pairs.select("dk", "rk", "license", (2.0 * F.col("common") / (F.col("n") + F.col("size"))).alias("dice")).where(F.col("dice") >= dice)
    return scored.groupBy("dk", "rk", "license").agg(F.max("dice").alias("dice"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence, coefficient and number of licences of every document."""
    docs = C.table(spark, sf_dir, "documents")
    found = matches(docs).groupBy("dk", "rk").agg(
        F.min(F.struct((-F.col("dice")).alias("d"), F.col("license").alias("l"))).alias("best"),
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    ids = C.keyed(docs, "doc_id", "text").select("dk", "rk")
    return ids.join(found, ["dk", "rk"], "left").select(
        C.doc_id().alias("doc_id"),
        F.col("best.l").alias("license"),
        F.coalesce(-F.col("best.d"), F.lit(0.0)).alias("dice"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
    )


def _sql() -> str:
    values = ",\n    ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    norm = lambda c: f"trim(regexp_replace(translate({c}, '{C.UPPER}', '{C.LOWER}'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'))"
    lo, hi = DICE / (2 - DICE), (2 - DICE) / DICE
    return f"""
WITH t0 (t, license, text) AS (VALUES
    {values}),
t1 AS (SELECT t, license, string_split({norm("text")}, ' ') AS w FROM t0),
g AS (SELECT t, license, size, gram, count(*) AS times FROM (
  SELECT t, license, len(w) - 1 AS size, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS gram FROM t1) GROUP BY ALL),
d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
u0 AS (SELECT rid, unnest(list_distinct(list_concat(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[\\x20\\x09-\\x0D]*\\n')), [text]))) AS u FROM d),
u1 AS (SELECT rid, row_number() OVER () AS unit, string_split({norm("u")}, ' ') AS w FROM u0 WHERE length(u) > 2),
u2 AS (SELECT rid, unit, len(w) - 1 AS n, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS gram FROM u1
       WHERE len(w) - 1 <= (SELECT max(size) FROM g) * CAST({hi!r} AS DOUBLE)),
c AS (SELECT rid, unit, n, gram, count(*) AS k FROM u2 GROUP BY ALL),
p AS (
  SELECT rid, unit, t, license, size, n, sum(least(k, times)) AS common FROM c JOIN g USING (gram)
  WHERE n BETWEEN size * CAST({lo!r} AS DOUBLE) AND size * CAST({hi!r} AS DOUBLE) GROUP BY ALL),
s AS (SELECT rid, license, max(2e0 * common / (n + size)) AS dice FROM p WHERE 2e0 * common / (n + size) >= CAST({DICE!r} AS DOUBLE) GROUP BY ALL),
r AS (SELECT rid, count(*) AS n, string_agg(license, ',' ORDER BY license) AS licenses, max(dice) AS dice FROM s GROUP BY rid),
b AS (SELECT rid, min(license) AS license FROM s JOIN r USING (rid) WHERE s.dice = r.dice GROUP BY rid)
SELECT d.doc_id, b.license, coalesce(r.dice, 0e0) AS dice, CAST(coalesce(r.n, 0) AS BIGINT) AS n_licenses, coalesce(r.licenses, '') AS licenses
FROM d LEFT JOIN r USING (rid) LEFT JOIN b USING (rid)
"""


OP7_SQL = _sql()

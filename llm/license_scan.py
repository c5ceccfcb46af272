"""License scans by a positional rare-token index, in DataFrame functions only.

Licence notices (TEMPLATES) are indexed as postings: word, notice, position.  Document
frequencies of the licence words are counted over all documents and give each word its
IDF.  Of each notice the words of highest IDF that any document holds are looked up, as
many as leave less than MATCH of the notice's IDF to the others, so that no place that
could match is missed.  Occurrences of these words in a text are joined with their
postings; each proposes an offset of the notice in the text, and offsets are intersected:
one stays if the words that agree on it, with all that were not looked up, could reach
MATCH.  What stays is verified word by word: the share of the notice's IDF that stands
in place, and the mandatory key phrases.

Postings are a table of a row per word of the notices and joined like any other; results
belong to a text (by its MD5 sum), so that copies are verified once.

Defined results: a null or empty text has no words, label or score; texts are scanned
whole; equal texts get equal results; a notice whose words no document holds matches
nothing; an empty table gives an empty result; further columns stay, but for those that
have the name of a result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WORD, ascii_lower, materialize, scratch, table

#: Base phrases and their labels (the contract's).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Fixed values: (label, notice, mandatory key phrases in small letters).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("free of charge", "without restriction")),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee",)),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("compliance with the license",)),
    ("gpl", "This work is licensed under the GNU General Public License version 3", ("general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", ("gnu general public license", "free software foundation")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("lesser general public license",)),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("affero general public license",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("commons attribution 4",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("source and binary forms", "following conditions")),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("public domain",)),
)
#: Parameter: share of a notice's IDF at one offset that counts.
MATCH = 0.6
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    """The words of a notice (ASCII)."""
    return re.findall(r"[a-z0-9]+", text.lower())


def frequencies(df: DataFrame, words: Column, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """(documents that hold each licence word, all documents); a row per word of the notices reaches the driver."""
    own = F.array_union(F.array_intersect(words, F.array(*map(F.lit, vocabulary))), F.array(F.lit("")))
    counts = {r["w"]: r["n"] for r in df.select(F.explode(own).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts, counts.pop("", 0)


def index(templates, counts: dict[str, int], total: int) -> list[tuple[int, str, list[tuple[int, str, float]], float, set[str], float]]:
    """Per notice: number, label, postings (position, word, IDF), their sum, the words to look up, and the sum of the others'."""
    out = []
    for t, (label, notice, _) in enumerate(templates):
        posted = [(p, w, math.log((total + 1) / (counts.get(w, 0) + 1)) + 1e-3) for p, w in enumerate(plain_words(notice))]
        whole = sum(x for _, _, x in posted)
        # words that no document holds agree nowhere
        left = sum((x for _, w, x in posted if counts.get(w, 0)), 0.0)
        look: set[str] = set()
        for _, w in sorted({(-x, w) for _, w, x in posted if counts.get(w, 0)}):
            if left < MATCH * whole - 1e-9:
                break
            look.add(w)
            left -= sum(x for _, v, x in posted if v == w)
        out.append((t, label, posted, whole, look, left))
    return out


def _places(words: Column, phrase: str) -> Column:
    """Word positions where the phrase's words stand consecutively."""
    first, *rest = phrase.split()

    def here(w: Column, i: Column) -> Column:
        same = w == first
        for j, x in enumerate(rest, 1):
            same &= F.coalesce(F.get(words, i + j) == x, F.lit(False))
        return same

    marks = F.transform(words, lambda w, i: F.when(here(w, i), i.cast("long")))
    return F.filter(marks, lambda i: i.isNotNull())


def find_notices(df: DataFrame, text: str = "text", templates=TEMPLATES) -> DataFrame:
    """text_md5, more_labels (array) and match (highest share) of the texts in which a notice stands."""
    spark = df.sparkSession
    vocabulary = sorted({w for _, notice, _ in templates for w in plain_words(notice)})
    body = F.col(f"`{text}`")
    worded = df.where(body.isNotNull()).select(F.md5(body).alias("text_md5"), words_of(body).alias("w"))
    indexed = index(templates, *frequencies(worded, F.col("w"), vocabulary))
    look = sorted({w for x in indexed for w in x[4]})
    held = F.arrays_overlap("w", F.array(*map(F.lit, look))) if look else F.lit(False)
    texts = materialize(worded.where(held), "license-texts")
    # a row per word of the notices, and per notice: broadcast for their fixed size
    postings = spark.createDataFrame([(w, t, p, x) for t, _, posted, _, own, _ in indexed for p, w, x in posted if w in own], "word string, t int, p int, weight double")
    notices = [(t, label, posted, whole, left, [f" {p} " for p in templates[t][2]]) for t, label, posted, whole, _, left in indexed]
    notices = spark.createDataFrame(notices, "t int, label string, posted array<struct<p:int,word:string,weight:double>>, whole double, unseen double, phrases array<string>")
    at = F.filter(F.transform("w", lambda w, i: F.when(w.isin(look) if look else F.lit(False), F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    seen = texts.select("text_md5", F.explode(at).alias("x")).select("text_md5", "x.*").distinct()
    offsets = seen.join(F.broadcast(postings), "word").groupBy("text_md5", "t", (F.col("at") - F.col("p")).alias("offset")).agg(F.sum("weight").alias("agreed"))
    possible = offsets.join(F.broadcast(notices.select("t", "whole", "unseen")), "t").where(F.col("agreed") + F.col("unseen") >= MATCH * F.col("whole") - 1e-9)
    possible = materialize(possible.groupBy("text_md5", "t").agg(F.collect_set("offset").alias("offsets")), "license-offsets")
    both = texts.join(possible, "text_md5").join(F.broadcast(notices), "t").withColumn("joined", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    here = lambda o, x: (o + x["p"] >= 0) & (F.get("w", F.greatest(o + x["p"], F.lit(0))) == x["word"])
    share = lambda o: F.aggregate("posted", F.lit(0.0), lambda a, x: a + F.when(here(o, x), x["weight"]).otherwise(0.0)) / F.col("whole")
    scored = both.where(F.forall("phrases", lambda p: F.contains("joined", p))).select("text_md5", "label", F.array_max(F.transform("offsets", share)).alias("share"))
    found = scored.where(F.col("share") >= MATCH).groupBy("text_md5").agg(F.sort_array(F.collect_set("label")).alias("more_labels"), F.max("share").alias("match"))
    return materialize(found, "license-found", keep=True)


def scan_licenses(df: DataFrame, text: str = "text", templates=TEMPLATES) -> DataFrame:
    """df without the text, with n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score (the share of the best
    notice, 0.5 at least with a base label)."""
    keep = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(df.columns) if c != text and c not in RESULTS]
    names = [(f"__{i}", c) for i, c in enumerate(df.columns) if c != text and c not in RESULTS]
    with scratch(df.sparkSession):
        found = find_notices(df, text, templates)
    body = F.col(f"`{text}`")
    words = F.col("__words")
    worded = df.select(*keep, F.md5(body).alias("text_md5"), words_of(body).alias("__words"))
    joined = worded.withColumn("__joined", F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" ")))
    places = joined.withColumns({f"__p{i}": F.when(F.contains("__joined", F.lit(f" {phrase} ")), _places(words, phrase)).otherwise(F.array().cast("array<bigint>")) for i, (phrase, _) in enumerate(PHRASES)})
    counted = places.select(*[c for c, _ in names], "text_md5", F.size(words).cast("long").alias("n_words"), *[f"__p{i}" for i in range(len(PHRASES))])
    every = F.concat(*[F.col(f"__p{i}") for i in range(len(PHRASES))])
    base = F.array_compact(F.array(*[F.when(F.size(f"__p{i}") > 0, label) for i, (_, label) in enumerate(PHRASES)]))
    none = F.array().cast("array<string>")
    return counted.join(found, "text_md5", "left").select(
        *[F.col(i).alias(c) for i, c in names],
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).alias("first_word"),
        F.array_max(every).alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base, F.coalesce("more_labels", none)))).alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.coalesce("match", F.lit(0.0)), F.when(F.size(every) > 0, 0.5).otherwise(0.0))).alias("score"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ","))


QUERIES = {"op8_license_scan": op8_license_scan}
SQL: dict[str, str] = {}

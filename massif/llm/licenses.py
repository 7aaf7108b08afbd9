"""License scans (operator 7), in DataFrame functions alone.

Words of texts and templates are lower-cased runs without white space and ``PUNCTUATION``; shingles are ``SHINGLE`` words (the
whole template if it is shorter).  Templates fall into classes by their number of shingles; a class
of at most ``t`` shingles uses text windows of ``2 t`` shingles, one every ``t``, so that every
occurrence lies whole in some window.  The signature of a window is a one-permutation MinHash: the
smallest shingle hash of each of ``2 ** BIN_BITS`` bins, each bin a band of one row.  A shingle that
a template and a window share collides unless a smaller hash of the window falls into its bin: at
most (2 t - 1) / 2 ** (BIN_BITS + 1), under 0.4 % for 128 shingles, and an occurrence is missed only
if all its shingles are.  Windows that collide are verified on their words: a match is a window with
at least ``CONTAINMENT`` of the template's distinct shingles.

Before that, texts are left out that can't match: over a fifth of a template's shingles hold one of
a few of its words (``hitting_words``), so a text without any of these lacks too many shingles.

Defined results: null and empty texts match nothing; a document with several matching windows gives
one row for each template, with the best containment and the first window; rows that share a doc_id
are taken together; empty tables give no rows; other columns are ignored.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.llm.common import SPACES, window_hashes

SHINGLE, CONTAINMENT, BIN_BITS, CLASSES = 5, 0.8, 15, (16, 128, 1024)
PUNCTUATION = ".,;:!?\"'()[]"
_SPLIT = r"[ \t\n\x0B\f\r.,;:!?\"'()\[\]]+"
#: Signature values of all templates up to which texts without any of them are left out before windows are made.
LITERAL_VALUES = 20_000

#: Notices as their licences publish them, the MIT grant without its definition in brackets.
TEMPLATES = {
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
}


def normal(text: Column) -> Column:
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES + PUNCTUATION))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPLIT))


def words(text: str) -> list[str]:
    """The same for a template, on the driver."""
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def hitting_words(template: str, k: int) -> set[str]:
    """Long words such that the k-word shingles without any of them are less than CONTAINMENT of the template, so that every match has one."""
    own, out, bare = words(template), set(), set()
    shingles = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
    for word in sorted(set(own), key=lambda w: (-len(w), w)):
        if len(shingles - bare) / len(shingles) >= CONTAINMENT:  # as matches are compared
            new = {s for s in shingles - bare if word in s}
            if new:
                out.add(word)
                bare |= new
    return out


def _texts(words: Column, k: int) -> Column:
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.concat_ws(" ", x, *(F.get(words, i + j) for j in range(1, k))))


def signature(hashes: Column, bits: int = BIN_BITS) -> Column:
    """The smallest hash of each bin; a bin is the hash's leading bits, so that sorting groups bins."""
    ordered = F.sort_array(hashes)
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - bits)
    return F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1))))


def plan(templates: dict[str, str]) -> list[tuple[int, int, list[str]]]:
    """Shingle length, largest number of shingles and template ids of each class."""
    groups: dict[tuple[int, int], list[str]] = {}
    for name, text in sorted(templates.items()):
        n = len(words(text))
        if n:
            k = min(SHINGLE, n)
            t = next((c for c in CLASSES if n - k + 1 <= c), n - k + 1)
            groups.setdefault((k, t), []).append(name)
    return [(k, t, names) for (k, t), names in sorted(groups.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license_id, containment, window_start (in words): the templates found in each document."""
    templates = TEMPLATES if templates is None else templates
    spark: SparkSession = docs.sparkSession
    classes, found = plan(templates), None
    for k in sorted({k for k, _, _ in classes}):
        own = [(t, names) for kk, t, names in classes if kk == k]
        known = spark.createDataFrame([(name, t, templates[name]) for t, names in own for name in names], "license_id string, t int, text string")
        known = known.withColumn("w", normal(F.col("text"))).withColumns({"shingles": F.array_distinct(_texts(F.col("w"), k)), "values": signature(window_hashes(F.col("w"), k))})
        index = known.select("license_id", "t", "shingles", F.explode("values").alias("value"))
        needed = sorted(set().union(*(hitting_words(templates[n], k) for _, names in own for n in names)))
        # through an array of one, so that the text is lower-cased once and not for each word
        has = F.exists(F.array(F.lower("text")), lambda low: reduce(lambda a, w: a | F.contains(low, F.lit(w)), needed, F.lit(False)))  # noqa: B023
        able = docs.select("doc_id", "text").filter(has)
        hashed = able.select("doc_id", normal(F.col("text")).alias("w")).withColumn("h", window_hashes(F.col("w"), k))
        values = [r.value for r in index.select("value").distinct().limit(LITERAL_VALUES + 1).collect()]
        bands, hit = signature(F.col("x.h")), F.sequence(F.lit(0), F.size("h") - 1)
        if len(values) <= LITERAL_VALUES:  # the index fits into the plan: bands and windows without a template's value are dropped before they become rows
            literal = F.lit(sorted(values)).cast("array<bigint>")
            bands = F.array_intersect(bands, literal)
            hit = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains(literal, x), i)), lambda i: i.isNotNull())
        some = F.size("h") > 0 if len(values) > LITERAL_VALUES else F.arrays_overlap("h", literal)
        hashed = hashed.withColumn("hit", F.when(some, hit))
        sets = []
        for t, _ in own:
            last = F.greatest(F.lit(0), F.ceil(F.size("h") / F.lit(t)).cast("int") - 2)
            both = F.flatten(F.transform("hit", lambda i: F.array(F.floor(i / F.lit(t)).cast("int"), F.floor(i / F.lit(t)).cast("int") - 1)))  # noqa: B023
            near = F.array_distinct(F.transform(both, lambda j: F.least(F.greatest(j, F.lit(0)), last)))  # noqa: B023
            sets.append(F.transform(near, lambda j: F.struct(F.lit(t).alias("t"), (j * t).alias("at"), F.slice(F.col("h"), j * t + 1, 2 * t).alias("h"), F.slice(F.col("w"), j * t + 1, 2 * t + k - 1).alias("w"))))  # noqa: B023
        # outer, since for an inner explode the planner infers a filter that would compute texts and hashes again below
        windows = hashed.select("doc_id", F.explode_outer(F.concat(*sets)).alias("x")).filter(F.col("x").isNotNull())
        probes = windows.select("doc_id", "x.t", "x.at", "x.w", F.explode_outer(bands).alias("value")).filter(F.col("value").isNotNull())
        hits = probes.join(index, ["t", "value"])
        shared = F.size(F.array_intersect("shingles", _texts(F.col("w"), k))) / F.size("shingles")
        kept = hits.select("doc_id", "license_id", shared.alias("containment"), F.col("at").cast("long").alias("window_start")).filter(F.col("containment") >= CONTAINMENT)
        found = kept if found is None else found.unionByName(kept)
    if found is None:
        return spark.createDataFrame([], "doc_id long, license_id string, containment double, window_start long")
    return found.groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"), F.min("window_start").alias("window_start"))

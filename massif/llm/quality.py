"""Quality rules with adaptive thresholds (operator 1), in DataFrame functions alone.

Each document gets integer counts, and rates of them in millionths.  Per language and source, every rate
and every denominator is summarised in a log-linear histogram: exact below 64, 64 buckets for each power
of two above, so a quantile is off by at most one part in 64.  Such sketches merge by adding counts, give
the same result for any partitioning, and pre-aggregate before the shuffle, so that a source with a third
of all rows costs no more than another.  Documents that fail the base rules are left out of them.

A group's fence for a rate is ``median + REACH * max(q80 - median, step)``, all from the group's own
sketches: ``step`` is what one occurrence makes in a text of the group's median length (for the mean word
length, its standard error there), so that a rate that is zero in most texts still allows a few
occurrences.  A count is an outlier if it exceeds the fence's share of the text, or of a text of median
length if that is longer.  Groups of fewer than ``MIN_GROUP`` documents take the merged sketch of their
language, then that of everything.

Windows of words are compared by their 64-bit hash.

Defined results: a null text has no words and fails the base rules; null languages and sources are
groups of their own; repeated rows count as often as they occur; an empty table gives no rows;
other columns are ignored by ``score`` and kept by ``filter_documents``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.llm.common import SPACES, cut, fresh, window_hashes, words_of

MIN_WORDS, REPEAT_PERCENT, WINDOW, MIN_GROUP = 10, 20, 5, 200
#: Rate: its count, its denominator, and the count that one occurrence adds (None: the step is a standard error).
RATES = {"symbol_rate": ("n_symbols", "word_chars", 1), "dup_line_rate": ("n_dup_lines", "n_lines", 1), "repeat_rate": ("n_repeat_words", "n_words", 2 * WINDOW), "shout_rate": ("n_shout", "word_chars", 1), "word_len": ("word_chars", "n_words", None)}
LENGTHS = ("word_chars", "n_lines", "n_words")
REACH, UNIT = 6, 1_000_000
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rows of thresholds up to which they are broadcast; a larger table is joined by shuffling.
BROADCAST_ROWS = 20_000


def _count(text: Column, chars: str) -> Column:
    """Characters of a class: one less than the parts between them (much faster than translate)."""
    return (F.size(F.split(text, chars)) - 1).cast("long")


def _repeated(words: Column, hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; sorts only texts that have any."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), ordered)


def features(docs: DataFrame) -> DataFrame:
    """Append the base counts and the rates to every row; other columns stay."""
    n = fresh(docs, "_t", "_w", "_l", "_h", "_o", "_p")
    t, w, l, h, o, p = (n[k] for k in ("_t", "_w", "_l", "_h", "_o", "_p"))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = docs.withColumn(t, F.coalesce("text", F.lit("")))
    df = df.withColumns({w: words_of(F.col(t)), l: lines})
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": _count(F.col(t), r"[#*$%&|<>]"),
            "n_shout": _count(F.col(t), "[A-Z!]"),
            "n_lines": F.size(l).cast("long"),
            "n_dup_lines": (F.size(l) - F.size(F.array_distinct(l))).cast("long"),
            h: window_hashes(F.col(w), WINDOW),
        }
    ).drop(w, l, t)
    df = df.withColumn(o, _repeated(F.col(h), F.col(h))).drop(h)
    same = lambda x, i: F.coalesce(F.get(F.col(o), i)["h"] == x["h"], F.lit(False))
    df = df.withColumn(p, F.sort_array(F.transform(F.filter(F.col(o), lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))).drop(o)
    gained = F.transform(F.col(p), lambda x, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(F.col(p), i - 1))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(gained, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop(p)
    rates = {r: F.expr(f"case when {d} > 0 then {UNIT} * {c} div {d} else 0 end").cast("long") for r, (c, d, _) in RATES.items()}
    return df.withColumns(rates | {"base_failed": F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")})


def bucket(value: str) -> str:
    """SQL for the sketch's bucket of a count."""
    return f"case when {value} < 64 then {value} else 64 * (length(bin({value})) - 7) + shiftright({value}, length(bin({value})) - 7) end"


def bucket_floor(b: str) -> str:
    """SQL for the smallest value in a bucket."""
    return f"case when {b} < 64 then {b} else shiftleft(64 + {b} % 64, cast(({b} div 64) - 1 as int)) end"


def sketches(scored: DataFrame) -> DataFrame:
    """lang, source, name, bucket, n: one mergeable histogram for each language, source, and rate or length."""
    names = F.array(*(F.struct(F.lit(r).alias("name"), F.expr(bucket(r)).cast("long").alias("bucket")) for r in (*RATES, *LENGTHS)))
    each = scored.filter(~F.col("base_failed")).select("lang", "source", F.explode(names).alias("x"))
    return each.groupBy("lang", "source", "x.name", "x.bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, by: list[str], reach: int) -> DataFrame:
    """The groups' columns, total, the fence of each rate and the median of each length."""
    merged = sketch.groupBy(*by, "name", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "name")
    ranked = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w), "low": F.expr(bucket_floor("bucket"))})
    at = lambda name, share: F.min(F.when((F.col("name") == name) & F.expr(share), F.col("low")))
    half, most = "2 * upto >= total", "5 * upto >= 4 * total"
    got = ranked.groupBy(*by).agg(F.max("total").alias("total"), *(at(x, half).alias(f"mid_{x}") for x in (*RATES, *LENGTHS)), *(at(r, most).alias(f"high_{r}") for r in RATES))
    out = [*by, "total", *(F.col(f"mid_{x}").alias(f"typical_{x}") for x in LENGTHS)]
    for r, (_, length, one) in RATES.items():
        step = f"mid_{r} div greatest(1, floor(sqrt(mid_{length})))" if one is None else f"{UNIT * one} div greatest(1, mid_{length})"
        out.append(F.expr(f"mid_{r} + {reach} * greatest(high_{r} - mid_{r}, {step})").cast("long").alias(f"max_{r}"))
    return got.select(*out)


def thresholds(sketch: DataFrame, groups: DataFrame, min_group: int = MIN_GROUP, reach: int = REACH) -> DataFrame:
    """t_lang, t_source of every one of ``groups`` (lang, source) with, for each rate, the largest value that is no outlier, and the typical lengths."""
    names = [*(f"typical_{x}" for x in LENGTHS), *(f"max_{r}" for r in RATES)]
    frames = [_fences(sketch, by, reach) for by in (["lang", "source"], ["lang"], [])]
    frames = [f.select(*(F.col(c).alias(f"{c}{k}") for c in f.columns)).withColumn(f"one{k}", F.lit(1)) for k, f in enumerate(frames)]
    own = groups.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), F.lit(1).alias("one")).distinct()
    own = own.join(frames[0], F.col("t_lang").eqNullSafe(F.col("lang0")) & F.col("t_source").eqNullSafe(F.col("source0")), "left")
    own = own.join(frames[1], F.col("t_lang").eqNullSafe(F.col("lang1")), "left").join(F.broadcast(frames[2]), F.col("one") == F.col("one2"), "left")  # one row
    pick = lambda c: F.when(F.col("total0") >= min_group, F.col(f"{c}0")).when(F.col("total1") >= min_group, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    return own.select("t_lang", "t_source", *(pick(c).alias(c) for c in names))


def judge(scored: DataFrame) -> DataFrame:
    """Join the thresholds and add ``kept``; the rows keep their columns."""
    limits = cut(thresholds(sketches(scored), scored.select("lang", "source")))
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    fits = ~F.col("base_failed")
    for r, (count, length, one) in RATES.items():
        share = f"greatest({length}, typical_{length})" if one else length
        fits = fits & F.expr(f"{UNIT} * {count} <= max_{r} * {share}")
    joined = scored.join(limits, scored["lang"].eqNullSafe(limits["t_lang"]) & scored["source"].eqNullSafe(limits["t_source"]), "left")
    return joined.withColumn("kept", F.coalesce(fits, F.lit(False))).drop("t_lang", "t_source")


def score(docs: DataFrame) -> DataFrame:
    """One row for each document: its counts, rates, thresholds and verdict.  Reads the texts once."""
    scored = cut(features(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return judge(scored).select("doc_id", *FEATURES, "base_failed", "kept", *RATES, *(f"max_{r}" for r in RATES))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns.  Counts are computed once and kept with the texts."""
    names = docs.columns
    plain = docs.select("doc_id", "lang", "source", "text", F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")).drop("text").withColumn("text", F.col("_row")["text"])
    scored = cut(features(plain).drop("text"))
    return judge(scored).filter("kept").select(*(F.col("_row")[c].alias(c) for c in names))

"""The operators' queries over whole tables, with production parameters, and their SQL where SQL can express them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.llm import copies, decontam, langid, licenses, packing, ppm, quality, sharding, simhash, toxicity, warc
from massif.llm.common import table

TOKENIZER, SMALL_SHARD = public_tokenizers.path("byte_bpe_50k.json"), 50_000


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def shard_buckets_50kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 with a limit that splits small tables, and single texts above it."""
    return sharding.buckets(table(spark, sf_dir, "documents"), SMALL_SHARD)


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER).drop("ids")


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 on instruction data, where only the assistant's tokens bear loss."""
    return packing.pack_conversations(table(spark, sf_dir, "conversations"), TOKENIZER)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_language_id, op3_extendible_shards, shard_buckets_50kb, op4_warc_round_trip, op5_decontamination, op6_lm_score, op7_license_scan, op8_packing, conversation_packing, op9_toxicity, op10_simhash)
    return {f.__name__: f for f in own}


def _quality_sql() -> str:
    unit, names = quality.UNIT, (*quality.RATES, *quality.LENGTHS)
    bucket = "CASE WHEN v < 64 THEN v ELSE 64 * (length(bin(v)) - 7) + (v >> (length(bin(v)) - 7)) END"
    floor = "CASE WHEN bucket < 64 THEN bucket ELSE (64 + bucket % 64) << CAST(bucket // 64 - 1 AS INT) END"
    # the group's median and 80th percentile of each name, its fences, and its typical lengths
    level = lambda by: f"""SELECT {by} max(total) AS total, {", ".join(f"min(CASE WHEN name = '{x}' AND 2 * upto >= total THEN {floor} END) AS mid_{x}" for x in names)}, {", ".join(f"min(CASE WHEN name = '{r}' AND 5 * upto >= 4 * total THEN {floor} END) AS high_{r}" for r in quality.RATES)}
      FROM (SELECT *, sum(n) OVER (PARTITION BY {by} name ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by} name) AS total
            FROM (SELECT {by} name, bucket, sum(n) AS n FROM sk GROUP BY {by} name, bucket)) {"GROUP BY " + by.rstrip(", ") if by else ""}"""  # noqa: E731
    step = lambda t, r, d, one: f"{t}.mid_{r} // greatest(1, CAST(floor(sqrt({t}.mid_{d})) AS BIGINT))" if one is None else f"{unit * one} // greatest(1, {t}.mid_{d})"
    fence = lambda t, r: f"{t}.mid_{r} + {quality.REACH} * greatest({t}.high_{r} - {t}.mid_{r}, {step(t, r, *quality.RATES[r][1:])})"
    pick = lambda f: f"CAST(CASE WHEN g2.total >= {quality.MIN_GROUP} THEN {f('g2')} WHEN g1.total >= {quality.MIN_GROUP} THEN {f('g1')} ELSE {f('g0')} END AS BIGINT)"
    limits = ", ".join([f"{pick(lambda t: fence(t, r))} AS max_{r}" for r in quality.RATES] + [f"{pick(lambda t: f'{t}.mid_{x}')} AS typical_{x}" for x in quality.LENGTHS])
    fits = " AND ".join(f"{unit} * {c} <= max_{r} * {f'greatest({d}, typical_{d})' if one else d}" for r, (c, d, one) in quality.RATES.items())
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rn, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    win AS (SELECT rn, i, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
    again AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM win) WHERE c > 1),
    rep AS (SELECT rn, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 5)) AS u(k) GROUP BY rn),
    f AS (SELECT w.rn, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(length(t) - length(regexp_replace(t, '[A-Z!]', '', 'g')) AS BIGINT) AS n_shout, len(ls) AS n_lines,
                 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
          FROM w LEFT JOIN rep ON rep.rn = w.rn),
    r AS (SELECT *, {", ".join(f"CAST(CASE WHEN {d} > 0 THEN {unit} * {c} // {d} ELSE 0 END AS BIGINT) AS {r}" for r, (c, d, _) in quality.RATES.items())},
                 n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM f),
    l AS (UNPIVOT (SELECT lang, source, {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in names)} FROM r WHERE NOT base_failed) ON {", ".join(names)} INTO NAME name VALUE v),
    sk AS (SELECT lang, source, name, CAST({bucket} AS BIGINT) AS bucket, count(*) AS n FROM l GROUP BY ALL),
    g2 AS ({level("lang, source, ")}), g1 AS ({level("lang, ")}), g0 AS ({level("")}),
    own AS (SELECT DISTINCT lang, source FROM r),
    p AS (SELECT own.lang, own.source, {limits} FROM own LEFT JOIN g2 ON g2.lang IS NOT DISTINCT FROM own.lang AND g2.source IS NOT DISTINCT FROM own.source LEFT JOIN g1 ON g1.lang IS NOT DISTINCT FROM own.lang LEFT JOIN g0 ON true)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {fits}, false) AS kept,
           {", ".join(quality.RATES)}, {", ".join(f"max_{r}" for r in quality.RATES)}
    FROM r JOIN p ON p.lang IS NOT DISTINCT FROM r.lang AND p.source IS NOT DISTINCT FROM r.source"""


def _buckets_sql(limit: int, deepest: int = 24) -> str:
    last = sharding.LAST_BIT
    return f"""
    d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k, coalesce(octet_length(encode(text)), 0) AS b FROM documents),
    c AS (SELECT depth, k >> CAST({last} - depth AS INT) AS p, sum(b) AS bytes FROM d, unnest(list_append(range(0, {deepest + 1}), {last})) AS u(depth) GROUP BY ALL),
    f AS (SELECT d.doc_id, d.k, d.b, min(c.depth) AS depth FROM d, c WHERE c.p = d.k >> CAST({last} - c.depth AS INT) AND (c.bytes <= {limit} OR c.depth = {last}) GROUP BY ALL),
    x AS (SELECT f.doc_id, 'b' || CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(f.k >> CAST({last} - f.depth AS INT)), CAST(f.depth AS INT), '0') END AS bucket,
           CAST(f.depth AS INT) AS depth, CAST(f.b AS BIGINT) AS n_bytes, CAST(c.bytes AS BIGINT) AS bucket_bytes
    FROM f JOIN c ON c.depth = f.depth AND c.p = f.k >> CAST({last} - f.depth AS INT))"""


def _licenses_sql() -> str:
    words = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[ \\t\\n\\x0B\\f\\r.,;:!?\"''()\\[\\]]+'), lambda x: x <> '')"
    known = ", ".join(f"('{name}', {k}, {t}, '{licenses.TEMPLATES[name]}')" for k, t, names in licenses.plan(licenses.TEMPLATES) for name in names)
    return f"""
    WITH tm(license_id, k, t, text) AS (VALUES {known}),
    tw AS (SELECT license_id, k, t, {words.format("text")} AS ws FROM tm),
    ts AS (SELECT DISTINCT license_id, k, t, array_to_string(ws[i:i + k - 1], ' ') AS g FROM tw, unnest(range(1, len(ws) - k + 2)) AS u(i)),
    n AS (SELECT license_id, count(*) AS n FROM ts GROUP BY license_id),
    d AS (SELECT row_number() OVER () AS rn, doc_id, {words.format("text")} AS ws FROM documents),
    kk AS (SELECT DISTINCT k FROM tm),
    s AS (SELECT rn, doc_id, k, len(ws) - k + 1 AS m, i - 1 AS i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM d, kk, unnest(range(1, len(ws) - k + 2)) AS u(i)),
    h AS (SELECT s.rn, s.doc_id, s.m, s.i, ts.license_id, ts.t, ts.g FROM s JOIN ts ON ts.g = s.g AND ts.k = s.k),
    j AS (SELECT *, unnest([i // t, i // t - 1]) AS j FROM h),
    x AS (SELECT rn, doc_id, license_id, t, j, count(DISTINCT g) AS c FROM j WHERE j >= 0 AND j <= greatest(0, CAST(ceil(m / t) AS BIGINT) - 2) AND i < j * t + 2 * t GROUP BY ALL)
    SELECT doc_id, x.license_id, max(c / n) AS containment, CAST(min(j * t) AS BIGINT) AS window_start
    FROM x JOIN n ON n.license_id = x.license_id WHERE c / n >= {licenses.CONTAINMENT} GROUP BY doc_id, x.license_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _quality_sql(), "op3_extendible_shards": f"WITH {_buckets_sql(sharding.LIMIT)} SELECT doc_id, bucket AS shard_id, depth, n_bytes, bucket_bytes AS shard_bytes FROM x",
            "shard_buckets_50kb": f"WITH {_buckets_sql(SMALL_SHARD)} SELECT * FROM x", "op7_license_scan": _licenses_sql()}


# ---- the pipeline's stages, on one another's output ----


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.filter_documents(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return copies.deduplicate(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.filter_documents(docs, table(spark, sf_dir, "benchmark"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, TOKENIZER).drop("ids")

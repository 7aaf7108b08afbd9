import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from massif.llm import common, copies, decontam, langid, licenses, packing, ppm, quality, sharding, simhash, toxicity, warc
from massif.llm import queries as q
from massif.llm.common import share_code

WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "un", "sel", "dor") for b in ("ra", "vin", "po", "", "est", "gul", "hem")]


@pytest.fixture(scope="module")
def spark(spark):
    share_code(spark)
    return spark


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def table(spark, rows):
    """Rows (doc_id, text) as documents with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en" if k % 3 else None, None if k % 5 == 0 else "s") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "_row": F.lit(1), "_w": F.lit("x"), "kept": F.lit("y"), "score": F.lit(2), "rejected": F.lit("z"), "fp": F.lit(3), "component_id": F.lit("c"), "key": F.lit(0), "uid": F.lit(9)})


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c"), (None, None), (5, "same words here again"), (5, "same words here again"), (6, prose(6, 60_000)), (7, "!!! 123"), (8, "\u00e9\u00df\u4e2d\U0001f600 caf\u00e9"), (9, "a " * 500)]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [(1, "x")]).limit(0)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows_and_empty_tables(spark, odd, empty):
    b, l = bench(spark, [(1, prose(1, 30)), (2, None), (3, "")]), labels(spark, [(1, 1, 0), (9, 1, 1), (None, 1, 1), (5, 0, None)])
    for f in (quality.score, langid.identify, sharding.assign, ppm.score, simhash.components, lambda d: toxicity.score(d, l)):
        assert f(odd).count() == len(ODD) and f(empty).count() == 0
    assert licenses.scan(odd).count() == decontam.matches(odd, b).count() == licenses.scan(empty).count() == decontam.matches(empty, b).count() == 0
    got = packing.pack_documents(odd, q.TOKENIZER).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert {r.doc_id: (r.n, r.m) for r in got.collect()}[1] == (1, 1) and packing.pack_documents(empty, q.TOKENIZER).count() == 0
    for f in (quality.filter_documents, langid.filter_documents, simhash.deduplicate, lambda d: decontam.filter_documents(d, b)):
        assert f(odd).columns == odd.columns and f(odd).count() <= len(ODD) and f(empty).count() == 0
    assert sorted(r.doc_id for r in simhash.deduplicate(odd).filter("doc_id is not null").collect()) == [1, 5, 6, 7, 8, 9]


# ---- 1 ----


def test_quality_counts(spark, odd):
    def plain(text):
        import re

        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(5)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    rows = [*ODD, (20, "x y\nx y\n\nx y\n a"), (21, "a b c d e f a b c d e g ## <b>"), (22, "\u00a0 \x1c z")]
    got = {r.doc_id: r for r in quality.score(table(spark, rows)).collect()}
    for i, t in rows:
        if i is not None:
            r, want = got[i], plain(t)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (r.kept is not None) and not (r.kept and r.base_failed)


def test_sketch_buckets(spark):
    v = spark.range(1, 5000).selectExpr("id as v").union(spark.sql("select 123456789L"))
    r = v.selectExpr("v", f"{quality.bucket('v')} as b").selectExpr("v", f"{quality.bucket_floor('b')} as low").collect()
    assert all(x.low <= x.v < x.low * (1 + 1 / 32) + 1 for x in r)


def test_thresholds_adapt_and_junk_goes(spark):
    rows = [(i, prose(i, 80 + i % 50)) for i in range(300)] + [(1000 + i, " ".join(w + "###" for w in prose(i, 50).split())) for i in range(20)]
    docs = table(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    kept = {r.doc_id for r in quality.filter_documents(docs).collect()}
    assert kept == set(range(300))


def test_fences_follow_each_source(spark):
    """A text with marks passes where marks are usual and goes where they aren't."""
    marked = lambda i, share: " ".join(w + ("#" if random.Random(i * 1000 + k).random() < share else "") for k, w in enumerate(prose(i, 120).split()))
    rows = [(i, "plain", prose(i, 120)) for i in range(300)] + [(1000 + i, "code", marked(i, 0.2)) for i in range(300)]
    rows += [(5000 + i, source, marked(i, 0.25)) for i, source in enumerate(("plain", "code"))]
    docs = spark.createDataFrame([(i, "en", s, t) for i, s, t in rows], "doc_id long, lang string, source string, text string")
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    assert not got[5000].kept and got[5001].kept and got[5000].max_symbol_rate < got[5001].max_symbol_rate
    assert sum(got[i].kept for i in range(300)) == 300 and sum(got[1000 + i].kept for i in range(300)) >= 299


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_extendible_shards", "shard_buckets_50kb", "op7_license_scan"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    where = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{where}/documents.parquet')")
    want = duck.execute(q.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in names]
    got = q.queries()[name](spark, where)
    assert sorted(got.columns) == names
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


# ---- 2 ----


def test_language_id_holds_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}


def test_language_logits_do_not_depend_on_blocks():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(size=(langid.BUCKETS, 3)), np.zeros(3)])
    texts = [prose(i, n) for i, n in enumerate((1, 400, 7))] + ["", "x"]
    before = langid.logits(texts, rows)
    langid.BLOCK, old = 64, langid.BLOCK
    try:
        assert np.allclose(langid.logits(texts, rows), before)
        assert np.allclose(langid.logits(texts[1:2], rows), before[1:2])
        idx, n = langid.counts(texts[1])
    finally:
        langid.BLOCK = old
    assert np.allclose((rows[idx] * (n / n.sum())[:, None]).sum(axis=0), before[1])


# ---- 3 ----


def test_shards_fit_and_only_large_buckets_split(spark):
    rows = [(i, "x" * (50 + i % 100)) for i in range(800)] + [(7, "y" * 300)] * 40
    got = sharding.assign(table(spark, rows), 2000).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in got:
        size[r.shard_id] += r.n_bytes
    assert all(s <= 2000 for s in size.values()) and all(size[r.shard_id] == r.shard_bytes for r in got)
    plain = {s[1:] for s in size if "." not in s}
    for s in plain:  # no proper prefix is a shard, and the parent was too large
        assert not any(s[:k] in plain for k in range(len(s)))
        assert not s or sum(v for k, v in size.items() if k[1:].startswith(s[:-1])) > 2000


def test_written_shards_of_hot_and_null_ids_fit(spark, tmp_path):
    rows = [(i, "x" * 100) for i in range(60)] + [(7, f"{k:03d}" + "y" * 297) for k in range(30)] + [(None, f"{k:03d}" + "z" * 197) for k in range(30)]
    docs = table(spark, rows)
    sharding.write(docs, str(tmp_path / "shards"), 2000)
    got = spark.read.parquet(str(tmp_path / "shards"))
    assert set(got.columns) == {*docs.columns, "shard_id"}
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(rows)
    assert all(r.n <= 2000 for r in got.groupBy("shard_id").agg(F.sum(F.length("text")).alias("n")).collect())


# ---- 4 ----


def test_loser_tree():
    rng = random.Random(4)
    for k in range(8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_warc_round_trip(spark):
    rows = [(1, "http://b.org/x", "same"), (2, "http://a.org/", "same"), (3, None, None), (4, "http://a.org/y?q", "caf\u00e9 \n\n"), (5, "http://a.org/", "same"), (6, "", ""), (None, "http://c.org", "same"), (7, "x:\n y", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), warc.digest(data))
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 5, None)] == [("revisit", 5), ("revisit", 5), ("response", None), ("revisit", 5)]
    assert (got[3].record_type, got[3].refers_to, got[6].record_type) == ("revisit", 6, "response")
    order = sorted(got.values(), key=lambda r: (r.merge_range, r.merge_position))
    assert [(r.urlkey, r.ts) for r in order] == sorted((r.urlkey, r.ts) for r in order)
    assert all(r.record_type == "response" for r in warc.round_trip(pages, 5).filter("payload_bytes < 5").collect())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_digests_that_are_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(warc, "HOT", 5)
    rows = [(i, f"http://h{i % 3}.org/{i % 7}", None if i % 4 == 0 else f"page {i % 9 if i % 2 else i}", "own") for i in range(120)] + [(200, "http://a.org", "twice", "x")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string").withColumns({"payload": F.lit(1), "run": F.lit("r"), "newest": F.lit(0)}).repartition(4)
    newest, seen = {}, Counter()
    for i, _, html, _ in rows:
        newest[html or ""] = max(i, newest.get(html or "", -1))
        seen[html or ""] += 1
    got = warc.round_trip(pages).collect()
    text = {i: html or "" for i, _, html, _ in rows}
    want = lambda i: ("response", None) if newest[text[i]] == i else ("revisit", newest[text[i]])
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows) and all((r.record_type, r.refers_to) == want(r.page_id) for r in got)
    order = sorted(got, key=lambda r: (r.merge_range, r.merge_position))
    assert [(r.urlkey, r.ts) for r in order] == sorted((r.urlkey, r.ts) for r in order)


# ---- 5 ----


def least_edits(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, d in enumerate(item, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_equals_the_table():
    r = random.Random(5)
    for _ in range(60):
        item, text = "".join(r.choices("ab ", k=r.randrange(1, 90))), "".join(r.choices("ab ", k=r.randrange(0, 120)))
        assert decontam.best_match(decontam.letters(item), len(item), text)[0] == least_edits(item, text)


def test_edited_passages_are_found_and_nothing_else(spark):
    r = random.Random(6)
    items = [(i, prose(1000 + i, 25 + i)) for i in range(12)]
    rows, want = [], set()
    for k in range(120):
        text = prose(k, 120)
        if k % 2:
            i, item = items[k % 12]
            item = list(decontam.normal(item))
            for _ in range(r.randrange(0, len(item) // 20 + 4)):
                at = r.randrange(len(item))
                item[at : at + 1] = r.choice([[], ["q"], [item[at], "z"]])
            text = f"{text} {''.join(item).upper()}, {prose(k + 500, 50)}"
        rows.append((k, text))
    for k, text in rows:
        for i, item in items:
            flat = decontam.normal(item)
            if least_edits(flat, decontam.normal(text)) <= decontam.budget(flat):
                want.add((k, i))
    docs, b = table(spark, rows), bench(spark, items)
    got = decontam.matches(docs, b).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and want
    assert {x.doc_id for x in decontam.filter_documents(docs, b).collect()} == set(range(120)) - {k for k, _ in want}


def test_short_items_are_whole_words(spark):
    docs = table(spark, [(1, "the quick fox"), (2, "a qu, sign"), (3, "QU"), (4, "two words here"), (5, "two wordshere")])
    got = decontam.matches(docs, bench(spark, [(1, "Qu"), (None, "two words"), (3, "fox")])).collect()
    assert sorted((r.doc_id, str(r.item_id), r.edits) for r in got) == [(1, "3", 0), (2, "1", 0), (3, "1", 0), (4, "None", 0)]
    assert {r.doc_id: r.match_end for r in got if r.item_id == 1} == {2: 4, 3: 2}


# ---- 6 ----


def test_trie_probabilities_sum_to_one():
    texts = [prose(i, 40).encode() for i in range(20)] + [b"", b"\xff\x00a"]
    keys, n = np.unique(np.concatenate([ppm.windows(p) for t in texts for p in ppm.pieces(t)]), return_counts=True)
    for kept in (n >= 1, n >= 3):
        short = ppm.summed(keys & np.uint64((1 << 8 * ppm.ORDER) - 1), n)
        trie = ppm.Trie(keys[kept], n[kept], *short)
        for context in (b"kara ", b"zzzzz", b"\0\0\0\0\0", b"qqqka", b"ter k", b"\xff\x00a\0\0"):
            at = int.from_bytes(context, "big") << 8
            assert (10.0 ** trie(np.arange(at, at + 256, dtype=np.uint64))).sum() == pytest.approx(1, abs=1e-5)
    assert ppm.Trie(*(np.zeros(0, np.int64),) * 4).score([b"ab"])[0] == pytest.approx(-3 * math.log10(256))


def test_lm_scores(spark, odd):
    rows = [*ODD, *((100 + i, prose(i, 30).upper()) for i in range(40))]
    docs = table(spark, rows)
    known, total = Counter(), 0
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            own = ppm.lowered(t).split() + [None]
            known.update(own)
            total += len(own)
    for frequent in (200_000, 5):
        got = ppm.score(docs, frequent=frequent).collect()
        assert len(got) == len(rows)
        for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, len((x[1] or "").split()))), strict=True):
            own = ppm.lowered(t).split() + [None]
            want = sum(math.log10((known[w] + 0.1) / (total + 0.1 * (len(known) + 1))) for w in own)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(known[w] > 0 for w in own), total)
            assert r.base_score == pytest.approx(want, rel=1e-9) and r.score < 0
            assert r.held_out == (i is None or zlib.crc32(str(i).encode()) % 10 == 0)


def test_lm_score_is_that_of_one_trie(spark, monkeypatch):
    rows = [*((i, t) for i, t in ODD if i is not None), *((100 + i, prose(i, 30) + " zq" * (i % 4)) for i in range(40)), (900, None)]
    texts = [ppm.lowered(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    keys, n = np.unique(np.concatenate([ppm.windows(p) for t in texts for p in ppm.pieces(t)]), return_counts=True)
    trie = ppm.Trie(keys, n, *ppm.summed(keys & np.uint64((1 << 8 * ppm.ORDER) - 1), n))
    want = sorted(trie.score([ppm.lowered(t) for _, t in rows]))
    for nodes, piece in ((ppm.NODES, 1 << 20), (50, 100), (0, 1)):
        monkeypatch.setattr(ppm, "PIECE", piece)
        assert sorted(r.score for r in ppm.score(table(spark, rows), nodes=nodes).collect()) == pytest.approx(want, rel=1e-5)


def plain_ppm(train, text):
    """PPM, method C with exclusion, symbol by symbol over dictionaries of contexts."""
    seen = {}
    for t in train:
        data = b"\0" * ppm.ORDER + t + b"\0"
        for i in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                seen.setdefault(data[i - k : i], Counter())[data[i]] += 1
    total, data = 0.0, b"\0" * ppm.ORDER + text + b"\0"
    for i in range(ppm.ORDER, len(data)):
        gone = set()
        for k in reversed(range(ppm.ORDER + 1)):
            left = {s: n for s, n in seen.get(data[i - k : i], {}).items() if s not in gone}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if data[i] in left:
                total += math.log10(left[data[i]] / whole)
                break
            total += math.log10(len(left) / whole)
            gone |= set(left)
        else:
            total -= math.log10(max(1, 256 - len(gone)))
    return total


def test_trie_equals_a_plain_model():
    train = [prose(i, 25).encode() for i in range(15)] + [b"", b"aaaa aaaa", b"\xff\x00a", b"kara kara"]
    keys, n = np.unique(np.concatenate([ppm.windows(p) for t in train for p in ppm.pieces(t)]), return_counts=True)
    trie = ppm.Trie(keys, n, *ppm.summed(keys & np.uint64((1 << 8 * ppm.ORDER) - 1), n))
    texts = [train[0], prose(99, 20).encode(), b"", b"zzz qq", b"aaaaaaaaaa", b"\xfe\x01", b"karavin kara"]
    assert trie.score(texts) == pytest.approx([plain_ppm(train, t) for t in texts], rel=1e-5)


# ---- 7 ----


def test_licenses(spark):
    grant = licenses.TEMPLATES["MIT-grant"]
    rows = [(i, f"{prose(i, 10 * i)}\n{t.upper()}\n{prose(i + 50, 700)}") for i, t in enumerate(licenses.TEMPLATES.values())]
    rows += [(50, grant.replace("sublicense", "sublet")), (51, " ".join(grant.split()[:40])), (52, "all rights were reserved"), (53, prose(3, 300))]
    got = {(r.doc_id, r.license_id): r.containment for r in licenses.scan(table(spark, rows)).collect()}
    assert all(got[i, name] == 1.0 for i, name in enumerate(licenses.TEMPLATES)) and 0.8 <= got[50, "MIT-grant"] < 1
    assert not {i for i, _ in got} & {51, 52, 53}
    assert licenses.scan(table(spark, rows), {}).count() == 0


def test_a_license_match_at_the_threshold_passes_the_filter(spark):
    text = licenses.TEMPLATES["MIT-grant"].replace("restriction", "limits").replace("associated documentation", "related manual")
    got = {(r.doc_id, r.license_id): r.containment for r in licenses.scan(table(spark, [(1, text)])).collect()}
    assert got == {(1, "MIT-grant"): 0.8}


# ---- 8 ----


def test_packing_round_trip(spark, odd):
    texts = [t for _, t in ODD if t] + ["a<|endoftext|>b", "  x\n\n y\t", prose(1, 3000)]
    tok = Tokenizer.from_file(q.TOKENIZER)
    encode = packing.encoder(q.TOKENIZER)
    old, packing.BLOCK = packing.BLOCK, 50
    try:
        assert all(encode(t) == tok.encode(t, add_special_tokens=False).ids for t in texts)
    finally:
        packing.BLOCK = old
    rows = [(i, prose(i, (i * 37) % 400)) for i in range(300)] + [(1000 + i, "a") for i in range(500)]
    got = packing.pack_documents(table(spark, rows), q.TOKENIZER).collect()
    docs, sequences = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        assert [x for r in sorted(docs[i], key=lambda r: r.start) for x in r.ids] == ids and docs[i][0].doc_tokens == len(ids)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        n = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert n <= 1024 and n & (n - 1) == 0 and len(own) <= packing.SEGMENTS


def test_packing_keeps_all_three_limits():
    r = np.random.default_rng(0)
    items = [(r.random(int(n)) < p).astype(int) for n, p in zip(r.integers(1, 90, 400), r.random(400), strict=True)]
    for cut in (True, False):
        packer, got = packing.Packer(100, 5, 60, cut), []
        items = [x if x.sum() <= 60 else x * 0 for x in items]
        for i, flags in enumerate(items):
            got += packer.add(i, flags)
        got += packer.finish()
        seen = Counter()
        for sequence in got:
            assert sum(n for _, _, n in sequence) <= 100 and len(sequence) <= 5
            assert sum(items[i][a : a + n].sum() for i, a, n in sequence) <= 60
            seen.update((i, k) for i, a, n in sequence for k in range(a, a + n))
        assert len(seen) == sum(map(len, items)) and set(seen.values()) == {1}


def test_packing_conversations(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", prose(c * 9 + t, 20 + t)) for c in range(40) for t in range(4)]
    rows += [(99, 0, "assistant", prose(5, 900))] + [(7, 0, "user", "again")] * 3 + [(None, None, None, None), (8, None, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = packing.pack_conversations(turns, q.TOKENIZER).collect()
    tok, want, seen = Tokenizer.from_file(q.TOKENIZER), Counter(), Counter()
    for c, t, role, text in rows:
        n = len(tok.encode(text or "", add_special_tokens=False).ids) + 1
        want[c, t] += n
        want[c, t, "loss"] += n * (role == "assistant")
    sequences = {}
    for r in got:
        seen[r.conv_id, r.turn] += r.length
        seen[r.conv_id, r.turn, "loss"] += r.loss_tokens
        sequences.setdefault(r.sequence_id, []).append(r)
    assert seen == want
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 1024 and sum(r.loss_tokens for r in own) <= 512 and len(own) <= packing.SEGMENTS
    assert max(sum(r.loss_tokens for r in own) for own in sequences.values()) > 400  # the loss limit binds here
    assert packing.pack_conversations(turns.limit(0), q.TOKENIZER).count() == 0


# ---- 9 ----


def test_ordinal_grades(spark):
    bad = {1: "rude", 2: "nasty", 3: "vile"}
    rows = [(i, prose(i, 60) + (f" {bad[i % 4]}!" if i % 4 else "")) for i in range(800)]
    l = labels(spark, [(i, 1, i % 4) for i in range(0, 800, 1) if i % 5])
    got = {r.doc_id: r for r in toxicity.score(table(spark, rows), l).collect()}
    held = [i for i in range(800) if i % 5 == 0]
    assert sum(got[i].severity_grade == i % 4 for i in held) / len(held) > 0.95
    means = [np.mean([got[i].expected_severity for i in held if i % 4 == g]) for g in range(4)]
    assert means == sorted(means) and all(got[i].toxic == (i % 4 > 0) for i in held)
    assert not any(r.toxic for r in toxicity.score(table(spark, rows), l.limit(0)).collect())


def test_ordinal_fit_reaches_the_plain_optimum():
    """The fitted weights are as good as plain descent on the penalised likelihood, written out row by row."""
    rng = np.random.default_rng(9)
    rows, grades = [], []
    for i in range(240):
        g = i % 3
        rows.append(np.unique(np.concatenate([rng.integers(100, 160, 12), [1 + g] * (rng.random() < 0.8), rng.integers(1000 + 50 * i, 1050 + 50 * i, 3)]).astype(np.int64)))
        grades.append(g)
    grades = np.array(grades)
    model = toxicity.fit(rows, grades)
    used = np.flatnonzero(model.weights)
    x = np.array([[c in set(r.tolist()) for c in used] for r in rows], float)
    weight = np.array([1 / (grades == g).sum() for g in grades]) / 3

    def loss(w, theta):
        total = toxicity.L1 * np.abs(w).sum()
        for row, g, share in zip(x @ w, grades, weight, strict=True):
            up = 1.0 if g == 2 else 1 / (1 + math.exp(-(theta[g] - row)))
            low = 0.0 if g == 0 else 1 / (1 + math.exp(-(theta[g - 1] - row)))
            total -= share * math.log(max(up - low, 1e-9))
        return total

    found = loss(model.weights[used].astype(float), model.thresholds)
    point = np.concatenate([model.weights[used].astype(float), model.thresholds])
    for size in (0.1, 0.03):  # no coordinate alone, nor a common scale, makes it much better
        for k in range(len(point)):
            for sign in (-1, 1):
                moved = point.copy()
                moved[k] += sign * size
                if moved[-2] < moved[-1]:
                    assert loss(moved[:-2], moved[-2:]) > found - 2e-3
    assert found < 0.6 * loss(np.zeros(len(used)), np.array([-math.log(2), math.log(2)]))
    z = x @ model.weights[used]
    assert model.thresholds[0] < model.thresholds[1] and np.mean((z[:, None] > model.thresholds).sum(axis=1) == grades) > 0.75


# ---- 10 ----


def plain_fingerprint(text):
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(points, linked):
    up = {p: p for p in points}

    def find(p):
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        return p

    for a in points:
        for b in points:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {p: find(p) for p in points}


def test_fingerprints_and_components(spark, odd):
    rows = ODD + [(30 + i, prose(i // 4, 200) + (" extra" * (i % 4 == 3))) for i in range(40)]
    got = simhash.components(table(spark, rows)).collect()
    prints = {}
    for i, t in rows:
        if i is not None:
            prints.setdefault(i, plain_fingerprint(t))
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}"
    want = roots(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want


@pytest.mark.parametrize("cell", [64, 2])
def test_links_equal_brute_force(spark, cell):
    r = random.Random(cell)
    points = {r.getrandbits(64) for _ in range(150)}
    for p in sorted(points)[:20]:
        for _ in range(12):  # chains of near copies
            for b in r.sample(range(64), r.choice([1, 2, 3])):
                p ^= 1 << b
            points.add(p)
    signed = sorted(int(np.array(p, np.uint64).view(np.int64)) for p in points)
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, cell)
    got = {x.node: x.root for x in simhash.closure(edges).collect()}
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    assert {p: got.get(p, p) for p in signed} == roots(signed, apart)
    for tau in (0, 1, 3):
        found = {tuple(sorted((x.a, x.b))) for x in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), tau, 1 << 20).collect()}
        assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= tau}


def test_thresholds_satisfy_the_principle():
    rng = np.random.default_rng(1)
    sample = rng.integers(-(2**63), 2**63 - 1, 500).tolist()
    parts = simhash.plan(sample, 10**6, 2)
    used = [m & (2**64 - 1) for m, _ in parts]
    assert all(a & b == 0 for i, a in enumerate(used) for b in used[:i])


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(r, text, share):
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split())


def test_near_copies_equal_brute_force(spark):
    r = random.Random(8)
    line = prose(999, 40)
    rows = list(ODD) + [(100 + i, f"{line} {prose(i, r.randrange(5, 300))}") for i in range(60)]
    for k in range(25):  # copies of copies, about 0.7 to 1 alike
        text = prose(500 + k, 100 + 10 * k)
        rows += [(1000 + 10 * k + j, edited(r, text, share)) for j, share in enumerate((0, 0.005, 0.01, 0.02, 0.03, 0.04))]
    hot = prose(77, 150)
    rows += [(2000 + i, edited(r, hot, 0.01 if i % 2 else 0.03)) for i in range(60)] + [(3000 + i, hot) for i in range(20)]
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, plain_set(t))
    want = roots(sorted(sets), lambda a, b: similar(sets[a], sets[b]))
    near = sum(similar(sets[a], sets[b]) and sets[a] != sets[b] for a in sets for b in sets if a < b)
    prints = {i: plain_fingerprint(t) for i, t in rows if i is not None and 1000 <= i < 1250}
    wide = sum((prints[a] ^ prints[b]).bit_count() > 2 for a in prints for b in prints if a < b and similar(sets[a], sets[b]))
    assert near > 100 and wide > 20
    docs = table(spark, rows)
    got = {x.doc_id: x.component_id for x in copies.components(docs, cell=2).collect() if x.doc_id is not None}
    assert got == want
    kept = q.stage_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.filter("doc_id is not null").collect()) == sorted(set(want.values()))
    assert copies.deduplicate(docs.limit(0)).count() == 0


def test_sets_of_crowded_cells_are_ordered_by_all_of_them(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    shared = word(40)
    texts = [" ".join(word(60) + shared) for _ in range(60)]
    texts += [" ".join([*texts[0].split()[:-1], "z"]), " ".join([*texts[1].split()[:-1], "y"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), 1 << 30
    monkeypatch.setattr(copies, "_frequent", lambda docs, k: none)  # a sample that has none of them
    first = copies._cells(copies.index(docs), 4).cache()
    assert first.filter("b is null").count() > 0
    distinct = copies.described(docs).groupBy("fp").agg(F.first("n").alias("n"), F.min("mark").alias("mark"))
    sets = copies._sets(docs, distinct, first.filter("b is null").select(F.col("a").alias("fp")).distinct(), copies.SHINGLE).cache()
    assert sets.count() == len(texts)
    again = copies._cells(copies.reindex(sets), 4)
    assert again.filter("b is null").count() == 0
    got = {x.doc_id: x.component_id for x in copies.components(docs, cell=4).collect()}
    assert got == {k: k for k in range(60)} | {60: 0, 61: 1}


def test_driver_collects_its_garbage_when_its_heap_is_large(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "swept", calls.append)
    monkeypatch.setattr(common, "HEAP", 2.0)
    common.cut(spark.range(1))
    assert not calls
    monkeypatch.setattr(common, "HEAP", 0.0)
    assert common.cut(spark.range(3)).count() == 3 and len(calls) == 1


# ---- pipeline ----


def test_pipeline(spark, data):
    """Each stage against a plain version of it, on what the stage before kept."""
    import duckdb

    import corpus_pipeline

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    docs, kept = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, out))
        assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
        if name == "quality rules":
            assert set(after) == {i for i, ok in duck.execute(f"SELECT doc_id, kept FROM ({q.oracle_sql()['op1_quality_rules']})").fetchall() if ok}
        if name == "simhash near-dedup":
            sets = {i: plain_set(t) for i, t in before.items()}
            assert set(after) == set(roots(sorted(sets), lambda a, b: similar(sets[a], sets[b])).values())
        if name == "benchmark decontamination":
            items = [decontam.normal(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            for i, text in before.items():
                flat = decontam.normal(text)
                whole = any(item and item in flat for item in items)
                assert not (whole and i in after)
                if i not in after and not whole:
                    assert any(decontam.best_match(decontam.letters(x), len(x), flat)[0] <= decontam.budget(x) for x in items if x)
        kept.append(set(after))
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert all(kept) and len(kept[0]) > len(kept[-1])
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in rows} == kept[-1]
    size = Counter()
    for r in rows:
        size[r.doc_id] += r.length
    assert all(size[r.doc_id] == r.doc_tokens for r in rows)


def test_passages_that_many_texts_share_fill_no_cells(spark):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    passages = [word(40) for _ in range(30)]
    docs = spark.createDataFrame([(f"{word(60)} {passages[i % 30]} {word(60)}",) for i in range(900)], "text string")  # 30 of each: more than a cell
    short = spark.range(120_000).select(F.concat_ws(" ", *(F.xxhash64("id", F.lit(k)).cast("string") for k in range(5))).alias("text"))
    assert copies._cells(copies.index(docs.unionByName(short)), copies.CELL).count() == 0

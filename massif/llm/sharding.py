"""Sharding by extendible hashing (operator 3).

A row's key is the leading 60 bits of the MD5 of its doc_id.  The directory is indexed by the leading
``depth`` bits of the key; a bucket is a prefix, and only a bucket of more than ``limit`` bytes is split on
one more bit.  The rows are read once: their bytes are added up for each directory cell, with partial
sums before the shuffle; every cell adds its bytes to each of its prefixes, and its bucket is the shortest
prefix that fits.  Cells that are still too large at the directory's depth are opened once more, by whole
keys, for their rows alone.  So the directory takes two rounds whatever the data, and each row is joined
once with its cell and, in cells that were opened, once with its key.

Rows of one key share all bits (a copied id, or null ids).  If they are too large together, their bucket has
``LAST_BIT`` bits and is dealt on in parts of a quarter of the limit and, where that isn't enough, by running
bytes; a row of more than half the limit is then a shard of its own.

Defined results: null ids hash as one key, null texts have zero bytes and still need a shard; equal
rows are equal keys, dealt on as above; empty tables give no rows; other columns are ignored, and
``write`` keeps them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.llm.common import cut, fresh, held

LIMIT, LAST_BIT, SHALLOW = 16 << 20, 60, 12


def key_of(doc_id: Column) -> Column:
    """The leading 60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftright(key, LAST_BIT - depth) if depth else F.lit(0).cast("long")


def _buckets(cells: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """at, depth, prefix, bucket_bytes: for each cell (at: ``last`` bits, bytes) its shortest prefix of ``first`` bits or more that fits; no row where none does."""
    each = cells.select("at", "bytes", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(at, {last} - depth)"))
    sums = cut(each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bucket_bytes")).filter(F.col("bucket_bytes") <= limit))
    shallow = each.filter(F.col("depth") <= SHALLOW).join(F.broadcast(sums.filter(F.col("depth") <= SHALLOW)), ["depth", "prefix"])  # fewer than 2 ** 13 prefixes
    deep = each.filter(F.col("depth") > SHALLOW).join(sums.filter(F.col("depth") > SHALLOW), ["depth", "prefix"])
    best = shallow.unionByName(deep).groupBy("at").agg(F.min(F.struct("depth", "prefix", "bucket_bytes")).alias("b"))
    return best.select("at", "b.depth", "b.prefix", "b.bucket_bytes")


def directory(sizes: DataFrame, limit: int = LIMIT) -> tuple[int, DataFrame, DataFrame]:
    """The directory's depth, the buckets of its cells (none for cells that are too large), and those of the keys in the others."""
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
    depth = min(LAST_BIT - 1, (max(1, -(-total // limit)) - 1).bit_length() + 2)
    cells = cut(sizes.groupBy(_prefix(F.col("key"), depth).alias("at")).agg(F.sum("bytes").alias("bytes")))
    fine = cut(_buckets(cells, 0, depth, limit))
    large = sizes.join(held(cells.filter(F.col("bytes") > limit).select(F.col("at").alias("large"))), _prefix(F.col("key"), depth) == F.col("large"), "left_semi")
    keys = cut(large.groupBy(F.col("key").alias("at")).agg(F.sum("bytes").alias("bytes")))
    found = _buckets(keys, depth + 1, LAST_BIT, limit)
    none = keys.filter(F.col("bytes") > limit).select("at", F.lit(LAST_BIT).alias("depth"), F.col("at").alias("prefix"), F.col("bytes").alias("bucket_bytes"))
    return depth, fine, cut(found.unionByName(none))


def buckets(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each document, before large keys are dealt on: doc_id, bucket, depth, n_bytes, bucket_bytes."""
    return _placed(docs.select("doc_id", "text"), limit).select("doc_id", F.col("_bucket").alias("bucket"), F.col("_depth").alias("depth"), F.col("_size").alias("n_bytes"), F.col("_total").alias("bucket_bytes"))


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each document: doc_id, shard_id, depth, n_bytes, shard_bytes.

    shard_id is the bucket's bits; where one key alone is too large, with the parts' numbers behind.
    """
    placed = _placed(docs.select("doc_id", "text"), limit).drop("text")
    return _dealt(placed, limit).select("doc_id", F.col("_bucket").alias("shard_id"), F.col("_depth").alias("depth"), F.col("_size").alias("n_bytes"), F.col("_total").alias("shard_bytes"))


def _placed(docs: DataFrame, limit: int) -> DataFrame:
    """The rows with _key, _size, _mark, _bucket, _depth and _total; columns of these names must not be there."""
    rows = docs.withColumns({"_key": key_of(F.col("doc_id")), "_size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "_mark": F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))})
    depth, fine, opened = directory(cut(rows.select(F.col("_key").alias("key"), F.col("_size").alias("bytes"))), limit)
    names = ("depth", "prefix", "bucket_bytes")
    cell, key = fine.select(F.col("at").alias("_cell"), *(F.col(c).alias(f"_a_{c}") for c in names)), opened.select(F.col("at").alias("_whole"), *(F.col(c).alias(f"_b_{c}") for c in names))
    got = rows.join(held(cell), _prefix(F.col("_key"), depth) == F.col("_cell"), "left").join(held(key), F.col("_key") == F.col("_whole"), "left")
    got = got.withColumns({f"_{c}": F.coalesce(f"_a_{c}", f"_b_{c}") for c in names})
    bits = F.expr("concat('b', lpad(bin(_prefix), _depth, '0'))")
    return got.select(*docs.columns, "_key", "_size", "_mark", bits.alias("_bucket"), F.col("_depth").cast("int").alias("_depth"), F.col("_bucket_bytes").alias("_total"))


def _dealt(rows: DataFrame, limit: int) -> DataFrame:
    """Split buckets of one key: rows are dealt at random into quarters of the limit, and a part that still is too large by running bytes."""
    large = cut(rows.filter(F.col("_total") > limit).withColumn("_cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.greatest(F.lit(1), F.ceil(F.col("_total") * 4 / F.lit(limit)).cast("long")))))
    if not large.limit(1).count():
        return rows
    w = Window.partitionBy("_bucket", "_cell").orderBy("_mark", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    # a part holds what starts within one half of the limit; a row over that half is a part of its own
    half = F.lit(max(1, limit // 2))
    before = large.withColumn("_upto", F.coalesce(F.sum(F.when(F.col("_size") <= half, F.col("_size")).otherwise(0)).over(w), F.lit(0)))
    alone = F.when(F.col("_size") > half, F.concat(F.lit("x"), F.monotonically_increasing_id().cast("string"))).otherwise(F.floor(F.col("_upto") / half).cast("string"))
    placed = cut(before.withColumn("_bucket", F.concat_ws(".", "_bucket", F.col("_cell").cast("string"), alone)).drop("_cell", "_upto", "_total"))
    return rows.filter(F.col("_total") <= limit).unionByName(placed.join(placed.groupBy("_bucket").agg(F.sum("_size").alias("_total")), "_bucket"))


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write the documents with their columns as Parquet, one folder for each shard (column ``shard_id``, or that with underscores before if the documents have one)."""
    name = fresh(docs, "shard_id")["shard_id"]
    whole = _placed(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")), limit)
    rows = _dealt(whole.drop("text"), limit).select("_row.*", F.col("_bucket").alias(name))
    rows.repartition(name).write.partitionBy(name).parquet(path)

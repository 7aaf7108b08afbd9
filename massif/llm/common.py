"""What the operators share: table access, lineage cuts, word splitting and pass-through Arrow maps."""

import ctypes
import gc
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points that end a word: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Texts in an Arrow batch.
TEXTS = 1000
#: Share of the largest heap that the driver's may take before its garbage is collected.
HEAP = 0.6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table, with this package at hand for Python workers."""
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _local(spark: SparkSession) -> bool:
    """Whether driver and workers are one machine's processes."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def short_batches(spark: SparkSession) -> None:
    """Let Spark pass texts to Python TEXTS at a time, unless the session says otherwise: a batch is held several times outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's own value
        spark.conf.set(name, str(TEXTS))


def give_back() -> None:
    """Return the memory that this process no longer uses to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # only glibc has it


def released(run):
    """The map function, with the memory that its buffers took given back at the end of each partition: workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package: from the driver's folder if that is theirs too, else from a zip that Spark sends them."""
    short_batches(spark)
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    paths = [p for p in sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if str(root) in paths or getattr(sc, "_massif_code", False):
        return
    if _local(spark):
        sc.environment["PYTHONPATH"] = os.pathsep.join([str(root), *paths])
        return
    with tempfile.TemporaryDirectory() as folder:  # addPyFile copies it to Spark's own file server
        name = f"{folder}/massif-code.zip"
        with zipfile.ZipFile(name, "w") as out:
            for f in sorted((root / "massif").rglob("*.py")):
                out.write(f, f.relative_to(root))
        sc.addPyFile(name)
    sc._massif_code = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only on a single machine whose session names none (tests)."""
    short_batches(spark)
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not _local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="massif-checkpoint-")
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a replicated, shared checkpoint."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    eased(df.sparkSession)
    return out


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer used; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def eased(spark: SparkSession) -> None:
    """Collect the driver's garbage if its heap has grown large: plans of many steps fill it, and only a whole collection gives memory back."""
    runtime = spark._jvm.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP * runtime.maxMemory():
        swept(spark)


def held(small: DataFrame, rows: int = 500_000) -> DataFrame:
    """The frame, to be broadcast if it has few rows (of a few numbers or short strings); else it is joined by shuffling."""
    return F.broadcast(small) if small.count() <= rows else small


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"))


def window_hashes(words: Column, k: int) -> Column:
    """The 64-bit hash of each run of k words."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(words, i + j) for j in range(1, k))))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id has remainder 0, so it is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """For each wanted column name one that does not clash with the frame's own."""
    have, out = {c.lower() for c in df.columns}, {}
    for name in names:
        new = name
        while new.lower() in have:
            new = f"_{new}"
        have.add(new.lower())
        out[name] = new
    return out


def slices(batch: pa.RecordBatch, rows: int = 256):
    """A batch in pieces, so that Python holds the objects of a few texts at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def with_arrow(df: DataFrame, reads: list[str], adds: T.StructType, fn) -> DataFrame:
    """Append columns made by ``fn``; every input column passes through untouched.

    ``fn(batches)`` takes an iterator of tuples of Python lists, one list for each column of
    ``reads``, and yields for each a list of Arrow arrays in the order of ``adds``.
    Added columns replace input columns of the same name, in whatever case.
    """
    new = {c.lower() for c in adds.fieldNames()}
    keep = [c for c in df.columns if c.lower() not in new]
    at = [df.columns.index(c) for c in reads]
    kept_at = [df.columns.index(c) for c in keep]
    schema = T.StructType([df.schema[c] for c in keep] + list(adds.fields))

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                made = fn(tuple(batch.column(i).to_pylist() for i in at))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept_at] + list(made), names=schema.fieldNames())

    return df.mapInArrow(released(run), schema)

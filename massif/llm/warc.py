"""WARC archives with an external index merge (operator 4).

``write_archives``: each task streams its records into one archive of gzip members in the shared
folder.  Of records whose payloads are equal and have at least ``min_bytes`` bytes, those with the
largest page_id are ``response``, the others ``revisit`` records without a payload that refer to it.
A file is named after its attempt, and only the names that a finished attempt returns are used, so a
lost executor leaves at worst a file that nothing refers to.  Payloads are compared by their SHA-1 and are
not shuffled: of the digests that repeat, those of more than ``HOT`` records (or all, if they are few) are
broadcast, and only records of the others meet by digest, at most ``HOT`` of them on one.

``read_archives`` streams the archives back, one record at a time, and checks lengths and digests.

``merge_index``: each archive's captures are a run sorted by (URL key, timestamp, page_id).  Ranges of
that order, ties in the order of the runs, are dealt to tasks, so that a URL, or one capture, with very
many records is split too; each task merges its slices of the runs with a loser tree.  Ranges follow each other, so (range, position) is
the global order of all captures, and a URL's captures are its history.

A timestamp column is optional; without it a capture's time is EPOCH + page_id seconds.

Defined results: a null html is an empty payload; null page_ids come before all others and a revisit
may refer only to rows with one; rows that share the largest page_id of a payload are all responses;
a null URL has the empty key; empty tables give no rows; other columns are ignored, whatever their names.
"""

import base64
import gzip
import hashlib
import io
import uuid
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.llm.common import cut, remove, shared_dir

EPOCH, LEVEL, RANGE_ROWS, HOT = datetime(2020, 1, 1, tzinfo=UTC), 1, 50_000, 10_000
#: Seconds after EPOCH that still have a date of four digits; and digests up to which a table of them is broadcast.
SECONDS, BROADCAST_ROWS = 251_000_000_000, 500_000
_ID = "urn:massif:page:"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, urlkey string, ts string, run string, seq long"


def url_key(url: str | None) -> str:
    """Host labels backwards, then path and query: com,example,www)/path?query"""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return host + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _target(folder: str):
    """The file system and path of a folder that Spark names by URI."""
    if "://" not in folder and not folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(folder)


def record_bytes(page_id, url, payload: bytes, full_digest: str, stamp: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    name = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{name}>", f"WARC-Date: {stamp}", f"WARC-Payload-Digest: sha1:{full_digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", " ").replace("\n", " "))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def read_records(stream):
    """(headers, payload) of each record of an open archive; payload is None for revisits."""
    with gzip.GzipFile(fileobj=stream) as data:
        reader = io.BufferedReader(data, 1 << 16)
        while True:
            line = reader.readline()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {line[:40]!r}")
            head: dict[str, str] = {}
            while (line := reader.readline()).strip():
                key, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
                head[key.lower()] = value
            length = int(head["content-length"])
            block = reader.read(length)
            if len(block) != length:
                raise ValueError("an archive ends within a record")
            yield head, None if head["warc-type"] == "revisit" else block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, ts: str | None = None) -> DataFrame:
    """Write one archive for each task; returns archive, n_records, n_bytes (computed once)."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"), (F.col(ts).cast("timestamp") if ts else F.lit(None).cast("timestamp")).alias("ts"))
    base = base.withColumn("sha", F.sha1("payload"))
    best = base.filter(F.length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).filter("n > 1")
    best = cut(best)
    few = best.count() <= BROADCAST_ROWS
    hot = (best if few else best.filter(F.col("n") > HOT)).select(F.col("sha").alias("hot"), F.col("newest").alias("newest_hot"))
    rows = base.join(F.broadcast(hot) if few or hot.count() <= BROADCAST_ROWS else hot, F.col("sha") == F.col("hot"), "left").withColumnRenamed("newest_hot", "newest")
    if not few:  # records of hot digests have theirs, and are spread
        rest = best.filter(F.col("n") <= HOT).select(F.col("sha").alias("other"), F.col("newest").alias("newest_other"))
        own = F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit("hot"), F.monotonically_increasing_id().cast("string")))
        rows = rows.withColumn("at", own).join(rest, F.col("at") == F.col("other"), "left").withColumn("newest", F.coalesce("newest", "newest_other"))
    rows = rows.select("page_id", "url", "payload", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.when(F.coalesce(F.col("page_id") < F.col("newest"), F.col("page_id").isNull() & F.col("newest").isNotNull()), F.col("newest")).alias("refers_to"))

    def run(batches):
        system, path = _target(folder)
        context, out, n, size = TaskContext.get(), None, 0, 0
        name = f"{path.rstrip('/')}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for page_id, url, payload, stamp, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
                page_id, url, payload, stamp, refers = (x.as_py() for x in (page_id, url, payload, stamp, refers))
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(name, compression=None)  # the members are compressed already
                stamp = stamp or (EPOCH + timedelta(seconds=(page_id or 0) % SECONDS)).strftime("%Y-%m-%dT%H:%M:%SZ")
                member = gzip.compress(record_bytes(page_id, url, payload, digest(payload), stamp, refers), LEVEL, mtime=0)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name.rpartition("/")[2]], "n_records": [n], "n_bytes": [size]})

    return cut(rows.mapInArrow(run, "archive string, n_records long, n_bytes long"))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the archives; a revisit has no payload_bytes yet, and the digest that it names."""

    def run(batches):
        system, path = _target(folder)
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "urlkey", "ts", "run", "seq"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        number = lambda x: None if x is None or x.strip("<>").removeprefix(_ID) == "null" else int(x.strip("<>").removeprefix(_ID))
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with system.open_input_file(f"{path.rstrip('/')}/{archive}") as stream:
                    for seq, (head, payload) in enumerate(read_records(stream)):
                        named = head["warc-payload-digest"].removeprefix("sha1:")
                        if payload is not None and digest(payload) != named:
                            raise ValueError(f"{archive}: the payload of {head['warc-record-id']} has another digest")
                        url = head.get("warc-target-uri")
                        rows.append((number(head["warc-record-id"]), url, head["warc-type"], number(head.get("warc-refers-to")), None if payload is None else len(payload), named, url_key(url), head["warc-date"], archive, seq))
                        if len(rows) >= 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n = max(1, archives.count())
    return archives.select("archive").repartition(n).mapInArrow(run, RECORD)


class LoserTree:
    """k-way merge: the losers of a tournament of the runs' heads; each step replays one path."""

    def __init__(self, runs: list, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads = [self._next(i) for i in range(self.k)]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _next(self, i: int):
        item = next(self.runs[i], None) if i < len(self.runs) else None
        return None if item is None else (self.key(item), item)

    def _less(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a][0], a) < (self.heads[b][0], b)

    def _replay(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other == -1:  # while building: wait here for the opponent
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.heads[winner := self.tree[0]] is not None:
            yield self.heads[winner][1]
            self.heads[winner] = self._next(winner)
            self._replay(winner)


def merge_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Append merge_range and merge_position: the captures' place in the global (urlkey, ts, page_id, run, seq) order."""
    runs = cut(captures.sortWithinPartitions("urlkey", "ts", "page_id"))
    ranges = max(1, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(ranges, "urlkey", "ts", "page_id", "run", "seq")
    names, at = dealt.columns, {c: i for i, c in enumerate(dealt.columns)}
    schema = dealt.schema

    def run(batches):
        slices: dict[str, list] = {}
        for batch in batches:  # one range: at most about range_rows rows
            cols = batch.to_pydict()
            for row in zip(*(cols[c] for c in names), strict=True):
                slices.setdefault(row[at["run"]], []).append(row)
        key = lambda r: (r[at["urlkey"]] or "", r[at["ts"]] or "", r[at["page_id"]] is not None, r[at["page_id"]] or 0, r[at["run"]], r[at["seq"]])
        ordered = [own if all(key(a) <= key(b) for a, b in zip(own, own[1:], strict=False)) else sorted(own, key=key) for _, own in sorted(slices.items())]
        merged = list(LoserTree(ordered, key))
        if merged:
            part = TaskContext.get().partitionId()
            arrays = [pa.array(c, k) for c, k in zip(zip(*merged, strict=True), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(merged), pa.int32()), pa.array(range(len(merged)), pa.int64())], names=[*names, "merge_range", "merge_position"])

    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    arrow = [kinds[f.dataType.simpleString()] for f in schema.fields]
    return dealt.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields) + ", merge_range int, merge_position long")


def round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, ts: str | None = None) -> DataFrame:
    """Write, read back and index all pages; the archives stay if ``folder`` is given.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, urlkey, ts, merge_range, merge_position.
    """
    spark, own = pages.sparkSession, folder is None
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    records = cut(merge_index(read_archives(write_archives(pages, folder, min_bytes, ts), folder)))
    if own:
        remove(spark, folder)
    sizes = records.filter("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("target"), F.col("payload_digest").alias("target_digest"), F.col("payload_bytes").alias("target_bytes")).dropDuplicates(["target", "target_digest"])
    # a revisit's payload is that of the response that it refers to, if the digests agree
    whole = records.join(sizes, (records["refers_to"] == sizes["target"]) & (records["payload_digest"] == sizes["target_digest"]), "left")
    return whole.select("page_id", F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "urlkey", "ts", "merge_range", "merge_position")

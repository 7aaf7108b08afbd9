"""Job logs: queue positions, last states and expiry, for batch tables and streams."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_states(log: DataFrame) -> DataFrame:
    """job_id, state, ts: the latest event of each job."""
    return log.groupBy("job_id").agg(F.max_by("state", F.struct("ts", "seq")).alias("state"), F.max("ts").alias("ts"))


def queue_positions(log: DataFrame, buckets: int = 64) -> DataFrame:
    """job_id, position: the queued jobs, first come first served.

    The queue is cut into ``buckets`` ranges of time; each range's rows are numbered by themselves and start
    after the counts of the ranges before, one row a range.
    """
    waiting = last_states(log).filter("state = 'queued'").select("job_id", F.col("ts").alias("at"))
    span = waiting.agg(F.min("at").cast("timestamp").cast("double").alias("low"), F.max("at").cast("timestamp").cast("double").alias("high")).first()
    low, high = span.low or 0.0, span.high or 0.0
    share = (F.col("at").cast("timestamp").cast("double") - F.lit(low)) / F.lit(max(high - low, 1e-6))
    dealt = waiting.withColumn("part", F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int"))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # at most ``buckets`` rows
    own = F.row_number().over(Window.partitionBy("part").orderBy("at", "job_id"))
    return dealt.join(F.broadcast(before), "part").select("job_id", (own + F.col("before")).alias("position"))


def state_changes(log: DataFrame) -> DataFrame:
    """The events that differ from the job's event before."""
    w = Window.partitionBy("job_id").orderBy("ts", "seq")
    return log.withColumn("before", F.lag("state").over(w)).filter(~F.col("state").eqNullSafe(F.col("before"))).drop("before")


#: States that end a job.
TERMINAL = ("completed", "failed", "cancelled")


def expired(log: DataFrame, hours: float, now, inputs: DataFrame | None = None) -> DataFrame:
    """job_id, state: jobs whose last event is older than the time to live: two left anti joins.

    Jobs that haven't ended stay, and so do those whose files they use: ``inputs`` (job_id, source_job_id) names them.
    """
    last = last_states(log)
    live = last.filter(~F.col("state").isin(*TERMINAL)).select(F.col("job_id").alias("live"))
    old = last.filter(F.col("ts") < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(hours) * 3600)))
    out = old.join(live, F.col("job_id") == F.col("live"), "left_anti")
    if inputs is not None:
        used = inputs.filter("source_job_id is not null").join(live, F.col("job_id") == F.col("live"), "left_semi").select(F.col("source_job_id").alias("used"))
        out = out.join(used, F.col("job_id") == F.col("used"), "left_anti")
    return out.select("job_id", "state")


def input_owners(inputs: DataFrame, deepest: int = 32) -> DataFrame:
    """job_id, owner: the job whose files each job works on, through any chain of sources; a chain that names a job that isn't there ends with that name."""
    out = inputs.select("job_id", F.coalesce("source_job_id", "job_id").alias("owner"))
    known = inputs.select(F.col("job_id").alias("at"), F.coalesce("source_job_id", "job_id").alias("next"))
    hops = 1
    while hops < deepest:  # each round doubles the steps taken
        known = known.alias("a").join(known.alias("b"), F.col("a.next") == F.col("b.at"), "left").select(F.col("a.at").alias("at"), F.coalesce("b.next", "a.next").alias("next"))
        hops *= 2
    return out.select("job_id").join(known, F.col("job_id") == F.col("at")).select("job_id", F.col("next").alias("owner"))


def progress(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of each job and hour from a stream of the log; events later than ``late`` are dropped by the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "job_id").agg(F.count("*").alias("n")).select("job_id", F.col("window.start").alias("hour"), "n")


def events_after(log: DataFrame, cursor: DataFrame) -> DataFrame:
    """The events of each job beyond a reader's cursor (job_id, seq); jobs without a cursor are read from the start."""
    seen = cursor.select(F.col("job_id").alias("reader"), F.col("seq").alias("upto"))
    return log.join(seen, F.col("job_id") == F.col("reader"), "left").filter(F.col("upto").isNull() | (F.col("seq") > F.col("upto"))).drop("reader", "upto")


#: Which states may follow which; a job starts as queued.
FOLLOWS = {None: ("queued",), "queued": ("running", "cancelled"), "running": ("cancelling", "completed", "failed", "cancelled"), "cancelling": ("cancelled", "completed", "failed")}


def wrong_changes(log: DataFrame) -> DataFrame:
    """job_id, seq, before, state: changes that the order of states doesn't allow."""
    w = Window.partitionBy("job_id").orderBy("ts", "seq")
    both = log.withColumn("before", F.lag("state").over(w)).filter(~F.col("state").eqNullSafe(F.col("before")))
    right = F.lit(False)
    for before, after in FOLLOWS.items():
        right = right | (F.col("before").eqNullSafe(F.lit(before)) & F.col("state").isin(*after))
    return both.filter(~right).select("job_id", "seq", "before", "state")

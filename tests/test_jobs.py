from datetime import datetime, timedelta

from pyspark.sql import functions as F

from massif.streaming import jobs

LOG = "job_id long, seq long, ts timestamp, state string"
START = datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(j, s, START + timedelta(minutes=m), state) for j, s, m, state in rows], LOG)


def test_progress_of_a_stream_equals_the_batch(spark, tmp_path):
    rows = [(j, k, 7 * k + j, "running") for j in range(4) for k in range(60)]
    for part in range(3):
        log(spark, rows[part::3]).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(log(spark, rows).schema).parquet(str(tmp_path / "in" / "*"))
    query = jobs.progress(stream, "10 days").writeStream.format("memory").queryName("progress").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {(r.job_id, r.hour): r.n for r in spark.table("progress").collect()}
    want = {(r.job_id, r.hour): r.n for r in log(spark, rows).groupBy("job_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n")).collect()}
    assert got == want and len(want) > 20


def test_running_jobs_and_their_inputs_stay(spark):
    rows = [(1, 0, 0, "queued"), (1, 1, 1, "running"), (2, 0, 0, "queued"), (2, 1, 5, "completed"), (3, 0, 0, "queued"), (3, 1, 6, "failed"), (4, 0, 0, "cancelling"), (5, 0, 7, "cancelled"), (6, 0, 6000, "completed")]
    inputs = spark.createDataFrame([(1, 3), (2, None), (3, None), (4, 9), (5, 2), (6, 2)], "job_id long, source_job_id long")
    now = START + timedelta(hours=30)
    got = {r.job_id for r in jobs.expired(log(spark, rows), 24, now, inputs).collect()}
    assert got == {2, 5} and {r.job_id for r in jobs.expired(log(spark, rows), 24, now).collect()} == {2, 3, 5}
    assert {r.job_id for r in jobs.expired(log(spark, rows), 29.95, now).collect()} == set()


def test_positions_count_the_whole_queue(spark):
    rows = [(j, 0, (j * 37) % 100 // 3, "queued") for j in range(200)] + [(500, 0, 0, "queued"), (500, 1, 90, "running")]
    got = {r.job_id: r.position for r in jobs.queue_positions(log(spark, rows), 5).collect()}
    order = sorted(range(200), key=lambda j: ((j * 37) % 100 // 3, j))
    assert got == {j: i for i, j in enumerate(order, 1)}
    assert jobs.queue_positions(log(spark, rows[-1:])).count() == 0


def test_wrong_changes_and_owners(spark):
    rows = [(1, 0, 0, "queued"), (1, 1, 1, "running"), (1, 2, 2, "running"), (1, 3, 3, "queued"), (2, 0, 0, "running"), (3, 0, 0, "queued"), (3, 1, 1, "cancelled"), (3, 2, 2, "running")]
    assert {(r.job_id, r.seq) for r in jobs.wrong_changes(log(spark, rows)).collect()} == {(1, 3), (2, 0), (3, 2)}
    inputs = spark.createDataFrame([(j, j - 1 if j % 10 else None) for j in range(30)] + [(90, 77)], "job_id long, source_job_id long")
    got = {r.job_id: r.owner for r in jobs.input_owners(inputs).collect()}
    assert got == {j: j // 10 * 10 for j in range(30)} | {90: 77}

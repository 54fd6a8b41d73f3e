"""Streaming jobs resume from their checkpoints: a restart processes only new input."""

import os

from pyspark.sql import functions as F

from redline.operators.windows import latest_per_job
from redline.sources import views as V
from redline.sources.scratch import scratch_path
from redline.sources.store import BucketTable
from redline.streaming import jobs as ST


def _latest(store):
    return sorted(map(tuple, store.read().select("job_id", "step").collect()))


def test_latest_rows_resume_and_rewrite_only_what_they_touch(spark, sf):
    log = V.loss_log(spark, sf)
    first, second = log.where("step < 500"), log.where("step >= 500 AND job_id IN ('job_1', 'job_2')")
    src, ck = scratch_path(spark, "restart-in"), scratch_path(spark, "restart-ck")
    store = BucketTable(spark, scratch_path(spark, "restart-out"), log.schema, "job_id", 8)

    def run():
        q = ST.stream_latest(spark, f"{src}/delivery=*", log.schema, store, ck, max_files_per_trigger=1)
        q.awaitTermination()
        return sum(p["numInputRows"] for p in q.recentProgress)
    first.write.parquet(f"{src}/delivery=1")
    run()
    assert _latest(store) == sorted(map(tuple, latest_per_job(first).select("job_id", "step").collect()))
    before = store._current()
    second.coalesce(1).write.parquet(f"{src}/delivery=2")
    assert run() == second.count()              # only the new delivery was read
    both = first.unionByName(second)
    assert _latest(store) == sorted(map(tuple, latest_per_job(both).select("job_id", "step").collect()))
    after = store._current()
    touched = {r["b"] for r in second.select(store.bucket().alias("b")).distinct().collect()}
    assert {b for b in after if after[b] != before.get(b)} == touched and len(touched) < len(after)
    # Older rows that come late change nothing, whatever their order.
    log.where("step < 100").coalesce(1).write.parquet(f"{src}/delivery=0")
    run()
    assert _latest(store) == sorted(map(tuple, latest_per_job(both).select("job_id", "step").collect()))


def test_stored_table_commits_replays_and_drops(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n"), F.col("id").alias("x"))
    store = BucketTable(spark, scratch_path(spark, "store"), rows.schema, "k", 8)
    assert store.read().count() == 0
    store.insert_new(rows)
    store.insert_new(rows.where("x < 10").withColumn("n", F.lit(9)).unionByName(rows.where("x = 5").withColumn("k", F.lit("new"))))
    assert store.read().count() == 101 and store.read().where("n = 9").count() == 0
    one = rows.where("x = 7")
    c = store.delete(one, version=7)
    assert len(c.written) == 1 and len(c.untouched) == 7 and store.read().where("x = 7").count() == 0
    assert store.delete(rows, version=7).written == () and store.read().count() == 100     # a replay does nothing
    u = store.update(rows.where("x IN (1, 2)"), lambda old: old.withColumn("n", F.col("n") + 1))
    assert u.version == 8 and {r.k for r in store.read().where("n = 2").collect()} == {"1", "2"}
    # An attempt without its commit marker is not read, and the next one starts afresh.
    died = f"{store.path}/v={9:012d}/bucket=0"
    rows.limit(1).write.parquet(died)
    assert store.read().count() == 100
    store.upsert(rows.where("x < 50").withColumn("n", F.lit(5)), "n")
    assert store.read().where("n = 5").count() == 50 and store.versions()[-1] == 9
    store.delete(rows)
    assert store.read().count() == 1
    # A bucket has two versions at most.
    kept = [(v, b) for v in store._names(store.path, "v=") for b in store._names(f"{store.path}/{v}", "bucket=")]
    assert max(sum(b == x for _, b in kept) for x in {b for _, b in kept}) <= 2


def test_ingest_replay_rewrites_its_own_batch(spark, sf):
    files = V.contract_files(spark, sf).select("id", "doc_id", "extracted_text", "uploaded_at")
    out = scratch_path(spark, "replay-out")
    write = ST.ingest_writer(V.law_firms(spark, sf), out, buckets=4)
    write(files.where("doc_id < 30"), 0)
    write(files.where("doc_id < 60").unionByName(files.where("doc_id = 40")), 1)

    def content():
        return sorted((r.id, r["index"], r.batch) for r in spark.read.option("basePath", out).parquet(f"{out}/batch=*").collect())
    once = content()
    write(files.where("doc_id < 60"), 1)
    assert content() == once
    write(files.where("doc_id < 30"), 0)
    assert content() == once
    write(files.where("doc_id < 60"), 2)
    assert content() == once
    assert {b for i, _, b in once if int(i) < 30} == {0} and {b for i, _, b in once if int(i) >= 30} == {1}


def test_time_zone_free_event_time(spark):
    df = spark.createDataFrame([("2024-01-05 23:59:59.123456",)], "s string").select(
        F.col("s").cast("timestamp_ntz").alias("ts"))
    back = df.select(ST.utc_as_ntz(ST.ntz_as_utc("ts")).alias("t")).first().t
    assert back == df.first().ts


def test_ingest_keeps_uploads_in_any_order(spark, sf):
    """Later files hold older uploads and repeats: every upload is ingested once."""
    files = V.contract_files(spark, sf).select("id", "doc_id", "extracted_text", "uploaded_at").where("doc_id < 40")
    src, out, ck = scratch_path(spark, "order-in"), scratch_path(spark, "order-out"), scratch_path(spark, "order-ck")
    for n, part in enumerate(["doc_id >= 30", "doc_id < 10", "doc_id between 5 and 32", "doc_id between 10 and 29"]):
        files.where(part).withColumn("uploaded_at", F.expr("uploaded_at + make_dt_interval(doc_id, 0, 0, 0)")) \
            .coalesce(1).write.parquet(f"{src}/delivery={n}")
    q = ST.stream_ingest(spark, f"{src}/delivery=*", files.schema, V.law_firms(spark, sf), out, ck, max_files_per_trigger=1)
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert {r.id for r in got.select("id").distinct().collect()} == {r.id for r in files.select("id").collect()}
    assert got.count() == got.select("id", "index").distinct().count()


def test_status_counts_do_not_depend_on_file_order(spark, tmp_path):
    """Two deliveries of several files each, the later days' files with the earlier modification times."""
    log = spark.range(40 * 24).select(F.expr("TIMESTAMP_NTZ '2024-01-01 00:30:00' + make_dt_interval(0, CAST(id AS INT), 0, 0)").alias("ts"),
                                      F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("status"), F.col("id").alias("step"))
    seen, src, out, ck = set(), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for n, days in enumerate(["ts < '2024-01-21'", "ts >= '2024-01-21'"]):
        for i, d in enumerate(range(20 * n + 1, 20 * n + 21, 5)):
            folder = f"{src}/delivery={n}"
            start = f"TIMESTAMP_NTZ '2024-01-01' + make_dt_interval({d - 1}, 0, 0, 0)"
            log.where(days).where(f"ts >= {start} AND ts < {start} + make_dt_interval(5, 0, 0, 0)").coalesce(1).write.mode("append").parquet(folder)
            for f in set((tmp_path / "in" / f"delivery={n}").glob("part-*")) - seen:
                seen.add(f)
                os.utime(f, (1_700_000_000 + 1000 * n - 10 * i,) * 2)
        ST.run_status_counts(spark, f"{src}/delivery=*", log.schema, out, ck)
    got = {(r.window_start, r.status): r.n for r in spark.read.parquet(out).collect()}
    want = {(r.d, r.status): r.n for r in log.where("ts < '2024-02-09'").groupBy(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d"), "status").agg(F.count("*").alias("n")).collect()}
    assert got == want and sum(got.values()) == 39 * 24

"""Structured Streaming versions of the polled views (ST1-ST3).

The reference polls its database; here new uploads / events arrive as files and are processed
incrementally.  Every query has a checkpoint location under the shared checkpoint folder, so a
restarted driver or lost executor resumes from the last committed micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.functions.text import clean_text, contract_type
from redline.operators.detect import detect_firm
from redline.operators.text import chunk_text
from redline.session import materialize
from redline.sources.store import BucketTable


def ntz_as_utc(col):
    """TIMESTAMP_NTZ wall clock -> TIMESTAMP at that wall clock in UTC, independent of the session
    time zone (watermarks need TIMESTAMP; windows then align to UTC days)."""
    c = F.col(col) if isinstance(col, str) else col
    micros = (F.datediff(F.to_date(c), F.lit("1970-01-01")).cast("bigint") * 86_400_000_000
              + F.hour(c).cast("bigint") * 3_600_000_000 + F.minute(c).cast("bigint") * 60_000_000
              + F.date_format(c, "ssSSSSSS").cast("bigint"))
    return F.timestamp_micros(micros)


def utc_as_ntz(col):
    """Inverse of :func:`ntz_as_utc`."""
    c = F.col(col) if isinstance(col, str) else col
    secs = (F.unix_micros(c).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


#: Folders that one batch's ids are dealt to in the sink.
INGEST_BUCKETS = 64
#: Ids of a batch that are sent to the sink's earlier rows, at most; more meet them in a shuffle.
FEW_IDS = 200_000


def ingest_writer(firms: DataFrame, out_dir: str, buckets: int = INGEST_BUCKETS):
    """foreachBatch sink: firm detection against the firm table, contract type and chunks of the batch's
    new uploads.

    An upload is new if its id is in no earlier batch of the sink.  The sink is partitioned by batch and
    by the id's hash, so only the buckets that the batch's ids fall into are read, and no state holds
    ids.  Ids alone decide; texts are stored once, those of new uploads.  A batch writes its own folder,
    a file per bucket: replayed, it sees the same earlier batches and rewrites its own result."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")

    def write(uploads: DataFrame, epoch_id: int):
        spark = uploads.sparkSession
        ids = materialize(uploads.select("id").distinct())
        touched, n = ids.agg(F.collect_set(bucket), F.count(F.lit(1))).first()
        few = n <= FEW_IDS
        earlier = earlier_ids(spark, out_dir, epoch_id, touched)
        if earlier is not None:
            seen = earlier.join(F.broadcast(ids) if few else ids, "id", "left_semi").distinct()
            ids = materialize(ids.join(seen, "id", "left_anti"))
            if ids.isEmpty():
                return
        ids = ids.select(F.col("id").alias("_new"))
        new = uploads.join(F.broadcast(ids) if few else ids, F.col("id").eqNullSafe(F.col("_new")), "left_semi")
        # One row per id within the batch, dealt out from its few files, read by the detection and by the
        # chunks, computed once.
        new = materialize(new.dropDuplicates(["id"]))
        d = detect_firm(new, firms, "id", "extracted_text")
        d = d.withColumn("contract_type", contract_type("extracted_text"))
        # Only the length of the cleaned text travels with the chunks.
        d = d.withColumn("cleaned_length", F.length(clean_text("extracted_text")))
        chunks = chunk_text(d, id_col="doc_id", text_col="extracted_text",
                            keep=("id", "law_firm_id", "contract_type", "cleaned_length"))
        (chunks.select("doc_id", "id", "law_firm_id", "contract_type", "cleaned_length", "index", "length", bucket.alias("bucket"))
         .repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out_dir}/batch={epoch_id}"))
    return write


def earlier_ids(spark: SparkSession, out_dir: str, epoch_id: int, buckets: list[int]):
    """(id) of the chunks of the sink's earlier batches in the given buckets; None before the first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [st.getPath().getName() for st in fs.listStatus(path)] if fs.exists(path) else []
    older = sorted(int(n[6:]) for n in names if n.startswith("batch=") and int(n[6:]) < epoch_id)
    filled = [f"{out_dir}/batch={n}" for n in older
              if any(st.getPath().getName().startswith("bucket=") for st in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{out_dir}/batch={n}")))]
    if not filled:
        return None
    sink = spark.read.option("basePath", out_dir).schema("id string, batch long, bucket int").parquet(*filled)
    return sink.where(F.col("bucket").isin(buckets)).select("id")


def stream_ingest(spark: SparkSession, in_dir: str, schema, firms: DataFrame, out_dir: str, checkpoint: str,
                  max_files_per_trigger: int | None = None):
    """Uploads arriving as files, in any order -> dedup by id over the stream's whole life, against the
    sink itself -> firm, contract type and chunks under `out_dir`."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return (reader.parquet(in_dir).writeStream.foreachBatch(ingest_writer(firms, out_dir))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_status_counts(sdf: DataFrame, window: str = "1 day", watermark: str = "1 hour",
                         ts_col: str = "ts", status_col: str = "status") -> DataFrame:
    """Counts per status per tumbling window; rows later than the watermark are dropped."""
    return (sdf.withColumn("_event_time", ntz_as_utc(ts_col)).withWatermark("_event_time", watermark)
            .groupBy(F.window("_event_time", window).alias("w"), F.col(status_col))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .select(utc_as_ntz("w.start").alias("window_start"), utc_as_ntz("w.end").alias("window_end"),
                    status_col, "n"))


def run_status_counts(spark: SparkSession, in_dir: str, schema, out_dir: str, checkpoint: str) -> None:
    """Count what was delivered since the last run, in one micro-batch: the watermark moves after
    all of the delivery's files, whatever order they are listed in."""
    s = spark.readStream.schema(schema).parquet(in_dir)
    q = (stream_status_counts(s, "1 day", "1 hour").writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def latest_writer(store: BucketTable, order: str = "step"):
    """foreachBatch sink: the batch's latest row per key goes to a stored table of latest rows.  Only the
    buckets of the batch's keys are rewritten, in one commit named by the batch id, so a replayed batch
    that was committed is not applied again and one that died is applied from the start; what a commit
    replaced is dropped.  No state but the table itself."""
    def write(rows: DataFrame, epoch_id: int):
        rest = [c for c in rows.columns if c != store.key]
        latest = (rows.groupBy(store.key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("l"))
                  .select(store.key, *[F.col("l").getField(c).alias(c) for c in rest]))
        store.upsert(materialize(latest), order, epoch_id)   # read for the buckets and for the rows
    return write


def stream_latest(spark: SparkSession, in_dir: str, schema, store: BucketTable, checkpoint: str, order: str = "step",
                  max_files_per_trigger: int | None = None):
    """Rows arriving as files, in any order -> the latest row per key in ``store``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return (reader.parquet(in_dir).writeStream.foreachBatch(latest_writer(store, order))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

"""Queries: streaming (ST1-ST3) and sink read-backs.

Each streaming query stages its input from the corpus tables as files under the shared
checkpoint folder, runs the stream to completion with ``availableNow`` and returns the sink's
content; the oracle SQL is the batch twin over the same tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.operators import loader as L
from redline.operators import text as T
from redline.operators.features import stat_features
from redline.plans.q_features import STAT_SQL
from redline.plans.q_detect import _ctype_sql
from redline.plans.q_text import FILE_CHUNKS_SQL, _chunk_sql, clean_sql
from redline.plans.q_compare import DETECTED_SQL
from redline.plans.registry import query
from redline.plans.views_sql import with_views
from redline.sources import files as S
from redline.sources import views as V
from redline.sources.scratch import scratch_path
from redline.sources.store import BucketTable
from redline.sources.tables import table
from redline.streaming import jobs as ST


# ---- sinks and read-backs -------------------------------------------------------------------------

@query("read_chat_jsonl", with_views("SELECT line_no AS id, CAST(len(messages) AS BIGINT) AS n_messages FROM chat", "chat"))
def read_chat_jsonl_q(spark, sf):
    """Write every conversation as a JSONL line, load the files back through the loader."""
    path = scratch_path(spark, "chat-jsonl")
    S.write_jsonl(V.chat(spark, sf).select(F.col("line_no").alias("id"), "messages"), path)
    recs = L.load_examples(spark, [path], fmt="jsonl")
    msgs = F.expr("try_variant_get(try_parse_json(value), '$.messages', 'array<variant>')")
    return recs.select(F.expr("try_variant_get(try_parse_json(value), '$.id', 'bigint')").alias("id"),
                       F.size(msgs).cast("bigint").alias("n_messages"))


@query("read_json_examples", """
WITH c AS (SELECT conv_id, turn, text, conv_id % 2 AS form, conv_id // 100 AS part FROM conversations WHERE text IS NOT NULL)
SELECT form, part, CAST(row_number() OVER (PARTITION BY form, part ORDER BY conv_id, turn) - 1 AS BIGINT) AS line_no, text FROM c
UNION ALL SELECT 2, part, 0, text FROM (SELECT part, arg_min(text, (conv_id, turn)) AS text FROM c WHERE conv_id % 4 = 2 GROUP BY part)""")
def read_json_examples_q(spark, sf):
    """Every text as training files of every shape, read back by the loader: form 0 a list per file, form 1
    an object with chunks, form 2 a single object, form 3 broken JSON (skipped), and a missing file.  Forms 0
    and 1 hold half the conversations of one hundred ids each, forms 2 and 3 come on top."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "text").where(F.col("text").isNotNull())
    c = c.withColumn("part", F.expr("conv_id div 100"))
    g = (c.groupBy((F.col("conv_id") % 2).alias("form"), "part")
         .agg(F.sort_array(F.collect_list(F.struct("conv_id", "turn", "text"))).alias("t")))
    items = F.transform("t", lambda x: F.struct(x["text"].alias("text")))
    value = F.when(F.col("form") == 0, F.to_json(items)).otherwise(F.to_json(F.struct(items.alias("chunks"))))
    single = (c.where("conv_id % 4 = 2").groupBy("part").agg(F.min(F.struct("conv_id", "turn", "text"))["text"].alias("text"))
              .select(F.lit(2).cast("bigint").alias("form"), "part", F.to_json(F.struct("text")).alias("value")))
    broken = (c.where("conv_id % 4 = 3").select("part").distinct()
              .select(F.lit(3).cast("bigint").alias("form"), "part", F.lit("[{broken").alias("value")))
    path = scratch_path(spark, "json-examples")
    (g.select("form", "part", value.alias("value")).unionByName(single).unionByName(broken)
     .repartition("form", "part").write.partitionBy("form", "part").text(path))
    recs = L.load_examples(spark, [f"{path}/form=*/part=*", f"{path}/missing.json"], fmt="json")
    at = r"form=(\d+)/part=(\d+)"
    return recs.select(F.regexp_extract("file", at, 1).cast("bigint").alias("form"),
                       F.regexp_extract("file", at, 2).cast("bigint").alias("part"), "line_no",
                       F.expr("try_variant_get(try_parse_json(value), '$.text', 'string')").alias("text"))


@query("write_training_jsonl", FILE_CHUNKS_SQL + """
SELECT doc_id, index, filename AS source, md5(CAST(doc_id AS VARCHAR) || ':' || CAST(index AS VARCHAR)) AS chunk_id,
       CAST(length(text) AS BIGINT) AS text_length, text FROM fchunks""")
def write_training_jsonl_q(spark, sf):
    from redline.plans.q_text import _file_chunks
    path = scratch_path(spark, "training-jsonl")
    S.write_jsonl(T.chunk_training_rows(_file_chunks(spark, sf)), path)
    back = spark.read.schema("doc_id bigint, index int, text string, source string, chunk_id string").json(path)
    return back.select("doc_id", "index", "source", "chunk_id", F.length("text").cast("bigint").alias("text_length"), "text")


@query("write_features", STAT_SQL)
def write_features_q(spark, sf):
    feats = stat_features(table(spark, sf, "documents", "doc_id", "text"))
    path = scratch_path(spark, "features-csv")
    S.write_features(feats, path, "csv")
    return spark.read.option("header", "true").schema(feats.schema).csv(path)


# ---- streaming ------------------------------------------------------------------------------------

INGEST_SQL = with_views("SELECT 1", "contract_files", "law_firms", "contract_templates")[:-len("SELECT 1")].rstrip() \
    + ",\n" + DETECTED_SQL.split("pairs AS (")[0].rstrip().rstrip(",") + ",\n" + \
    _chunk_sql().replace("FROM documents", "FROM (SELECT doc_id, extracted_text AS text FROM contract_files)") + """
SELECT c.doc_id, d.id, d.law_firm_id, CTYPE AS contract_type, CAST(length(CLEANED) AS BIGINT) AS cleaned_length,
       c.index, c.length
FROM chunks c JOIN detected d ON d.doc_id = c.doc_id""".replace("CTYPE", _ctype_sql("d.extracted_text")).replace(
    "CLEANED", clean_sql("d.extracted_text"))


@query("stream_ingest", INGEST_SQL)
def stream_ingest_q(spark, sf):
    cf = V.contract_files(spark, sf).select("id", "doc_id", "extracted_text", "uploaded_at")
    src = scratch_path(spark, "ingest-in")
    # Uploads arrive in two deliveries; the second repeats every upload (duplicates are ignored).
    cf.write.mode("overwrite").parquet(f"{src}/delivery=1")
    cf.write.mode("overwrite").parquet(f"{src}/delivery=2")
    out, ck = scratch_path(spark, "ingest-out"), scratch_path(spark, "ingest-ck")
    q = ST.stream_ingest(spark, f"{src}/delivery=*", cf.schema, V.law_firms(spark, sf), out, ck,
                         max_files_per_trigger=4)
    q.awaitTermination()
    return spark.read.parquet(out).select("doc_id", "id", "law_firm_id", "contract_type",
                                          F.col("cleaned_length").cast("bigint").alias("cleaned_length"), "index", "length")


@query("stream_status_counts", with_views("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
       status, CAST(count(*) AS BIGINT) AS n
FROM loss_log
WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM loss_log) - INTERVAL 1 HOUR
GROUP BY ALL""", "loss_log"))
def stream_status_counts_q(spark, sf):
    """Events stream in as files; counts per status per day, emitted once the watermark passes a
    window's end (append mode), so the last, still-open window is not part of the result.  Four
    deliveries follow each other in time; the order of a delivery's files does not matter."""
    log = V.loss_log(spark, sf).select("ts", "status", "step")
    src = scratch_path(spark, "status-in")
    out, ck = scratch_path(spark, "status-out"), scratch_path(spark, "status-ck")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    lo, hi = log.agg(F.min(day), F.max(day)).first()
    part = F.least(F.floor((day - F.lit(lo)) * 4 / F.lit((hi or 0) - (lo or 0) + 1)), F.lit(3))
    for n in range(4):
        log.where(part == n).write.mode("overwrite").parquet(f"{src}/delivery={n}")
        ST.run_status_counts(spark, f"{src}/delivery=*", log.schema, out, ck)
    return spark.read.parquet(out)


LATEST_BUCKETS = 16


@query("stream_latest_job", with_views("""
SELECT job_id, arg_max(step, step) AS step, arg_max(metric, step) AS metric, arg_max(value, step) AS value,
       arg_max(ts, step) AS ts, arg_max(status, step) AS status
FROM loss_log GROUP BY job_id""", "loss_log"))
def stream_latest_job_q(spark, sf):
    log = V.loss_log(spark, sf)
    src = scratch_path(spark, "jobs-in")
    log.write.mode("overwrite").parquet(src)
    store = BucketTable(spark, scratch_path(spark, "jobs-latest"), log.schema, "job_id", LATEST_BUCKETS)
    ST.stream_latest(spark, src, log.schema, store, scratch_path(spark, "jobs-ck"), max_files_per_trigger=1).awaitTermination()
    return store.read().select("job_id", "step", "metric", "value", "ts", "status")

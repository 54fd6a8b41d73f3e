"""Queries: listings, lookups, formatting, dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.functions import text as FT
from redline.operators import reports as R
from redline.operators.windows import latest_per_job
from redline.plans.registry import query
from redline.plans.views_sql import with_views
from redline.sources import views as V
from redline.sources.tables import table


@query("list_newest_first", """
SELECT 'rev_' || CAST(event_id AS VARCHAR) AS id, ts AS created_at,
       CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status,
       CAST(json_extract(props, '$.k') AS INTEGER) AS k
FROM events""")
def list_newest_first_q(spark, sf):
    e = table(spark, sf, "events", "event_id", "ts", "event_type", "props")
    r = e.select(F.concat(F.lit("rev_"), F.col("event_id").cast("string")).alias("id"), F.col("ts").alias("created_at"),
                 F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
                 .otherwise("processing").alias("status"), "props")
    out = R.list_newest(r, json_cols={"props": "k INT"})
    return out.select("id", "created_at", "status", F.col("props.k").alias("k"))


@query("lookup_by_id", with_views("SELECT id, status, model_id, created_at FROM reviews WHERE event_id = 777", "reviews"))
def lookup_by_id_q(spark, sf):
    return R.lookup(V.reviews(spark, sf), "event_id", 777).select("id", "status", "model_id", "created_at")


@query("template_search", with_views("""
SELECT id, law_firm_id, template_type, file_name FROM contract_templates WHERE law_firm_id = 'firm_3'""",
                                     "contract_templates"))
def template_search_q(spark, sf):
    t = R.template_search(V.contract_templates(spark, sf), firm="firm_3")
    return t.select("id", "law_firm_id", "template_type", "file_name")


@query("template_listing", with_views("""
SELECT id, law_firm_id, template_type, file_name, strftime(created_at, '%Y-%m-%d %H:%M') AS created,
       row_number() OVER (PARTITION BY law_firm_id ORDER BY template_type, created_at, id) = 1 AS firm_header
FROM contract_templates""", "contract_templates"))
def template_listing_q(spark, sf):
    return R.template_listing(V.contract_templates(spark, sf))


@query("firm_listing", with_views("SELECT id, name, CAST(len(keywords) AS BIGINT) AS n_keywords FROM law_firms",
                                  "law_firms"))
def firm_listing_q(spark, sf):
    f = V.law_firms(spark, sf)
    return f.orderBy("name").select("id", "name", F.size("keywords").cast("bigint").alias("n_keywords"))


@query("history_search", with_views("""
SELECT id, status, model_id FROM reviews
WHERE (list_bool_or(list_transform(contract_files, lambda f: strpos(lower(f), 'annex_3') > 0))
       OR strpos(lower(law_firm_name), 'annex_3') > 0 OR strpos(lower(model_id), 'annex_3') > 0)
  AND lower(status) = 'completed'""", "reviews"))
def history_search_q(spark, sf):
    return R.history_search(V.reviews(spark, sf), "annex_3", "completed").select("id", "status", "model_id")


@query("processed_only", with_views("SELECT id, filename FROM contract_files WHERE processed", "contract_files"))
def processed_only_q(spark, sf):
    return V.contract_files(spark, sf).where(F.col("processed")).select("id", "filename")


@query("recent_activity", with_views("""
SELECT * FROM (
  SELECT * FROM (SELECT id, created_at, status, 'review' AS type FROM reviews ORDER BY created_at DESC, id LIMIT 3)
  UNION ALL
  SELECT * FROM (SELECT id, created_at, status, 'comment' AS type FROM review_comments
                 ORDER BY created_at DESC, id LIMIT 3))
ORDER BY created_at DESC, id LIMIT 3""", "reviews", "review_comments"))
def recent_activity_q(spark, sf):
    return R.recent_activity(V.reviews(spark, sf), V.review_comments(spark, sf), 3)


_SIZE_SQL = """CASE WHEN size_bytes = 0 THEN '0 Bytes' ELSE
  regexp_replace(regexp_replace(printf('%.2f', round(size_bytes / pow(1024, least(floor(log(size_bytes) / log(1024)), 3)), 2)),
                 '0+$', ''), '[.]$', '') || ' ' ||
  ['Bytes', 'KB', 'MB', 'GB'][CAST(least(floor(log(size_bytes) / log(1024)), 3) AS INTEGER) + 1] END"""


@query("human_size", with_views(f"SELECT id, size_bytes, {_SIZE_SQL} AS size_label FROM contract_files",
                                "contract_files"))
def human_size_q(spark, sf):
    cf = V.contract_files(spark, sf)
    return cf.select("id", "size_bytes", FT.human_size("size_bytes").alias("size_label"))


@query("human_duration", with_views("""
SELECT id, printf('%dh %dm %ds', d // 3600, (d % 3600) // 60, d % 60) AS duration,
       CASE WHEN processing_time IS NULL OR processing_time = 0 THEN 'N/A'
            ELSE printf('%.2fs', processing_time) END AS processing_label
FROM (SELECT id, processing_time, CAST(round(value * 100) AS BIGINT) AS d
      FROM reviews JOIN (SELECT event_id, value FROM events) USING (event_id))""", "reviews"))
def human_duration_q(spark, sf):
    r = V.reviews(spark, sf).join(table(spark, sf, "events", "event_id", "value"), "event_id")
    return r.select("id", FT.human_duration(F.round(F.col("value") * 100).cast("bigint")).alias("duration"),
                    FT.processing_time_label("processing_time").alias("processing_label"))


@query("status_bucket", with_views("""
SELECT id, status, CASE WHEN status IS NULL THEN 'default' WHEN lower(status) = 'completed' THEN 'success'
                        WHEN lower(status) IN ('failed', 'error') THEN 'error' ELSE 'warning' END AS bucket
FROM reviews""", "reviews"))
def status_bucket_q(spark, sf):
    return V.reviews(spark, sf).select("id", "status", FT.status_bucket("status").alias("bucket"))


# ---- aggregates ---------------------------------------------------------------------------------

@query("dashboard_stats", with_views("""
SELECT r.n AS total_reviews, c.n AS total_comments,
       CAST(CASE WHEN r.n + c.n > 0 THEN round((r.d + c.d) * 100.0 / (r.n + c.n)) ELSE 0 END AS BIGINT) AS success_rate_pct
FROM (SELECT CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE status = 'completed') AS d FROM reviews) r,
     (SELECT CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE status = 'completed') AS d FROM review_comments) c""",
                                     "reviews", "review_comments"))
def dashboard_stats_q(spark, sf):
    return R.dashboard_stats(V.reviews(spark, sf), V.review_comments(spark, sf))


@query("processing_time", with_views("""
SELECT model_id, CAST(count(*) AS BIGINT) AS n, round(avg(s), 6) AS avg_seconds, round(min(s), 6) AS min_seconds,
       round(max(s), 6) AS max_seconds
FROM (SELECT model_id, (epoch_us(completed_at) - epoch_us(created_at)) / 1e6 AS s FROM reviews
      WHERE completed_at IS NOT NULL) GROUP BY model_id""", "reviews"))
def processing_time_q(spark, sf):
    return R.processing_time(V.reviews(spark, sf), ["model_id"])


@query("latency_summary", """
SELECT CAST(count(*) AS BIGINT) AS total_requests,
       CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS successful_requests,
       round(count(*) FILTER (WHERE event_type <> 'error') * 100.0 / count(*), 6) AS success_rate,
       round(avg(value), 6) AS avg_response_time, round(min(value), 6) AS min_response_time,
       round(max(value), 6) AS max_response_time
FROM events""")
def latency_summary_q(spark, sf):
    e = table(spark, sf, "events", "event_type", "value").withColumn("ok", F.col("event_type") != "error")
    return R.latency_summary(e, "ok", "value")


@query("perplexity", with_views("""
SELECT job_id, round(avg(value), 6) AS eval_loss, round(exp(avg(value)), 6) AS perplexity,
       CAST(count(*) AS BIGINT) AS n FROM loss_log GROUP BY job_id""", "loss_log"))
def perplexity_q(spark, sf):
    return R.perplexity(V.loss_log(spark, sf), ["job_id"])


@query("active_jobs", with_views("""
SELECT CAST(count(*) FILTER (WHERE status = 'processing') AS BIGINT) AS active_jobs, CAST(count(*) AS BIGINT) AS jobs
FROM (SELECT job_id, arg_max(status, step) AS status FROM loss_log GROUP BY job_id)""", "loss_log"))
def active_jobs_q(spark, sf):
    latest = latest_per_job(V.loss_log(spark, sf))
    return latest.agg(F.count_if(F.col("status") == "processing").cast("bigint").alias("active_jobs"),
                      F.count(F.lit(1)).cast("bigint").alias("jobs"))


@query("templates_per_firm", with_views("""
SELECT f.id AS law_firm_id, f.name AS law_firm_name, CAST(coalesce(c.n, 0) AS BIGINT) AS n_templates,
       c.n IS NOT NULL AS has_templates
FROM law_firms f LEFT JOIN (SELECT law_firm_id, count(*) AS n FROM contract_templates GROUP BY 1) c
  ON c.law_firm_id = f.id""", "law_firms", "contract_templates"))
def templates_per_firm_q(spark, sf):
    return R.templates_per_firm(V.contract_templates(spark, sf), V.law_firms(spark, sf))


def _quality_sql(full: bool) -> str:
    from redline.functions.text import WS
    ok = (f"coalesce(length(text) > 20 AND NOT starts_with(lower(text), 'error') AND "
          f"len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')) > 5, false)")
    if full:
        return f"SELECT conv_id, turn, {ok} AS quality_ok FROM conversations WHERE role = 'assistant'"
    return (f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE q) AS BIGINT) AS n_ok, "
            f"round(count(*) FILTER (WHERE q) / count(*), 6) AS rate, count(*) FILTER (WHERE q) / count(*) >= 0.7 "
            f"AS passed FROM (SELECT {ok} AS q FROM conversations WHERE role = 'assistant')")


@query("response_quality", _quality_sql(True))
def response_quality_q(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").where(F.col("role") == "assistant")
    return R.response_quality(c, "text").select("conv_id", "turn", "quality_ok")


@query("response_quality_summary", _quality_sql(False))
def response_quality_summary_q(spark, sf):
    c = table(spark, sf, "conversations", "role", "text").where(F.col("role") == "assistant")
    return R.quality_summary(R.response_quality(c, "text"))

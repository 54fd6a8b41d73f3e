"""Queries: per-job series analytics (N1-N4) and change application."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.operators import changes as W
from redline.operators import windows as N
from redline.plans.registry import query
from redline.plans.views_sql import with_views
from redline.session import materialize
from redline.sources import views as V
from redline.sources.scratch import scratch_path
from redline.sources.store import BucketTable
from redline.sources.tables import table


@query("best_loss", with_views("""
SELECT job_id, step, value, min(value) OVER (PARTITION BY job_id ORDER BY step
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_loss
FROM loss_log""", "loss_log"))
def best_loss_q(spark, sf):
    return N.best_loss(V.loss_log(spark, sf).select("job_id", "step", "value"))


@query("job_progress", with_views("""
SELECT job_id, step, round(rn * 100.0 / count(*) OVER (PARTITION BY job_id), 6) AS progress_pct,
       rn % 50 = 0 AS reported
FROM (SELECT job_id, step, row_number() OVER (PARTITION BY job_id ORDER BY step) AS rn FROM loss_log)""", "loss_log"))
def job_progress_q(spark, sf):
    p = N.job_progress(V.loss_log(spark, sf).select("job_id", "step"), 50)
    return p.select("job_id", "step", "progress_pct", "reported")


@query("early_stop", with_views("""
SELECT job_id, arg_min(step, step) AS stop_step, arg_min(value, step) AS stop_value
FROM (SELECT *, seq - max(CASE WHEN imp THEN seq END) OVER (PARTITION BY job_id ORDER BY seq
                                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak
      FROM (SELECT job_id, step, value, row_number() OVER (PARTITION BY job_id ORDER BY step) - 1 AS seq,
                   coalesce(value < min(value) OVER (PARTITION BY job_id ORDER BY step
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS imp
            FROM loss_log))
WHERE streak >= 3 GROUP BY job_id""", "loss_log"))
def early_stop_q(spark, sf):
    return N.early_stop(V.loss_log(spark, sf).select("job_id", "step", "value"), 3)


@query("latest_per_job", with_views("""
SELECT job_id, arg_max(step, step) AS step, arg_max(metric, step) AS metric, arg_max(value, step) AS value,
       arg_max(ts, step) AS ts, arg_max(status, step) AS status
FROM loss_log GROUP BY job_id""", "loss_log"))
def latest_per_job_q(spark, sf):
    return N.latest_per_job(V.loss_log(spark, sf))


# ---- change application --------------------------------------------------------------------------

def _candidate_firms(spark, sf):
    b = table(spark, sf, "benchmark", "item_id")
    k = (F.col("item_id") % 10).cast("string")
    return b.select(F.concat(F.lit("firm_"), k).alias("id"), F.concat(F.lit("Firm "), k).alias("name"), "item_id")


@query("insert_if_absent", with_views("""
, cand AS (SELECT 'firm_' || CAST(item_id % 10 AS VARCHAR) AS id, 'Firm ' || CAST(item_id % 10 AS VARCHAR) AS name,
                  item_id FROM benchmark),
first AS (SELECT id, arg_min(name, item_id) AS name, min(item_id) AS item_id FROM cand GROUP BY id),
rej AS (SELECT * FROM first WHERE id IN (SELECT id FROM law_firms) OR name IN (SELECT name FROM law_firms))
SELECT id, name, item_id, 'inserted' AS action FROM first WHERE id NOT IN (SELECT id FROM rej)
UNION ALL SELECT id, name, item_id, 'rejected' FROM rej
UNION ALL SELECT c.id, c.name, c.item_id, 'duplicate' FROM cand c JOIN first f ON c.id = f.id AND c.item_id <> f.item_id
""", "law_firms").replace("\n, cand AS", ", cand AS"))
def insert_if_absent_q(spark, sf):
    return W.insert_if_absent(V.law_firms(spark, sf), _candidate_firms(spark, sf), ["id"], "item_id", ["name"])


@query("apply_status_log", with_views("""
SELECT job_id, max(step) AS last_step, arg_max(status, step) FILTER (WHERE status IS NOT NULL) AS status,
       arg_max(value, step) FILTER (WHERE value IS NOT NULL) AS value,
       arg_max(completed_at, step) FILTER (WHERE completed_at IS NOT NULL) AS completed_at
FROM (SELECT *, CASE WHEN status IN ('completed', 'failed') THEN ts END AS completed_at FROM loss_log)
GROUP BY job_id""", "loss_log"))
def apply_status_log_q(spark, sf):
    log = V.loss_log(spark, sf).withColumn(
        "completed_at", F.when(F.col("status").isin("completed", "failed"), F.col("ts")))
    return W.apply_log(log, "job_id", "step", ["status", "value", "completed_at"])


@query("delete_rows", with_views("""
SELECT id, law_firm_id, template_type, law_firm_id = 'firm_3' AS deleted,
       CAST(count(*) FILTER (WHERE law_firm_id = 'firm_3') OVER () AS BIGINT) AS n_deleted
FROM contract_templates""", "contract_templates"))
def delete_rows_q(spark, sf):
    """The templates as a stored table; a firm's are deleted there, and the table is read back."""
    t = V.contract_templates(spark, sf).select("id", "law_firm_id", "template_type")
    store = BucketTable(spark, scratch_path(spark, "templates"), t.schema, "id", 16)
    store.insert_new(t)
    _, gone = W.delete_rows(store.read(), store.read().where(F.col("law_firm_id") == "firm_3"), ["id"])
    gone = materialize(gone)
    store.delete(gone)
    n = gone.agg(F.count(F.lit(1)).alias("n")).scalar()
    both = store.read().withColumn("deleted", F.lit(False)).unionByName(gone.withColumn("deleted", F.lit(True)))
    return both.select("id", "law_firm_id", "template_type", "deleted", n.alias("n_deleted"))


@query("orphan_check", with_views("""
SELECT 'template_firm' AS fk_name, CAST(law_firm_id AS VARCHAR) AS fk_value, CAST(count(*) AS BIGINT) AS n_rows
FROM contract_templates WHERE law_firm_id IS NOT NULL AND law_firm_id NOT IN (SELECT id FROM law_firms) GROUP BY 2
UNION ALL
SELECT 'comment_file', contract_file_id, CAST(count(*) AS BIGINT) FROM review_comments
WHERE contract_file_id NOT IN (SELECT id FROM contract_files) GROUP BY 2
UNION ALL
SELECT 'comment_processed_file', contract_file_id, CAST(count(*) AS BIGINT) FROM review_comments
WHERE contract_file_id NOT IN (SELECT id FROM contract_files WHERE processed) GROUP BY 2
UNION ALL
SELECT 'label_doc', CAST(doc_id AS VARCHAR), CAST(count(*) AS BIGINT) FROM labels
WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY 2
UNION ALL
SELECT 'event_user', CAST(user_id AS VARCHAR), CAST(count(*) AS BIGINT) FROM events
WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 2""",
                                   "law_firms", "contract_templates", "review_comments", "contract_files"))
def orphan_check_q(spark, sf):
    return W.orphans([
        ("template_firm", V.contract_templates(spark, sf), "law_firm_id", V.law_firms(spark, sf), "id"),
        ("comment_file", V.review_comments(spark, sf), "contract_file_id", V.contract_files(spark, sf), "id"),
        # Comments on files that have not been processed: this relation does have orphans.
        ("comment_processed_file", V.review_comments(spark, sf), "contract_file_id",
         V.contract_files(spark, sf).where("processed"), "id"),
        ("label_doc", table(spark, sf, "labels", "doc_id"), "doc_id", table(spark, sf, "documents", "doc_id"), "doc_id"),
        ("event_user", table(spark, sf, "events", "user_id"), "user_id", table(spark, sf, "customer", "c_custkey"),
         "c_custkey"),
    ])


def _w5_sql():
    from redline.plans.q_examples import P1
    return P1 + """
SELECT DISTINCT system, "user" FROM (
  SELECT e.system, e."user" FROM examples e JOIN pcomments c USING (review_id, comment_idx) WHERE len(c.refs) > 0
  UNION ALL
  SELECT e.system, e."user" FROM examples e JOIN pcomments c USING (review_id, comment_idx) WHERE len(c.refs) = 0)"""


@query("distinct_union", _w5_sql())
def distinct_union_q(spark, sf):
    """Union of the two example sets (section-specific and general), distinct prompts."""
    from redline.operators.examples import chat_examples
    from redline.plans.q_examples import _p1
    comments, sections = _p1(spark, sf)
    ex = chat_examples(comments, sections).join(comments.select("review_id", "comment_idx", "refs"),
                                                ["review_id", "comment_idx"])
    def prompts(df):
        return df.select(F.get("messages", 0)["content"].alias("system"), F.get("messages", 1)["content"].alias("user"))
    return W.union_distinct([prompts(ex.where(F.size("refs") > 0)), prompts(ex.where(F.size("refs") == 0))])


@query("cancel_jobs", with_views("""
SELECT job_id, step, ts, CASE WHEN can THEN 'cancelled' ELSE status END AS status,
       CASE WHEN can THEN requested_at END AS cancelled_at,
       CASE WHEN can THEN 'cancelled' WHEN requested_at IS NOT NULL THEN 'rejected' ELSE 'unchanged' END AS action
FROM (SELECT j.*, r.requested_at, r.requested_at IS NOT NULL AND j.status NOT IN ('completed', 'failed', 'cancelled') AS can
      FROM (SELECT job_id, arg_max(step, step) AS step, arg_max(ts, step) AS ts, arg_max(status, step) AS status
            FROM loss_log GROUP BY job_id) j
      LEFT JOIN (SELECT job_id, max(ts) AS requested_at FROM loss_log WHERE status = 'failed' GROUP BY job_id) r
        USING (job_id))""", "loss_log"))
def cancel_jobs_q(spark, sf):
    """Every job that logged a failure asks to be cancelled (at its last failure time); only jobs
    whose latest state is unfinished are cancelled."""
    log = V.loss_log(spark, sf)
    jobs = N.latest_per_job(log.select("job_id", "step", "ts", "status"))
    req = log.where(F.col("status") == "failed").groupBy("job_id").agg(F.max("ts").alias("requested_at"))
    return W.cancel_jobs(jobs, req).select("job_id", "step", "ts", "status", "cancelled_at", "action")

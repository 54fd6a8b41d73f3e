"""Queries: prompt assembly, exports (B1, B4) and history reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.operators import compare as C
from redline.operators import scoring as B
from redline.operators.windows import latest_per_job
from redline.plans.q_compare import _base, _with
from redline.plans.registry import query
from redline.plans.views_sql import with_views
from redline.sources import views as V
from redline.sources.scratch import scratch_path
from redline.sources.tables import table


def review_requests(spark, sf):
    """One review request per event: the user's contract and a second file id (user * 7), which
    does not exist for every user, so some requests fail."""
    e = table(spark, sf, "events", "event_id", "user_id")
    return e.select(F.col("event_id").alias("request_id"),
                    F.array(F.col("user_id").cast("string"), (F.col("user_id") * 7).cast("string")).alias("file_ids"))


@query("review_prompt", with_views("""
, r AS (SELECT event_id AS request_id, p.pos, p.file_id
        FROM events, (SELECT unnest([CAST(user_id AS VARCHAR), CAST(user_id * 7 AS VARCHAR)]) AS file_id,
                             unnest([0, 1]) AS pos) p),
j AS (SELECT r.*, f.filename, f.extracted_text FROM r LEFT JOIN contract_files f ON f.id = r.file_id)
SELECT request_id, failed,
       CASE WHEN NOT failed THEN CAST(n AS BIGINT) END AS n_sections,
       CASE WHEN NOT failed THEN CAST(total AS BIGINT) END AS total_length,
       CASE WHEN NOT failed THEN txt END AS contract_text
FROM (SELECT request_id, bool_or(extracted_text IS NULL OR extracted_text = '') AS failed, count(*) AS n,
             sum(length('Contract: ' || filename || chr(10) || chr(10) || extracted_text)) AS total,
             string_agg('Contract: ' || filename || chr(10) || chr(10) || extracted_text, chr(10) || chr(10) ORDER BY pos)
               AS txt
      FROM j GROUP BY request_id)""", "contract_files").replace("\n, r AS", ", r AS"))
def review_prompt_q(spark, sf):
    return B.review_prompt(review_requests(spark, sf), V.contract_files(spark, sf))


@query("conversation_export", """
SELECT conv_id, string_agg('[' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn),
                                            '%Y-%m-%d %H:%M:%S') || '] ' || upper(role) || ': ' || text,
                           chr(10) || chr(10) ORDER BY turn) AS export
FROM conversations GROUP BY conv_id""")
def conversation_export_q(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    c = c.withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(conv_id AS INT), "
                                  "CAST(turn AS INT), 0)"))
    return B.export_conversation(c)


def _word_scorer(prompt, attempt):
    """A deterministic scorer: the words of the prompt.  One length in seven always fails, one more at
    the first attempt only."""
    n = F.length(prompt)
    error = F.when(n % 7 == 0, "rejected").when((n % 7 == 1) & (attempt == 1), "busy")
    value = F.size(F.split(F.trim(prompt), " +")).cast("bigint")
    return F.struct(error.isNull().alias("success"), error.alias("error"), F.when(error.isNull(), value).alias("value"))


@query("batch_score", """
SELECT conv_id * 1000 + turn AS id, CAST(CASE length(text) % 7 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS attempts,
       length(text) % 7 <> 0 AS success, CASE WHEN length(text) % 7 = 0 THEN 'rejected' END AS error,
       CASE WHEN length(text) % 7 <> 0 THEN CAST(len(regexp_split_to_array(trim(text), ' +')) AS BIGINT) END AS value
FROM conversations WHERE trim(text) <> ''""")
def batch_score_q(spark, sf):
    """Every turn scored in two calls with one log: the second, with all requests, finds the first one's
    results and scores the rest."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    r = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("prompt"))
    log = scratch_path(spark, "score-log")
    B.resumable_score(r.where("id % 2 = 0"), log, _word_scorer, "bigint")
    return B.resumable_score(r, log, _word_scorer, "bigint")


# ---- J7-J9 --------------------------------------------------------------------------------------

@query("comment_report", _with("""
, lc AS (SELECT law_firm_id, count(*) AS n_shared FROM (
           SELECT *, row_number() OVER (PARTITION BY law_firm_id ORDER BY created_at, id) AS rn
           FROM contract_templates WHERE template_type = 'legal_comments') WHERE rn = 1 AND length(trim(content)) > 0
         GROUP BY law_firm_id),
per AS (SELECT pp.contract_id, pp.template_id, c.n_removed + c.n_added AS n
        FROM pp JOIN counts c USING (contract_id, template_id)),
firms AS (SELECT DISTINCT contract_id, law_firm_id, contract_type FROM pairs WHERE law_firm_id IS NOT NULL)
SELECT f.contract_id, f.law_firm_id, CAST(coalesce(lc.n_shared, 0) AS BIGINT) AS n_shared_comments,
       CAST(count(per.template_id) AS BIGINT) AS n_comparisons, CAST(coalesce(sum(per.n), 0) AS BIGINT) AS n_differences,
       count(per.template_id) = 0 AS failed
FROM firms f LEFT JOIN per USING (contract_id) LEFT JOIN lc USING (law_firm_id)
GROUP BY f.contract_id, f.law_firm_id, lc.n_shared""").replace("\n, lc AS", ", lc AS"))
def comment_report_q(spark, sf):
    cf, tpl, pairs = _base(spark, sf)
    pairs = pairs.where(F.col("law_firm_id").isNotNull())
    diffs = C.line_diff(pairs, cf, tpl)
    rep = C.comment_report(pairs, diffs, C.legal_comments(tpl))
    return rep.select("contract_id", "law_firm_id", "n_shared_comments", "n_comparisons", "n_differences", "failed")


def comment_request_rows(spark, sf):
    """One request per user: the user's contract and two more ids (some do not exist), for the firm
    number user mod 11 (some firms do not exist)."""
    u = table(spark, sf, "events", "user_id").distinct()
    ids = F.array(*[(F.col("user_id") * k).cast("string") for k in (1, 7, 2)])
    return u.select(F.concat(F.lit("req_"), F.col("user_id").cast("string")).alias("request_id"),
                    F.concat(F.lit("firm_"), (F.col("user_id") % 11).cast("string")).alias("law_firm_id"), ids.alias("file_ids"))


@query("comment_requests", with_views("""
, rq AS (SELECT 'req_' || user_id AS request_id, 'firm_' || (user_id % 11) AS law_firm_id, user_id
         FROM (SELECT DISTINCT user_id FROM events)),
r AS (SELECT rq.*, f.name AS law_firm_name,
             CASE WHEN f.id IS NULL THEN 'Law firm not found'
                  WHEN NOT EXISTS (SELECT 1 FROM contract_templates t WHERE t.law_firm_id = rq.law_firm_id)
                  THEN 'No templates found for law firm: ' || f.name END AS error
      FROM rq LEFT JOIN law_firms f ON f.id = rq.law_firm_id),
named AS (SELECT r.request_id, r.law_firm_id, k.pos, c.id AS file_id, c.filename, coalesce(c.document_type, '') AS document_type
          FROM r, (VALUES (0, 1), (1, 7), (2, 2)) k(pos, m) JOIN contract_files c ON c.id = CAST(r.user_id * k.m AS VARCHAR)
          WHERE r.error IS NULL),
asked AS (SELECT DISTINCT file_id, law_firm_id, document_type FROM named),
pairs AS (SELECT a.file_id AS contract_id, a.law_firm_id, t.id AS template_id, t.template_type, t.file_name AS template_filename
          FROM asked a JOIN contract_templates t ON t.law_firm_id = a.law_firm_id
           AND (a.document_type = t.template_type OR (a.document_type = '' AND t.template_type <> 'legal_comments'))),
pp AS (SELECT DISTINCT contract_id, template_id FROM pairs),
cl AS (SELECT id AS contract_id, l AS line, count(*) AS n FROM contract_files, unnest(string_split(extracted_text, chr(10))) AS u(l)
       WHERE id IN (SELECT contract_id FROM pp) GROUP BY ALL),
tl AS (SELECT id AS template_id, l AS line, count(*) AS n FROM contract_templates,
       unnest(string_split(content, chr(10))) AS u(l) GROUP BY ALL),
d AS (SELECT coalesce(a.contract_id, b.contract_id) AS contract_id, coalesce(a.template_id, b.template_id) AS template_id,
             coalesce(a.line, b.line) AS line, coalesce(a.n, 0) AS n_c, coalesce(b.n, 0) AS n_t
      FROM (SELECT pp.*, cl.line, cl.n FROM pp JOIN cl USING (contract_id)) a
      FULL OUTER JOIN (SELECT pp.*, tl.line, tl.n FROM pp JOIN tl USING (template_id)) b
        ON a.contract_id = b.contract_id AND a.template_id = b.template_id AND a.line = b.line),
diffs AS (SELECT contract_id, template_id, 'removed' AS type, line AS content, CAST(o AS BIGINT) AS occurrence
          FROM d, range(n_c + 1, n_t + 1) AS x(o) WHERE n_t > n_c
          UNION ALL SELECT contract_id, template_id, 'added', line, CAST(o AS BIGINT) FROM d, range(n_t + 1, n_c + 1) AS x(o) WHERE n_c > n_t),
listed AS (SELECT contract_id, template_id, count(*) AS n, list({'type': type, 'content': content, 'occurrence': occurrence}
                  ORDER BY encode(type), encode(content), occurrence) AS differences FROM diffs GROUP BY ALL),
per_file AS (SELECT contract_id, law_firm_id, count(*) AS n_c, sum(coalesce(n, 0)) AS n_d,
                    list({'template_id': template_id, 'template_type': template_type, 'template_filename': template_filename,
                          'differences': coalesce(differences, [])} ORDER BY template_id) AS comparisons
             FROM pairs LEFT JOIN listed USING (contract_id, template_id) GROUP BY ALL),
parts AS (SELECT request_id, count(*) AS n_files, sum(coalesce(n_c, 0)) AS n_comparisons, sum(coalesce(n_d, 0)) AS n_differences,
                 list({'file_id': file_id, 'filename': filename, 'document_type': document_type} ORDER BY pos) AS files,
                 list({'contract_file_id': file_id, 'contract_filename': filename, 'document_type': document_type,
                       'comparisons': coalesce(comparisons, [])} ORDER BY pos) AS comparisons
          FROM named n LEFT JOIN per_file p ON p.contract_id = n.file_id AND p.law_firm_id = n.law_firm_id GROUP BY request_id),
lc AS (SELECT law_firm_id, id, file_name, trim(content) AS comment FROM (
         SELECT *, row_number() OVER (PARTITION BY law_firm_id ORDER BY created_at, id) AS rn
         FROM contract_templates WHERE template_type = 'legal_comments') WHERE rn = 1 AND length(trim(content)) > 0)
SELECT r.request_id, r.law_firm_id, r.law_firm_name, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, error,
       CAST(coalesce(n_files, 0) AS BIGINT) AS n_files, CAST(coalesce(n_comparisons, 0) AS BIGINT) AS n_comparisons,
       CAST(coalesce(n_differences, 0) AS BIGINT) AS n_differences,
       CASE WHEN error IS NULL THEN CAST(to_json({'contract_files': coalesce(files, []), 'law_firm_id': r.law_firm_id,
         'law_firm_name': r.law_firm_name,
         'comments': CASE WHEN lc.id IS NULL THEN [] ELSE [{'comment': lc.comment, 'section': 'Legal Comments', 'severity': 'info'}] END,
         'legal_comments_template_id': coalesce(lc.id, ''), 'legal_comments_template_filename': coalesce(lc.file_name, ''),
         'document_comparisons': coalesce(comparisons, [])}) AS VARCHAR) END AS report
FROM r LEFT JOIN parts USING (request_id) LEFT JOIN lc ON lc.law_firm_id = r.law_firm_id""",
                                      "contract_files", "law_firms", "contract_templates").replace("\n, rq AS", ", rq AS"))
def comment_requests_q(spark, sf):
    return C.comment_requests(comment_request_rows(spark, sf), V.contract_files(spark, sf), V.law_firms(spark, sf),
                              V.contract_templates(spark, sf))


@query("comment_history", with_views("""
SELECT c.id, c.created_at, c.status, f.filename, l.name AS law_firm_name,
       CAST(json_extract(e.props, '$.k') AS INTEGER) AS result_k
FROM review_comments c JOIN events e ON e.event_id = c.event_id
LEFT JOIN contract_files f ON f.id = c.contract_file_id LEFT JOIN law_firms l ON l.id = c.law_firm_id""",
                                     "review_comments", "contract_files", "law_firms"))
def comment_history_q(spark, sf):
    c = V.review_comments(spark, sf).join(table(spark, sf, "events", "event_id", "props"), "event_id")
    f = V.contract_files(spark, sf).select(F.col("id").alias("contract_file_id"), "filename")
    firms = V.law_firms(spark, sf).select(F.col("id").alias("law_firm_id"), F.col("name").alias("law_firm_name"))
    out = c.join(f, "contract_file_id", "left").join(firms, "law_firm_id", "left")
    out = out.withColumn("result", F.from_json("props", "k INT")).orderBy(F.col("created_at").desc(), "id")
    return out.select("id", "created_at", "status", "filename", "law_firm_name", F.col("result.k").alias("result_k"))


@query("model_status", with_views("""
SELECT t.job_id AS model_id, t.ts AS trained_at, CASE WHEN s.job_id IS NOT NULL THEN 'loaded' ELSE 'available' END AS status
FROM (SELECT job_id, arg_max(status, step) AS status, arg_max(ts, step) AS ts FROM loss_log GROUP BY job_id) t
LEFT JOIN (SELECT DISTINCT job_id FROM loss_log WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' AND status = 'completed') s
  USING (job_id)
WHERE t.status = 'completed'""", "loss_log"))
def model_status_q(spark, sf):
    log = V.loss_log(spark, sf)
    trained = latest_per_job(log.select("job_id", "step", "status", "ts")).where(F.col("status") == "completed")
    served = (log.where((F.col("ts") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")) & (F.col("status") == "completed"))
              .select("job_id").distinct().withColumn("_loaded", F.lit(True)))
    out = trained.join(served, "job_id", "left").orderBy(F.col("ts").desc(), "job_id")
    return out.select(F.col("job_id").alias("model_id"), F.col("ts").alias("trained_at"),
                      F.when(F.col("_loaded"), "loaded").otherwise("available").alias("status"))


@query("file_manifest", with_views("""
SELECT id, filename, size_bytes, uploaded_at FROM contract_files
WHERE suffix(lower(filename), '.pdf') OR suffix(lower(filename), '.docx')""", "contract_files"))
def file_manifest_q(spark, sf):
    from redline.sources.files import file_manifest_table
    return file_manifest_table(V.contract_files(spark, sf)).select("id", "filename", "size_bytes", "uploaded_at")


@query("docx_text", """
SELECT CAST(doc_id AS VARCHAR) || '.docx' AS path,
       regexp_replace(regexp_replace(text, '[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0D}\\x{0E}-\\x{1F}\\x{FFFE}\\x{FFFF}]', '', 'g'),
         '^[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+\\z',
         '', 'g') AS extracted_text,
       CAST(NULL AS VARCHAR) AS error
FROM documents""")
def docx_text_q(spark, sf):
    """Every document rendered as a DOCX (bytes built in tasks) and unpacked again by the DOCX
    extractor: the S2 path over the whole corpus."""
    from redline.sources.files import extract_docx, render_docx
    d = table(spark, sf, "documents", "doc_id", "text").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), "text")
    return extract_docx(render_docx(d, "path", "text")).select("path", "extracted_text", "error")

"""Queries: template pairing, diffs, comparison reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.operators import compare as C
from redline.operators import ordered_diff as OD
from redline.operators.detect import detect_firm
from redline.plans.registry import query
from redline.plans.views_sql import with_views
from redline.session import materialize
from redline.sources import views as V

# DuckDB twin of detect_firm over contract_files (first firm by rank whose keyword is a substring).
DETECTED_SQL = """
kw AS (SELECT f.firm_rank, f.id AS firm_id, f.name AS firm_name, lower(u.k) AS kw
       FROM law_firms f, unnest(f.keywords) AS u(k) WHERE length(u.k) > 0),
hit AS (SELECT c.id, arg_min(kw.firm_id, kw.firm_rank) AS law_firm_id
        FROM contract_files c JOIN kw ON strpos(lower(c.extracted_text), kw.kw) > 0 GROUP BY c.id),
detected AS (SELECT c.*, h.law_firm_id FROM contract_files c LEFT JOIN hit h USING (id)),
pairs AS (
  SELECT d.id AS contract_id, d.law_firm_id, d.document_type AS contract_type,
         t.id AS template_id, t.template_type, t.file_name AS template_filename
  FROM detected d LEFT JOIN contract_templates t
    ON d.law_firm_id = t.law_firm_id
   AND (d.document_type = t.template_type
        OR ((d.document_type IS NULL OR d.document_type = '') AND t.template_type <> 'legal_comments'))),
cl AS (SELECT id AS contract_id, l AS line, count(*) AS n FROM contract_files,
       unnest(string_split(extracted_text, chr(10))) AS u(l) GROUP BY ALL),
tl AS (SELECT id AS template_id, l AS line, count(*) AS n FROM contract_templates,
       unnest(string_split(content, chr(10))) AS u(l) GROUP BY ALL),
pp AS (SELECT DISTINCT contract_id, template_id FROM pairs WHERE template_id IS NOT NULL),
d AS (
  SELECT coalesce(a.contract_id, b.contract_id) AS contract_id,
         coalesce(a.template_id, b.template_id) AS template_id,
         coalesce(a.line, b.line) AS line, coalesce(a.n, 0) AS n_c, coalesce(b.n, 0) AS n_t
  FROM (SELECT pp.*, cl.line, cl.n FROM pp JOIN cl USING (contract_id)) a
  FULL OUTER JOIN (SELECT pp.*, tl.line, tl.n FROM pp JOIN tl USING (template_id)) b
    ON a.contract_id = b.contract_id AND a.template_id = b.template_id AND a.line = b.line),
diffs AS (
  SELECT contract_id, template_id, 'removed' AS type, line AS content, CAST(o AS BIGINT) AS occurrence
  FROM d, range(n_c + 1, n_t + 1) AS r(o) WHERE n_t > n_c
  UNION ALL
  SELECT contract_id, template_id, 'added', line, CAST(o AS BIGINT)
  FROM d, range(n_t + 1, n_c + 1) AS r(o) WHERE n_c > n_t),
counts AS (
  SELECT pp.contract_id, pp.template_id,
         CAST(count(x.type) FILTER (WHERE x.type = 'removed') AS BIGINT) AS n_removed,
         CAST(count(x.type) FILTER (WHERE x.type = 'added') AS BIGINT) AS n_added
  FROM pp LEFT JOIN diffs x USING (contract_id, template_id) GROUP BY ALL)"""


def _with(sql: str) -> str:
    s = with_views("SELECT 1", "contract_files", "law_firms", "contract_templates")
    head = s[: s.rindex("SELECT 1")].rstrip()
    return f"{head},\n{DETECTED_SQL}\n{sql}"


def _base(spark, sf):
    cf = V.contract_files(spark, sf)
    tpl = V.contract_templates(spark, sf)
    # Detected once: the narrow (id, firm) table is stored and everything else reads it.
    det = detect_firm(cf.select("id", "extracted_text", "document_type"), V.law_firms(spark, sf))
    pairs = C.pair_templates(materialize(det.select("id", "law_firm_id", "document_type")), tpl)
    return cf, tpl, pairs


def contract_deviation_query(spark, sf):
    cf, tpl, pairs = _base(spark, sf)
    diffs = C.line_diff(pairs, cf, tpl)
    counts = C.diff_counts(pairs, diffs)
    return C.contract_deviation(pairs.where(F.col("law_firm_id").isNotNull()), counts)


query("contract_deviation", _with("""
SELECT p.contract_id, p.law_firm_id, p.contract_type,
       CAST(count(c.template_id) AS BIGINT) AS n_comparisons,
       CAST(coalesce(sum(c.n_removed + c.n_added), 0) AS BIGINT) AS total_differences,
       CAST(coalesce(max(c.n_removed + c.n_added), 0) AS BIGINT) AS max_differences
FROM (SELECT DISTINCT contract_id, law_firm_id, contract_type FROM pairs WHERE law_firm_id IS NOT NULL) p
LEFT JOIN counts c USING (contract_id)
GROUP BY ALL"""))(contract_deviation_query)


@query("pair_templates", _with("""
SELECT contract_id, law_firm_id, contract_type, template_id, template_type, template_filename
FROM pairs"""))
def pair_templates_q(spark, sf):
    return _base(spark, sf)[2]


@query("line_multiset_diff", _with("SELECT * FROM diffs"))
def line_multiset_diff_q(spark, sf):
    cf, tpl, pairs = _base(spark, sf)
    return C.line_diff(pairs, cf, tpl)


@query("diff_counts", _with("""
SELECT contract_id, template_id, n_removed, n_added, n_removed + n_added AS n_differences,
       n_removed + n_added > 0 AS differs FROM counts"""))
def diff_counts_q(spark, sf):
    cf, tpl, pairs = _base(spark, sf)
    return C.diff_counts(pairs, C.line_diff(pairs, cf, tpl))


@query("legal_comments_pick", with_views("""
SELECT law_firm_id, id AS template_id, file_name AS template_filename, trim(content) AS comment,
       'Legal Comments' AS section, 'info' AS severity
FROM (SELECT *, row_number() OVER (PARTITION BY law_firm_id ORDER BY created_at, id) AS rn
      FROM contract_templates WHERE template_type = 'legal_comments')
WHERE rn = 1 AND length(trim(content)) > 0""", "contract_templates"))
def legal_comments_pick_q(spark, sf):
    return C.legal_comments(V.contract_templates(spark, sf))


# ---- ordered differences (a longest common subsequence has no SQL form; see tests) -----------------

def _script(spark, sf):
    cf, tpl, pairs = _base(spark, sf)
    return OD.edit_script(pairs, cf.select("id", "extracted_text"), tpl.select("id", "content"))


@query("edit_script")
def edit_script_q(spark, sf):
    return _script(spark, sf)


@query("template_diff")
def template_diff_q(spark, sf):
    return OD.template_diff(_script(spark, sf))


@query("diff_hunks")
def diff_hunks_q(spark, sf):
    return OD.hunks(materialize(_script(spark, sf)))


@query("diff_by_line")
def diff_by_line_q(spark, sf):
    return OD.diff_by_line(OD.template_diff(_script(spark, sf)))

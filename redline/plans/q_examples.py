"""Queries: training-example construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.operators import examples as E
from redline.operators import sections as X
from redline.plans.q_sections import (PARAS_SQL, PROJECT_FILES_SQL, _ctes, _line_sections_sql, comments_df,
                                      project_sections_df)
from redline.plans.q_text import strip_sql
from redline.plans.registry import query
from redline.functions.text import WS
from redline.session import materialize
from redline.sources import views as V


def _sq(s: str) -> str:
    return s.replace("'", "''")


def _flat_sql() -> str:
    c = strip_sql(f"regexp_replace(paragraph, '{WS}+', ' ', 'g')")
    return (f"fcomments AS (SELECT * FROM (SELECT p.review_id, p.pos, r.project, p.refs, len(p.refs) > 0 AS has_section_refs,"
            f" {c} AS comment FROM paras p JOIN review_docs r USING (review_id) WHERE length(p.paragraph) > 10)"
            f" WHERE length(comment) > 30)")


def _full(strict: bool) -> str:
    secs = _line_sections_sql("sectioned_docs", 1500, 50) if strict else _line_sections_sql("sectioned_docs", 2000, None)
    return _ctes("sectioned_docs", "contract_files", "comment_docs", "review_docs",
                 extra=f"secs AS ({secs}),\n{PROJECT_FILES_SQL},\n{PARAS_SQL},\n"
                       "pcomments AS (SELECT c.*, r.project FROM comments c JOIN review_docs r USING (review_id)),\n"
                       + _flat_sql())


REF_CTX_SQL = """,
r AS (SELECT review_id, comment_idx, project, unnest(refs) AS ref, generate_subscripts(refs, 1) AS ref_pos
      FROM pcomments),
ex AS (SELECT r.review_id, r.comment_idx, r.ref_pos, 'Section ' || s.section_num || ':' || chr(10) || s.section_text AS part
       FROM r JOIN proj_sections s ON s.project = r.project AND s.section_num = r.ref),
fb AS (SELECT r.review_id, r.comment_idx, r.ref_pos,
              arg_min('Section ' || s.section_num || ':' || chr(10) || s.section_text, s.first_pos) AS part
       FROM r JOIN proj_sections s ON s.project = r.project AND strpos(s.section_num, r.ref) > 0
       GROUP BY ALL),
parts AS (SELECT r.review_id, r.comment_idx, r.ref_pos, coalesce(ex.part, fb.part) AS part
          FROM r LEFT JOIN ex USING (review_id, comment_idx, ref_pos) LEFT JOIN fb USING (review_id, comment_idx, ref_pos)),
refctx AS (SELECT c.review_id, c.comment_idx,
                  coalesce((SELECT string_agg(p.part, chr(10) || chr(10) ORDER BY p.ref_pos) FROM parts p
                            WHERE p.review_id = c.review_id AND p.comment_idx = c.comment_idx), '') AS context
           FROM pcomments c WHERE len(c.refs) > 0),
gen AS (SELECT project, string_agg('Section ' || section_num || ':' || chr(10) || section_text, chr(10) || chr(10)
                                   ORDER BY rk) AS context
        FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY KEYSQL, first_pos) AS rk FROM proj_sections)
        WHERE rk <= 5 GROUP BY project),
examples AS (
  SELECT c.review_id, c.comment_idx, c.project, 'SYSPROMPT' AS system,
         CASE WHEN len(c.refs) > 0
              THEN 'Please review section(s) ' || array_to_string(c.refs, ', ') || ' of this contract:' || chr(10) || chr(10)
                   || rc.context
              ELSE 'Please review this contract and provide professional comments:' || chr(10) || chr(10)
                   || coalesce(g.context, '') END AS "user",
         c.comment AS assistant
  FROM pcomments c LEFT JOIN refctx rc USING (review_id, comment_idx) LEFT JOIN gen g USING (project))
"""


def _ref_sql():
    from redline.plans.q_sections import KEY_SQL
    return REF_CTX_SQL.replace("KEYSQL", KEY_SQL).replace("SYSPROMPT", _sq(E.SYSTEM_PROMPT))


P1 = _full(False) + _ref_sql()

EXACT_SQL = """,
r2 AS (SELECT review_id, pos, project, unnest(refs) AS ref, generate_subscripts(refs, 1) AS ref_pos
       FROM fcomments WHERE has_section_refs),
exctx AS (SELECT r2.review_id, r2.pos, string_agg('Section ' || s.section_num || ': ' || s.section_text,
                                                chr(10) || chr(10) ORDER BY r2.ref_pos) AS context
          FROM r2 JOIN proj_sections s ON s.project = r2.project AND s.section_num = r2.ref GROUP BY ALL),
gen3 AS (SELECT project, string_agg('Section ' || section_num || ': ' || section_text, chr(10) || chr(10)
                                    ORDER BY first_pos) AS context
         FROM proj_sections WHERE first_pos < 3 GROUP BY project),
examples2 AS (
  SELECT c.review_id, c.pos, c.project, 'SYSPROMPT2' AS system,
         'Please review the following contract section(s) from the ' || c.project || ' project:' || chr(10) || chr(10)
           || x.context AS "user", c.comment AS assistant
  FROM fcomments c JOIN exctx x USING (review_id, pos) WHERE c.has_section_refs
  UNION ALL
  SELECT c.review_id, c.pos, c.project, 'SYSPROMPT2',
         'Please provide a general review of this contract from the ' || c.project || ' project:' || chr(10) || chr(10)
           || g.context, c.comment
  FROM fcomments c JOIN gen3 g USING (project) WHERE NOT c.has_section_refs)
""".replace("SYSPROMPT2", _sq(E.SYSTEM_PROMPT_PROJECT))

P2 = _full(True) + EXACT_SQL


def _p1(spark, sf):
    """Comments and project sections of the first builder; both feed several joins downstream, so
    they are materialised once (checkpoint) instead of being recomputed per consumer."""
    return materialize(comments_df(spark, sf)), materialize(project_sections_df(spark, sf))


def _p2(spark, sf):
    sections = project_sections_df(spark, sf, patterns=X.SECTION_PATTERNS_STRICT, max_len=1500, min_len=50)
    r = V.review_docs(spark, sf)
    flat = X.parse_comments_flat(r.select("review_id", "text"), id_col="review_id")
    return materialize(flat.join(r.select("review_id", "project"), "review_id")), materialize(sections)


def _flat_msgs(df, key):
    return df.select(*key, "project", F.col("messages")[0]["content"].alias("system"),
                     F.col("messages")[1]["content"].alias("user"), F.col("messages")[2]["content"].alias("assistant"))


@query("ref_context", P1 + "SELECT review_id, comment_idx, context FROM refctx")
def ref_context_q(spark, sf):
    c, s = _p1(spark, sf)
    return E.ref_context(c, s)


@query("ref_context_exact", P2 + "SELECT review_id, CAST(pos AS BIGINT) AS pos, context FROM exctx")
def ref_context_exact_q(spark, sf):
    c, s = _p2(spark, sf)
    return E.ref_context_exact(c, s).withColumn("pos", F.col("pos").cast("bigint"))


@query("general_context", P1 + "SELECT project, context FROM gen")
def general_context_q(spark, sf):
    return E.general_context(project_sections_df(spark, sf), 5)


@query("general_context_first3", P2 + "SELECT project, context FROM gen3")
def general_context_first3_q(spark, sf):
    s = project_sections_df(spark, sf, patterns=X.SECTION_PATTERNS_STRICT, max_len=1500, min_len=50)
    return E.general_context(s, 3, numeric_order=False, sep_line=False)


@query("chat_examples", P1 + 'SELECT review_id, comment_idx, project, system, "user", assistant FROM examples')
def chat_examples_q(spark, sf):
    c, s = _p1(spark, sf)
    return _flat_msgs(E.chat_examples(c, s), ["review_id", "comment_idx"])


@query("chat_examples_project", P2 + 'SELECT review_id, CAST(pos AS BIGINT) AS pos, project, system, "user", '
                                     'assistant FROM examples2')
def chat_examples_project_q(spark, sf):
    c, s = _p2(spark, sf)
    out = _flat_msgs(E.chat_examples_project(c, s), ["review_id", "pos"])
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query("dataset_summary", P2 + """
SELECT CAST(count(*) AS BIGINT) AS total_examples, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_dataset_size,
       round(CASE WHEN count(*) > 0 THEN coalesce(sum(n), 0) / count(*) ELSE 0.0 END, 6) AS average_example_length,
       CAST(floor(coalesce(sum(n), 0) / 4) AS BIGINT) AS estimated_tokens
FROM (SELECT length(to_json({'messages': [{'role': 'system', 'content': system}, {'role': 'user', 'content': "user"},
                                          {'role': 'assistant', 'content': assistant}]})) AS n FROM examples2)""")
def dataset_summary_q(spark, sf):
    c, s = _p2(spark, sf)
    return E.dataset_summary(E.chat_examples_project(c, s))


@query("project_example_counts", P1 + """
SELECT project, CAST(count(*) AS BIGINT) AS n_examples FROM examples GROUP BY ROLLUP (project)""")
def project_example_counts_q(spark, sf):
    c, s = _p1(spark, sf)
    return E.example_counts(E.chat_examples(c, s))

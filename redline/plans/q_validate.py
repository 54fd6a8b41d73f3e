"""Queries: validation and analysis of chat training data (V1-V5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.operators import validate as VD
from redline.plans.q_examples import P2, _p2
from redline.operators.examples import chat_examples_project
from redline.plans.registry import query
from redline.plans.views_sql import with_views
from redline.sources import views as V
from redline.plans.q_text import strip_sql


def chat_lines(spark, sf):
    """JSONL text of every conversation, one example per line (line_no = conversation id)."""
    return VD.examples_to_jsonl(V.chat(spark, sf))


_ERR = f"""
SELECT line_no, struct_err IS NULL AS valid,
       CASE WHEN struct_err IS NOT NULL THEN [struct_err] ELSE content_errs END AS errors
FROM (SELECT line_no,
        CASE WHEN len(messages) <> 3 THEN 'Line ' || line_no || ': Expected 3 messages, got ' || len(messages)
             WHEN list_transform(messages, lambda m: m.role) <> ['system', 'user', 'assistant']
             THEN 'Line ' || line_no || ': Expected roles [''system'', ''user'', ''assistant''], got [' ||
                  array_to_string(list_transform(messages, lambda m: '''' || m.role || ''''), ', ') || ']'
        END AS struct_err,
        list_transform(list_filter(list_transform(messages, lambda m, i: CASE WHEN m.content IS NULL OR
                         {strip_sql('m.content')} = '' THEN i END), lambda x: x IS NOT NULL),
                       lambda i: 'Line ' || line_no || ': Message ' || i || ' missing or empty content') AS content_errs
      FROM chat)"""
CHECKED = with_views("SELECT 1", "chat")[:-len("SELECT 1")].rstrip() + f",\nchecked AS ({_ERR})\n"


@query("validate_chat", CHECKED + """
SELECT line_no, valid, array_to_string(errors, chr(10)) AS errors, CAST(len(errors) AS BIGINT) AS n_errors
FROM checked""")
def validate_chat_q(spark, sf):
    c = VD.validate_chat(chat_lines(spark, sf))
    return c.select("line_no", "valid", F.array_join("errors", "\n").alias("errors"),
                    F.size("errors").cast("bigint").alias("n_errors"))


@query("validate_chat_summary", CHECKED + """
SELECT CAST(count(*) AS BIGINT) AS total_examples, CAST(count(*) FILTER (WHERE valid) AS BIGINT) AS valid_examples,
       CAST(sum(len(errors)) AS BIGINT) AS n_errors,
       CAST(count(*) - count(*) FILTER (WHERE valid) AS BIGINT) AS invalid_examples,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE valid) * 100.0 / count(*) END, 6) AS success_rate
FROM checked""")
def validate_chat_summary_q(spark, sf):
    return VD.validation_summary(VD.validate_chat(chat_lines(spark, sf)))


@query("validate_chat_strict", with_views(f"""
SELECT line_no, coalesce(len(messages) = 3
         AND list_transform(messages, lambda m: m.role) = ['system', 'user', 'assistant']
         AND list_bool_and(list_transform(messages, lambda m: m.content IS NOT NULL AND {strip_sql('m.content')} <> '')),
       false) AS valid
FROM chat""", "chat"))
def validate_chat_strict_q(spark, sf):
    return VD.validate_chat_strict(chat_lines(spark, sf))


@query("validation_errors_top", CHECKED + """
SELECT * FROM (
  SELECT line_no, CAST(err_pos AS INTEGER) AS err_pos, error, CAST(NULL AS BIGINT) AS remaining
  FROM (SELECT line_no, unnest(errors) AS error, generate_subscripts(errors, 1) - 1 AS err_pos FROM checked)
  ORDER BY line_no, err_pos LIMIT 10)
UNION ALL
SELECT NULL, NULL, NULL, CAST(greatest(sum(len(errors)) - 10, 0) AS BIGINT) FROM checked""")
def validation_errors_top_q(spark, sf):
    return VD.first_errors(VD.validate_chat(chat_lines(spark, sf)), 10)


@query("content_analysis", P2 + """
SELECT coalesce((SELECT string_agg(DISTINCT p, '|' ORDER BY p) FROM
                   (SELECT nullif(regexp_extract("user", 'from the (.+?) project:', 1), '') AS p FROM examples2)), '')
         AS projects,
       CAST(count(DISTINCT system) AS BIGINT) AS unique_system_prompts,
       round(avg(length("user")), 6) AS avg_user_length, CAST(min(length("user")) AS BIGINT) AS min_user_length,
       CAST(max(length("user")) AS BIGINT) AS max_user_length,
       round(avg(length(assistant)), 6) AS avg_assistant_length,
       CAST(min(length(assistant)) AS BIGINT) AS min_assistant_length,
       CAST(max(length(assistant)) AS BIGINT) AS max_assistant_length
FROM examples2""")
def content_analysis_q(spark, sf):
    c, s = _p2(spark, sf)
    return VD.content_analysis(chat_examples_project(c, s))


@query("sample_first_last", with_views("""
SELECT sample, line_no, substr(m[1].content, 1, 100) || '...' AS system, substr(m[2].content, 1, 150) || '...' AS "user",
       substr(m[3].content, 1, 150) || '...' AS assistant
FROM (SELECT 1 AS sample, arg_min(line_no, line_no) AS line_no, arg_min(messages, line_no) AS m FROM chat
      UNION ALL
      SELECT 2, arg_max(line_no, line_no), arg_max(messages, line_no) FROM chat)""", "chat"))
def sample_first_last_q(spark, sf):
    return VD.sample_first_last(V.chat(spark, sf))

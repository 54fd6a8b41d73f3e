"""Queries: training-data loading, rendering, profiling, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.functions.text import word_tokens
from redline.operators import loader as L
from redline.plans.q_text import strip_sql
from redline.plans.registry import query
from redline.plans.views_sql import with_views
from redline.functions.text import WS
from redline.sources import views as V
from redline.sources.tables import table


def training_records(spark, sf):
    """Mixed-format training files derived from the conversations: ten conversations per file,
    each written as a chat, instruction or plain-text record (by conversation id)."""
    c = V.chat(spark, sf)
    first = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), 0)["content"]
    kind = F.col("line_no") % 3
    chat_rec = F.to_json(F.struct(F.col("messages").alias("messages")))
    alp_rec = F.to_json(F.struct(first("user").alias("instruction"),
                                 F.coalesce(first("system"), F.lit("")).alias("input"),
                                 first("assistant").alias("output")))
    txt_rec = F.to_json(F.struct(F.array_join(F.transform("messages", lambda m: m["content"]), "\n").alias("text")))
    value = F.when(kind == 0, chat_rec).when(kind == 1, alp_rec).otherwise(txt_rec)
    return c.select(F.concat(F.lit("train_"), F.floor(F.col("line_no") / 10).cast("string"), F.lit(".jsonl")).alias("file"),
                    "line_no", value.alias("value"))


RECORDS_SQL = """
records AS (
  SELECT 'train_' || CAST(line_no // 10 AS VARCHAR) || '.jsonl' AS file, line_no, line_no % 3 AS kind, messages,
         list_filter(messages, lambda m: m.role = 'user')[1].content AS instruction,
         coalesce(list_filter(messages, lambda m: m.role = 'system')[1].content, '') AS "input",
         list_filter(messages, lambda m: m.role = 'assistant')[1].content AS output,
         array_to_string(list_transform(messages, lambda m: m.content), chr(10)) AS text
  FROM chat),
fmt AS (
  SELECT file, CASE WHEN arg_min(kind, line_no) = 0 THEN 'chat'
                    WHEN arg_min(kind = 1 AND instruction IS NOT NULL AND output IS NOT NULL, line_no) THEN 'instruction'
                    ELSE 'text' END AS format
  FROM records GROUP BY file)"""
REC = with_views("SELECT 1", "chat")[:-len("SELECT 1")].rstrip() + "," + RECORDS_SQL


@query("detect_format", REC + "\nSELECT file, format FROM fmt")
def detect_format_q(spark, sf):
    return L.detect_format(training_records(spark, sf))


def _render_sql(manual: bool) -> str:
    if manual:
        part = ("CASE m.role WHEN 'system' THEN 'System: ' || coalesce(m.content, '') WHEN 'user' THEN 'Human: ' || "
                "coalesce(m.content, '') WHEN 'assistant' THEN 'Assistant: ' || coalesce(m.content, '') END")
        sep = "chr(10) || chr(10)"
    else:
        part = ("CASE m.role WHEN 'system' THEN m.content || chr(10) || chr(10) WHEN 'user' THEN '### Human: ' || "
                "m.content || chr(10) || chr(10) WHEN 'assistant' THEN '### Assistant: ' || m.content || chr(10) || "
                "chr(10) END")
        sep = "''"
    return (f"array_to_string(list_filter(list_transform(messages, lambda m: {part}), lambda p: p IS NOT NULL), {sep})")


@query("render_chat", with_views(f"SELECT line_no, {_render_sql(False)} AS text FROM chat WHERE len(messages) > 0",
                                 "chat"))
def render_chat_q(spark, sf):
    c = V.chat(spark, sf).where(F.size("messages") > 0)
    return c.select("line_no", L.render_chat("messages").alias("text"))


@query("render_chat_manual", with_views(f"SELECT line_no, {_render_sql(True)} AS text FROM chat "
                                        "WHERE len(messages) > 0", "chat"))
def render_chat_manual_q(spark, sf):
    c = V.chat(spark, sf).where(F.size("messages") > 0)
    return c.select("line_no", L.render_chat_manual("messages").alias("text"))


def instruction_pairs(spark, sf):
    """Each user turn followed by an assistant turn -> (instruction, input = the conversation's
    first system turn or '', output)."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    u = c.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("u_turn"), F.col("text").alias("instruction"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("u_turn"),
                                                      F.col("text").alias("output"))
    s = (c.where(F.col("role") == "system").groupBy("conv_id")
         .agg(F.min_by("text", "turn").alias("input")))
    return u.join(a, ["conv_id", "u_turn"]).join(s, "conv_id", "left")


@query("render_instruction", """
WITH pairs AS (
  SELECT u.conv_id, u.turn AS u_turn, u.text AS instruction, a.text AS output, s."input"
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS "input" FROM conversations WHERE role = 'system' GROUP BY conv_id) s
    ON s.conv_id = u.conv_id
  WHERE u.role = 'user')
SELECT conv_id, u_turn,
       CASE WHEN coalesce("input", '') <> ''
            THEN '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Input:' || chr(10) || "input"
                 || chr(10) || chr(10) || '### Response:' || chr(10) || output
            ELSE '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response:' || chr(10) || output
       END AS text, 'instruction' AS format
FROM pairs WHERE instruction <> '' AND output <> ''""")
def render_instruction_q(spark, sf):
    return L.render_instruction(instruction_pairs(spark, sf)).select("conv_id", "u_turn", "text", "format")


@query("normalize_text_examples", f"""
SELECT doc_id, {strip_sql('text')} AS text, 'text' AS format FROM documents
WHERE text IS NOT NULL AND length({strip_sql('text')}) >= 10""")
def normalize_text_examples_q(spark, sf):
    return L.normalize_text(table(spark, sf, "documents", "doc_id", "text"))


def unified(spark, sf):
    """Every record converted by its file's detected format; misfits dropped."""
    r = training_records(spark, sf).join(L.detect_format(training_records(spark, sf)), "file")
    g = lambda path, t="string": F.expr(f"try_variant_get(try_parse_json(value), '{path}', '{t}')")
    msgs = g("$.messages", "array<struct<role: string, content: string>>")
    chat = r.where((F.col("format") == "chat") & msgs.isNotNull() & (F.size(msgs) > 0)) \
        .select("file", "line_no", L.render_chat(msgs).alias("text"), "format")
    alp = L.render_instruction(r.where(F.col("format") == "instruction").select(
        "file", "line_no", g("$.instruction").alias("instruction"), g("$.input").alias("input"),
        g("$.output").alias("output"))).select("file", "line_no", "text", "format")
    txt = L.normalize_text(r.where(F.col("format") == "text").select("file", "line_no", g("$.text").alias("text"))) \
        .select("file", "line_no", "text", "format")
    return chat.unionByName(alp).unionByName(txt)


UNIFIED_SQL = REC + f""",
unified AS (
  SELECT r.file, r.line_no, {_render_sql(False)} AS text, 'chat' AS format
  FROM records r JOIN fmt USING (file) WHERE fmt.format = 'chat' AND r.kind = 0 AND len(messages) > 0
  UNION ALL
  SELECT r.file, r.line_no,
         CASE WHEN "input" <> '' THEN '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Input:'
                   || chr(10) || "input" || chr(10) || chr(10) || '### Response:' || chr(10) || output
              ELSE '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response:' || chr(10)
                   || output END, 'instruction'
  FROM records r JOIN fmt USING (file)
  WHERE fmt.format = 'instruction' AND r.kind = 1 AND instruction <> '' AND output <> ''
  UNION ALL
  SELECT r.file, r.line_no, {strip_sql('text')}, 'text'
  FROM records r JOIN fmt USING (file) WHERE fmt.format = 'text' AND r.kind = 2 AND length({strip_sql('text')}) >= 10)
"""


@query("unify_examples", UNIFIED_SQL + "SELECT file, line_no, text, format FROM unified")
def unify_examples_q(spark, sf):
    return unified(spark, sf)


@query("dataset_stats", UNIFIED_SQL + """
SELECT format, n, avg_length, min_length, max_length,
       round(n * 100.0 / max(CASE WHEN g = 1 THEN n END) OVER (), 6) AS pct
FROM (SELECT format, CAST(count(*) AS BIGINT) AS n, round(avg(length(text)), 6) AS avg_length,
             CAST(min(length(text)) AS BIGINT) AS min_length, CAST(max(length(text)) AS BIGINT) AS max_length,
             grouping(format) AS g
      FROM unified GROUP BY GROUPING SETS ((), (format)))""")
def dataset_stats_q(spark, sf):
    return L.dataset_stats(unified(spark, sf))


_BUCKET_SQL = ("CASE WHEN length(text) <= 100 THEN '0-100' WHEN length(text) <= 500 THEN '100-500' "
               "WHEN length(text) <= 1000 THEN '500-1000' WHEN length(text) <= 2000 THEN '1000-2000' ELSE '2000+' END")


@query("length_histogram", f"""
SELECT b.bucket_order, b.bucket, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
       round(CASE WHEN sum(coalesce(c.n, 0)) OVER () > 0
                  THEN coalesce(c.n, 0) * 100.0 / sum(coalesce(c.n, 0)) OVER () ELSE 0.0 END, 6) AS pct
FROM (VALUES (0, '0-100'), (1, '100-500'), (2, '500-1000'), (3, '1000-2000'), (4, '2000+')) b(bucket_order, bucket)
LEFT JOIN (SELECT {_BUCKET_SQL} AS bucket, count(*) AS n FROM documents GROUP BY 1) c USING (bucket)""")
def length_histogram_q(spark, sf):
    return L.length_histogram(table(spark, sf, "documents", "text"))


@query("train_val_split", """
SELECT doc_id, CASE WHEN rn <= ceil(0.1 * n) THEN 'validation' ELSE 'train' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 15), doc_id) AS rn,
             count(*) OVER () AS n FROM documents)""")
def train_val_split_q(spark, sf):
    d = table(spark, sf, "documents", "doc_id")
    return L.exact_hash_split(d, "doc_id", 0.1, 42).select("doc_id", "split")


_TOKS = f"list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')"


@query("truncate_tokens", f"""
SELECT doc_id, CAST(len({_TOKS}[1:128]) AS BIGINT) AS n_tokens, array_to_string({_TOKS}[1:128], ' ') AS input_text,
       array_to_string({_TOKS}[1:128], ' ') AS labels_text
FROM documents""")
def truncate_tokens_q(spark, sf):
    t = L.truncate_tokens(table(spark, sf, "documents", "doc_id", "text"), "text", 128)
    return t.select("doc_id", "n_tokens", F.array_join("input_tokens", " ").alias("input_text"),
                    F.array_join("labels", " ").alias("labels_text"))


@query("token_estimates", f"""
SELECT doc_id, CAST(len({_TOKS}) AS BIGINT) AS ws_tokens, CAST(length(text) // 4 AS BIGINT) AS char_tokens
FROM documents""")
def token_estimates_q(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    from redline.functions.text import token_estimate_chars, token_estimate_ws
    return d.select("doc_id", token_estimate_ws("text").alias("ws_tokens"),
                    token_estimate_chars("text").alias("char_tokens"))


@query("pad_plan", f"""
SELECT lang, batch, CAST(count(*) AS BIGINT) AS n_rows, CAST(max(n_tokens) AS BIGINT) AS max_length,
       CAST(ceil(max(n_tokens) / 8) * 8 AS BIGINT) AS padded_length,
       CAST(ceil(max(n_tokens) / 8) * 8 * count(*) - sum(n_tokens) AS BIGINT) AS padding
FROM (SELECT lang, len({_TOKS}) AS n_tokens,
             CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 8 AS BIGINT) AS batch FROM documents)
GROUP BY lang, batch""")
def pad_plan_q(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "lang", "text").select(
        "doc_id", "lang", F.size(word_tokens("text")).alias("n_tokens"))
    return L.pad_plan(d, "n_tokens", ["lang"], ["doc_id"], 8, 8)

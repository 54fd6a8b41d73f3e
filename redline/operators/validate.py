"""Validation and content analysis of chat-format training data (V1-V5).

Input is a JSONL line table ``(line_no, value)`` (``spark.read.text`` plus a line number, or
text produced by ``examples_to_jsonl``).  Parsing is ``try_parse_json`` + typed extraction, all
JVM-side; the summaries are single-pass aggregates (map-side partial), never a driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.operators.text import py_strip

MESSAGES_TYPE = "array<struct<role: string, content: string>>"
EXPECTED_ROLES = ["system", "user", "assistant"]


def examples_to_jsonl(examples: DataFrame, line_col: str = "line_no") -> DataFrame:
    """(line_no, messages) -> (line_no, value) JSON text, one example per line."""
    return examples.select(F.col(line_col).alias("line_no"),
                           F.to_json(F.struct(F.col("messages").alias("messages"))).alias("value"))


def _py_list(arr: Column) -> Column:
    """Python repr of a list of strings (None for nulls), e.g. ['user', 'assistant']."""
    items = F.transform(arr, lambda x: F.when(x.isNull(), F.lit("None")).otherwise(F.concat(F.lit("'"), x, F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ok_json, has_messages, `items` (the messages as variants, null if no list), `length`
    (what a length of the field is: list items, string characters, object keys; null for none) and
    `messages_` (the typed messages, null if they do not fit)."""
    v = F.try_parse_json(py_strip(F.col("value")))
    p = lines.select("*", v.alias("_v")).select("*", F.try_variant_get("_v", "$.messages", "variant").alias("_m"))
    length = F.coalesce(F.size(F.try_variant_get("_m", "$", "array<variant>")),
                        F.size(F.map_keys(F.try_variant_get("_m", "$", "map<string,variant>"))),
                        F.when(F.schema_of_variant("_m") == "STRING", F.length(F.try_variant_get("_m", "$", "string"))))
    return p.select(*lines.columns, F.col("_v").isNotNull().alias("ok_json"), F.col("_m").isNotNull().alias("has_messages"),
                    F.try_variant_get("_m", "$", "array<variant>").alias("items"),
                    F.when(F.schema_of_variant("_m") != "VOID", length).alias("length"),
                    F.try_variant_get("_m", "$", MESSAGES_TYPE).alias("messages_"))


def validate_chat(lines: DataFrame) -> DataFrame:
    """Per line: first failing rule -> error, `valid`; an empty content adds an error per message
    but the line still counts as valid (the reference's quirk).  A `messages` field without a
    length (null, a number, a boolean) or that is no list of three is an error of its own."""
    p = parse_lines(lines)
    line = F.concat(F.lit("Line "), F.col("line_no").cast("string"))
    roles = F.transform("items", lambda m: F.try_variant_get(m, "$.role", "string"))
    struct_err = (F.when(~F.col("ok_json"), F.concat(line, F.lit(": JSON decode error")))
                  .when(~F.col("has_messages"), F.concat(line, F.lit(": Missing 'messages' field")))
                  .when(F.col("length").isNull(), F.concat(line, F.lit(": 'messages' has no length")))
                  .when(F.col("length") != 3, F.concat(line, F.lit(": Expected 3 messages, got "),
                                                       F.col("length").cast("string")))
                  .when(F.col("items").isNull(), F.concat(line, F.lit(": 'messages' is not a list")))
                  .when(~F.coalesce(roles == F.array(*[F.lit(r) for r in EXPECTED_ROLES]), F.lit(False)),
                        F.concat(line, F.lit(": Expected roles ['system', 'user', 'assistant'], got "), _py_list(roles))))

    def blank(m):
        return py_strip(F.coalesce(F.try_variant_get(m, "$.content", "string"), F.lit(""))) == ""
    empty_idx = F.filter(F.transform("items", lambda m, i: F.when(blank(m), i + 1)), lambda x: x.isNotNull())
    content_errs = F.transform(empty_idx, lambda i: F.concat(
        line, F.lit(": Message "), i.cast("string"), F.lit(" missing or empty content")))
    errors = F.when(struct_err.isNotNull(), F.array(struct_err)).otherwise(
        F.coalesce(content_errs, F.array().cast("array<string>")))
    return p.select("line_no", struct_err.isNull().alias("valid"), errors.alias("errors"))


def validation_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_examples"),
        F.count_if("valid").cast("bigint").alias("valid_examples"),
        F.sum(F.size("errors")).cast("bigint").alias("n_errors")
    ).select("*", (F.col("total_examples") - F.col("valid_examples")).alias("invalid_examples"),
             F.round(F.when(F.col("total_examples") > 0, F.col("valid_examples") * 100.0 / F.col("total_examples")),
                     6).alias("success_rate"))


def validate_chat_strict(lines: DataFrame) -> DataFrame:
    """Blank lines are not counted; any failure, empty content included, invalidates the line."""
    p = parse_lines(lines.where(py_strip(F.col("value")) != ""))
    ok = (F.col("ok_json") & F.col("has_messages") & (F.size("messages_") == 3)
          & (F.transform("messages_", lambda m: m["role"]) == F.array(*[F.lit(r) for r in EXPECTED_ROLES]))
          & F.forall("messages_", lambda m: m["content"].isNotNull() & (py_strip(m["content"]) != "")))
    return p.select("line_no", F.coalesce(ok, F.lit(False)).alias("valid"))


def first_errors(checked: DataFrame, k: int = 10) -> DataFrame:
    """First k errors in line order (a bounded TakeOrdered), then one trailer row whose `remaining`
    says how many errors were not listed."""
    e = checked.select("line_no", F.posexplode("errors").alias("err_pos", "error"))
    top = (e.orderBy("line_no", "err_pos").limit(k)
           .select("line_no", "err_pos", "error", F.lit(None).cast("bigint").alias("remaining")))
    rest = e.agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).cast("bigint").alias("remaining")).select(
        F.lit(None).cast(e.schema["line_no"].dataType).alias("line_no"), F.lit(None).cast("int").alias("err_pos"),
        F.lit(None).cast("string").alias("error"), "remaining")
    return top.unionByName(rest)


def content_analysis(examples: DataFrame) -> DataFrame:
    """Projects named in the user turns, distinct system prompts, user / assistant length stats."""
    user = F.get(F.col("messages"), 1)["content"]
    asst = F.get(F.col("messages"), 2)["content"]
    proj = F.regexp_extract(user, r"from the (.+?) project:", 1)
    x = examples.select(F.when(proj != "", proj).alias("project"), F.get(F.col("messages"), 0)["content"].alias("sys"),
                        F.length(user).alias("ul"), F.length(asst).alias("al"))
    return x.agg(
        F.array_join(F.sort_array(F.collect_set("project")), "|").alias("projects"),
        F.count_distinct("sys").cast("bigint").alias("unique_system_prompts"),
        F.round(F.avg("ul"), 6).alias("avg_user_length"), F.min("ul").cast("bigint").alias("min_user_length"),
        F.max("ul").cast("bigint").alias("max_user_length"),
        F.round(F.avg("al"), 6).alias("avg_assistant_length"), F.min("al").cast("bigint").alias("min_assistant_length"),
        F.max("al").cast("bigint").alias("max_assistant_length"))


def sample_first_last(examples: DataFrame, line_col="line_no") -> DataFrame:
    """First and last example by line order, cut to 100 / 150 / 150 characters + '...'.
    min_by / max_by are partial aggregates, so no sort of the whole set."""
    def cut(c, n):
        return F.concat(F.substring(c, 1, n), F.lit("..."))
    key = F.col(line_col) if isinstance(line_col, str) else line_col
    s = F.struct(key.alias("line_no"), "messages")
    g = examples.agg(F.min_by(s, key).alias("first"), F.max_by(s, key).alias("last"))
    rows = g.select(F.explode(F.array(F.struct(F.lit(1).alias("sample"), F.col("first").alias("e")),
                                      F.struct(F.lit(2).alias("sample"), F.col("last").alias("e")))).alias("x"))
    m = F.col("x.e.messages")
    return rows.select(F.col("x.sample").alias("sample"), F.col("x.e.line_no").alias("line_no"),
                       cut(F.get(m, 0)["content"], 100).alias("system"), cut(F.get(m, 1)["content"], 150).alias("user"),
                       cut(F.get(m, 2)["content"], 150).alias("assistant"))

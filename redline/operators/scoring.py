"""Prompt assembly and batch scoring.

Scoring calls a user function, so it is the one place Python runs per record: batches arrive as
Arrow-backed pandas frames through ``mapInPandas``; the scorer sees a whole batch.  Concurrency
against a rate-limited service is the number of partitions of the scoring stage.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORE_SCHEMA = "success boolean, error string, generated_text string, finish_reason string, tokens_generated bigint"


def batch_score(df: DataFrame, prompt_col: str, scorer: Callable,
                max_concurrent: int | None = None, keep: tuple = ()) -> DataFrame:
    """Score every non-blank prompt; per-row success / error.  `scorer(pd.Series) -> DataFrame`
    with generated_text, finish_reason, tokens_generated; a failing batch is retried row by row so
    one bad prompt only fails its own row."""
    fn = scorer
    cols = list(keep) + [prompt_col]
    x = df.where(F.col(prompt_col).isNotNull() & (F.trim(F.col(prompt_col)) != "")).select(*cols)
    if max_concurrent:
        x = x.repartition(max_concurrent)

    def run(batches):
        for pdf in batches:
            try:
                res = fn(pdf[prompt_col]).reset_index(drop=True)
                out = pd.DataFrame({"success": True, "error": None}, index=range(len(pdf)))
                out = pd.concat([out, res[["generated_text", "finish_reason", "tokens_generated"]]], axis=1)
            except Exception:
                rows = []
                for p in pdf[prompt_col]:
                    try:
                        r = fn(pd.Series([p])).iloc[0]
                        rows.append((True, None, r["generated_text"], r["finish_reason"], int(r["tokens_generated"])))
                    except Exception as e:  # noqa: BLE001 - reported per row
                        rows.append((False, str(e), None, None, None))
                out = pd.DataFrame(rows, columns=["success", "error", "generated_text", "finish_reason",
                                                  "tokens_generated"])
            for k in keep:
                out[k] = pdf[k].values
            out[prompt_col] = pdf[prompt_col].values
            yield out[list(keep) + [prompt_col, "success", "error", "generated_text", "finish_reason",
                                    "tokens_generated"]]

    schema = x.select(*cols).schema.simpleString()[len("struct<"):-1].replace(":", " ")
    return x.mapInPandas(run, f"{schema}, {SCORE_SCHEMA}")


# ---- resumable scoring (B2) ---------------------------------------------------------------------

def _log_rounds(spark, log_dir: str) -> list[int]:
    """Numbers of the rounds that were written to their end."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(log_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[6:]) for n in names if n.startswith("round=")
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{log_dir}/{n}/_SUCCESS")))


def score_log(spark, log_dir: str, id_type: str, value_type: str) -> DataFrame:
    """(id, attempt, success, error, value, round, slot): what the committed rounds tried."""
    schema = f"id {id_type}, attempt int, success boolean, error string, value {value_type}, round int, slot int"
    rounds = _log_rounds(spark, log_dir)
    if not rounds:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", log_dir).schema(schema).parquet(*[f"{log_dir}/round={n}" for n in rounds])


def resumable_score(requests: DataFrame, log_dir: str, scorer: Callable, value_type: str, slots: int = 8,
                    max_attempts: int = 3, id_col: str = "id", prompt_col: str = "prompt") -> DataFrame:
    """(id, attempts, success, error, value): the outcome of every request with a non-blank prompt.

    ``scorer(prompt, attempt)`` is a column of struct(success, error, value).  Requests (one row per id)
    are dealt to ``slots`` by their id; a slot is one task, so it bounds the calls made at a time.  Each
    round tries what has neither succeeded nor used its attempts, and logs one row per try; a round counts
    once it is written to its end.  Called again with the same log, after a crash or with more requests,
    only what is missing is scored."""
    spark = requests.sparkSession
    id_type = requests.schema[id_col].dataType.simpleString()
    asked = (requests.where(F.col(prompt_col).isNotNull() & (F.trim(F.col(prompt_col)) != ""))
             .select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt")))
    slot = F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int")
    for _ in range(max_attempts):
        tried = (score_log(spark, log_dir, id_type, value_type).groupBy("id")
                 .agg(F.max("attempt").alias("tried"), F.max("success").alias("done")))
        left = (asked.join(tried, "id", "left").withColumn("attempt", F.coalesce("tried", F.lit(0)) + 1)
                .where(~F.coalesce("done", F.lit(False)) & (F.col("attempt") <= max_attempts)))
        if left.isEmpty():
            break
        out = left.select("id", "attempt", slot.alias("slot"), scorer(F.col("prompt"), F.col("attempt")).alias("s"))
        done = _log_rounds(spark, log_dir)
        (out.select("id", "attempt", F.col("s.success").alias("success"), F.col("s.error").alias("error"),
                    F.col("s.value").cast(value_type).alias("value"), "slot")
         .repartition(slots, "slot").write.mode("overwrite").partitionBy("slot")
         .parquet(f"{log_dir}/round={done[-1] + 1 if done else 0}"))
    last = (score_log(spark, log_dir, id_type, value_type).groupBy("id")
            .agg(F.max("attempt").alias("attempts"), F.max_by(F.struct("success", "error", "value"), "attempt").alias("s")))
    return (asked.select("id").join(last, "id")
            .select(F.col("id").alias(id_col), "attempts", "s.success", "s.error", "s.value"))


#: Requests of one file list that share a copy of its prompt's texts.
REQUESTS_PER_COPY = 1000


def review_prompt(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests(request_id, file_ids) x files(id, filename, extracted_text) -> per request the
    contract sections 'Contract: <file>\\n\\n<text>' in requested order joined by a blank line,
    their count and total length; a missing or unextracted file fails the request (no prompt).

    Lists are judged by ids alone.  Texts travel once per distinct list without a failure, and once
    more for every ``REQUESTS_PER_COPY`` of its requests, not once per request."""
    r = requests.select("request_id", F.posexplode("file_ids").alias("pos", "file_id"))
    asked = r.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("pos", "file_id"))).alias("_list"))
    bad = F.col("extracted_text").isNull() | (F.col("extracted_text") == "")
    found = files.select(F.col("id").alias("file_id"), bad.alias("bad"))
    lists = asked.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / REQUESTS_PER_COPY).cast("int").alias("copies"))
    judged = (lists.select("*", F.explode("_list").alias("_f")).select("_list", "copies", F.col("_f.file_id").alias("file_id"))
              .join(found, "file_id", "left")
              .groupBy("_list").agg(F.max("copies").alias("copies"), F.bool_or(F.coalesce("bad", F.lit(True))).alias("failed")))
    parts = (judged.where(~F.col("failed")).select("_list", F.explode("_list").alias("_f"), "copies")
             .select("_list", "_f.*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_copy")))
    sec = F.concat(F.lit("Contract: "), F.col("filename"), F.lit("\n\n"), F.col("extracted_text"))
    texts = parts.join(files.select(F.col("id").alias("file_id"), sec.alias("s")), "file_id")
    prompts = (texts.groupBy("_list", "_copy").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("_p"))
               .select("_list", "_copy", F.size("_p").cast("bigint").alias("n_sections"),
                       F.aggregate("_p", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["s"])).alias("total_length"),
                       F.array_join(F.col("_p")["s"], "\n\n").alias("contract_text")))
    return (asked.join(judged, "_list").withColumn("_copy", F.pmod(F.xxhash64("request_id"), "copies").cast("int"))
            .join(prompts, ["_list", "_copy"], "left")
            .select("request_id", "failed", "n_sections", "total_length", "contract_text"))


def export_conversation(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """'[ts] ROLE: text' lines joined by a blank line in turn order (one conversation per group)."""
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.upper("role"),
                    F.lit(": "), F.col("text"))
    return (turns.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(order_col, line.alias("l")))).alias("_l"))
            .select(id_col, F.array_join(F.col("_l")["l"], "\n\n").alias("export")))


def score_udf(scorer: Callable):
    """The scorer as a column function (Arrow-batched pandas UDF) returning
    struct<generated_text, finish_reason, tokens_generated>; usable in select / SQL
    (``spark.udf.register``).  Unlike :func:`batch_score` a failing batch fails the task."""
    fn = scorer

    @F.pandas_udf("generated_text string, finish_reason string, tokens_generated bigint")
    def score(prompts: pd.Series) -> pd.DataFrame:
        out = fn(prompts).reset_index(drop=True)
        return out[["generated_text", "finish_reason", "tokens_generated"]].astype(
            {"tokens_generated": "int64"})

    return score

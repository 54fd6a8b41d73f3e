"""Listings, lookups, searches, formatting and dashboard aggregates.

Listings are distributed sorts (range exchange), top-k reports are bounded ``TakeOrdered``s, and
every aggregate is a single pass with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def list_newest(df: DataFrame, ts_col: str = "created_at", id_col: str = "id", json_cols: dict | None = None) -> DataFrame:
    """Newest first (ties by id), JSON text columns decoded with the given schemas."""
    out = df
    for c, schema in (json_cols or {}).items():
        out = out.withColumn(c, F.from_json(F.col(c), schema))
    return out.orderBy(F.col(ts_col).desc(), F.col(id_col))


def lookup(df: DataFrame, key_col: str, value) -> DataFrame:
    """Point lookup; the equality reaches the Parquet scan as a pushed filter."""
    return df.where(F.col(key_col) == F.lit(value))


def template_search(templates: DataFrame, firm: str | None = None, template_type: str | None = None) -> DataFrame:
    out = templates
    if firm is not None:
        out = out.where(F.col("law_firm_id") == firm)
    if template_type is not None:
        out = out.where(F.col("template_type") == template_type)
    return out.orderBy("law_firm_id", "template_type", "id")


def template_listing(templates: DataFrame) -> DataFrame:
    """Ordered by firm, type, creation; `firm_header` marks the first template of each firm (the
    place the listing prints a firm heading); creation time at minute precision."""
    w = Window.partitionBy("law_firm_id").orderBy("template_type", "created_at", "id")
    return (templates.select("id", "law_firm_id", "template_type", "file_name",
                             F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created"),
                             (F.row_number().over(w) == 1).alias("firm_header"), "created_at")
            .orderBy("law_firm_id", "template_type", "created_at", "id").drop("created_at"))


def history_search(df: DataFrame, term: str | None, status: str = "all") -> DataFrame:
    """Case-insensitive substring search over file name(s), firm and model, ANDed with a status
    filter ('all' = none)."""
    out = df
    if term:
        t = F.lit(term.lower())
        hit = (F.exists(F.col("contract_files"), lambda f: F.lower(f).contains(t))
               | F.coalesce(F.lower(F.col("law_firm_name")).contains(t), F.lit(False))
               | F.coalesce(F.lower(F.col("model_id")).contains(t), F.lit(False)))
        out = out.where(hit)
    if status != "all":
        out = out.where(F.lower(F.col("status")) == status.lower())
    return out


def recent_activity(reviews: DataFrame, comments: DataFrame, k: int = 3) -> DataFrame:
    """Top k reviews and top k comments (newest first), tagged, merged, top k again."""
    def top(df, tag):
        return (df.orderBy(F.col("created_at").desc(), F.col("id")).limit(k)
                .select("id", "created_at", "status", F.lit(tag).alias("type")))
    both = top(reviews, "review").unionByName(top(comments, "comment"))
    return both.orderBy(F.col("created_at").desc(), F.col("id")).limit(k)


def dashboard_stats(reviews: DataFrame, comments: DataFrame) -> DataFrame:
    """Totals and success rate = round(100 * completed / total) over reviews and comments; 0 when
    there is nothing."""
    def agg(df, p):
        return df.agg(F.count(F.lit(1)).cast("bigint").alias(f"total_{p}"),
                      F.count_if(F.col("status") == "completed").cast("bigint").alias(f"completed_{p}"))
    r, c = agg(reviews, "reviews"), agg(comments, "comments")
    # Two one-row aggregates merged without a join: union, then take each column's value.
    j = r.unionByName(c, allowMissingColumns=True).agg(*[F.max(x).alias(x) for x in ["total_reviews", "completed_reviews", "total_comments", "completed_comments"]])
    total = F.col("total_reviews") + F.col("total_comments")
    done = F.col("completed_reviews") + F.col("completed_comments")
    return j.select("total_reviews", "total_comments",
                    F.when(total > 0, F.round(done * 100.0 / total, 0)).otherwise(F.lit(0.0)).cast("bigint")
                    .alias("success_rate_pct"))


def processing_time(df: DataFrame, by: list) -> DataFrame:
    """Seconds from creation to completion, summarised per group."""
    # timestampdiff on the zone-less values: independent of the session time zone.
    secs = F.expr("timestampdiff(MICROSECOND, created_at, completed_at)")
    x = df.where(F.col("completed_at").isNotNull()).withColumn("_s", secs / 1e6)
    return x.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.round(F.avg("_s"), 6).alias("avg_seconds"),
                              F.round(F.min("_s"), 6).alias("min_seconds"), F.round(F.max("_s"), 6).alias("max_seconds"))


def latency_summary(df: DataFrame, success_col: str, time_col: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("total_requests"),
                  F.count_if(F.col(success_col)).cast("bigint").alias("successful_requests"),
                  F.round(F.count_if(F.col(success_col)) * 100.0 / F.count(F.lit(1)), 6).alias("success_rate"),
                  F.round(F.avg(time_col), 6).alias("avg_response_time"),
                  F.round(F.min(time_col), 6).alias("min_response_time"),
                  F.round(F.max(time_col), 6).alias("max_response_time"))


def perplexity(losses: DataFrame, by: list, loss_col: str = "value") -> DataFrame:
    return losses.groupBy(*by).agg(F.round(F.avg(loss_col), 6).alias("eval_loss"),
                                   F.round(F.exp(F.avg(loss_col)), 6).alias("perplexity"),
                                   F.count(F.lit(1)).cast("bigint").alias("n"))


def templates_per_firm(templates: DataFrame, firms: DataFrame) -> DataFrame:
    """Template count per firm (zero kept), existence flag; firms without templates via left join."""
    counts = templates.groupBy("law_firm_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_templates"))
    return (firms.select(F.col("id").alias("law_firm_id"), F.col("name").alias("law_firm_name"))
            .join(counts, "law_firm_id", "left")
            .select("law_firm_id", "law_firm_name", F.coalesce("n_templates", F.lit(0)).cast("bigint").alias("n_templates"),
                    F.col("n_templates").isNotNull().alias("has_templates")))


def response_quality(df: DataFrame, text_col: str, threshold: float = 0.7) -> DataFrame:
    """Per response: > 20 chars, not starting with 'error' (any case), > 5 whitespace words."""
    from redline.functions.text import word_tokens
    t = F.col(text_col)
    ok = (F.length(t) > 20) & ~F.lower(t).startswith("error") & (F.size(word_tokens(t)) > 5)
    return df.withColumn("quality_ok", F.coalesce(ok, F.lit(False)))


def quality_summary(checked: DataFrame, threshold: float = 0.7) -> DataFrame:
    rate = F.count_if("quality_ok") / F.count(F.lit(1))
    return checked.agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                       F.count_if("quality_ok").cast("bigint").alias("n_ok"),
                       F.round(rate, 6).alias("rate"), (rate >= threshold).alias("passed"))

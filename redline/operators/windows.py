"""Per-job series analytics (N1-N4): running best loss, progress, early stopping, latest point.

A job's log is ordered by step and one job may hold a large share of all rows, so no window is
partitioned by the job alone.  Running aggregates use a two-level scan: rows are cut into
fixed-width step buckets, the running value is computed inside each (job, bucket) window
(bounded size), and the value carried in from earlier buckets comes from a small per-bucket
summary table.  Latest-point queries are plain ``max_by`` aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redline.operators.loader import sequence_within

BUCKET_WIDTH = 1 << 20   # steps per bucket: bounds every window partition


def running_extreme(df: DataFrame, key: str, order: str, value: str, out: str, fn: str = "min",
                    inclusive: bool = True, bucket_width: int = BUCKET_WIDTH) -> DataFrame:
    """Running min / max of `value` per `key` in `order` (an integer column).  `inclusive=False`
    gives the value over strictly earlier rows (null on the first row)."""
    agg = F.min if fn == "min" else F.max
    comb = F.least if fn == "min" else F.greatest
    b = df.withColumn("_b", F.floor(F.col(order) / bucket_width).cast("bigint"))
    hi = Window.currentRow if inclusive else -1
    wl = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, hi)
    b = b.withColumn("_local", agg(value).over(wl))
    per_bucket = b.groupBy(key, "_b").agg(agg(value).alias("_bv"))
    wb = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.withColumn("_carry", agg("_bv").over(wb)).drop("_bv")
    j = b.join(carry, [key, "_b"], "left")
    return j.withColumn(out, comb(F.col("_local"), F.col("_carry"))).drop("_b", "_local", "_carry")


def best_loss(log: DataFrame, key: str = "job_id", order: str = "step", value: str = "value") -> DataFrame:
    """Running minimum of the loss per job."""
    return running_extreme(log, key, order, value, "best_loss", "min")


def job_progress(log: DataFrame, every: int = 50, key: str = "job_id", order: str = "step") -> DataFrame:
    """Per logged point: its 1-based position / the job's point count * 100, and whether it is a
    reported point (every 50th)."""
    s = sequence_within(log, [key], [order], "seq")
    totals = log.groupBy(key).agg(F.count(F.lit(1)).alias("_total"))
    j = s.join(totals, key)
    pos = F.col("seq") + 1
    return j.select("*", F.round(pos * 100.0 / F.col("_total"), 6).alias("progress_pct"),
                    (pos % every == 0).alias("reported")).drop("_total")


def early_stop(log: DataFrame, patience: int = 3, key: str = "job_id", order: str = "step",
               value: str = "value") -> DataFrame:
    """First point per job at which `patience` consecutive evaluations failed to improve on the
    best loss seen before them (improvement = strictly lower; the first point improves)."""
    prev_best = running_extreme(log, key, order, value, "_prev_best", "min", inclusive=False)
    imp = prev_best.withColumn("_imp", F.col("_prev_best").isNull() | (F.col(value) < F.col("_prev_best")))
    seq = sequence_within(imp, [key], [order], "_seq")
    last = running_extreme(seq.withColumn("_imp_seq", F.when(F.col("_imp"), F.col("_seq"))),
                           key, "_seq", "_imp_seq", "_last_imp", "max")
    streak = last.withColumn("_streak", F.col("_seq") - F.col("_last_imp"))
    hit = streak.where(F.col("_streak") >= patience)
    return hit.groupBy(key).agg(F.min_by(F.struct(F.col(order).alias("stop_step"), F.col(value).alias("stop_value")),
                                         F.col(order)).alias("s")) \
        .select(key, "s.stop_step", "s.stop_value")


def latest_per_job(log: DataFrame, key: str = "job_id", order: str = "step") -> DataFrame:
    """Last logged row per job (max_by on the step: a partial aggregate)."""
    cols = [c for c in log.columns if c != key]
    return (log.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("l"))
            .select(key, *[F.col(f"l.{c}").alias(c) for c in cols]))

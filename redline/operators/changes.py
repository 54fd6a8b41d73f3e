"""Change application on immutable snapshots.

Spark tables here are snapshots; an "update" is a new snapshot computed with joins: anti joins
for absence checks, semi joins for existence, aggregates (not windows) to pick one row per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.session import materialize


def insert_if_absent(base: DataFrame, new: DataFrame, keys: list, order_col: str | None = None,
                     unique_cols: list | None = None) -> DataFrame:
    """Incoming rows with an `action`.  Of the batch's rows with one key the first by `order_col`
    counts, the others are 'duplicate'.  It is 'rejected' if its key is in `base` or, for a unique
    column in turn, its value is in `base` or with an earlier row that got as far; else 'inserted'.

    Every incoming row comes out once: rows are told apart by an id of their own (stored once, so
    that it is the same wherever it is read), keys compare null-safe, and a null in a unique column
    collides with nothing.  First rows come from min aggregates, so a hot key does not sort in one
    task."""
    rows = materialize(new.withColumn("_id", F.monotonically_increasing_id()))
    place = F.struct((F.col(order_col) if order_col else F.lit(0)).alias("o"), F.col("_id").alias("id"))

    def firsts(df: DataFrame, by: list) -> DataFrame:
        return df.groupBy(*by).agg(F.min(place).alias("_m")).select(F.col("_m.id").alias("_id"))
    first = rows.join(firsts(rows, keys), "_id", "left_semi")
    known = base.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)]).distinct()
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(keys)])
    left = first.join(known, same, "left_anti")
    for u in unique_cols or []:
        left = left.join(base.select(u).distinct(), u, "left_anti")
        taken = firsts(left.where(F.col(u).isNotNull()), [u])
        left = left.where(F.col(u).isNull()).unionByName(left.join(taken, "_id", "left_semi"))
    marks = (first.select(F.col("_id").alias("_f"), F.lit(True).alias("_first"))
             .join(left.select(F.col("_id").alias("_f"), F.lit(True).alias("_new")), "_f", "left"))
    action = F.when(F.col("_first").isNull(), "duplicate").when(F.col("_new").isNull(), "rejected").otherwise("inserted")
    return rows.join(marks, F.col("_id") == F.col("_f"), "left").select(*new.columns, action.alias("action"))


def apply_log(log: DataFrame, key: str, seq: str, cols: list) -> DataFrame:
    """Latest state per key from an append-only change log: each column takes its last non-null
    value (max_by over the sequence, rows with a null value ignored)."""
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols]
    return log.groupBy(key).agg(F.max(seq).alias("last_" + seq), *aggs)


def delete_rows(df: DataFrame, doomed: DataFrame, keys: list) -> tuple[DataFrame, DataFrame]:
    """(new snapshot without the doomed keys, the deleted rows)."""
    return df.join(doomed.select(*keys), keys, "left_anti"), df.join(doomed.select(*keys), keys, "left_semi")


def orphans(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Foreign-key check: for each (name, child, fk, parent, pk) the child rows whose non-null key
    has no parent.  Output (fk_name, fk_value, n_rows)."""
    parts = []
    for name, child, fk, parent, pk in checks:
        c = child.where(F.col(fk).isNotNull()).select(F.col(fk).cast("string").alias("fk_value"))
        p = parent.select(F.col(pk).cast("string").alias("fk_value"))
        parts.append(c.join(p, "fk_value", "left_anti").groupBy("fk_value")
                     .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).withColumn("fk_name", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts).select("fk_name", "fk_value", "n_rows")


def union_distinct(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs).distinct()


FINISHED = ["completed", "failed", "cancelled"]


def cancel_jobs(jobs: DataFrame, requested: DataFrame, key: str = "job_id", ts_col: str = "ts") -> DataFrame:
    """Cancel requested jobs that are not finished: their status becomes 'cancelled' with the
    request time as completion; finished jobs keep their state and are reported as rejected.
    jobs(key, status, ...), requested(key, requested_at).  Output: new job snapshot + `action`."""
    j = jobs.join(requested, key, "left")
    asked = F.col("requested_at").isNotNull()
    can = asked & ~F.col("status").isin(*FINISHED)
    return j.select(
        *[c for c in jobs.columns if c not in ("status",)],
        F.when(can, F.lit("cancelled")).otherwise(F.col("status")).alias("status"),
        F.when(can, F.col("requested_at")).alias("cancelled_at"),
        F.when(can, "cancelled").when(asked, "rejected").otherwise("unchanged").alias("action"))

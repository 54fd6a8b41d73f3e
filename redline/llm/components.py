"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import stored

MAX_ROUNDS = 100
#: A task of a round takes about so many edges; few edges make few tasks, whatever the number of shuffle partitions.
TASK_ROWS = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)`` that is not its component's smallest node.

    A large star links the larger neighbours of each node to its smallest one, a small star the
    smaller ones; both keep the components and shorten paths, until only stars are left.  Each
    round is two joins with pre-aggregated minima, so a node with very many links costs one row
    per task; the state is stored each round, in as many files as its rows need."""
    e = stored(_down(edges), "component-edges")
    for _ in range(MAX_ROUNDS):
        rows, far = _state(e)
        if not far:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        tasks = max(e.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS)
        e = stored(_small_star(_large_star(e, tasks), tasks), "component-edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _down(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distinct edges from the larger to the smaller node, in ``tasks`` partitions at most."""
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return down.distinct() if tasks is None else down.coalesce(tasks).distinct().coalesce(tasks)


def _state(e: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes that keep them from being stars: with several smaller
    neighbours, or with smaller and larger ones."""
    up = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first())


def _large_star(e: DataFrame, tasks: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return _down(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")), tasks)


def _small_star(e: DataFrame, tasks: int) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    down = e.join(least, "u")
    moved = down.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _down(moved.unionByName(least.select("u", F.col("m").alias("v"))), tasks)

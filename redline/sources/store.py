"""A stored table with unique keys, dealt to buckets by the key's hash.

Rows live in ``<path>/v=<version>/bucket=<n>/`` as Parquet.  A change reads the buckets its keys fall
into, writes those buckets under a new version and creates the version's commit marker last; the other
buckets stay where they are.  Readers take each bucket from its newest committed version, so a job that
dies half way changes nothing, and a version that is committed already is not applied again.  What two
later versions have replaced is dropped.

Changes of one table follow each other (one streaming query, or one job at a time).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMITTED = "_COMMITTED"


@dataclass(frozen=True)
class Commit:
    """What a change did: its version, the buckets written and the buckets left alone."""
    version: int
    written: tuple[int, ...]
    untouched: tuple[int, ...]


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- layout -----------------------------------------------------------------------------

    def _names(self, folder: str, prefix: str) -> list[str]:
        p = self._jpath(folder)
        if not self._fs.exists(p):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(p)) if n.startswith(prefix))

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return [int(v[2:]) for v in self._names(self.path, "v=") if self._fs.exists(self._jpath(f"{self.path}/{v}/{COMMITTED}"))]

    def _folder(self, version: int) -> str:
        return f"{self.path}/v={version:012d}"

    def _current(self) -> dict[int, int]:
        """The newest committed version of each bucket that was ever written."""
        return {int(b[7:]): v for v in self.versions() for b in self._names(self._folder(v), "bucket=")}

    def bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    # ---- reading ----------------------------------------------------------------------------

    def read(self, buckets=None) -> DataFrame:
        """The table, or the rows of some of its buckets."""
        at = self._current()
        chosen = [f"{self._folder(v)}/bucket={b}" for b, v in sorted(at.items()) if buckets is None or b in buckets]
        filled = [p for p in chosen if self._names(p, "part-")]
        if not filled:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*filled)

    # ---- changing ---------------------------------------------------------------------------

    def change(self, keys: DataFrame, merge: Callable[[DataFrame], DataFrame], version: int | None = None) -> Commit:
        """Replace the buckets of ``keys`` by ``merge(their rows)``, in one commit.  ``version`` names the
        change (a batch id): one that is committed already is not applied again."""
        done, at = self.versions(), self._current()
        if version is None:
            version = done[-1] + 1 if done else 0
        elif version in done:
            return Commit(version, (), tuple(sorted(at)))
        # At most as many numbers as there are buckets.
        touched = tuple(sorted(r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()))
        folder = self._folder(version)
        self._fs.delete(self._jpath(folder), True)      # of an attempt that died
        new = merge(self.read(set(touched))).select(*self.schema.fieldNames())
        (new.withColumn("bucket", self.bucket()).repartition(max(1, len(touched)), "bucket")
         .write.partitionBy("bucket").parquet(folder))
        for b in touched:                                # emptied buckets leave an empty folder
            self._fs.mkdirs(self._jpath(f"{folder}/bucket={b}"))
        self._fs.create(self._jpath(f"{folder}/{COMMITTED}")).close()
        self._drop_replaced()
        return Commit(version, touched, tuple(b for b in sorted(at) if b not in touched))

    def _drop_replaced(self) -> None:
        """Drop buckets that a committed version before the newest replaced: who reads the last
        snapshot but one still finds its files."""
        *older, _ = self.versions()
        last: dict[int, int] = {}
        for v in older:
            for b in self._names(self._folder(v), "bucket="):
                n = int(b[7:])
                if n in last:
                    self._fs.delete(self._jpath(f"{self._folder(last[n])}/{b}"), True)
                last[n] = v

    def upsert(self, changes: DataFrame, order: str, version: int | None = None) -> Commit:
        """Per key the row with the greatest ``order``, of the table's and the changes' rows."""
        rest = [c for c in self.schema.fieldNames() if c != self.key]

        def latest(old: DataFrame) -> DataFrame:
            both = old.unionByName(changes.select(*self.schema.fieldNames()))
            return (both.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_l"))
                    .select(self.key, *[F.col("_l").getField(c).alias(c) for c in rest]))
        return self.change(changes, latest, version)

    def insert_new(self, rows: DataFrame, version: int | None = None) -> Commit:
        """Add the rows (one per key) whose key is not there yet."""
        def added(old: DataFrame) -> DataFrame:
            new = rows.select(*self.schema.fieldNames())
            return old.unionByName(new.join(old.select(self.key), self.key, "left_anti"))
        return self.change(rows, added, version)

    def delete(self, keys: DataFrame, version: int | None = None) -> Commit:
        """Remove the rows of the given keys."""
        return self.change(keys, lambda old: old.join(keys.select(self.key), self.key, "left_anti"), version)

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], version: int | None = None) -> Commit:
        """Rewrite the rows of the given keys by ``change``; the others stay as they are."""
        def changed(old: DataFrame) -> DataFrame:
            k = keys.select(self.key)
            return old.join(k, self.key, "left_anti").unionByName(change(old.join(k, self.key, "left_semi")))
        return self.change(keys, changed, version)

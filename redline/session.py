"""Spark session helpers.

Operators never create sessions themselves; they take DataFrames.  These helpers exist for
tests, the bench and the entry points.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at every scale: AQE re-plans joins and coalesces shuffle output at
# runtime, skew-join splitting handles hot keys, Arrow keeps the pandas paths batched.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "redline",
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("REDLINE_DRIVER_MEMORY", "16g"))
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is; it must be set
    there.  Only a local master (tests), where all tasks share one machine, gets a scratch folder.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir()
    if hasattr(current, "isDefined"):
        current = current.get() if current.isDefined() else None
    if current:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(current)
        return current
    master = sc.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    path = tempfile.mkdtemp(prefix="redline-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def materialize(df):
    """Reliable checkpoint into the shared checkpoint folder: the result is computed once, later
    consumers read it back, and the lineage is cut (a lost executor does not recompute upstream
    stages).  Never a machine-local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make the `redline` package importable by the Python workers (pandas UDFs, mapInPandas
    functions are pickled by module reference): zip it once per application and add it with
    ``addPyFile`` so Spark distributes it to every executor."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    if "redline" in sc.getConf().get("spark.submit.pyFiles", ""):
        _SHIPPED.add(app)      # already shipped at submit time (--py-files)
        return
    import zipfile
    # The archive is driver-side code shipped by Spark's file server (what addPyFile does); it is
    # not data, so a driver-local folder is the right place for it.
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="redline-pkg-", dir="/tmp")
    path = os.path.join(out_dir, "redline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("redline", os.path.relpath(full, pkg_dir)))
    sc.addPyFile(path)
    _SHIPPED.add(app)

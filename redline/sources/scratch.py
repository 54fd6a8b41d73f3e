"""Scratch locations for jobs that persist intermediate tables.

Always under the cluster's shared ``spark.checkpoint.dir`` (set by the session helper only when
the cluster does not name one), never a machine-local temporary folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from redline.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/redline-scratch/{name}-{uuid.uuid4().hex[:12]}"

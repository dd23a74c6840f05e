"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Applied only when this library builds the session; a session handed in keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where that costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "contraluz", **settings: str) -> SparkSession:
    """Create (or reuse) a session with the settings the jobs are tuned for."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_FOLDERS: dict[str, str] = {}


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``.

    Only where that setting is absent (local runs and tests) a machine-local folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="contraluz-")
        base = _LOCAL_FOLDERS[app]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"

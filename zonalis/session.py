"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None,
                  app: str = "zonalis", **conf: str) -> SparkSession:
    """A session with the settings this package is tuned for.

    On a cluster leave ``shuffle_partitions`` unset: AQE then coalesces down from the
    cluster's own default, so one setting serves both small and very large inputs.
    """
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .config("spark.ui.enabled", "false")
        # Call-site capture on every Column operation doubles the time to build large plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written intermediates and stream state.

    It lives under the cluster's ``spark.checkpoint.dir``. Only a local-mode session may
    fall back to a temporary folder of this machine: on a cluster other hosts could not
    read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all hosts share")
        base = tempfile.mkdtemp(prefix="zonalis-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of every executor.

    Called by the operators that run Python in tasks. By reference rather than pickled by
    value, so that a reused worker keeps what it cached.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="zonalis-"), "zonalis-package")
        sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(sc.applicationId)

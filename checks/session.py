"""A local session for checks, tests and the bench."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cpus: int = 8, partitions: int = 8, shared: str | None = None) -> SparkSession:
    """``shared`` is the folder for intermediate tables; a new one unless the session has one."""
    paths = [str(ROOT), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(paths))  # for the workers
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skyledger")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    own_folder(spark, shared)
    return spark


def own_folder(spark: SparkSession, shared: str | None = None) -> None:
    """Gives a session on this machine alone a folder for intermediate tables, if it has none."""
    context = spark.sparkContext
    if context.master.startswith("local-cluster") or not context.master.startswith("local"):
        return
    if not (context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="shared-"))

"""SparkSession set-up for tests, bench and the command line.

On a cluster the session comes from the platform; these settings are the
ones the library relies on (UTC, AQE with skew-join splitting).  The
checkpoint folder is read from ``spark.checkpoint.dir``; a scratch folder is
only chosen when the setting is missing, as in local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def _driver_memory() -> str:
    """Local runs: 60% of the machine's memory, between 1 and 8 GiB."""
    try:
        with open("/proc/meminfo") as f:
            kb = next(int(line.split()[1]) for line in f if line.startswith("MemTotal:"))
        gib = max(1, min(8, int(kb * 0.6 / (1024 * 1024))))
    except (OSError, StopIteration, ValueError):
        gib = 4
    return f"{gib}g"


def get_spark(master: str | None = None, app: str = "staylens",
              shuffle_partitions: int | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or os.environ.get("STAYLENS_MASTER", f"local[{cpus}]")
    parts = shuffle_partitions or int(os.environ.get("STAYLENS_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files (the insight cube) are removed once no longer referenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("STAYLENS_DRIVER_MEMORY", _driver_memory()))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the platform and only read here; without it the
    call fails, as executors do not share a machine's own folders.  A session in
    one process (tests, bench) gets a scratch folder where it is unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="staylens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A table location under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"

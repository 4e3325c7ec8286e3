"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

# AQE coalesces small shuffle partitions, splits skewed ones and re-plans joins
# from run-time sizes, so one setting serves both a laptop and a large cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Without the call site of every expression: plans with hundreds of cells build faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "featloom", **conf: str) -> SparkSession:
    """A session with featloom's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder ``DataFrame.checkpoint`` writes to.

    The cluster names it in ``spark.checkpoint.dir``. A local session without
    one gets a temporary folder; a cluster session without one is an error,
    because a folder on one machine does not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            current = tempfile.mkdtemp(prefix="featloom-checkpoint-")
            atexit.register(shutil.rmtree, current, ignore_errors=True)
        sc.setCheckpointDir(current)
    return current

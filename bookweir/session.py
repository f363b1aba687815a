"""Session set-up and the settings every job relies on."""

from __future__ import annotations

import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import bookweir


def build_session(app_name: str = "bookweir", master: str | None = None, **conf: str) -> SparkSession:
    """A session for scripts and tests; on a cluster the submitted session is used as it is."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session what the jobs need: UTC, and this package's functions on every Python worker.

    Functions travel by value, so the package need not be installed on the
    executors.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    cloudpickle.register_pickle_by_value(bookweir)
    return spark


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the session names.

    A local session without one (tests) gets a temporary folder. A cluster
    session without one is an error: a machine-local folder would be lost with
    the machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="bookweir-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size, at most that of all the plan reads.

    Without column statistics the estimate of a join is the product of its sides.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(int(str(plan.stats().sizeInBytes())), read)

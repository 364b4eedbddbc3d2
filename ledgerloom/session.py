"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle partition counts are left to the caller: adaptive execution merges
    small ones and splits skewed ones at run time.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, visible to every executor.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a session
    whose executors are threads of the driver may leave that unset; it gets a
    folder below its warehouse.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


_folders: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when the application ends."""
    application = spark.sparkContext.applicationId
    if application not in _folders:
        path = f"{shared_folder(spark).rstrip('/')}/ledgerloom-{application}-{uuid.uuid4().hex[:8]}"
        _folders[application] = path
        atexit.register(_discard_at_exit, spark, path)
    return _folders[application]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _discard_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session has no connection left
        discard(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(frame: DataFrame, name: str) -> DataFrame:
    """Write a table that several jobs will read, and return a scan of it.

    Iterative fits read their input many times. A written table cuts the
    lineage, survives the loss of executors, keeps column pruning, and gives the
    optimizer a real size to choose join strategies by.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and nothing will read again.

    Shuffle files of finished jobs go when the driver collects garbage, which a
    driver with room to spare does too seldom for long jobs, so it is asked to.
    """
    for frame in frames:
        for folder in {path.rsplit("/", 1)[0] for path in frame.inputFiles()}:
            if f"/{run_folder(frame.sparkSession).rsplit('/', 1)[1]}/" in folder:
                discard(frame.sparkSession, folder)
    session = SparkSession.getActiveSession()
    if session is not None:
        gc.collect()
        session.sparkContext._jvm.System.gc()

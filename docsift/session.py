"""Session builder with the settings every plan in this library assumes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "docsift", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A UTC session with adaptive execution; an already running session is returned as it is."""
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DOCSIFT_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local master may do without the setting."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not folder:
            own = tempfile.mkdtemp(prefix="docsift-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            folder = f"file://{own}"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so that a lost executor repeats one step."""
    shared_folder(df.sparkSession)
    return df.checkpoint()

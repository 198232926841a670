"""Session helpers: SQL settings the engine relies on, and lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where the split costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings; sizing knobs stay with the cluster."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("engram")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; a temporary one on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="engram-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession) -> str:
    """A fresh folder all executors share, under the session's checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/work-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in ``checkpoint_folder``."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def drops_shuffles(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Shuffle files of what a step executes go at once, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @wraps(step)
    def run(rows: DataFrame, *args, **kwargs) -> DataFrame:
        conf = rows.sparkSession.conf
        before = conf.get(key, "false")
        conf.set(key, "true")
        try:
            return step(rows, *args, **kwargs)
        finally:
            conf.set(key, before)

    return run


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark deletes checkpoints (where the session says so) and shuffles no longer used."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

"""Session helpers: shared folder, lineage cuts, table access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lodestone", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution, as tests, bench and the CLI use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_shared_dir(spark: SparkSession) -> None:
    """Set a checkpoint folder only where the session names none (single-machine runs and tests)."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for a table that is written once and read by later steps."""
    ensure_shared_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def side_session(spark: SparkSession, **settings: str) -> SparkSession:
    """A session of the same context with the same SQL settings but for ``settings`` (dots as double underscores), so that
    other queries of ``spark`` do not see these."""
    side = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            side.conf.set(key, value)
    for key, value in settings.items():
        side.conf.set(key.replace("__", "."), value)
    return side


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there; an executor lost later costs nothing of it."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

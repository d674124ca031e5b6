"""Session helpers: shared checkpoint folder, table reading, bounded broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "pairlake", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the engine is tested with."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; a folder of our own only on a local master (tests), else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="pairlake-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folders: str | None = None) -> DataFrame:
    """Cut the lineage by a compressed table in the shared folder; unlike a checkpoint it is read column by column.

    ``folders``: a column of few values, each of which gets a folder, so that its rows are read alone.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(folders) if folders else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a frame that is proven small; the size is checked, never assumed."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, which is beyond the size proven safe for the driver")
    return rows


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast only after counting at most limit + 1 rows; otherwise leave the join to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ship(spark: SparkSession, obj):
    """Broadcast an object of our own classes (its size bounded by its caller); returns a loader for the executors."""
    from pyspark import cloudpickle

    shared = spark.sparkContext.broadcast(cloudpickle.dumps(obj))

    def load():
        from pyspark import cloudpickle

        return cloudpickle.loads(shared.value)

    return load

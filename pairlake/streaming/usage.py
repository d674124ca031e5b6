"""Streaming forms: usage counters, rolling windows and resumable work, run to completion with availableNow."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..runtime import ensure_checkpoint_dir, materialise


def file_stream(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A folder or a single file of parquet as a stream."""
    schema = schema or spark.read.parquet(path).schema
    folder = path if os.path.isdir(path) else os.path.dirname(path)
    glob = "*.parquet" if os.path.isdir(path) else os.path.basename(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def _shared(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None if there is none (or no file in it) yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()


def usage_stream(spark: SparkSession, path: str) -> DataFrame:
    """Calls and tokens per model from a folder or file of responses, read as a stream and complete at the end.

    A response delivered again is dropped by its resp_id; the state forgets ids a watermark behind created_at, which is the same
    on every delivery. Each batch adds its partial counts to a table in the shared folder (a batch number is written
    once, so a restarted batch counts once); nothing is kept on the driver.
    """
    out = _shared(spark, "usage")
    source = file_stream(spark, path).withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", "36500 days").dropDuplicatesWithinWatermark(["resp_id"])

    def add(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("model").agg(
            F.count("*").alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("long").alias("prompt_tokens"),
            F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("long").alias("completion_tokens"),
        )
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    finish(source.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start())
    parts = read_table(spark, out)
    if parts is None:
        return spark.createDataFrame([], "model string, calls long, prompt_tokens long, completion_tokens long")
    return parts.groupBy("model").agg(*[F.sum(c).cast("long").alias(c) for c in ("calls", "prompt_tokens", "completion_tokens")])


def window_stream(spark: SparkSession, path: str, by: str, at: str, value: str, seconds: int = 60, slide: int = 30, late: str = "365 days") -> DataFrame:
    """(by, start_us, n, total): sums over sliding windows with a watermark, by append of closed windows into a table.

    What is still open when the input ends is not reported, as in any append stream.
    """
    out = _shared(spark, "windows")
    w = F.window(at, f"{seconds} seconds", f"{slide} seconds")
    sums = file_stream(spark, path).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.col(by), w).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    rows = sums.select(by, F.unix_micros("window.start").alias("start_us"), "n", "total")
    finish(rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start())
    got = read_table(spark, out)
    return got if got is not None else spark.createDataFrame([], rows.schema)


def resumable_stream(
    spark: SparkSession, source: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, quarantine: str, key: str, state: str
) -> None:
    """Work off a stream of items: results by key into ``target``, failed items into ``quarantine``.

    ``work`` maps a batch of items to results with a column ``error``, null where it went well. A key that is in the target
    is never worked again, so a restarted batch adds nothing twice; what failed before is tried again with the next batch.
    """

    def batch(items: DataFrame, number: int) -> None:
        failed = read_table(spark, quarantine)
        if failed is not None:
            items = items.unionByName(failed)
        items = items.dropDuplicates([key])
        done = read_table(spark, target)
        items = materialise(items.join(done.select(key), key, "left_anti") if done is not None else items)
        got = materialise(work(items))  # worked once, for both outputs
        append_new(spark, got.filter("error IS NULL").drop("error"), target, key)
        items.join(got.filter("error IS NOT NULL").select(key), key, "left_semi").write.mode("overwrite").parquet(quarantine)

    finish(source.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start())


def append_new(spark: SparkSession, todo: DataFrame, target: str, key: str) -> int:
    """Append the rows whose key is not in the target yet; running it again adds nothing. Returns the rows added.

    The rows are counted while they are written, so they are computed once.
    """
    from pyspark.sql import Observation

    done = read_table(spark, target)
    if done is not None:
        todo = todo.join(done.select(key), key, "left_anti")
    seen = Observation()
    todo.dropDuplicates([key]).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(target)
    return int(seen.get["n"])

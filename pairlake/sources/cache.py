"""A response cache as a keyed table: lookups are joins, writes append, compaction keeps the newest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.usage import newest
from ..runtime import written
from ..streaming.usage import read_table


class ResponseCache:
    """Responses by request key. Columns: key, text, finish_reason, prompt_tokens, completion_tokens, created_at."""

    SCHEMA = "key string, text string, finish_reason string, prompt_tokens long, completion_tokens long, created_at timestamp"
    VALUES = ("text", "finish_reason", "prompt_tokens", "completion_tokens")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """The newest response of each key."""
        got = read_table(self.spark, self.path)
        got = got if got is not None else self.spark.createDataFrame([], self.SCHEMA)
        return newest(got, "key", ["created_at", "text"])

    def get(self, requests: DataFrame, key: str = "key") -> DataFrame:
        """Requests with the cached values and ``cached``; requests with a null key are never cached."""
        hit = self.rows().select(F.col("key").alias(key), *self.VALUES, F.lit(True).alias("cached"))
        return requests.join(hit, key, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))

    def put(self, responses: DataFrame) -> None:
        """Upsert: a later response of a key hides the former ones."""
        now = responses if "created_at" in responses.columns else responses.withColumn("created_at", F.current_timestamp())
        now.filter(F.col("key").isNotNull()).select("key", *self.VALUES, F.col("created_at").cast("timestamp").alias("created_at")).write.mode("append").parquet(self.path)

    def compact(self) -> None:
        """Drop hidden rows: the newest ones are written elsewhere first, then replace the table."""
        written(self.rows().select("key", *self.VALUES, "created_at")).write.mode("overwrite").parquet(self.path)

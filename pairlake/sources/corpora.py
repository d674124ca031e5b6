"""Connectors to the public corpora: dialogue pairs per subset and split, and grade-school word problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import gold_number
from ..operators.prep import lowest_per_group, shuffled
from ..runtime import bounded_rows


def with_ordinals(df: DataFrame, name: str = "n") -> DataFrame:
    """Dense 0-based ordinals in file order: counts per file part, then offsets; no window over all rows in one task."""
    marked = df.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    sizes = sorted(bounded_rows(marked.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")), 1_000_000, "file parts"), key=lambda r: r.first)
    before, rows = 0, []
    for r in sizes:
        rows.append((r["__part"], before - r["first"]))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(rows, "__part int, __off long")
    return marked.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__off")).drop("__part", "__at", "__off")


def read_dialogues(spark: SparkSession, folder: str, subset: str, split: str) -> DataFrame:
    """(id, subset, split, chosen, rejected) of <folder>/<subset>/<split>.jsonl; id is hh-<subset>-<split>-<six digits of the line>."""
    raw = spark.read.schema("chosen string, rejected string").option("mode", "FAILFAST").json(f"{folder}/{subset}/{split}.jsonl*")
    at = F.format_string(f"hh-{subset}-{split}-%06d", "n")
    return with_ordinals(raw).select(at.alias("id"), F.lit(subset).alias("subset"), F.lit(split).alias("split"), "chosen", "rejected")


def read_word_problems(spark: SparkSession, path: str, split: str, n: int, seed: int = 1234) -> DataFrame:
    """(id, prompt, gold_answer): n problems by a seeded order; a solution without #### raises."""
    raw = spark.read.schema("question string, answer string").option("mode", "FAILFAST").json(path)
    gold = F.coalesce(gold_number(F.col("answer")), F.raise_error(F.lit("a solution has no #### answer")).cast("string"))
    rows = with_ordinals(raw).select(F.format_string(f"gsm8k-{split}-%05d", "n").alias("id"), F.col("question").alias("prompt"), gold.alias("gold_answer"))
    return lowest_per_group(rows.withColumn("__g", F.lit(1)), ["__g"], shuffled(F.col("id"), seed=seed), "id", n).drop("__g", "rank")

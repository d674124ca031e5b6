"""Labelling plan and API budget from small configuration frames; configuration checks on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JUDGED = ("panel", "single_judge")


def label_plan(conditions: DataFrame, main_n: int, scale_n: int, dev_n: int) -> DataFrame:
    """(split, source, method, n): what each source and method needs at most over the trainable conditions.

    conditions: name, train (null counts as true), candidates, labels, scaling.
    """
    c = conditions.filter(F.coalesce("train", F.lit(True)) & ~F.col("candidates").isin("hh_rlhf", "policy_samples"))
    n = F.when(F.col("scaling"), scale_n).otherwise(main_n)
    gen = c.select(F.col("candidates").alias("source"), F.lit(None).cast("string").alias("method"), n.alias("n"))
    judged = c.filter(F.col("labels").isin(*JUDGED)).select(F.col("candidates").alias("source"), F.col("labels").alias("method"), n.alias("n"))
    needs = gen.unionByName(judged).groupBy("source", "method").agg(F.max("n").cast("long").alias("n"))
    train = needs.select(F.lit("train").alias("split"), "source", "method", "n")
    return train.unionByName(needs.select(F.lit("dev").alias("split"), "source", "method", F.lit(dev_n).cast("long").alias("n"))).filter("n > 0")


def ordered_plan(plan: DataFrame) -> DataFrame:
    """Adds place per split: generation before judging, then by source and method."""
    w = Window.partitionBy("split").orderBy(F.col("method").isNotNull(), "source", "method")
    return plan.withColumn("place", F.row_number().over(w).cast("long"))


def api_budget(plan: DataFrame, judges: DataFrame, quotas: DataFrame, gen_model: str, per_prompt: int) -> DataFrame:
    """(model, calls, days): calls of a plan per model, and days at the daily quota (null without one)."""
    gen = plan.filter("method IS NULL AND source <> 'human_pair'").select(F.lit(gen_model).alias("model"), (F.col("n") * per_prompt).alias("calls"))
    judged = plan.filter("method IS NOT NULL").join(judges, "method").select("model", (F.col("n") * F.col("calls_per_prompt")).alias("calls"))
    total = gen.unionByName(judged).groupBy("model").agg(F.sum("calls").cast("long").alias("calls"))
    return total.join(quotas, "model", "left").select("model", "calls", F.ceil(F.col("calls") / F.col("rpd")).cast("long").alias("days"))


def check_independence(jurors: dict[str, str], data_families: set[str], policy_families: set[str]) -> None:
    """No juror may be of a family that made or judged the data or that is trained; jurors: name -> family."""
    bad = sorted(n for n, f in jurors.items() if f in data_families | policy_families)
    if bad:
        raise ValueError(f"jurors are not independent: {', '.join(bad)}")


def example_conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [
            ("human", None, "hh_rlhf", "human", False), ("random", None, "multi_persona", "random", False),
            ("length", None, "multi_persona", "longer", False), ("single_single", None, "single_persona", "single_judge", False),
            ("single_panel", None, "single_persona", "panel", False), ("multi_single", None, "multi_persona", "single_judge", False),
            ("multi_panel", True, "multi_persona", "panel", True), ("untrained", False, "other_source", "panel", True),
        ],
        "name string, train boolean, candidates string, labels string, scaling boolean",
    )

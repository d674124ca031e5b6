"""Candidate groups and the five labelling rules; pairs common to all conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import hash32
from ..functions.text import strip, word_count


def candidates(responses: DataFrame) -> DataFrame:
    """(prompt_id, source, cand, text): usable answers, re-indexed from 0 in resp_id order.

    Empty answers and those that ended by length are dropped. A group is one prompt and source, so the window's
    groups are as small as the number of answers asked for.
    """
    gen = responses.filter(F.col("tag").startswith("gen:")).withColumn("source", F.split("tag", ":")[1])
    ok = gen.filter(F.col("text").isNotNull() & (strip(F.col("text")) != "") & (F.coalesce("finish_reason", F.lit("stop")) != "length"))
    at = F.row_number().over(Window.partitionBy("prompt_id", "source").orderBy("resp_id")) - 1
    return ok.withColumn("cand", at).select("prompt_id", "source", "cand", "text")


def dropped(responses: DataFrame) -> DataFrame:
    gen = responses.filter(F.col("tag").startswith("gen:")).withColumn("source", F.split("tag", ":")[1])
    bad = F.col("text").isNull() | (strip(F.col("text")) == "") | (F.coalesce("finish_reason", F.lit("stop")) == "length")
    return gen.groupBy("source").agg(F.count("*").alias("n_asked"), F.sum(bad.cast("long")).alias("n_dropped"))


def _pair(df: DataFrame, condition: str) -> DataFrame:
    """Pairs whose stripped texts differ."""
    return df.filter(strip(F.col("chosen")) != strip(F.col("rejected"))).select(
        F.lit(condition).alias("condition"), "prompt_id", "chosen", "rejected", "agreement"
    )


def human_pairs(prompts: DataFrame) -> DataFrame:
    got = prompts.filter(F.col("human_chosen").isNotNull() & F.col("human_rejected").isNotNull())
    return _pair(got.select(F.col("id").alias("prompt_id"), F.col("human_chosen").alias("chosen"), F.col("human_rejected").alias("rejected"), F.lit(None).cast("double").alias("agreement")), "human")


def _two(cands: DataFrame, first: Column, last: Column, extra: list[Column] | None = None) -> DataFrame:
    return cands.groupBy("prompt_id", "source").agg(
        F.max_by("text", first).alias("chosen"), F.max_by("text", last).alias("rejected"), F.count("*").alias("n"), *(extra or [])
    ).filter("n >= 2")


def random_pairs(cands: DataFrame, seed: int = 1234) -> DataFrame:
    """Two candidates by a hash of (seed, prompt, candidate): the lowest is chosen, the highest rejected."""
    coin = hash32(F.concat_ws("|", F.lit(str(seed)), "prompt_id", "source", F.col("cand").cast("string")))
    got = _two(cands.withColumn("h", coin), F.struct(-F.col("h"), -F.col("cand")), F.struct("h", "cand"))
    return _pair(got.withColumn("agreement", F.lit(None).cast("double")), "random")


def longer_pairs(cands: DataFrame) -> DataFrame:
    """Longest against shortest by words, the first on ties; none where all are equally long."""
    w = cands.withColumn("w", word_count(F.col("text")))
    got = _two(w, F.struct("w", -F.col("cand")), F.struct(-F.col("w"), -F.col("cand")), [F.max("w").alias("hi"), F.min("w").alias("lo")])
    return _pair(got.filter("hi > lo").withColumn("agreement", F.lit(None).cast("double")), "longer")


def judged_pairs(cands: DataFrame, votes: DataFrame, condition: str) -> DataFrame:
    """The candidates that a vote names."""
    pick = lambda name: cands.select("prompt_id", "source", F.col("cand").cast("long").alias(name), F.col("text").alias(f"{name}_text"))
    got = votes.join(pick("chosen"), ["prompt_id", "source", "chosen"]).join(pick("rejected"), ["prompt_id", "source", "rejected"])
    return _pair(got.select("prompt_id", F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected"), "agreement"), condition)


def common_prompts(pairs: DataFrame) -> DataFrame:
    """Pairs of prompts that are valid in every condition of the table."""
    ids = pairs.select("condition", "prompt_id").distinct()
    k = ids.select("condition").distinct().count()
    every = ids.groupBy("prompt_id").agg(F.count("*").alias("k")).filter(F.col("k") == k).select("prompt_id")
    return pairs.join(every, "prompt_id", "left_semi")


def nested_prefixes(pairs: DataFrame, order: Column, sizes: list[int]) -> DataFrame:
    """Members of nested prefixes per condition: (condition, prompt_id, size) with size the smallest that holds it.

    A condition with fewer pairs than the largest size raises.
    """
    from ..runtime import bounded_rows
    from .prep import lowest_per_group

    short = pairs.groupBy("condition").agg(F.countDistinct("prompt_id").alias("n")).filter(F.col("n") < max(sizes))
    bad = bounded_rows(short, 10_000, "conditions")
    if bad:
        raise ValueError("too few pairs for the largest prefix: " + ", ".join(f"{r.condition} has {r.n}" for r in bad))
    low = lowest_per_group(pairs.select("condition", "prompt_id").distinct(), ["condition"], order, "prompt_id", max(sizes))
    size = reduce(lambda acc, s: acc.when(F.col("rank") <= s, s), sorted(sizes)[1:], F.when(F.col("rank") <= min(sizes), min(sizes)))
    return low.select("condition", "prompt_id", size.cast("long").alias("size"))


def smoothing(agreement: Column, most: float) -> Column:
    """Label smoothing of a pair: most * (1 - agreement). Raises for most outside 0..0.5, and for a row without agreement or with one outside 0..1."""
    if not 0 <= most <= 0.5:
        raise ValueError("the largest smoothing must lie between 0 and 0.5")
    wrong = F.raise_error(F.concat(F.lit("agreement must lie between 0 and 1, got "), F.coalesce(agreement.cast("string"), F.lit("null"))))
    return F.when(agreement.between(0, 1), most * (1 - agreement)).otherwise(wrong.cast("double"))


def smoothed_loss(eps: Column, x: Column) -> Column:
    """Conservative preference loss at margin x; stable for margins of any size."""
    soft = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    return (1 - eps) * soft(-x) + eps * soft(x)


def training_rows(pairs: DataFrame) -> DataFrame:
    """Conversational form: prompt, chosen and rejected as arrays of (role, content)."""
    turn = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), F.col(c).alias("content")))
    return pairs.select("pair_id", turn("user", "prompt").alias("prompt"), turn("assistant", "chosen").alias("chosen"), turn("assistant", "rejected").alias("rejected"))

"""Verdicts: validity, overall scores, votes, rounds and shown positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import hash32


def map_total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0), lambda a, v: a + v)


def with_totals(verdicts: DataFrame) -> DataFrame:
    """Adds n (candidates), totals (sum of scores per candidate) and valid.

    Valid: at least two candidates, every score in 1..5, best and worst given, different and within the candidates.
    """
    n = F.coalesce(F.size("scores"), F.lit(0))
    in_range = F.forall("scores", lambda m: F.forall(F.map_values(m), lambda v: v.between(1, 5)) & (F.size(m) == 3))
    valid = (n >= 2) & in_range & F.col("best").between(0, n - 1) & F.col("worst").between(0, n - 1) & (F.col("best") != F.col("worst"))
    return verdicts.withColumns({"n": n, "totals": F.transform("scores", map_total), "valid": F.coalesce(valid, F.lit(False))})


def score_rows(verdicts: DataFrame) -> DataFrame:
    """Long form: one row per verdict and candidate, with the total and the mean over criteria."""
    v = with_totals(verdicts).filter("valid")
    long = v.select("verdict_id", "prompt_id", "source", "judge", "round", F.posexplode("totals").alias("cand", "total"))
    return long.withColumn("overall", F.round(F.col("total") / 3, 6))


def vote(verdicts: DataFrame, seed: int = 1234) -> DataFrame:
    """Preference per (prompt_id, source): candidates with the highest and lowest mean total; ties by a hash.

    Means, as a candidate may be scored by fewer verdicts than others; equal ratios of whole numbers are equal doubles.

    No row where fewer than two candidates or all totals are equal. agreement: share of verdicts that score chosen
    above rejected, ties half.
    """
    v = with_totals(verdicts).filter("valid").select("prompt_id", "source", "totals")
    per = v.select("prompt_id", "source", F.posexplode("totals").alias("cand", "t")).groupBy("prompt_id", "source", "cand").agg((F.sum("t") / F.count("t")).alias("t"))
    coin = hash32(F.concat_ws("|", F.lit(str(seed)), "prompt_id", "source", F.col("cand").cast("string")))
    best = (
        per.withColumn("coin", coin)
        .groupBy("prompt_id", "source")
        .agg(
            F.max_by("cand", F.struct("t", -F.col("coin"), -F.col("cand"))).alias("chosen"),
            F.min_by("cand", F.struct("t", "coin", "cand")).alias("rejected"),
            F.max("t").alias("hi"), F.min("t").alias("lo"), F.count("*").alias("n_candidates"),
        )
        .filter("n_candidates >= 2 AND hi > lo")
    )
    joined = v.join(best, ["prompt_id", "source"])
    a, b = F.try_element_at("totals", F.col("chosen") + 1), F.try_element_at("totals", F.col("rejected") + 1)
    a, b = F.coalesce(a, F.lit(-1)), F.coalesce(b, F.lit(-1))
    return joined.groupBy("prompt_id", "source").agg(
        F.first("chosen").cast("long").alias("chosen"), F.first("rejected").cast("long").alias("rejected"),
        F.count("*").alias("n_final"),
        F.round(F.sum(F.when(a > b, 1.0).when(a == b, 0.5).otherwise(0.0)) / F.count("*"), 6).alias("agreement"),
    )


def devils_advocate(verdicts: DataFrame) -> DataFrame:
    """Per item the candidate with the lowest mean total of round 1, first index on ties."""
    v = with_totals(verdicts).filter("valid AND round = 1")
    per = v.select("prompt_id", "source", F.posexplode("totals").alias("cand", "t")).groupBy("prompt_id", "source", "cand").agg((F.sum("t") / F.count("t")).alias("t"))
    return per.groupBy("prompt_id", "source").agg(F.min_by("cand", F.struct("t", "cand")).cast("long").alias("target"))


def peer_targets(verdicts: DataFrame) -> DataFrame:
    """Per item and judge the candidate with the lowest mean total of the other judges' round 1: (prompt_id, source, judge, target).

    The judge's own verdicts are taken off the item's sums, so no pairs of judges are formed.
    """
    v = with_totals(verdicts).filter("valid AND round = 1").select("prompt_id", "source", "judge", F.posexplode("totals").alias("cand", "t"))
    own = v.groupBy("prompt_id", "source", "judge", "cand").agg(F.sum("t").alias("s"), F.count("t").alias("n"))
    every = own.groupBy("prompt_id", "source", "cand").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    judges = own.select("prompt_id", "source", "judge").distinct()
    mine = own.select("prompt_id", "source", "cand", "judge", "s", "n")
    j = every.join(judges, ["prompt_id", "source"]).join(mine, ["prompt_id", "source", "cand", "judge"], "left")
    rest = j.select("prompt_id", "source", "judge", "cand", (F.col("all_s") - F.coalesce("s", F.lit(0))).alias("s"), (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0")
    return rest.groupBy("prompt_id", "source", "judge").agg(F.min_by("cand", F.struct(F.col("s") / F.col("n"), F.col("cand"))).cast("long").alias("target"))


def coerced_score(c: Column) -> Column:
    """A score given as text: whole numbers, also as '4.0' and with blanks around; null for anything else."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?[0-9]{1,9}(\.0*)?$"), F.regexp_extract(t, r"^([+-]?[0-9]+)", 1).cast("int"))


def shown_position(perm: Column, cand: Column) -> Column:
    """0-based place in the shown order; null if it was not shown."""
    at = F.array_position(perm, cand)
    return F.when(at > 0, at - 1).cast("long")


def relabelled(verdicts: DataFrame) -> DataFrame:
    """Best and worst as the letters that the judge saw, and the scores in shown order."""
    v = with_totals(verdicts).filter("valid")
    letter = lambda c: F.char(F.lit(65) + shown_position(F.col("permutation"), F.col(c)))
    return v.select(
        "verdict_id", letter("best").alias("best_label"), letter("worst").alias("worst_label"),
        F.array_join(F.transform("permutation", lambda p: F.try_element_at("totals", p + 1).cast("string")), ",").alias("shown_totals"),
    )


def round_changes(verdicts: DataFrame) -> DataFrame:
    """Per judge: items with a verdict in both rounds and how often the best changed (last verdict of a round counts)."""
    one = lambda r: F.max_by("best", F.when(F.col("round") == r, F.col("verdict_id")))
    both = (
        verdicts.filter(F.col("best").isNotNull() & F.col("round").isin(1, 2))
        .groupBy("prompt_id", "source", "judge")
        .agg(one(1).alias("b1"), one(2).alias("b2"), F.countDistinct("round").alias("r"))
        .filter("r = 2")
    )
    return both.groupBy("judge").agg(F.count("*").alias("n"), F.sum((F.col("b1") != F.col("b2")).cast("long")).alias("changed"))

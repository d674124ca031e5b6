"""Reports over votes, pairs and win rates: rates with intervals, label statistics, manifests, examples."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_rows
from ..sources.documents import read_document, write_document
from .evalstats import bootstrap_draws, length_controlled
from .judging import shown_position


def rates(values: DataFrame, by: list[str], value: str, resamples: int = 10_000) -> DataFrame:
    """(by, n, rate, ci_low, ci_high): count, mean and percentile interval of the mean; nulls are no values.

    An empty group has no row; its n is 0 and its rate null wherever a report joins it.
    """
    ok = values.filter(F.col(value).isNotNull())
    mean = ok.groupBy(*by).agg(F.round(F.avg(F.col(value).cast("double")), 6).alias("rate"))
    ends = bootstrap_draws(ok, by, value, resamples)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return mean.alias("a").join(ends.alias("b"), cond).select(*[F.col(f"a.{c}").alias(c) for c in by], "b.n", "a.rate", "b.ci_low", "b.ci_high")


def agreement_values(items: DataFrame, verdicts: DataFrame, votes: DataFrame, subsets: DataFrame) -> DataFrame:
    """(grp, name, value): what an agreement report averages, against candidate 0 as the human choice.

    items (prompt_id, source): all judged; an item without a vote is a tie and counts half, but has no confidence.
    """
    of = subsets.select(F.col("id").alias("prompt_id"), "subset")
    k = items.join(votes, ["prompt_id", "source"], "left").join(of, "prompt_id", "left").select(
        F.when(F.col("chosen").isNull(), 0.5).otherwise((F.col("chosen") == 0).cast("double")).alias("hit"),
        F.coalesce("subset", F.lit("unknown")).alias("subset"), F.col("chosen").isNull().cast("double").alias("none"),
        F.when(F.col("agreement") == 1, "unanimous").when(F.col("agreement").isNotNull(), "split").alias("confidence"),
    )
    row = lambda g, n, v: F.struct(F.lit(g).alias("grp"), n.alias("name"), v.alias("value"))
    all_ = F.lit("all")
    a = k.select(F.explode(F.array(row("overall", all_, F.col("hit")), row("subset", F.col("subset"), F.col("hit")), row("confidence", F.col("confidence"), F.col("hit")), row("no_preference", all_, F.col("none")))).alias("r"))
    v = verdicts.filter(F.col("best").isNotNull())
    first = (shown_position(F.col("permutation"), F.col("best")) == 0).cast("double")
    who = F.concat_ws(" r", F.coalesce("judge", F.lit("unknown")), F.col("round").cast("string"))
    b = v.select(F.explode(F.array(row("judge_round", who, (F.col("best") == 0).cast("double")), row("first_shown", all_, first))).alias("r"))
    return a.unionByName(b).select("r.*").filter(F.col("name").isNotNull() & F.col("value").isNotNull())


def label_stats(verdicts: DataFrame, votes: DataFrame, asked: DataFrame) -> DataFrame:
    """(source, prompts, pairs, too_few, ties, dropped): judged items, with a vote, with under two candidates, tied, answers lost.

    asked: source, n_dropped (of labels.dropped).
    """
    n = F.greatest(F.coalesce(F.size("scores"), F.lit(0)), F.coalesce(F.size("permutation"), F.lit(0)))
    items = verdicts.groupBy("prompt_id", "source").agg(F.max(n).alias("k"))
    j = items.join(votes.select("prompt_id", "source", F.lit(1).alias("v")), ["prompt_id", "source"], "left")
    one = lambda c: F.count(F.when(c, 1))
    per = j.groupBy("source").agg(F.count("*").alias("prompts"), F.count("v").alias("pairs"), one(F.col("k") < 2).alias("too_few"), one((F.col("k") >= 2) & F.col("v").isNull()).alias("ties"))
    return per.join(asked.select("source", "n_dropped"), "source", "left").select("source", "prompts", "pairs", "too_few", "ties", F.coalesce("n_dropped", F.lit(0)).alias("dropped"))


def choice_histogram(votes: DataFrame) -> DataFrame:
    """(source, role, cand, n): how often each candidate's place was chosen and rejected."""
    roles = F.explode(F.array(F.struct(F.lit("chosen").alias("role"), F.col("chosen").alias("cand")), F.struct(F.lit("rejected").alias("role"), F.col("rejected").alias("cand"))))
    return votes.select("source", roles.alias("r")).groupBy("source", "r.role", "r.cand").agg(F.count("*").alias("n"))


def win_report(outcomes: DataFrame, jurors: DataFrame, resamples: int = 10_000) -> DataFrame:
    """(x, y, n, win, tie, loss, win_rate, ci_low, ci_high, lc_win_rate, juror_agreement) per compared pair of variants."""
    from .evalstats import juror_agreement
    from .evalstats import win_report as shares

    r = shares(outcomes).select("x", "y", "n", "win", "tie", "loss", "win_rate")
    ends = bootstrap_draws(outcomes, ["x", "y"], "outcome", resamples).select("x", "y", "ci_low", "ci_high")
    lc = length_controlled(outcomes, ["x", "y"]).select("x", "y", "lc_win_rate")
    agree = juror_agreement(jurors).select("x", "y", "juror_agreement")
    return r.join(ends, ["x", "y"], "left").join(lc, ["x", "y"], "left").join(agree, ["x", "y"], "left")


def mean_words(outcomes: DataFrame) -> DataFrame:
    """(variant, n, words): mean answer length of each variant, wherever it stands in a comparison."""
    sides = F.explode(F.array(F.struct(F.col("x").alias("variant"), F.col("len_x").alias("w")), F.struct(F.col("y").alias("variant"), F.col("len_y").alias("w"))))
    return outcomes.select(sides.alias("s")).filter("s.w IS NOT NULL").groupBy("s.variant").agg(F.count("*").alias("n"), F.round(F.avg(F.col("s.w").cast("double")), 6).alias("words"))


def spot_check(verdicts: DataFrame, votes: DataFrame) -> DataFrame:
    """(source, n_items, n_pairs, failed_calls, mean_agreement); verdicts with a column valid."""
    calls = verdicts.groupBy("source").agg(F.countDistinct("prompt_id").alias("n_items"), F.sum((~F.col("valid")).cast("long")).alias("failed_calls"))
    got = votes.groupBy("source").agg(F.count("*").alias("n_pairs"), F.round(F.avg("agreement"), 6).alias("mean_agreement"))
    return calls.join(got, "source", "left").select("source", "n_items", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "failed_calls", "mean_agreement")


def first_examples(rows: DataFrame, wants: dict[str, Column], order: str) -> DataFrame:
    """(want, order): for each predicate in turn the first row that fulfils it and was not taken before.

    A predicate needs at most its first len(wants) rows, as the others take one row each.
    """
    k = len(wants)
    taken: set = set()
    out = []
    for name, want in wants.items():
        low = [r[0] for r in rows.filter(want).select(order).distinct().orderBy(order).limit(k).collect()]
        pick = next((v for v in low if v not in taken), None)
        if pick is not None:
            taken.add(pick)
            out.append((name, pick))
    kind = rows.schema[order].dataType.simpleString()
    return rows.sparkSession.createDataFrame(out, f"want string, `{order}` {kind}")


def walkthrough(verdicts: DataFrame, candidates: DataFrame, prompts: DataFrame) -> DataFrame:
    """(verdict_id, prompt, best_text, worst_text): verdicts with the texts they name; absent candidates are left out.

    A verdict on a prompt that is not in ``prompts`` is an error in the tables and raises when it is read.
    """
    pick = lambda n: candidates.select("prompt_id", "source", F.col("cand").alias(n), F.col("text").alias(f"{n}_text"))
    named = verdicts.select("verdict_id", "prompt_id", "source", "best", "worst").join(pick("best"), ["prompt_id", "source", "best"]).join(pick("worst"), ["prompt_id", "source", "worst"])
    of = prompts.select(F.col("id").alias("prompt_id"), "prompt", F.lit(True).alias("__known"))
    missing = F.raise_error(F.concat(F.lit("no prompt "), F.coalesce("prompt_id", F.lit("null")))).cast("string")
    return named.join(of, "prompt_id", "left").select("verdict_id", F.when(F.col("__known"), F.col("prompt")).otherwise(missing).alias("prompt"), "best_text", "worst_text")


def build_manifest(pairs: DataFrame, groups: dict[str, list[str]]) -> tuple[dict, list[str]]:
    """(manifest, conditions left out): per group its conditions, pairs valid per condition and prompts common to all.

    A condition without any pair has no inputs; it is left out of its groups, with its name in the second result.
    """
    ids = pairs.select("condition", "prompt_id").distinct()
    valid = {r.condition: r.n for r in bounded_rows(ids.groupBy("condition").agg(F.count("*").alias("n")), 100_000, "conditions")}
    absent = sorted({c for cs in groups.values() for c in cs if c not in valid})
    out: dict = {"groups": {}}
    for group, wanted in groups.items():
        members = [c for c in wanted if c in valid]
        if members:
            shared = ids.filter(F.col("condition").isin(members)).groupBy("prompt_id").agg(F.count("*").alias("k")).filter(F.col("k") == len(members)).count()
            out["groups"][group] = {"conditions": members, "n_prompts": shared, "per_condition_valid": {c: valid[c] for c in members}}
    return out, absent


def write_pairs(pairs: DataFrame, groups: dict[str, list[str]], folder: str, force: bool = False, main: str = "main") -> dict:
    """Write each group's pairs on the prompts common to it, one folder a group and condition, and the manifest.

    Where the conditions of the main group differ from the manifest that is there, nothing is written and it raises: other
    conditions mean other common prompts, so models trained before would not compare. ``force`` writes all the same.
    """
    manifest, absent = build_manifest(pairs, groups)
    path = Path(folder) / "manifest.json"
    before = read_document(path)
    now = manifest["groups"].get(main, {}).get("conditions")
    if before and not force and before.get("groups", {}).get(main, {}).get("conditions") != now:
        raise RuntimeError("the conditions differ from those that the pairs were built for; only force builds them anew")
    for group, about in manifest["groups"].items():
        mine = pairs.filter(F.col("condition").isin(about["conditions"]))
        common = mine.select("condition", "prompt_id").distinct().groupBy("prompt_id").agg(F.count("*").alias("k")).filter(F.col("k") == len(about["conditions"]))
        rows = mine.join(common.select("prompt_id"), "prompt_id", "left_semi")
        # ordered within each file, so that the first n rows of a condition are nested samples of one prompt order
        rows.repartitionByRange("condition", "prompt_id").sortWithinPartitions("condition", "prompt_id").write.mode("overwrite").partitionBy("condition").parquet(f"{folder}/{group}")
    write_document(path, manifest | {"absent": absent})
    return manifest

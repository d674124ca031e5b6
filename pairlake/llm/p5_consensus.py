"""Problem 5: consensus of several judges by latent ability and difficulty.

Model: judge j names the true best of an item's K candidates with odds exp(a_j * e_i) against each other
candidate, i.e. with probability exp(a_j e_i) / (exp(a_j e_i) + K - 1); a_j is the judge's skill (0 is chance,
negative is worse), e_i > 0 the item's easiness. Where it names another one, its worst candidate is the true best with
odds exp(-g) against each other candidate that it could have named; g is one number for all judges (0: the worst says
nothing beyond the best). Gradient expectation-maximisation: given skills and g, each item finds its posterior over
candidates and its easiness by inner gradient steps; skills and g then move along their gradient, scaled by the
curvature and with normal priors, until none moves by TOLERANCE. Votes are aggregated per (item, judge, best, worst)
first, so an item with a third of all rows is one row of counts. Up to MAX_JUDGES skills come to the driver (one number
a judge); beyond it they stay a distributed table with the same steps.

A verdict votes for its ``best``; where that is null, not among the candidates or equal to ``worst``, for the candidate
with the highest sum of scores in 1..5 if there is just one. Its ``worst`` counts where it is among
the candidates and not its best vote. The candidates are those of its scores or permutation (of any verdict of the item).
All rounds and samples count; a verdict delivered twice counts once.

Defined cases: null prompt_id or source form an item of their own like any other value; null judge is one judge
'(null)'; an item without any usable vote gets best null. Ties in the posterior go to the smallest index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, written

MAX_JUDGES = 500_000
STEPS = 40
TOLERANCE = 5e-3
INNER = 4
PRIOR_SKILL, PRIOR_VAR = 1.5, 4.0
PRIOR_WORST = 1.0


def votes(df: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    """(prompt_id, source, judge, cand, against, k): one row per verdict; cand and against null if it names none."""
    total = lambda m: F.aggregate(
        F.filter(F.map_values(m), lambda v: v.between(low, high)), F.lit(0), lambda a, v: a + v
    )
    k = F.greatest(F.coalesce(F.size("scores"), F.lit(0)), F.coalesce(F.size("permutation"), F.lit(0)))
    totals = F.transform(F.coalesce("scores", F.array().cast("array<map<string,int>>")), lambda m: F.coalesce(total(m), F.lit(0)))
    top = F.array_max(totals)
    derived = F.when(F.size(F.filter(totals, lambda v: v == top)) == 1, F.array_position(totals, top).cast("int") - 1)
    within = lambda c: F.col(c).isNotNull() & (F.col(c) >= 0) & ((k == 0) | (F.col(c) < k))
    ok = within("best") & ~F.col("best").eqNullSafe(F.col("worst"))
    return (
        df.select(
            "verdict_id", "prompt_id", "source", F.coalesce("judge", F.lit("(null)")).alias("judge"), "round", "sample_idx",
            F.when(ok, F.col("best")).otherwise(derived).alias("cand"), F.when(within("worst"), F.col("worst")).alias("against"), k.alias("k"),
        )
        .withColumn("against", F.when(~F.col("cand").eqNullSafe(F.col("against")) & ~((F.col("k") > 0) & (F.col("against") >= F.col("k"))), F.col("against")))
        .dropDuplicates(["verdict_id", "prompt_id", "source", "judge", "round", "sample_idx"])
        .select("prompt_id", "source", "judge", "cand", "against", "k")
    )


def vote_counts(df: DataFrame) -> DataFrame:
    """(prompt_id, source, judge, cand, against, n, k): verdicts by what they name; -1 where they name none."""
    v = votes(df).fillna(-1, ["cand", "against"])
    return materialise(v.groupBy("prompt_id", "source", "judge", "cand", "against").agg(F.count("*").cast("int").alias("n"), F.max("k").alias("k")))


def packed(counts: DataFrame, judge: str) -> DataFrame:
    """Items with their votes in arrays: j (judge index or skill), c best, w worst, n count, judge; k candidates."""
    v = F.struct(F.col(judge).alias("j"), F.col("cand").alias("c"), F.col("against").alias("w"), "n", *([] if judge == "j" else ["judge"]))
    got = counts.groupBy("prompt_id", "source").agg(
        F.when(F.max("k") > 0, F.max("k")).otherwise(F.greatest(F.max("cand"), F.max("against"), F.lit(0)) + 1).cast("int").alias("k"), F.collect_list(v).alias("v")
    )
    return got.select("prompt_id", "source", "k", *[F.col(f"v.{x}").alias(x) for x in ("j", "c", "w", "n", *(["judge"] if judge != "j" else []))])


class Votes:
    """The vote groups of a batch of items as flat arrays; a candidate beyond those of the item counts as none."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.k = np.maximum(batch.column("k").to_numpy(zero_copy_only=False).astype(int), 1)
        item = np.repeat(np.arange(len(self.k)), np.diff(batch.column("j").offsets.to_numpy()))
        self.j, c, w, n = (batch.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("j", "c", "w", "n"))
        self.item, self.n, self.width = item, n.astype(float), int(self.k.max(initial=1))
        self.c, self.w = (np.where(v < self.k[item], v, -1).astype(int) for v in (c, w))
        self.named = np.flatnonzero(self.c >= 0)

    def spread(self, at: np.ndarray, weights: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Sums of weights per (item, candidate)."""
        cells = len(self.k) * self.width
        return np.bincount(self.item[which] * self.width + at[which], weights=weights[which], minlength=cells).reshape(len(self.k), self.width)


def _estimate(skill: np.ndarray, g: float, v: Votes, inner: int):
    """Posterior (items x width), log easiness; P(right) and P(right | all votes) of each group that names a best."""
    k, at = v.k, v.named
    real = np.arange(v.width)[None, :] < k[:, None]
    item, n, skill, c = v.item[at], v.n[at], skill[at], v.c[at]
    others = np.maximum(k - 1, 1)[item]
    # what the worst adds, against candidates that are neither best nor worst
    worst = np.flatnonzero(v.w >= 0)
    k_all = k[v.item]
    at_best = np.where((v.c >= 0) & (v.w >= 0), np.log((np.exp(-g) + np.maximum(k_all - 2, 0)) / np.maximum(k_all - 1, 1)), 0.0)
    fixed = v.spread(v.w, -g * v.n, worst) + v.spread(v.c, v.n * at_best, at)
    log_e = np.zeros(len(k))
    for _ in range(inner):
        x = skill * np.exp(log_e)[item]
        p = 1 / (1 + others * np.exp(-np.clip(x, -30, 30)))
        score = fixed + np.bincount(item * v.width + c, weights=n * x, minlength=fixed.size).reshape(fixed.shape)
        score = np.where(real, score, -np.inf)
        score -= score.max(axis=1, keepdims=True)
        q = np.exp(score)
        q /= q.sum(axis=1, keepdims=True)
        hit = q[item, c]
        grad = np.bincount(item, weights=n * (hit - p) * x, minlength=len(k)) - log_e
        curv = np.bincount(item, weights=n * p * (1 - p) * x * x, minlength=len(k)) + 1.0
        log_e = np.clip(log_e + np.clip(grad / curv, -1, 1), -3, 3)
    return q, log_e, p, hit


def _worst_sums(g: float, v: Votes, q: np.ndarray) -> tuple[float, float]:
    """Gradient and curvature of g: how often the worst is the true best where the named best is not."""
    at = np.flatnonzero((v.c >= 0) & (v.w >= 0) & (v.k[v.item] > 2))
    wrong, is_worst = 1 - q[v.item[at], v.c[at]], q[v.item[at], v.w[at]]
    share = np.exp(-g) / (np.exp(-g) + v.k[v.item[at]] - 2)
    return float(np.sum(v.n[at] * (wrong * share - is_worst))), float(np.sum(v.n[at] * wrong * share * (1 - share)))


def _move(value, grad, curv, prior):
    return np.clip((grad - (value - prior) / PRIOR_VAR) / (curv + 1 / PRIOR_VAR), -1, 1)


def fit(items: DataFrame, judges: list[str], steps: int = STEPS, inner: int = INNER) -> tuple[np.ndarray, float]:
    """Skill of each judge, and g; raises if they still move after all steps."""
    m = len(judges)
    a, prior = np.append(np.full(m, PRIOR_SKILL), PRIOR_WORST), np.append(np.full(m, PRIOR_SKILL), PRIOR_WORST)
    for _ in range(steps):

        def sums(batches: Iterator[pa.RecordBatch], a=a) -> Iterator[pa.RecordBatch]:
            grad, curv = np.zeros(m + 1), np.zeros(m + 1)
            for b in batches:
                v = Votes(b)
                if not len(v.named):
                    continue
                j = v.j.astype(int)
                q, log_e, p, hit = _estimate(a[j], a[m], v, inner)
                e, j, n = np.exp(log_e)[v.item[v.named]], j[v.named], v.n[v.named]
                grad += np.bincount(j, weights=n * (hit - p) * e, minlength=m + 1)
                curv += np.bincount(j, weights=n * p * (1 - p) * e * e, minlength=m + 1)
                more = _worst_sums(a[m], v, q)
                grad[m] += more[0]
                curv[m] += more[1]
            at = np.flatnonzero(curv)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(grad[at]), pa.array(curv[at])], names=["j", "g", "h"])

        got = items.select("k", "j", "c", "w", "n").mapInArrow(sums, "j int, g double, h double").groupBy("j").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        grad, curv = np.zeros(m + 1), np.zeros(m + 1)
        for r in got:
            grad[r.j], curv[r.j] = r.g, r.h
        move = _move(a, grad, curv, prior)
        a = a + move
        if np.abs(move).max() < TOLERANCE:
            return a[:m], float(a[m])
    raise RuntimeError(f"consensus: skills still move by {np.abs(move).max():.2g} after {steps} steps")


def fit_table(counts: DataFrame, steps: int = STEPS, inner: int = INNER) -> tuple[DataFrame, float]:
    """(judge, a) and g: the same steps with the skills as a table, for any number of judges."""
    # written tables: a checkpoint would hand on the constraints of all former steps, which double each time
    table, g = written(counts.select("judge").distinct().withColumn("a", F.lit(PRIOR_SKILL))), PRIOR_WORST
    for _ in range(steps):

        def sums(batches: Iterator[pa.RecordBatch], g=g) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = Votes(b)
                if not len(v.named):
                    continue
                q, log_e, p, hit = _estimate(v.j.astype(float), g, v, inner)
                e, n = np.exp(log_e)[v.item[v.named]], v.n[v.named]
                more = _worst_sums(g, v, q)
                names = b.column("judge").flatten().take(pa.array(v.named)).to_pylist() + [None]
                grad, curv = np.append(n * (hit - p) * e, more[0]), np.append(n * p * (1 - p) * e * e, more[1])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(grad), pa.array(curv)], names=["judge", "g", "h"])

        items = packed(counts.join(table, "judge"), "a").select("k", "j", "c", "w", "n", "judge")
        got = written(items.mapInArrow(sums, "judge string, g double, h double").groupBy("judge").agg(F.sum("g").alias("g"), F.sum("h").alias("h")))
        step = (F.coalesce("g", F.lit(0.0)) - (F.col("a") - PRIOR_SKILL) / PRIOR_VAR) / (F.coalesce("h", F.lit(0.0)) + 1 / PRIOR_VAR)
        new = written(table.join(got, "judge", "left").select("judge", "a", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step)).alias("move")))
        all_worst = got.filter("judge IS NULL").first()
        g_move = float(_move(g, *(all_worst[1:] if all_worst else (0.0, 0.0)), PRIOR_WORST))
        table, g = new.select("judge", (F.col("a") + F.col("move")).alias("a")), g + g_move
        if max(new.agg(F.max(F.abs("move"))).first()[0], abs(g_move)) < TOLERANCE:
            return table, g
    raise RuntimeError(f"consensus: skills still move after {steps} steps")


ITEMS = "prompt_id string, source string, best long, posterior double, easiness double, n_votes long, agreement double"


def consensus(df: DataFrame, steps: int = STEPS, inner: int = INNER, max_judges: int = MAX_JUDGES) -> tuple[DataFrame, DataFrame]:
    """(items, judges): prompt_id, source, best, posterior, easiness, n_votes, agreement; judge, skill, reliability.

    agreement is chance-corrected: (share of agreeing pairs of best votes - 1/K) / (1 - 1/K); null with under two votes.
    reliability is the probability of naming the best of four candidates of middling easiness.
    """
    spark = df.sparkSession
    counts = vote_counts(df)
    names = counts.select("judge").distinct().orderBy("judge").limit(max_judges + 1).collect()
    if not names:
        return spark.createDataFrame([], ITEMS), spark.createDataFrame([], "judge string, skill double, reliability double")
    if len(names) <= max_judges:
        judges = [r.judge for r in names]
        index = spark.createDataFrame([(v, i) for i, v in enumerate(judges)], "judge string, j int")
        items = materialise(packed(counts.join(F.broadcast(index) if len(judges) <= 50_000 else index, "judge"), "j"))
        a, g = fit(items, judges, steps, inner)
        skills = spark.createDataFrame([(v, float(x)) for v, x in zip(judges, a)], "judge string, a double")
        skill_of = lambda j: a[j.astype(int)]
    else:
        skills, g = fit_table(counts, steps, inner)
        items = packed(counts.join(skills, "judge"), "a")
        skill_of = lambda j: j.astype(float)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = Votes(b)
            q, log_e = _estimate(skill_of(v.j), g, v, inner + 2)[:2]
            voted = np.bincount(v.item[(v.c >= 0) | (v.w >= 0)], minlength=len(v.k)) > 0
            per = v.spread(v.c, v.n, v.named)
            total = per.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                same = (per * (per - 1)).sum(axis=1) / (total * (total - 1))
                agree = (same - 1 / v.k) / (1 - 1 / v.k)
            best = np.round(q, 12).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("prompt_id"), b.column("source"),
                    pa.array(best, pa.int64(), mask=~voted), pa.array(q.max(axis=1), mask=~voted),
                    pa.array(np.exp(log_e)), pa.array(total.astype(np.int64)),
                    pa.array(agree, mask=~np.isfinite(agree)),
                ],
                names=["prompt_id", "source", "best", "posterior", "easiness", "n_votes", "agreement"],
            )

    out = items.select("prompt_id", "source", "k", "j", "c", "w", "n").mapInArrow(label, ITEMS)
    return out, skills.select("judge", F.col("a").alias("skill"), (1 / (1 + 3 * F.exp(-F.col("a")))).alias("reliability"))


def agreement_compared(verdicts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(condition, source, n_pairs, item_agreement, pair_agreement, correlation): this figure beside the pairs' own."""
    once = pairs.filter(F.col("agreement").isNotNull()).groupBy("pair_id").agg(F.first(F.struct("condition", "prompt_id", F.col("agreement").alias("told"))).alias("p")).select("p.*")
    items = consensus(verdicts)[0].filter(F.col("agreement").isNotNull()).select("prompt_id", "source", "agreement")
    return once.join(items, "prompt_id").groupBy("condition", "source").agg(
        F.count("*").alias("n_pairs"), F.avg("agreement").alias("item_agreement"), F.avg("told").alias("pair_agreement"), F.corr("agreement", "told").alias("correlation")
    )

"""Problem 1: one global ranking from pairwise comparisons.

Model: P(x beats y) = logistic(s_x - s_y + b * (len_x - len_y) / scale); a tie counts half for either side. The
strength s is what decides when both answers are equally long. Ridge penalty on s.

Method: rows are first aggregated to win counts per (x, y, length difference); the fit then runs on those counts
by minorisation-maximisation. Each step maximises a quadratic that lies below the likelihood and touches it
(curvature tanh(eta / 2) / (2 eta), at most 1/4), so the likelihood never falls. Up to ``LOCAL_ITEMS`` items
(size checked) the quadratic is solved as a whole on the driver from sparse sums that the executors make in one pass a
step; beyond it the quadratic is separated by item, the strengths stay a distributed table and steps are extrapolated
(with restarts). The penalised likelihood has one maximum, so both give the same strengths; either raises if it has not
converged. std_error comes from each item's own curvature at the fit, at any size; joint_error, from the whole inverse
curvature and relative to the mean, needs the whole matrix and is null beyond LOCAL_ITEMS. Connected components of the
comparison graph are found by distributed label spreading; strengths of different components are only comparable
through the penalty, so the component is reported.

Defined cases: rows with a null outcome, a null item or x = y carry no comparison and are left out; each key
(x, y, prompt_id) counts once (the latest delivery); a null length means that the difference is unknown: such
rows enter with the mean difference of their pair's other rows (0 if there are none). Items that only occur in
left-out rows still get a row, with strength 0 and no comparisons. Ties in strength are placed by name. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_rows, materialise, written

LOCAL_ITEMS = 500
RIDGE = 0.1
TOLERANCE = 1e-5
MAX_STEPS = 1_000


def comparisons(df: DataFrame) -> DataFrame:
    """(x, y, outcome, d): valid comparisons, each key once, with the length difference in words."""
    once = (
        df.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("x", "y", "prompt_id")
        .agg(F.max_by(F.struct("outcome", "len_x", "len_y"), F.struct(F.col("outcome").isNotNull(), "loaded_at")).alias("r"))
        .select("x", "y", "r.outcome", (F.col("r.len_x") - F.col("r.len_y")).cast("double").alias("d"))
    )
    return once.filter(F.col("outcome").isNotNull() & (F.col("x") != F.col("y")))


def win_counts(df: DataFrame) -> DataFrame:
    """(x, y, d, n, w): comparisons and wins of x (ties half) with x < y, per length difference."""
    swap = F.col("x") > F.col("y")
    c = comparisons(df).select(
        F.least("x", "y").alias("x"),
        F.greatest("x", "y").alias("y"),
        F.when(swap, 1 - F.col("outcome")).otherwise(F.col("outcome")).alias("outcome"),
        F.when(swap, -F.col("d")).otherwise(F.col("d")).alias("d"),
    )
    counts = c.groupBy("x", "y", "d").agg(F.count("*").cast("double").alias("n"), F.sum("outcome").alias("w"))
    mean = counts.groupBy("x", "y").agg((F.sum(F.col("d") * F.col("n")) / F.sum(F.when(F.col("d").isNotNull(), F.col("n")))).alias("m"))
    return counts.join(mean, ["x", "y"]).select("x", "y", F.coalesce("d", "m", F.lit(0.0)).alias("d"), "n", "w")


def components(edges: DataFrame) -> DataFrame:
    """(item, component): smallest item reachable; labels spread along edges and jump to their label's label.

    Labels only fall and there are finitely many, so the rounds end; jumps make them about the logarithm of the longest path.
    """
    e = written(edges.select("x", "y").distinct())
    both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels = both.select(F.col("x").alias("item")).distinct().withColumn("component", F.col("item"))
    while True:
        near = (
            both.join(labels.select(F.col("item").alias("y"), "component"), "y")
            .groupBy(F.col("x").alias("item"))
            .agg(F.min("component").alias("near"))
        )
        spread = labels.join(near, "item").select("item", F.least("component", "near").alias("next"), "component")
        jump = spread.select(F.col("item").alias("next"), F.col("next").alias("far"))
        new = written(
            spread.join(jump, "next", "left").select("item", F.least("next", F.coalesce("far", "next")).alias("new"), "component")
        )
        labels = new.select("item", F.col("new").alias("component"))
        if new.filter(F.col("new") != F.col("component")).limit(1).count() == 0:
            return labels


def _local_fit(counts: DataFrame, items: list[str], scale: float, ridge: float, steps: int, tolerance: float):
    """(strengths, own errors, joint errors, length effect)."""
    index = {v: i for i, v in enumerate(items)}
    k = len(items)

    def step(theta: np.ndarray, exact: bool = False):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums of the gradient (cell i, -1) and of the curvature (cell i, j), only those that occur."""
            sums: dict[int, float] = {}
            for b in batches:
                x = np.array([index[v] for v in b.column(0).to_pylist()], dtype=np.int64)
                y = np.array([index[v] for v in b.column(1).to_pylist()], dtype=np.int64)
                d, n, w = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                z = d / scale
                eta = theta[x] - theta[y] + theta[k] * z
                p = 1 / (1 + np.exp(-eta))
                r = w - n * p
                size = np.abs(eta)
                c = n * (p * (1 - p) if exact else np.where(size < 1e-4, 0.25, np.tanh(size / 2) / np.maximum(2 * size, 1e-4)))
                at = np.full(len(x), k)
                cell = lambda i, j: i * (k + 2) + j + 1
                cells = [cell(x, -1), cell(y, -1), cell(at, -1), cell(x, x), cell(y, y), cell(x, y), cell(y, x), cell(x, at), cell(y, at), cell(at, x), cell(at, y), cell(at, at)]
                values = [r, -r, r * z, c, c, -c, -c, c * z, -c * z, c * z, -c * z, c * z * z]
                keys, inverse = np.unique(np.concatenate(cells), return_inverse=True)
                for key, v in zip(keys.tolist(), np.bincount(inverse, weights=np.concatenate(values)).tolist()):
                    sums[key] = sums.get(key, 0.0) + v
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.float64())], names=["i", "v"])

        got = np.zeros((k + 1) * (k + 2))
        for row in counts.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            got[row.i] = row.v
        got = got.reshape(k + 1, k + 2)
        return got[:, 0], got[:, 1:]

    penalty = np.full(k + 1, ridge)
    penalty[k] = 1e-6
    theta = np.zeros(k + 1)
    for _ in range(steps):
        grad, bound = step(theta)
        move = np.linalg.solve(bound + np.diag(penalty), grad - penalty * theta)
        theta = theta + move
        if np.abs(move).max() < tolerance:
            break
    else:
        raise RuntimeError(f"ranking: strengths still move by {np.abs(move).max():.2g} after {steps} steps")
    h = step(theta, exact=True)[1] + np.diag(penalty)
    cov = np.linalg.inv(h)
    free = np.eye(k + 1)
    free[:k, :k] -= 1.0 / k  # errors of strengths relative to their mean
    joint = np.sqrt(np.maximum(np.diag(free @ cov @ free.T), 0))
    return theta[:k] - theta[:k].mean(), 1 / np.sqrt(np.diag(h)[:k]), joint[:k], theta[k] / scale


def _distributed_fit(counts: DataFrame, scale: float, ridge: float, steps: int, tolerance: float) -> tuple[DataFrame, float]:
    """Separable minoriser with extrapolation: item-wise curvature bounds; the strengths stay a table.

    (item, strength, std_error) and the length effect. Tables are written each step: checkpoints hand on constraints.
    """
    both = counts.select(F.col("x").alias("item"), F.col("y").alias("other"), (F.col("d") / scale).alias("z"), "n", "w").unionByName(
        counts.select(F.col("y").alias("item"), F.col("x").alias("other"), (-F.col("d") / scale).alias("z"), "n", (F.col("n") - F.col("w")).alias("w"))
    )
    both = written(both)
    size = F.abs("z")
    table = written(both.groupBy("item").agg((F.sum(F.col("n") * (2 + size)) / 4 + ridge).alias("bound")).withColumns({"s": F.lit(0.0), "y": F.lit(0.0)}))
    b_bound = both.agg(F.sum(F.col("n") * size * (2 + size)) / 8).first()[0] + 1e-6
    b = b_y = 0.0
    age = 1.0

    def joined(at: str, effect: float) -> DataFrame:
        mine = table.select("item", "bound", "s", F.col(at).alias("mine"))
        other = table.select(F.col("item").alias("other"), F.col(at).alias("theirs"))
        p = 1 / (1 + F.exp(-(F.col("mine") - F.col("theirs") + F.col("z") * effect)))
        return both.join(mine, "item").join(other, "other").withColumn("p", p)

    for _ in range(steps):
        resid = F.col("w") - F.col("n") * F.col("p")
        g = joined("y", b_y).groupBy("item").agg(
            F.first("bound").alias("bound"), F.first("s").alias("old"), F.first("mine").alias("y"), F.sum(resid).alias("g"), F.sum(resid * F.col("z")).alias("gb")
        )
        new = written(g.withColumn("s", F.col("y") + (F.col("g") - ridge * F.col("y")) / F.col("bound")))
        row = new.agg(
            F.max(F.abs(F.col("s") - F.col("y"))).alias("m"), F.sum("gb").alias("gb"), F.sum((F.col("y") - F.col("s")) * (F.col("s") - F.col("old")) * F.col("bound")).alias("back")
        ).first()
        b_new = b_y + (row.gb / 2 - 1e-6 * b_y) / b_bound
        back = row.back + (b_y - b_new) * (b_new - b) * b_bound
        older, age = (1.0, 1.0) if back > 0 else (age, (1 + (1 + 4 * age * age) ** 0.5) / 2)  # a step against the last one: begin anew
        ahead = 0.0 if back > 0 else (older - 1) / age
        table = new.select("item", "bound", "s", (F.col("s") + ahead * (F.col("s") - F.col("old"))).alias("y"))
        moved = max(row.m, abs(b_new - b_y))
        b, b_y = b_new, b_new + ahead * (b_new - b)
        if moved < tolerance:
            break
    else:
        raise RuntimeError(f"ranking: strengths still move by {moved:.2g} after {steps} steps")
    mean = table.agg(F.avg("s").alias("m")).first().m
    info = joined("s", b).groupBy("item").agg(F.first("s").alias("s"), (F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))) + ridge).alias("h"))
    return written(info.select("item", (F.col("s") - mean).alias("strength"), (1 / F.sqrt("h")).alias("std_error"), F.lit(None).cast("double").alias("joint_error"))), b / scale


FIT = "item string, strength double, std_error double, joint_error double"


def ranking(df: DataFrame, ridge: float = RIDGE, local_items: int = LOCAL_ITEMS, steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(item, strength, std_error, joint_error, n, component, length_effect, place), strongest first."""
    spark = df.sparkSession
    counts = materialise(win_counts(df))
    every = df.select(F.explode(F.array("x", "y")).alias("item")).filter(F.col("item").isNotNull()).distinct()
    spread = counts.agg(F.sqrt(F.sum(F.col("n") * F.col("d") * F.col("d")) / F.sum("n")).alias("s")).first().s
    scale = spread or 1.0
    names = counts.select(F.explode(F.array("x", "y")).alias("item")).distinct().orderBy("item").limit(local_items + 1).collect()
    if not names:
        fit, effect = spark.createDataFrame([], FIT), 0.0
    elif len(names) <= local_items:
        items = [r.item for r in names]
        theta, own, joint, effect = _local_fit(counts, items, scale, ridge, steps, tolerance)
        fit = spark.createDataFrame([(v, float(theta[i]), float(own[i]), float(joint[i])) for i, v in enumerate(items)], FIT)
    else:
        fit, effect = _distributed_fit(counts, scale, ridge, steps, tolerance)
    seen = counts.select(F.explode(F.array("x", "y")).alias("item"), "n").groupBy("item").agg(F.sum("n").cast("long").alias("n"))
    out = (
        every.join(fit, "item", "left")
        .join(seen, "item", "left")
        .join(components(counts), "item", "left")
        .select(
            "item",
            F.coalesce("strength", F.lit(0.0)).alias("strength"),
            "std_error",
            "joint_error",
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
            F.coalesce("component", "item").alias("component"),
            F.lit(effect).alias("length_effect"),
        )
    )
    return _placed(materialise(out))


def _placed(out: DataFrame) -> DataFrame:
    """Dense places without a window over all rows in one task: range partitions, then offsets by partition."""
    ordered = materialise(out.repartitionByRange(F.col("strength").desc(), F.col("item")).sortWithinPartitions(F.col("strength").desc(), "item").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    sizes = bounded_rows(ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")), 100_000, "partitions")
    before, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r.part):
        offsets.append((r.part, before, r.first))
        before += r.n
    if not offsets:
        return ordered.select(*out.columns, F.lit(1).cast("long").alias("place"))
    table = out.sparkSession.createDataFrame(offsets, "part int, before long, first long")
    return ordered.join(F.broadcast(table), "part").select(
        *out.columns, (F.col("before") + F.col("at") - F.col("first") + 1).cast("long").alias("place")
    )


def p1_places(df: DataFrame) -> DataFrame:
    return ranking(df).select(F.col("item").alias("variant"), "place")

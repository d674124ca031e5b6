"""Interpretable pairwise reward: text features, margins, logistic fits, importance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import hash32
from ..functions.text import strip, word_count, words
from ..runtime import bounded_rows, written

# The phrases that are counted.
HEDGES = r"\b(might|possibly|perhaps|maybe|probably|not sure|i think|i believe|it seems)\b"
REFUSALS = r"\b(i can't|i cannot|i won't|i'm not able|i am not able|i'm sorry|i apologize|as an ai)\b"
LIST_ITEM = r"(?m)^\s*(?:[-*•]|\d+[.)])\s+"
FEATURES = ["log_word_count", "hedge_count", "refusal_count", "question_count", "list_item_count"]


def text_features(c: Column) -> dict[str, Column]:
    low = F.translate(F.lower(c), "’", "'")
    return {
        "log_word_count": F.log1p(word_count(c).cast("double")),
        "hedge_count": F.regexp_count(low, F.lit(HEDGES)).cast("double"),
        "refusal_count": F.regexp_count(low, F.lit(REFUSALS)).cast("double"),
        "question_count": F.regexp_count(c, F.lit(r"\?")).cast("double"),
        "list_item_count": F.regexp_count(c, F.lit(LIST_ITEM)).cast("double"),
    }


def feature_differences(pairs: DataFrame) -> DataFrame:
    a, b = text_features(F.col("chosen")), text_features(F.col("rejected"))
    ok = pairs.filter(F.col("chosen").isNotNull() & F.col("rejected").isNotNull())
    return ok.select("pair_id", *[(a[f] - b[f]).alias(f) for f in FEATURES])


def fit(diffs: DataFrame, c: float = 1.0, features: list[str] | None = None, steps: int = 50, tolerance: float = 1e-8) -> dict[str, float]:
    """Ridge logistic fit on differences scaled by their population deviation, without intercept.

    A difference that is turned round together with its label has the same loss, so none is turned. Newton steps on sums
    that each partition makes once (a few numbers a partition come to the driver); raises if they do not settle.
    """
    features = features or FEATURES
    sd = diffs.agg(F.count("*").alias("n"), *[F.stddev_pop(f).alias(f) for f in features]).first()
    if not sd.n:
        return dict.fromkeys(features, 0.0)
    rows = written(diffs.select(*[(F.col(f) / F.lit(sd[f] or 1.0)).cast("double").alias(f) for f in features]))
    k, w = len(features), np.zeros(len(features))
    for _ in range(steps):

        def sums(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k + k * k)
            for b in batches:
                x = np.stack([col.to_numpy(zero_copy_only=False) for col in b.columns], axis=1)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
                total += np.concatenate([x.T @ (1 - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

        got = np.sum([r.v for r in rows.mapInArrow(sums, "v array<double>").collect()], axis=0)
        move = np.linalg.solve(got[k:].reshape(k, k) + np.eye(k) / c, got[:k] - w / c)
        w = w + move
        if np.abs(move).max() < tolerance:
            return {f: float(v) / (sd[f] or 1.0) for f, v in zip(features, w)}
    raise RuntimeError("the reward model's weights do not settle")


def margins(diffs: DataFrame, weights: dict[str, float]) -> DataFrame:
    total = sum((F.col(f) * F.lit(w) for f, w in weights.items()), F.lit(0.0))
    return diffs.withColumn("margin", total)


def accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    hit = F.when(F.col("margin") > 0, 1.0).when(F.col("margin") == 0, 0.5).otherwise(0.0)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


def preference_rows(rows: DataFrame, limit: int | None = None, order: str | None = None) -> DataFrame:
    """(chosen, rejected, source, subset) of rows in either layout: chosen/rejected, or human_chosen/human_rejected.

    A column that is there and filled decides the layout of its row. With a limit only the first rows by ``order`` are taken,
    and only they are checked: a missing, blank or same pair raises. No row at all raises too.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    if limit is not None:
        rows = (rows.orderBy(order) if order else rows).limit(limit)
    col = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    direct = col("chosen").isNotNull() & col("rejected").isNotNull()
    a, b = F.when(direct, col("chosen")).otherwise(col("human_chosen")), F.when(direct, col("rejected")).otherwise(col("human_rejected"))
    fault = (
        F.when(a.isNull() | b.isNull(), "missing string chosen/rejected responses").when((strip(a) == "") | (strip(b) == ""), "chosen/rejected responses must not be empty")
        .when(strip(a) == strip(b), "chosen and rejected responses are identical")
    )
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(a)
    got = rows.select(checked.alias("chosen"), b.alias("rejected"), F.when(direct, "preference_pairs").otherwise("human_labels").alias("source"), col("subset").alias("subset"))
    if rows.limit(1).count() == 0:
        raise ValueError("input contains no preference pairs")
    return got


def label_source(pairs: DataFrame) -> str:
    """The one source of all pairs, or 'mixed:' with the sources in order."""
    names = sorted(r.source for r in bounded_rows(pairs.select("source").distinct(), 100, "label sources"))
    return names[0] if len(names) == 1 else "mixed:" + "+".join(names)


#: Length of the stand-in vectors.
VECTOR = 32


def reward_rows(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """pair_id, subset, differences of the text features, and vectors vc and vr of both sides; written once.

    The vectors stand in for sentence embeddings: counts of hashed words, of length 1; an empty text is the zero vector.
    Rows with columns vc and vr of their own keep those.
    """
    a, b = text_features(F.col("chosen")), text_features(F.col("rejected"))
    ok = pairs.filter(F.col("chosen").isNotNull() & F.col("rejected").isNotNull())
    group = F.col("subset") if "subset" in pairs.columns else F.lit(None).cast("string")
    base = [F.col(key).alias("pair_id"), group.alias("subset"), *[(a[f] - b[f]).alias(f) for f in FEATURES]]
    if {"vc", "vr"} <= set(pairs.columns):
        return written(ok.select(*base, "vc", "vr"))
    spots = lambda c: F.transform(words(F.col(c)), lambda w: F.pmod(F.xxhash64(w), F.lit(VECTOR)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sides = []
            for c in ("vc", "vr"):
                col = batch.column(c)
                row = np.repeat(np.arange(n), np.diff(col.offsets.to_numpy()))
                m = np.bincount(row * VECTOR + col.flatten().to_numpy(), minlength=n * VECTOR).reshape(n, VECTOR).astype(float)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                sides.append(pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * VECTOR, VECTOR), pa.int32()), pa.array(m.ravel())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *sides], names=batch.schema.names)

    rows = ok.select(*base, spots("chosen").alias("vc"), spots("rejected").alias("vr"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return written(rows.mapInArrow(count, f"{kinds}, vc array<double>, vr array<double>"))


def with_components(rows: DataFrame, train: DataFrame, k: int) -> tuple[DataFrame, list[str]]:
    """Adds pc1..pck: differences of the components of both sides, fitted on the training pairs' responses only.

    k is at most the training responses - 1 and the vectors' length. The mean cancels in the difference.
    """
    size = rows.select(F.size("vc")).first()
    k = min(k, (size[0] if size else 0), 2 * train.count() - 1)
    if k < 1:
        return rows, []
    both = train.select(F.explode(F.array("vc", "vr")).alias("v")).select(array_to_vector("v").alias("v"))
    pcs = PCA(k=k, inputCol="v", outputCol="pc").fit(both).pc.toArray()
    names = [f"pc{i + 1}" for i in range(k)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            d = (side("vc") - side("vr")) @ pcs if b.num_rows else np.zeros((0, k))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(d[:, i]) for i in range(k))], names=[*b.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(project, kinds + "".join(f", {n} double" for n in names)), names


def folds_of(rows: DataFrame, folds: int, seed: int = 1234) -> DataFrame:
    """Adds fold: parts of a seeded order, even to a thousandth of the rows."""
    h = hash32(F.concat_ws("|", F.lit(str(seed)), F.col("pair_id").cast("string")))
    cuts = rows.select(h.alias("h")).approxQuantile("h", [i / folds for i in range(1, folds)], 0.001) if folds > 1 else []
    fold = F.lit(0)
    for c in cuts:
        fold = fold + (h > F.lit(c)).cast("int")
    return rows.withColumn("fold", fold)


def cross_validated(pairs: DataFrame, folds: int = 5, seed: int = 1234, components: int = 3) -> DataFrame:
    """(fold, n, accuracy) out of fold, and all folds together as fold null: components and weights are fitted anew per fold."""
    rows = written(folds_of(reward_rows(pairs), folds, seed))
    out = None
    for k in range(folds):
        part, names = with_components(rows, rows.filter(F.col("fold") != k), components)
        train = part.filter(F.col("fold") != k)
        w = fit(train, features=[*FEATURES, *names])
        got = margins(part.filter(F.col("fold") == k), w).select("pair_id", "subset", "fold", "margin")
        out = got if out is None else out.unionByName(got)
    every = F.explode(F.array("fold", F.lit(None).cast("int")))
    return accuracy(out.withColumn("fold", every), ["fold"])


def subset_models(pairs: DataFrame, folds: int = 5, components: int = 3, least: int = 2) -> DataFrame:
    """(grp, n, accuracy, longer_wins, weights of the text features): all pairs, then each subset with enough pairs a fold."""
    rows = pairs.filter(F.col("chosen").isNotNull() & F.col("rejected").isNotNull())
    sizes = bounded_rows(rows.filter(F.col("subset") != "").groupBy("subset").agg(F.count("*").alias("n")), 1_000, "subsets")
    out = []
    for name in ["all", *sorted(r.subset for r in sizes if r.n >= folds * least)]:
        mine = rows if name == "all" else rows.filter(F.col("subset") == name)
        score = next(r for r in cross_validated(mine, folds, components=components).collect() if r.fold is None)
        longer = accuracy(mine.withColumn("margin", word_count(F.col("chosen")) - word_count(F.col("rejected"))), []).first()
        full = reward_rows(mine)
        part, names = with_components(full, full, components)
        w = fit(part, features=[*FEATURES, *names])
        out.append((name, score.n, score.accuracy, longer.accuracy, {f: round(w[f], 6) for f in FEATURES}))
    return pairs.sparkSession.createDataFrame(out, "grp string, n long, accuracy double, longer_wins double, weights map<string,double>")


def component_extremes(vectors: DataFrame, ids: str, vec: str, k: int = 3, top: int = 3) -> DataFrame:
    """(component, side, rank, id): rows with the largest and smallest coordinate on each principal component."""
    x = vectors.filter(F.col(vec).isNotNull()).select(ids, array_to_vector(F.col(vec)).alias("v"))
    scored = PCA(k=k, inputCol="v", outputCol="pc").fit(x).transform(x).select(ids, F.posexplode(vector_to_array("pc")).alias("component", "value"))
    from .prep import lowest_per_group

    out = None
    for side, key in (("low", F.col("value")), ("high", -F.col("value"))):
        got = lowest_per_group(scored, ["component"], key, ids, top).select("component", F.lit(side).alias("side"), F.col("rank").cast("long").alias("rank"), F.col(ids).alias("id"))
        out = got if out is None else out.unionByName(got)
    return out


def importance(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean absolute contribution of each feature to a linear score, ranked."""
    mean = rows.agg(*[F.avg(f).alias(f) for f in weights])
    joined = rows.crossJoin(F.broadcast(mean.select(*[F.col(f).alias(f"m_{f}") for f in weights])))  # one row
    agg = joined.agg(*[F.avg(F.abs(F.lit(w) * (F.col(f) - F.col(f"m_{f}")))).alias(f) for f, w in weights.items()])
    long = agg.select(F.explode(F.create_map(*[x for f in weights for x in (F.lit(f), F.col(f))])).alias("feature", "importance"))
    return long.select("feature", F.round("importance", 6).alias("importance"), F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).cast("long").alias("place"))

"""Problem 8: draw texts so that each source has its target share of the tokens.

Method: time-varying curriculum. Source s has the weight schedule w_s(t) = share_s (1 + r_s (2 t - 1)) over
training time t in 0..1; the tilts r_s balance, so the weights add up to 1 at every t and their integrals are the
target shares. The cumulative demand of s is D_s(t) = T share_s (t + r_s (t^2 - t)) tokens. The texts of s lie
one after the other (pass after pass, in the order of a hash) on its token axis; a text that starts at token c
gets the training position t with D_s(t) = c, by inverting the quadratic. A range sort by position gives the
training order.

T is the largest total that every source can serve with max_repeats passes, unless ``total`` is given (then it
must not be larger). A source's last text may overshoot its demand by less than its own length.

Prefix sums over a source run in two levels (hash buckets, then within a bucket), so no source, however large,
is in one task. Defined cases: texts with null or unlisted source and texts without tokens are not drawn; target
sources without any token are left out and the other shares scaled up; repeated rows are separate texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import bounded_rows, materialise
from .tokens import VOCABULARY, with_token_counts

BUCKET_ROWS = 20_000


def tilts(shares: dict[str, float], tilt: float) -> dict[str, float]:
    """r_s in -1..1 with sum(share_s r_s) = 0: sources by name from late to early."""
    names = sorted(shares)
    raw = {s: 1 - 2 * (i + 0.5) / len(names) for i, s in enumerate(names)}
    mean = sum(shares[s] * raw[s] for s in names)
    most = max((abs(raw[s] - mean) for s in names), default=0) or 1.0
    return {s: tilt * (raw[s] - mean) / max(1.0, most) for s in names}


def mix(items: DataFrame, targets: DataFrame, tilt: float = 0.5, total: float | None = None, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """items (doc_id, source, n_tokens) -> (source, doc_id, pass, tokens, position), sorted by position."""
    spark = items.sparkSession
    goal = {r.source: (r.target_share, r.max_repeats) for r in bounded_rows(targets.select("source", "target_share", "max_repeats"), 100_000, "mix targets") if r.source is not None}
    items = materialise(items.filter((F.col("n_tokens") > 0) & F.col("source").isNotNull()))
    have = {
        r.source: (r.tokens, r.n)
        for r in bounded_rows(items.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), 1_000_000, "sources")
    }
    used = {s: g for s, g in goal.items() if s in have and g[0] and g[0] > 0 and g[1] and g[1] > 0}
    ddl = "source string, doc_id long, pass int, tokens long, position double"
    if not used:
        return spark.createDataFrame([], ddl)
    scale = sum(g[0] for g in used.values())
    shares = {s: g[0] / scale for s, g in used.items()}
    most = min(have[s][0] * used[s][1] / shares[s] for s in used)
    if total is not None and total > most:
        raise ValueError(f"total {total} is more than max_repeats allow ({most:.0f})")
    size = float(total if total is not None else most)
    r = tilts(shares, tilt)
    plan = spark.createDataFrame(
        [(s, shares[s], r[s], shares[s] * size, have[s][0], max(1, have[s][1] // bucket_rows)) for s in used],
        "source string, share double, r double, demand double, supply long, buckets long",
    )
    keyed = items.join(F.broadcast(plan), "source").withColumn("u", F.xxhash64(F.lit(seed), "doc_id"))
    # order of u is order of (bucket, u): the bucket is the high part of the hash
    keyed = materialise(keyed.withColumn("bucket", F.floor((F.col("u") / 2.0**64 + 0.5) * F.col("buckets"))))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = sums.withColumn(
        "before", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("t")
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("u", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    at = keyed.withColumn("inside", inside - F.col("n_tokens")).join(before, ["source", "bucket"])
    passes = F.sequence(F.lit(0), F.ceil(F.col("demand") / F.col("supply") - 1e-9).cast("int") - 1)
    drawn = at.withColumn("pass", F.explode(passes)).withColumn(
        "start", F.col("pass") * F.col("supply") + F.col("before") + F.col("inside")
    ).filter(F.col("start") < F.col("demand") - 1e-6)
    y = F.col("start") / F.col("demand")
    # r t^2 + (1 - r) t - y = 0, the root in 0..1, in the form that is stable for r near 0
    one = 1 - F.col("r")
    t = 2 * y / (one + F.sqrt(F.greatest(one * one + 4 * F.col("r") * y, F.lit(0.0))))
    out = drawn.select("source", "doc_id", "pass", F.col("n_tokens").alias("tokens"), t.alias("position"))
    return out.repartitionByRange("position", "source", "doc_id").sortWithinPartitions("position", "source", "doc_id")


def mix_documents(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, **how) -> DataFrame:
    return mix(with_token_counts(documents, ["doc_id", "source"], "text", vocabulary), targets, **how)


def share_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share, drawn tokens, texts and passes per source."""
    per = drawn.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("n_texts"), (F.max("pass") + 1).alias("passes")
    )
    whole = per.agg(F.sum("tokens").alias("whole"))
    return (
        targets.select("source", "target_share", "max_repeats")
        .join(per, "source", "left")
        .crossJoin(F.broadcast(whole))  # one row
        .select("source", "target_share", "max_repeats", (F.col("tokens") / F.col("whole")).alias("actual_share"), "tokens", "n_texts", "passes")
    )

"""Usage audit over an event log: totals, rolling windows, spaced start times, cache lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usage_by_model(responses: DataFrame) -> DataFrame:
    return responses.groupBy("model").agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("long").alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("long").alias("completion_tokens"),
    )


def rolling_sum(events: DataFrame, by: str, at: str, value: str, ident: str, seconds: int = 60, bucket: int = 3600) -> DataFrame:
    """What was used in the ``seconds`` before each event, without the event itself.

    Time is cut in buckets; each event also goes as a guest to every later bucket that a window with it can begin in, so
    a busy key is split over many tasks and every window is still whole. Buckets are at least as long as the window, which
    bounds the guests to one copy an event. Null times and values: the event is kept, its own value counts as 0 for others.
    """
    bucket = max(bucket, seconds)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.select(F.col(ident), F.col(by), us.alias("__t"), F.col(value).cast("long").alias("__v")).withColumn("__v", F.coalesce("__v", F.lit(0))).withColumn("__b", F.floor(F.col("__t") / (bucket * 1_000_000)))
    guests = rows.filter(F.floor((F.col("__t") + seconds * 1_000_000) / (bucket * 1_000_000)) > F.col("__b")).withColumn("__b", F.col("__b") + 1).withColumn("__guest", F.lit(True))
    both = rows.withColumn("__guest", F.lit(False)).unionByName(guests)
    w = Window.partitionBy(by, "__b").orderBy("__t").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return both.withColumn("used", F.sum("__v").over(w) - F.col("__v")).filter(~F.col("__guest")).select(ident, by, "used")


def admissions(events: DataFrame, by: str, at: str, value: str, ident: str, limit: int, seconds: int = 60) -> DataFrame:
    """(ident, by, used, admit): may a request of ``value`` start now?

    It may if nothing was used in the window (a single request above the limit would else never start) or if what was
    used and what it asks for stay within the limit.
    """
    used = rolling_sum(events, by, at, value, ident, seconds)
    asked = events.select(ident, F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("__asked"))
    ok = (F.col("used") == 0) | (F.col("used") + F.col("__asked") <= limit)
    return used.join(asked, ident).select(ident, by, "used", ok.alias("admit"))


def spaced_starts(events: DataFrame, by: str, at: str, ident: str, micros: int, bucket: int = 3600) -> DataFrame:
    """start_i = max(t_i, start_(i-1) + delta) in closed form: i * delta + running max of (t_j - j * delta).

    Row numbers and running maxima are built per time bucket and carried over the buckets of a key, so that no key's
    whole history is in one task.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.select(F.col(ident), F.col(by), us.alias("__t")).withColumn("__b", F.floor(F.col("__t") / (bucket * 1_000_000)))
    w = Window.partitionBy(by, "__b").orderBy("__t", ident)
    inner = rows.withColumn("__i", F.row_number().over(w))
    sizes = rows.groupBy(by, "__b").agg(F.count("*").alias("__n"))
    offset = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = inner.join(offset.select(by, "__b", "__before"), [by, "__b"]).withColumn("__k", F.col("__i") + F.col("__before")).withColumn("__slack", F.col("__t") - F.col("__k") * micros)
    top = placed.groupBy(by, "__b").agg(F.max("__slack").alias("__m"))
    carried = top.withColumn("__past", F.max("__m").over(Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select(by, "__b", "__past")
    run = F.max("__slack").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("__run", run).join(carried, [by, "__b"]).select(
        ident, by, (F.greatest("__run", F.coalesce("__past", "__run")) + F.col("__k") * micros).alias("start_us")
    )


def newest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Upsert view of a log: the newest row of each key, by a partial aggregate."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")

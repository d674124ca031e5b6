"""Prompt preparation: deduplication, bands, splits, samples, decontamination."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import hash32
from ..functions.text import normalize, word_count
from ..runtime import bounded_rows, materialise


def once(df: DataFrame, key: str | list[str]) -> DataFrame:
    """One row a key: the first delivery (smallest loaded_at, then the smallest content), so a differing repeat is decided, not drawn."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in (*keys, "loaded_at")]
    if not rest:
        return df.select(*keys).distinct()
    row = F.struct(*rest)
    # maps cannot be ordered: their text stands in
    plain = F.struct(*[F.to_json(c) if "map<" in t else F.col(c) for c, t in df.dtypes if c in rest])
    order = F.struct(*([F.col("loaded_at")] if "loaded_at" in df.columns else []), F.xxhash64(plain))
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("__r")).select(*keys, "__r.*")


def shuffled(*parts: Column | str, seed: int = 1234) -> Column:
    """Order of a seeded shuffle: a hash of the key."""
    return hash32(F.concat_ws("|", F.lit(str(seed)), *parts))


def first_per_key(df: DataFrame, text: str, pos: list[str]) -> DataFrame:
    """Keep the first row (by position) of each normalised text.

    A partial aggregate with min_by runs before the shuffle, so a text with a third of all rows is no hot task.
    Null texts are dropped; an empty key is a key.
    """
    keyed = df.filter(F.col(text).isNotNull()).withColumn("key", normalize(F.col(text)))
    row = F.struct(*[c for c in df.columns])
    return keyed.groupBy("key").agg(F.min_by(row, F.struct(*pos)).alias("r"), F.count("*").alias("n_copies")).select("key", "n_copies", "r.*")


def length_band(df: DataFrame, text: str, low: int, high: int) -> DataFrame:
    return df.withColumn("n_words", word_count(F.col(text))).filter(F.col("n_words").between(low, high))


def funnel(df: DataFrame, text: str, groups: list[str], low: int, high: int) -> DataFrame:
    """Stage counters per group, each stage within the one before: raw, with text, in the length band, distinct."""
    words = word_count(F.col(text))
    ok = F.col(text).isNotNull()
    fit = ok & words.between(low, high)
    per_key = (
        df.withColumns({"ok": ok.cast("long"), "fit": fit.cast("long"), "key": F.when(fit, normalize(F.col(text)))})
        .groupBy(*groups, "key")
        .agg(F.count("*").alias("raw"), F.sum("ok").alias("ok"), F.sum("fit").alias("fit"))
    )
    return per_key.groupBy(*groups).agg(
        F.sum("raw").cast("long").alias("raw"), F.sum("ok").cast("long").alias("with_text"),
        F.sum("fit").cast("long").alias("length_ok"), F.count("key").cast("long").alias("distinct_texts"),
    )


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def lowest_per_group(df: DataFrame, by: list[str], key: Column, ids: str, k: int) -> DataFrame:
    """The k lowest rows of each group by (key, id), without sorting a hot group in one task.

    Rows are cut to k in each of many hash buckets first, then to k over the buckets' survivors.
    """
    bucket = F.pmod(F.xxhash64(ids), F.lit(64))
    keyed = df.withColumns({"__k": key, "__b": bucket})
    part = ranked(keyed, [*by, "__b"], [F.col("__k"), F.col(ids)], "__r").filter(F.col("__r") <= k)
    return ranked(part, by, [F.col("__k"), F.col(ids)]).filter(F.col("rank") <= k).drop("__k", "__b", "__r")


def stratified(df: DataFrame, stratum: str, ids: str, n: int, seed: int = 1234) -> DataFrame:
    """n rows over the strata as evenly as possible; the remainder goes to the alphabetically first strata.

    A stratum with fewer rows than its share raises.
    """
    strata = df.select(stratum).distinct().withColumns(
        {"k": F.count("*").over(Window.partitionBy(F.lit(1))), "at": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(stratum))}
    )  # one row a stratum
    quota = strata.select(stratum, (F.floor(F.lit(n) / F.col("k")) + F.when(F.col("at") <= F.lit(n) % F.col("k"), 1).otherwise(0)).alias("quota"))
    have = df.groupBy(stratum).agg(F.count("*").alias("have"))
    short = bounded_rows(have.join(F.broadcast(quota), stratum).filter("have < quota"), 10_000, "strata")
    if short:
        raise ValueError("too few rows: " + ", ".join(f"{r[stratum]} has {r['have']} of {r['quota']}" for r in short))
    low = lowest_per_group(df, [stratum], shuffled(F.col(ids), seed=seed), ids, n)
    return low.join(F.broadcast(quota), stratum).filter(F.col("rank") <= F.col("quota")).drop("quota")


def disjoint_bands(df: DataFrame, stratum: str, ids: str, sizes: dict[str, int], seed: int = 1234) -> DataFrame:
    """Disjoint samples per stratum as consecutive bands of one shuffle: band -> rows per stratum."""
    low = lowest_per_group(df, [stratum], shuffled(F.col(ids), seed=seed), ids, sum(sizes.values()))
    band, at = None, 0
    for name, size in sizes.items():
        at += size
        band = F.when(F.col("rank") <= at, name) if band is None else band.when(F.col("rank") <= at, name)
    return low.withColumn("band", band)


def leaked_texts(train: DataFrame, held_out: DataFrame, text: str) -> DataFrame:
    """Train rows whose normalised text occurs in the held-out rows."""
    keys = held_out.filter(F.col(text).isNotNull()).select(normalize(F.col(text)).alias("key")).distinct()
    return train.withColumn("key", normalize(F.col(text))).join(keys, "key", "left_semi")


def near_vectors(rows: DataFrame, refs: DataFrame, ids: str, vec: str, tau: float, block: int = 5_000) -> DataFrame:
    """Rows with a reference of cosine tau or more: (id, best reference, cosine).

    Exact blocked products: the references go out in blocks of a fixed size, all rows stay where they are. With several
    blocks, each block's best matches are checkpointed and the block is released before the next one is sent.
    """
    import numpy as np

    refs = refs.select(ids, vec).orderBy(ids)
    n = refs.count()
    per = max(1, -(-n // block))
    out = None
    for i in range(per):
        part = refs.filter(F.pmod(F.xxhash64(ids), F.lit(per)) == i).collect() if per > 1 else refs.collect()
        if not part:
            continue
        keys = np.array([r[0] for r in part])
        m = np.array([r[1] for r in part], dtype=float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        shared = rows.sparkSession.sparkContext.broadcast((keys, m))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, m = shared.value
            for b in batches:
                ok = b.filter(b.column(1).is_valid())
                if not ok.num_rows:
                    continue
                flat = ok.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(ok.num_rows, -1)
                flat = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)
                sim = flat @ m.T
                at = sim.argmax(axis=1)
                top = sim[np.arange(len(at)), at]
                keep = top >= tau
                yield pa.RecordBatch.from_arrays(
                    [ok.column(0).filter(pa.array(keep)), pa.array(keys[at][keep]), pa.array(top[keep])], names=["id", "ref", "cosine"]
                )

        got = rows.select(ids, vec).mapInArrow(best, "id long, ref long, cosine double")
        if per > 1:
            got = materialise(got)
            shared.destroy()
        out = got if out is None else out.unionByName(got)
    if out is None:
        return rows.sparkSession.createDataFrame([], "id long, ref long, cosine double")
    return out.groupBy("id").agg(F.max_by("ref", F.struct("cosine", -F.col("ref"))).alias("ref"), F.max("cosine").alias("cosine")) if per > 1 else out

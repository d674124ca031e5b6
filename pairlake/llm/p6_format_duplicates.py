"""Problem 6: collapse records that are equal but for formatting and field order.

Method: recursive radix partitioning on canonical bytes. Every record gets canonical bytes
(:func:`pairlake.functions.text.canonical_record`). Each input partition counts its own copies first, so that
a group with a third of all rows leaves a partition as one row. A bucket is a prefix of the canonical bytes;
a bucket over ``capacity`` is split by the ``step`` bytes behind the longest prefix that all its keys share, until each
fits or is a single key: a template of any length that thousands of records share costs one round, not one for each
of its bytes. Each bucket is then counted in a trie whose terminals hold the number of copies and the smallest id.

Buckets have numbers (long); a row carries its bucket's number and depth from round to round in a written table, and what is
looked up in a round is the (bucket, next bytes) pairs of oversized buckets, by a join: no prefix comes to the driver.

Defined cases: a null text or null id is skipped; empty texts and texts of marks only are one group of their
own (canonical bytes ''); a row delivered twice counts as one copy; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_record
from ..runtime import bounded_rows, materialise, written

CAPACITY = 200_000
STEP = 8
#: A class with more copies than this, and than a thousandth of all, is matched to its rows in slots; there are under 1,000.
HOT, SLOTS = 50_000, 32


class CopyTrie:
    """Trie over byte chunks; a terminal holds [copies, smallest id]."""

    __slots__ = ("root", "step")

    def __init__(self, step: int) -> None:
        self.root: dict = {}
        self.step = step

    def add(self, key: bytes, copies: int, least: str) -> None:
        node, step = self.root, self.step
        for i in range(0, len(key), step):
            chunk = key[i : i + step]
            child = node.get(chunk)
            if child is None:
                child = node[chunk] = {}
            node = child
        end = node.get(None)
        if end is None:
            node[None] = [copies, least]
        else:
            end[0] += copies
            if least < end[1]:
                end[1] = least

    def terminals(self) -> Iterator[tuple[bytes, int, str]]:
        stack = [(b"", self.root)]
        while stack:
            key, node = stack.pop()
            for chunk, child in node.items():
                if chunk is None:
                    yield key, child[0], child[1]
                else:
                    stack.append((key + chunk, child))


def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies and smallest id of each canonical key within one input partition."""
    seen: dict[bytes, list] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict(
            {"canon": list(seen), "copies": [v[0] for v in seen.values()], "least": [v[1] for v in seen.values()]},
            schema=pa.schema([("canon", pa.binary()), ("copies", pa.int64()), ("least", pa.string())]),
        )
        seen.clear()
        return out

    for batch in batches:
        for key, rid in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = seen.get(key)
            if got is None:
                seen[key] = [1, rid]
            else:
                got[0] += 1
                if rid < got[1]:
                    got[1] = rid
        if len(seen) > 50_000:  # bounds the memory; partial counts may leave in several pieces
            yield flush()
    if seen:
        yield flush()


def split_buckets(partials: DataFrame, capacity: int, step: int) -> DataFrame:
    """partials with a column ``bucket`` (long): at most ``capacity`` rows each, or all of one key.

    A round finds, per oversized bucket, the length of the prefix that its smallest and largest key share (all others
    lie between them, so they share it too), and splits the bucket by the ``step`` bytes behind it. A bucket whose smallest
    and largest key are equal holds one key. Each round splits every open bucket, so the rounds are at most the distinct
    branchings on a path, not the bytes. Rows that are done leave the rounds.
    """
    common = F.udf(_shared_length, "int")
    rows = partials.withColumn("bucket", F.lit(0).cast("long"))
    done = None
    while True:
        groups = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("canon").alias("low"), F.max("canon").alias("high")).filter((F.col("n") > capacity) & (F.col("low") != F.col("high")))
        # one row per oversized bucket, at most rows / capacity of them; the function runs on these only
        over = written(groups.select("bucket", (common("low", "high") + step).alias("width")))
        if over.limit(1).count() == 0:
            return rows if done is None else done.unionByName(rows)
        kept = rows.join(over.select("bucket"), "bucket", "left_anti")
        done = kept if done is None else done.unionByName(kept)
        # salted, as one bucket may hold all rows: the few oversized buckets are repeated for each slot
        slots = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))
        wide = rows.withColumn("slot", F.pmod(F.xxhash64("canon"), F.lit(SLOTS)).cast("int")).join(over.withColumn("slot", slots), ["bucket", "slot"])
        rows = written(wide.select("canon", "copies", "least", F.xxhash64("bucket", F.substring("canon", F.lit(1), F.col("width"))).alias("bucket")))


def _shared_length(a, b):
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def format_classes(
    df: DataFrame, id_col: str = "id", text_col: str = "prompt", capacity: int = CAPACITY, step: int = STEP
) -> DataFrame:
    """One row per class of copies: canon (binary), copies, least (smallest id).

    >>> format_classes(prompts)  # doctest: +SKIP
    """
    rows = (
        df.select(F.col(id_col).cast("string").alias("id"), canonical_record(F.col(text_col)).alias("canon"))
        .filter(F.col("id").isNotNull() & F.col("canon").isNotNull())
        .select(F.col("canon").cast("binary").alias("canon"), "id")
    )
    return count_in_buckets(rows, capacity, step)


def count_in_buckets(rows: DataFrame, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """rows: (canon binary, id string), without nulls and each delivered row once or more."""
    partials = materialise(rows.mapInArrow(_local_counts, "canon binary, copies long, least string"))
    bucketed = split_buckets(partials, capacity, step)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("canon", pa.binary()), ("copies", pa.int64()), ("least", pa.string())])

        def emit(trie: CopyTrie) -> Iterator[pa.RecordBatch]:
            got = list(trie.terminals())
            for i in range(0, len(got), 20_000):
                part = got[i : i + 20_000]
                yield pa.RecordBatch.from_pydict(
                    {"canon": [x[0] for x in part], "copies": [x[1] for x in part], "least": [x[2] for x in part]},
                    schema=schema,
                )

        current, trie = None, CopyTrie(step)
        for batch in batches:  # sorted by bucket: one trie at a time
            for bucket, key, n, least in zip(*(batch.column(c).to_pylist() for c in ("bucket", "canon", "copies", "least"))):
                if bucket != current:
                    yield from emit(trie)
                    current, trie = bucket, CopyTrie(step)
                trie.add(key, n, least)
        yield from emit(trie)

    # two bytes more spread a bucket that needed no split over the tasks; equal keys stay together
    spread = F.xxhash64("bucket", F.substring("canon", 1, 2 * step))
    return (
        bucketed.select(F.when(F.col("bucket") == 0, spread).otherwise(F.col("bucket")).alias("bucket"), "canon", "copies", "least")
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "canon binary, copies long, least string")
    )


def format_duplicates(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "prompt",
    capacity: int = CAPACITY,
    step: int = STEP,
    hot: int = HOT,
) -> DataFrame:
    """(id_a, id_b): the smallest id of each class of two or more ids, with each other id of the class."""
    rows = (
        df.select(F.col(id_col).cast("string").alias("id"), canonical_record(F.col(text_col)).alias("canon"))
        .filter(F.col("id").isNotNull() & F.col("canon").isNotNull())
        .select(F.col("canon").cast("binary").alias("canon"), "id")
    )
    # keys are matched by 128 bits of their bytes, which are short to move; classes were counted on the bytes themselves
    digest = F.unhex(F.md5("canon")).alias("digest")
    rows = written(rows)
    classes = materialise(count_in_buckets(rows, capacity, step).filter("copies > 1").select(digest, "copies", "least"))
    total = rows.count()
    hot_keys = [bytes(r.digest) for r in bounded_rows(classes.filter(F.col("copies") > max(hot, total // 1000)).select("digest"), 1000, "hot classes")]
    is_hot = F.col("digest").isin(hot_keys) if hot_keys else F.lit(False)
    slot = F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int")).otherwise(0)
    every = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SLOTS - 1))).otherwise(F.array(F.lit(0))))
    mine = rows.select(digest, "id").withColumn("slot", slot)
    return (
        mine.join(classes.select("digest", "least").withColumn("slot", every), ["digest", "slot"])
        .filter(F.col("id") != F.col("least"))
        .select(F.col("least").alias("id_a"), F.col("id").alias("id_b"))
        .distinct()
    )


def copies_report(df: DataFrame, id_col: str = "id", text_col: str = "prompt") -> DataFrame:
    """One record for each class with its number of copies: (id, copies); rows delivered twice count once."""
    once = df.select(id_col, text_col).dropDuplicates([id_col, text_col])
    return format_classes(once, id_col, text_col).select(F.col("least").alias("id"), "copies")

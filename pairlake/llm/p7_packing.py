"""Problem 7: fill containers of fixed capacity with texts of varying length.

Method: bounded-space online packing. Texts are spread over shards by their id; each shard reads its texts in id
order and keeps at most ``OPEN`` windows: a text goes into the open window where it fits best; where none fits
and all windows are open, the fullest is emitted and a new one opened. The windows left open in all shards are
then merged with one another, largest first into the best fit, in groups of ``MERGE`` shards a task.

A text larger than the capacity is split into full containers and a rest; no other text is split.

Defined cases: null and empty texts take no room: tokens 0, container null. Null ids are allowed; repeated rows
are packed as often as they come. Extra columns are ignored. A capacity must be positive.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_rows, materialise
from .tokens import VOCABULARY, with_token_counts

OPEN = 64
MERGE = 256
SHARD_ROWS = 20_000


class Windows:
    """At most ``limit`` open windows; ``free`` is sorted by room, so best fit is a binary search."""

    def __init__(self, capacity: int, limit: int, prefix: str) -> None:
        self.capacity, self.limit, self.prefix = capacity, limit, prefix
        self.free: list[tuple[int, int]] = []  # (room, window)
        self.held: dict[int, list] = {}
        self.made = 0
        self.ready = None  # a second window emitted by the same put

    def put(self, item, size: int):
        """Place an item; returns (window, items, room) of a window that had to be emitted, or None."""
        out = None
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                full_room, full = self.free.pop(0)
                out = (full, self.held.pop(full), full_room)
            room, window = self.capacity, self.made
            self.made += 1
            self.held[window] = []
        self.held[window].append(item)
        if room == size:
            done = (window, self.held.pop(window), 0)
            if out is None:
                return done
            self.ready = done
            return out
        insort(self.free, (room - size, window))
        return out


ready_schema = pa.schema(
    [("profile", pa.string()), ("capacity", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("tokens", pa.int64()),
     ("container", pa.string()), ("fill", pa.int64()), ("open", pa.bool_()), ("shard", pa.int32())]
)
_DDL = "profile string, capacity long, doc_id long, piece int, tokens long, container string, fill long, open boolean, shard int"


def pack(items: DataFrame, limits: list[tuple[str, int]], open_windows: int = OPEN, shard_rows: int = SHARD_ROWS, merge: int = MERGE) -> DataFrame:
    """items (doc_id, n_tokens) -> (profile, doc_id, piece, tokens, container, fill, capacity), for every profile."""
    if any(c is None or c <= 0 for _, c in limits):
        raise ValueError("capacities must be positive")
    items = materialise(items)
    shards = max(1, -(-items.count() // shard_rows))
    limits = sorted(limits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        packs: list[Windows] = []

        def emit(profile, capacity, got, prefix, is_open):
            window, held, room = got
            name = f"{profile}-{prefix}-{window}"
            for doc, piece, size in held:
                rows.append((profile, capacity, doc, piece, size, name, capacity - room, is_open, shard))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ready_schema)], schema=ready_schema)
            rows.clear()
            return out

        def close():
            for (profile, capacity), w in zip(limits, packs):
                for room, window in w.free:
                    emit(profile, capacity, (window, w.held[window], room), w.prefix, True)

        for b in batches:
            for s, doc, size in zip(*(c.to_pylist() for c in b.columns)):
                if s != shard:
                    close()
                    shard = s
                    packs = [Windows(c, open_windows, str(s)) for _, c in limits]
                for (profile, capacity), w in zip(limits, packs):
                    if not size:
                        rows.append((profile, capacity, doc, 0, 0, None, None, False, s))
                        continue
                    piece, rest = 0, size
                    while rest > capacity:  # only an item over the capacity is split
                        rows.append((profile, capacity, doc, piece, capacity, f"{profile}-{s}-{w.made}", capacity, False, s))
                        w.made += 1
                        piece, rest = piece + 1, rest - capacity
                    w.ready = None
                    got = w.put((doc, piece, rest), rest)
                    for x in (got, w.ready):
                        if x is not None:
                            emit(profile, capacity, x, w.prefix, False)
                if len(rows) > 20_000:
                    yield flush()
        close()
        if rows:
            yield flush()

    sharded = items.select(F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("n_tokens"))), F.lit(shards)).cast("int").alias("shard"), "doc_id", F.col("n_tokens"))
    placed = materialise(sharded.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "n_tokens").mapInArrow(place, _DDL))

    def join_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole windows into one another: largest first, best fit, unbounded windows (the input is bounded)."""
        key, window = None, None
        for b in batches:
            out = []
            for profile, capacity, group, name, fill in zip(*(c.to_pylist() for c in b.columns)):
                if (profile, group) != key:
                    key, window = (profile, group), []
                at = bisect_left(window, (fill, ""))
                if at < len(window):
                    room, target = window.pop(at)
                else:
                    room, target = capacity, name
                out.append((name, target))
                insort(window, (room - fill, target))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["container", "target"])

    left = placed.filter("open").select("profile", "capacity", F.floor(F.col("shard") / merge).alias("group"), "container", "fill").distinct()
    target = materialise(
        left.repartition("profile", "group")
        .sortWithinPartitions("profile", "group", F.col("fill").desc(), "container")
        .mapInArrow(join_windows, "container string, target string")
    )
    filled = target.join(left, "container").groupBy("target").agg(F.sum("fill").alias("merged"))
    moved = target.join(filled, "target")
    out = ["profile", "doc_id", "piece", "tokens", "container", "fill", "capacity"]
    return placed.filter("NOT open").select(*out).unionByName(
        placed.filter("open").join(moved, "container").select(
            "profile", "doc_id", "piece", "tokens", F.col("target").alias("container"), F.col("merged").alias("fill"), "capacity"
        )
    )


def pack_documents(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    caps = [(r.profile, r.capacity_tokens) for r in bounded_rows(limits.select("profile", "capacity_tokens"), 1000, "pack_limits")]
    return pack(with_token_counts(documents, ["doc_id"], "text", vocabulary), caps)


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and mean fill per profile."""
    per = packed.filter("container IS NOT NULL").groupBy("profile", "capacity", "container").agg(F.sum("tokens").alias("t"))
    return per.groupBy("profile", "capacity").agg(
        F.count("*").alias("containers"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count("*") * F.col("capacity"))).alias("fill_share")
    )

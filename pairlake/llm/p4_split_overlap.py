"""Problem 4: same or near-same prompts between the training split and all other splits.

Method: exact prefix-filter bipartite join on rare shingles. Records of equal word sets are one class on each
side. The words of a class are put in one global order, rare words first. Two sets of Jaccard similarity t or more
that share a rare word share one within their prefixes of n - ceil(t n) + 1 words, so rare prefix words are the
keys: evaluation prefixes are the index, training prefixes probe it with the length filter, the position filter and
a parity signature of the words. The words of what is left are then counted exactly and names are compared.

Definition of a pair (the keys follow from it, no performance parameter changes the result):

1. shared distinct words / all distinct words of both is ``threshold`` or more (words: runs of letters and digits,
   case folded; single words and 0.75, as TESTDATA.md states);
2. not both sides have a word, capitalised inside a sentence, that the other lacks even with a typing error (two
   edits to a word that only the other has): they would name other places or persons;
3. a name is such a capitalised word that at most max(2, classes / NAME_SHARE) classes have (a *rare* word). Where
   one side has two names or more, one name of either must be a word of both.

Which keys exist. Pairs that share a rare word meet on that word; where its list is long (more than ``cold`` classes)
the key is the word with one *segment*: all words are hashed into one segment more than words can differ, so one
segment at least has the same words on both sides. Pairs without a common rare word have at most one name each, by 3;
such classes also get the segments of their frequent words as keys. A record of n words has at most n / 4 + 1 rare keys and
about 2 n / 7 segments in one or two size bands: linear in its length.

Defined cases: null id, text or split: skipped. Texts without a word match only texts without a word (same
class). Repeated rows count once. Extra columns are ignored. Equal word sets are one class, found by a 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, strip, words
from ..runtime import bounded_rows, materialise, written

THRESHOLD = 0.75
#: Part of the definition: words in more than 1 / NAME_SHARE of all classes name nothing in particular.
NAME_SHARE = 500
#: Longest list of a key on a single rare word; beyond it the key takes a segment too. Speed only.
COLD = 2_000
#: Words with known frequency on the executors (16 bytes each); the frequency they start from follows from it.
MAX_FREQUENT = 400_000
#: Links up to which the classes they name are picked out by a broadcast (16 bytes a link).
FEW_LINKS = 200_000
#: Classes of more records than this, and than a thousandth of all, are expanded in slots; so there are under 1,000.
HOT_CLASS, SLOTS = 10_000, 32


def _capitals(text: Column, n_words: Column) -> Column:
    """Case-folded words that begin with a capital inside a sentence; none in a text in capitals, or where most words have one."""
    inside = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[\p{Ll}\p{N}],? (?=(\p{Lu}[\p{L}\p{M}\p{N}]++))"), F.lit(1)), fold))
    none = F.array().cast("array<string>")
    return F.when((F.size(inside) > 0.6 * n_words) | (text == F.upper(text)), none).otherwise(inside)


def _records(df: DataFrame, id_col: str, text_col: str, split_col: str, train: str) -> DataFrame:
    """(id, train, class, words, names), one row per usable record, written once: texts are taken apart a single time."""
    text = strip(F.col(text_col))
    return written(
        df.select(F.col(id_col).cast("string").alias("id"), (F.col(split_col) == train).alias("train"), text.alias("text"))
        .filter(F.col("id").isNotNull() & F.col("train").isNotNull() & F.col("text").isNotNull())
        .withColumn("words", F.sort_array(F.array_distinct(words(F.col("text")))))
        .select("id", "train", F.unhex(F.md5(F.array_join("words", " "))).alias("class"), "words", _capitals(F.col("text"), F.size("words")).alias("names"))
    )


def _classes(records: DataFrame) -> DataFrame:
    """(class, cid, words, names, n_train, n_eval), written once. cid is a 64-bit hash of class, for the keys."""
    got = (
        records.groupBy("class")
        .agg(
            F.first("words").alias("words"),
            # a class's members have the same words, so this set is no longer than they are
            F.collect_set("names").alias("names"),
            F.count(F.when(F.col("train"), 1)).alias("n_train"),
            F.count(F.when(~F.col("train"), 1)).alias("n_eval"),
        )
        .withColumns({"names": F.array_distinct(F.flatten("names")), "cid": F.xxhash64("class")})
    )
    return written(got)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bands(n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, band) for each size band that the larger set of a pair with a set of n words can be in."""
    low = np.floor(np.log2(np.maximum(n, 1)) * 2).astype(int)
    high = np.floor(np.log2(np.maximum(np.floor(n / t + 1e-9), 1)) * 2).astype(int)
    count = high - low + 1
    row = np.repeat(np.arange(len(n)), count)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _segments(word: np.ndarray, row: np.ndarray, n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every segment: words hashed into (most words that can differ in a size band) + 1 parts.

    ``word`` holds mixed hashes grouped by ``row``, an index into ``n``.
    """
    inst_row, band = _bands(n, t)
    largest = np.ceil(2.0 ** ((band + 1) / 2))  # sets of the band are smaller than this or equal
    parts = (np.floor(2 * largest * (1 - t) / (1 + t) + 1e-9) + 1).astype(np.int64)
    start = np.cumsum(parts) - parts
    per_row = np.bincount(row, minlength=len(n))
    first = np.cumsum(per_row) - per_row
    times = per_row[inst_row]
    inst = np.repeat(np.arange(len(inst_row)), times)
    at = np.arange(len(inst)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[inst_row], times)
    slot = start[inst] + (word[at] % parts[inst].astype(np.uint64)).astype(np.int64)
    sums = np.zeros(int(parts.sum()), np.uint64)
    np.add.at(sums, slot, _mix(word[at]))
    owner = np.repeat(np.arange(len(inst_row)), parts)
    place = np.arange(len(owner)) - start[owner]
    tag = _mix(band[owner].astype(np.uint64) * np.uint64(1_000_003) + place.astype(np.uint64))
    return inst_row[owner], _mix(sums + tag)


def record_keys(hashes: np.ndarray, n: np.ndarray, freq: np.ndarray, names: np.ndarray, t: float, rare: int, cold: int):
    """(row, key, room) of every key. hashes and freq (number of classes with the word, 0 if few): flat, by row; names: per row."""
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, freq, row))
    h, freq = _mix(hashes[order].astype(np.uint64)), freq[order]
    pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    least = n - np.ceil(t * n - 1e-9).astype(int)  # words that the other may lack
    is_rare = freq <= rare
    prefix = is_rare & (pos <= least[row])
    single = np.flatnonzero(prefix & (freq <= cold))
    out = [(row[single], _mix(h[single] + np.uint64(1)), (n[row] - pos)[single])]
    # rare words with a long list: with each segment of the record
    long = np.flatnonzero(prefix & (freq > cold))
    if len(long):
        rows = np.unique(row[long])
        back = np.full(len(n), -1)
        back[rows] = np.arange(len(rows))
        mine = back[row] >= 0
        seg_row, seg = _segments(h[mine], back[row[mine]], n[rows], t)
        per = np.bincount(seg_row, minlength=len(rows))
        first = np.cumsum(per) - per
        by = np.argsort(seg_row, kind="stable")
        of = back[row[long]]
        which = np.repeat(np.arange(len(long)), per[of])
        at = by[np.arange(len(which)) - np.repeat(np.cumsum(per[of]) - per[of], per[of]) + first[of[which]]]
        out.append((row[long][which], _mix(_mix(h[long][which] + np.uint64(2)) + seg[at]), (n[row] - pos)[long][which]))
    # at most one name, and few enough rare words to match without any of them: segments of the frequent words
    n_rare = np.bincount(row, weights=is_rare, minlength=len(n)).astype(int)
    sparse = np.flatnonzero((names <= 1) & (n_rare <= least) & (n_rare < n))
    if len(sparse):
        back = np.full(len(n), -1)
        back[sparse] = np.arange(len(sparse))
        mine = (back[row] >= 0) & ~is_rare
        seg_row, seg = _segments(h[mine], back[row[mine]], n[sparse], t)
        out.append((sparse[seg_row], _mix(seg + np.uint64(3)), n[sparse[seg_row]]))
    return tuple(np.concatenate(c) for c in zip(*out))


def class_pairs(classes: DataFrame, threshold: float = THRESHOLD, rare_share: int | None = None) -> DataFrame:
    """(class_e, class_t) of similar, not equal classes; class_e occurs in an evaluation split, class_t in train.

    ``rare_share`` sets the longest list of a single word to 1 / rare_share of the classes instead of COLD: speed only.
    """
    n, total = classes.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    rare = max(2, n // NAME_SHARE)
    cold = max(COLD, total // MAX_FREQUENT) if rare_share is None else max(2, n // rare_share)
    # words above a frequency f are at most total / f: at most MAX_FREQUENT from COLD on, mean words x NAME_SHARE from rare on
    known = min(rare, cold)
    stats = (
        classes.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("h"))
        .groupBy("h").agg(F.count("*").alias("df")).filter(F.col("df") > known)
    )
    rows = bounded_rows(stats, total // known + 1, "frequent words")
    table = np.array(sorted((r.h, r.df) for r in rows), dtype=np.int64).reshape(-1, 2)
    shared = classes.sparkSession.sparkContext.broadcast((table[:, 0].copy(), table[:, 1].copy()))
    t = threshold

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value

        def df_of(h: np.ndarray) -> np.ndarray:
            if not len(frequent):
                return np.zeros(len(h), np.int64)
            at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
            return np.where(frequent[at] == h, counts[at], 0)

        def flat(col) -> tuple[np.ndarray, np.ndarray]:
            return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(col.offsets.to_numpy()).astype(np.int64)

        for batch in batches:
            cid = batch.column(0).to_numpy()
            h, n = flat(batch.column(1))
            caps, n_caps = flat(batch.column(2))
            of = np.repeat(np.arange(len(n)), n_caps)
            names = np.bincount(of, weights=df_of(caps) <= rare, minlength=len(n)).astype(int)
            row, key, room = record_keys(h, n, df_of(h), names, t, rare, cold)
            sign = np.zeros(len(n), np.uint64)
            words_of = np.repeat(np.arange(len(n)), n)
            np.bitwise_xor.at(sign, words_of, np.uint64(1) << (_mix(h.astype(np.uint64)) & np.uint64(63)))
            for at in range(0, max(len(row), 1), 200_000):
                part = slice(at, at + 200_000)
                r = row[part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[part].astype(np.int64)), pa.array(cid[r]), pa.array((n[r] << 32) | room[part]),
                        pa.array(sign[r].astype(np.int64)),
                    ],
                    names=["key", "cid", "size", "sign"],
                )

    def side(which: str, s: str) -> DataFrame:
        hashed = classes.filter(f"{which} > 0 AND size(words) > 0").select(
            "cid", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.transform("names", lambda w: F.xxhash64(w)).alias("c")
        )
        return hashed.mapInArrow(keys, "key long, cid long, size long, sign long").select(
            "key", F.col("cid").alias(f"cid_{s}"), F.shiftright("size", 32).alias(f"n_{s}"),
            F.col("size").bitwiseAND(F.lit((1 << 32) - 1)).alias(f"room_{s}"), F.col("sign").alias(f"sign_{s}"),
        )

    need = F.ceil(F.lit(t) / (1 + t) * (F.col("n_e") + F.col("n_t")) - 1e-9)
    found = (
        side("n_eval", "e").join(side("n_train", "t"), "key")
        .filter(
            (F.col("cid_e") != F.col("cid_t"))
            & (F.least("n_e", "n_t") >= F.lit(t) * F.greatest("n_e", "n_t") - 1e-9)
            & (F.least("room_e", "room_t") >= need)
            & (F.bit_count(F.col("sign_e").bitwiseXOR(F.col("sign_t"))) <= F.col("n_e") + F.col("n_t") - 2 * need)
        )
        .select("cid_e", "cid_t")
        .distinct()
    )
    found = materialise(found)
    wanted = found.select(F.explode(F.array("cid_e", "cid_t")).alias("cid")).distinct()
    few = found.count() <= FEW_LINKS
    texts = classes.select("cid", "class", "words", "names").join(F.broadcast(wanted) if few else wanted, "cid", "left_semi")
    rare_words = lambda s: texts.select(
        F.col("cid").alias(f"cid_{s}"), F.col("class").alias(f"class_{s}"), F.col("words").alias(f"w_{s}"), F.col("names").alias(f"c_{s}")
    )
    pairs = found.join(rare_words("e"), "cid_e").join(rare_words("t"), "cid_t")
    common = F.size(F.array_intersect("w_e", "w_t"))
    close = pairs.withColumn("common", common).filter(F.col("common") >= F.lit(t) * (F.size("w_e") + F.size("w_t") - F.col("common")) - 1e-9)
    load = close.select("class_e", "class_t", "w_e", "w_t", "c_e", "c_t")

    def same_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conditions 2 and 3 of the definition, on the few pairs that are left."""
        for b in batches:
            keep = [agree(*map(set, r)) for r in zip(*(b.column(c).to_pylist() for c in ("w_e", "w_t", "n_e", "n_t", "c_e", "c_t")))]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("class_e").filter(mask), b.column("class_t").filter(mask)], names=["class_e", "class_t"])

    # which capitalised words of the pairs are rare: a look-up in the frequent words that the executors already have
    def with_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        many = frequent[counts > rare]
        for b in batches:
            cols = {c: b.column(c) for c in ("class_e", "class_t", "w_e", "w_t", "c_e", "c_t")}
            for s in "et":
                strings, hashed = b.column(f"c_{s}").to_pylist(), b.column(f"h_{s}").to_pylist()
                often = [np.isin(np.array(h, np.int64), many) for h in hashed]
                cols[f"n_{s}"] = pa.array([[w for w, x in zip(ws, o) if not x] for ws, o in zip(strings, often)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(cols)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from same_names(with_names(batches))

    load = load.withColumns({f"h_{s}": F.transform(f"c_{s}", lambda w: F.xxhash64(w)) for s in "et"})
    return load.mapInArrow(verify, "class_e binary, class_t binary")


def within_two_edits(a: str, b: str) -> bool:
    """Edit distance (insert, delete, replace) of at most two."""
    if abs(len(a) - len(b)) > 2:
        return False
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (x != y)))
        if min(now) > 2:
            return False
        before = now
    return before[-1] <= 2


def agree(w_e: set, w_t: set, names_e: set, names_t: set, caps_e: set, caps_t: set) -> bool:
    """Conditions 2 and 3: the named places and persons are the same."""
    only_e, only_t = w_e - w_t, w_t - w_e
    far = lambda caps, mine, other: any(not any(within_two_edits(a, b) for b in other) for a in caps & mine)
    if far(caps_e, only_e, only_t) and far(caps_t, only_t, only_e):
        return False
    return max(len(names_e), len(names_t)) < 2 or bool((names_e | names_t) & w_e & w_t)


def class_links(classes: DataFrame, threshold: float = THRESHOLD, rare_share: int | None = None) -> DataFrame:
    """(class_e, class_t), equal classes too, materialised."""
    near = class_pairs(classes, threshold, rare_share)
    same = classes.filter("n_train > 0 AND n_eval > 0").select(F.col("class").alias("class_e"), F.col("class").alias("class_t"))
    return materialise(near.unionByName(same))


def split_overlaps(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "prompt",
    split_col: str = "split",
    train: str = "train",
    threshold: float = THRESHOLD,
    rare_share: int | None = None,
) -> DataFrame:
    """(id_e, id_t): every evaluation record with every train record of the same or almost the same text.

    Every pair of records is a row, as p4_found asks; class_overlaps and memberships are the compact form.
    """
    records = _records(df, id_col, text_col, split_col, train)
    classes = _classes(records)
    links = class_links(classes, threshold, rare_share)
    total = classes.agg(F.coalesce(F.sum(F.col("n_train") + F.col("n_eval")), F.lit(0))).first()[0]
    hot = bounded_rows(
        classes.filter(F.greatest("n_train", "n_eval") > max(HOT_CLASS, total // 1000)).select("class"), 1000, "hot classes"
    )  # proven: each holds more than a thousandth of all records
    is_hot = (lambda c: F.col(c).isin([bytes(r[0]) for r in hot])) if hot else (lambda c: F.lit(False))
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int")
    members = records.select("id", "train", "class").distinct()
    rows = members.select("train", "id", "class", F.when(is_hot("class"), slot).otherwise(0).alias("slot"))
    every = lambda c: F.explode(F.when(is_hot(c), F.sequence(F.lit(0), F.lit(SLOTS - 1))).otherwise(F.array(F.lit(0))))
    of = lambda s: [F.col("class").alias(f"class_{s}"), F.col("slot").alias(f"slot_{s}"), F.col("id").alias(f"id_{s}")]
    ev, tr = rows.filter(~F.col("train")).select(*of("e")), rows.filter("train").select(*of("t"))
    one = links.withColumn("slot_e", every("class_e")).join(ev, ["class_e", "slot_e"])
    both = one.withColumn("slot_t", every("class_t")).join(tr, ["class_t", "slot_t"])
    return both.select("id_e", "id_t").distinct()


def memberships(df: DataFrame) -> DataFrame:
    """(id, class_id, in_train): every usable record with the smallest id of its class of equal word sets."""
    rows = _records(df, "id", "prompt", "split", "train").select("id", "class", "train").distinct()
    least = rows.groupBy("class").agg(F.min("id").alias("class_id"))
    return rows.join(least, "class").select("id", "class_id", F.col("train").alias("in_train"))


def class_overlaps(df: DataFrame) -> DataFrame:
    """(class_e, class_t, n_eval, n_train): pairs between class representatives (smallest ids), with their records.

    With memberships this says all that split_overlaps says, without a row for every pair of copies.
    """
    records = _records(df, "id", "prompt", "split", "train")
    links = class_links(_classes(records))
    of = records.select("id", "class", "train").distinct().groupBy("class").agg(
        F.min("id").alias("least"), F.count(F.when(F.col("train"), 1)).alias("n_train"), F.count(F.when(~F.col("train"), 1)).alias("n_eval")
    )
    e = of.select(F.col("class").alias("class_e"), F.col("least").alias("e"), "n_eval")
    t = of.select(F.col("class").alias("class_t"), F.col("least").alias("t"), "n_train")
    return links.join(e, "class_e").join(t, "class_t").select(F.col("e").alias("class_e"), F.col("t").alias("class_t"), "n_eval", "n_train")


def overlap_report(df: DataFrame) -> DataFrame:
    """Overlapping evaluation records and pairs per split and subset."""
    pairs = split_overlaps(df)
    of = df.select(F.col("id").alias("id_e"), "split", "subset").dropDuplicates(["id_e", "split"]).filter("split <> 'train'")
    return (
        pairs.join(of, "id_e")
        .groupBy("split", "subset")
        .agg(F.countDistinct("id_e").alias("n_records"), F.count("*").alias("n_pairs"))
    )


def p4_pairs(df: DataFrame) -> DataFrame:
    return split_overlaps(df).select(F.least("id_e", "id_t").alias("id_a"), F.greatest("id_e", "id_t").alias("id_b"))

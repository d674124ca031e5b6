"""Does a text lack its end? A stack automaton for structure and a boundary model for prose.

The boundary model is a classifier fitted on all texts (``fit_rows``; ``fit`` does the same with a list).
Every word of a text is a labelled row: it is followed by a sentence or line end, or by more of the
sentence. Counts of the last three, two and one words are interpolated, so an unterminated text is judged by how
often its last words end a sentence elsewhere; the rate at which whole texts of the source go without terminator
is the prior. A last word that is no word of the texts but the beginning of one is a cut inside a word.

Texts are taken apart once, into sentences with their numbers; words and their contexts are counted from these.
Counts are kept by 64-bit hashes of words and contexts, 24 bytes each, with a checked bound (``ENTRIES``).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_rows, ship, written

#: Words, or contexts of words, that one model may hold (24 bytes each); beyond, fitting raises.
ENTRIES = 8_000_000
#: Distinct texts, or parts of texts, that a task counts in memory before it hands them on.
HELD = 50_000

#: Marks that software appends to a text it has cut.
CUT_MARK = re.compile(
    r"(?:\s*(?:[\[(<{][^\[\](){}<>]{0,24}(?:truncat|cut|clos|limit|interrupt|abort|stopp|continu|more)[^\[\](){}<>]{0,24}[\])>}]"
    r"|\.{3,}|…|\ufffd+))+\s*$",
    re.IGNORECASE,
)
MARK_ENDS = ("]", ")", ">", "}", "...", "…", "\ufffd")
HARD_MARK = re.compile(r"[\[(<{][^\[\](){}<>]{0,24}(?:truncat|cut|clos|limit|interrupt|abort|stopp)|\ufffd", re.IGNORECASE)
STAND_IN = re.compile(r"\W*(?:(?:no|n/?a|null|none|nil|empty|blank|nan|undefined|tbd)(?:[ _-](?:answer|response|reply|output|text|content))?)?\W*", re.IGNORECASE)
EMPTY_MARKS = "\u200b\ufeff"
DECOR = re.compile(r"(?:\s*(?:[:;]-?[)(DPp]|[\U0001F000-\U0001FAFF\u2600-\u27BF\ufe0f]+|\(see (?:above|below)\)|[\"'“”»›’)*_`\]]+))+\s*$")
TERMINATED = re.compile(r"[.!?。！？]$")
TOKEN = re.compile(r"\S+")
STRUCT = re.compile(r'["\\{}\[\]]')
OBJECT = re.compile(r'\{\s*(?:"|\}|$)')
#: What follows an element of an array: its end, another element, or the end of the text.
GOES_ON = re.compile(r'\s*(?:\]|(?:,\s*)?$|,\s*(?:["{\[\d-]|true\b|false\b|null\b))')
LIST_MARK = re.compile(r"(?:^|\n)\s*(?:[-*•]|\d+[.)])$")
#: The last line or part of a list of named fields.
LAST_SEGMENT = re.compile(r"[^\n;|]*$")
FIELD = re.compile(r"\s*[^\W\d_][\w-]*(?: [\w-]+){0,2}\s*[:=]\s*\S")
PLAIN_END = frozenset(".!?")
LAST_NUMBER = re.compile(r"\n\s*\d+\.$")
ITEM = re.compile(r"(?:[-*•]|\d+[.)])$")
EDGE = "\"'“”„«»‹›()[]{}*_`.,;:!?¡¿…<>|#=~"

#: Native tests, for Spark: ends in a terminator; the same and has no structure worth a stack (the first test).
ENDS_SQL = r"[.!?。！？][\"'“”»›’)*_`\]]*\s*$"
WHOLE_SQL = r"(?s)^(?!(?:.*\n)?[ \t]*\d+\.[\"'”»)*_]*\s*$)[^`{(\[\"“„«<\\]*[^.\s`{…\n][.!?][\"'”»)*_]*\s*$"


#: Prose structures of the automaton: what opens them, what closes them, markup with an end tag, broken ends.
STRUCTURED = re.compile(r"[`{(\[\"“„«<\\]")
OPENERS = re.compile(r"[(\[\"“„«<]")
CLOSERS = {"(": ")", "[": "]", '"': '"', "“": "”", "„": "“", "«": "»"}
TAG = re.compile(r"<(/?)(p|b|i|u|em|strong|div|span|ul|ol|table|code|pre|a|h[1-6]|blockquote|body|html|answer|response)(?:\s[^<>]*)?>", re.IGNORECASE)
BROKEN_END = re.compile(r"(?:<[a-zA-Z/][^<>\s]*(?:\s[^<>]*)?|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|&#?\w{1,8})$")
PASSED_OVER = re.compile(r"```.*?```|`[^`\n]*`|[:;]-?[()\[\]]|\d\"", re.DOTALL)
SENTENCE = re.compile(r"[.!?]\s+(?=\S)|\n")


def json_scan(text: str) -> tuple[int, int]:
    """(state, where the last closed object or array ends).

    State 0: no object begins here, 1: all objects and the arrays around them close, 2: the text ends inside one.
    """
    state, pos = 0, 0
    while start := OBJECT.search(text, pos):
        first = start.start()
        outer = text[pos:first]
        stack = ["["] * outer[len(outer.rstrip("[ \t\r\n")) :].count("[")
        around = len(stack)  # brackets that may be of an array, or of prose
        in_string = False
        skip = -1
        end = -1
        for m in STRUCT.finditer(text, first):
            at, ch = m.start(), m.group()
            if at == skip:
                continue
            if in_string:
                if ch == "\\":
                    skip = at + 1
                elif ch == '"':
                    in_string = False
            elif ch == '"':
                in_string = True
            elif ch in "{[":
                stack.append(ch)
            elif ch in "}]":
                if stack and (stack[-1] == "{") == (ch == "}"):
                    stack.pop()
                if len(stack) <= around and (not stack or not GOES_ON.match(text, at + 1)):
                    end = at + 1  # all is closed, or the bracket before the object is no array's
                    break
        if end < 0:
            return 2, pos
        state, pos = 1, end
    return state, pos


def json_state(text: str) -> int:
    return json_scan(text)[0]


def left_open(text: str) -> bool:
    """Does the text end inside brackets or quotes of its last sentence, inside markup, or inside an escape?

    Code and emoticons are passed over; a closing bracket without an opening one ('a)') is no structure.
    """
    if BROKEN_END.search(text):
        return True
    if not OPENERS.search(text):
        return False
    text = PASSED_OVER.sub("", text)
    tags: list[str] = []
    for m in TAG.finditer(text):
        if not m.group(1):
            tags.append(m.group(2).lower())
        elif m.group(2).lower() in tags:
            del tags[len(tags) - 1 - tags[::-1].index(m.group(2).lower()) :]
    if tags:
        return True
    start = 0
    for m in SENTENCE.finditer(text):
        start = m.end()
    stack: list[str] = []
    for i in range(start, len(text)):
        ch = text[i]
        if stack and ch == stack[-1]:
            stack.pop()
        elif ch == '"':  # a straight quote opens only before a word; behind one it closes, if anything
            if (i == 0 or text[i - 1] in " \n(") and text[i + 1 : i + 2].strip():
                stack.append(ch)
        elif ch in CLOSERS:
            stack.append(CLOSERS[ch])
    return bool(stack)


def _key(raw: str) -> str:
    return re.sub(r"\d+", "0", raw.strip(EDGE).lower())


def cut_mark(text: str) -> re.Match | None:
    """CUT_MARK in a text without space at its end, searched for only where it could end in one."""
    return CUT_MARK.search(text) if text.endswith(MARK_ENDS) else None


#: Where a sentence or line ends before more text.
PART_END = re.compile(r"[.!?。！？][\"'”»)*_]*\s+|\n\s*")
DIGITS = re.compile(r"\d+")
#: Kinds of parts: sentences (plus OPEN without an end, plus UNCOUNTED where the last word may be cut), texts of few words and
#: the first words of others, ends of texts without terminator (plus 1 in one case only).
OPEN, UNCOUNTED, SHORT, HEAD, END = 2, 1, 4, 5, 6


def text_parts(text: str) -> Iterator[tuple[int, str]]:
    """(kind, words) of what a prose text says about boundaries; digits are levelled, as words of digits count as one."""
    if json_state(text):
        return
    text = text.rstrip()
    mark = cut_mark(text)
    text = DIGITS.sub("0", text[: mark.start()].rstrip() if mark else text)
    first = text.split(None, BoundaryModel.FEW_WORDS)
    if not first:
        return
    yield SHORT if len(first) <= BoundaryModel.FEW_WORDS else HEAD, " ".join(map(_key, first[: BoundaryModel.FEW_WORDS]))
    start = 0
    for m in PART_END.finditer(text):
        piece = " ".join(text[start : m.end()].split())
        if " " not in piece and "\n" not in m.group() and ITEM.match(piece):
            continue  # '2.' before an item ends no sentence
        if piece:
            yield 0, piece
        start = m.end()
    piece = " ".join(text[start:].split())
    whole = TERMINATED.search(piece)
    ends = TERMINATED.search(piece.rstrip("\"'”»)*_")) and (" " in piece or not ITEM.match(piece))
    yield (0 if ends else OPEN) + (0 if whole else UNCOUNTED), piece
    if not whole:
        yield END + (text == text.lower() or text == text.upper()), text.rsplit("\n", 1)[-1].strip()


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _mixed(*parts) -> np.ndarray:
    """One 64-bit hash for each row of several hashes."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):  # products wrap around
        for p in parts:
            h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
            h = h ^ (h >> np.uint64(29))
    return h


class Counts:
    """Two numbers for each 64-bit hash, in sorted arrays."""

    def __init__(self, keys=(), first=(), second=None) -> None:
        keys = np.asarray(keys, np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.first = np.asarray(first, float)[order]
        self.second = self.first if second is None else np.asarray(second, float)[order]

    def get(self, key) -> tuple[float, float]:
        at = int(self.keys.searchsorted(np.uint64(key)))
        return (float(self.first[at]), float(self.second[at])) if at < len(self.keys) and self.keys[at] == key else (0.0, 0.0)


def _summed(keys: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got, at = np.unique(keys, return_inverse=True)
    return got, np.bincount(at, first, len(got)), np.bincount(at, second, len(got))


class BoundaryModel:
    MIN_WORD = 5
    #: A word of at most this share of all words (or of RARE_TIMES) may be the beginning of a far more frequent one.
    RARE, RARE_TIMES = 8e-6, 2
    #: Where the text ends inside a word; no habit of its source speaks against that.
    IN_WORD = 0.02
    #: Beginnings are kept up to so many characters, so that one endless word cannot fill the memory.
    LONGEST_WORD = 40
    #: Texts of so few words are whole where the texts that begin like them mostly end there too.
    FEW_WORDS, TIMES = 4, 3
    #: Fields ('Tone: kind') end without terminator; their words must speak clearly for a cut.
    FIELD_END = 0.1

    def __init__(self, prior: float = 0.5) -> None:
        self.prior = prior
        self.words = Counts()
        self.rare = float(self.RARE_TIMES)
        self.prefixes = Counts()
        self.grams = Counts()
        self.common: set[str] = set()
        self.short: dict[tuple, int] = {}
        self.begins: dict[tuple, int] = {}

    # -- fitting -----------------------------------------------------------------------------------------------
    def fit(self, texts: list[str]) -> "BoundaryModel":
        parts: Counter = Counter()
        for text in texts:
            parts.update(text_parts(text or ""))
        words = word_counts((k, t, n) for (k, t), n in parts.items() if k < SHORT)
        prefixes = prefix_counts(words.items())
        self.set_words(words.items(), prefixes.items(), [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:60]])
        self.set_short(((t, n) for (k, t), n in parts.items() if k == SHORT and n >= self.TIMES), ((t, n) for (k, t), n in parts.items() if k in (SHORT, HEAD)))
        keys, c, b = _summed(*self.gram_counts([(k, t, n) for (k, t), n in parts.items() if k < SHORT]))
        seen = (c + b >= 1.5) | (keys & np.uint64(1)).astype(bool)
        self.grams = Counts(keys[seen], c[seen], b[seen])
        ends = [(k, t, n) for (k, t), n in parts.items() if k >= END]
        self.set_prior(self.whole_ends(ends), sum(n for _, _, n in ends))
        return self

    def fit_rows(self, texts: DataFrame) -> "BoundaryModel":
        """The same over all rows of a column t of texts, none of which come to the driver; only counts do."""
        spark = texts.sparkSession

        def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: Counter = Counter()
            parts: Counter = Counter()

            def rows():
                got = pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in parts], pa.int32()), pa.array([t for _, t in parts], pa.string()), pa.array(list(parts.values()), pa.int64())], names=["kind", "part", "n"]
                )
                parts.clear()
                return got

            def spread():
                for t, n in held.items():
                    for p in text_parts(t):
                        parts[p] += n
                held.clear()

            for b in batches:
                held.update(b.column(0).to_pylist())
                if len(held) > HELD:
                    spread()
                if len(parts) > HELD:
                    yield rows()
            spread()
            yield rows()

        prose = texts.filter(F.col("t").rlike(r"\S"))
        parts = written(prose.select("t").mapInArrow(take_apart, "kind int, part string, n long").groupBy("kind", "part").agg(F.sum("n").alias("n")))
        sentences = parts.filter(F.col("kind") < SHORT)

        def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: Counter = Counter()
            for b in batches:
                held.update(word_counts(zip(*(c.to_pylist() for c in b.columns))))
                if len(held) > HELD:
                    yield _word_rows(held)
                    held.clear()
            yield _word_rows(held)

        words = written(sentences.mapInArrow(count_words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))

        def count_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _word_rows(prefix_counts(zip(*(c.to_pylist() for c in b.columns))))

        prefixes = words.mapInArrow(count_prefixes, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
        common = [r.w for r in words.orderBy(F.desc("n"), "w").limit(60).collect()]
        self.set_words(bounded_rows(words, ENTRIES // 8, "words"), bounded_rows(prefixes, ENTRIES // 8, "beginnings of words"), common)
        heads = parts.filter(F.col("kind").isin(SHORT, HEAD))
        short = heads.filter((F.col("kind") == SHORT) & (F.col("n") >= self.TIMES))
        few = bounded_rows(short.select("part", "n"), ENTRIES // 80, "repeated texts of few words")
        wanted = spark.sparkContext.broadcast({r.part for r in few})

        def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held: Counter = Counter()
                for head, n in zip(*(c.to_pylist() for c in b.columns)):
                    for p in _openings(head):
                        if p in wanted.value:
                            held[p] += n
                yield _word_rows(held)

        begun = heads.select("part", "n").mapInArrow(starts, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()  # at most as many as few
        self.short = {tuple(r.part.split(" ")): r.n for r in few}
        self.begins = {tuple(r.w.split(" ")): r.n for r in begun}
        load = ship(spark, self)

        def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            held: list = []
            size = 0
            for b in batches:
                held.append(_summed(*model.gram_counts(list(zip(*(c.to_pylist() for c in b.columns))))))
                size += len(held[-1][0])
                if size > 40 * HELD:
                    held = [_summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size > 20 * HELD:
                        yield _gram_rows(held.pop())
                        size = 0
            if held:
                yield _gram_rows(_summed(*map(np.concatenate, zip(*held))))

        grams = sentences.mapInArrow(count_grams, "g long, c double, b double").groupBy("g").agg(F.sum("c").alias("c"), F.sum("b").alias("b"))
        got = grams.filter((F.col("c") + F.col("b") >= 1.5) | (F.col("g") % 2 != 0)).limit(ENTRIES + 1).toArrow()
        if got.num_rows > ENTRIES:
            raise ValueError(f"contexts of words: more than {ENTRIES}, which is beyond the size proven safe for the driver")
        self.grams = Counts(got["g"].to_numpy().view(np.uint64), got["c"].to_numpy(), got["b"].to_numpy())
        fitted = ship(spark, self)

        def judge_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = fitted()
            for b in batches:
                rows = list(zip(*(c.to_pylist() for c in b.columns)))
                yield pa.RecordBatch.from_pydict({"whole": [model.whole_ends(rows)], "n": [sum(n for _, _, n in rows)]}, schema=pa.schema([("whole", pa.int64()), ("n", pa.int64())]))

        ends = parts.filter(F.col("kind") >= END).mapInArrow(judge_ends, "whole long, n long").agg(F.sum("whole"), F.sum("n")).first()
        self.set_prior(ends[0] or 0, ends[1] or 0)
        return self

    def set_words(self, words: Iterable[tuple], prefixes: Iterable[tuple], common: list[str]) -> None:
        for name, rows in (("words", words), ("prefixes", prefixes)):
            rows = list(rows)
            setattr(self, name, Counts(np.array([_word_hash(w) for w, _ in rows], np.uint64), [n for _, n in rows]))
        self.rare = max(self.RARE_TIMES, self.RARE * self.words.first.sum())
        self.common = {*common, "<s>"}

    def set_short(self, short: Iterable[tuple], heads: Iterable[tuple]) -> None:
        self.short = {tuple(t.split(" ")): n for t, n in short}
        begins: Counter = Counter()
        for t, n in heads:
            for p in _openings(t):
                begins[tuple(p.split(" "))] += n
        self.begins = {k: begins[k] for k in self.short}

    def set_prior(self, whole: int, ends: int) -> None:
        """The texts' own baseline: how many of those without terminator are whole all the same."""
        self.prior = min(0.8, max(0.2, (whole + 1) / (ends + 2)))

    def whole_ends(self, ends: list[tuple[int, str, int]]) -> int:
        return sum(n for k, line, n in ends if self.p_end(line, k > END) > 0.5)

    def gram_counts(self, sentences: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, times before more of the sentence, times before its end), not summed, of every word."""
        seen: dict[str, tuple[int, int]] = {}
        shapes, classes, item, length, weight, is_open = [], [], [], [], [], []
        for kind, text, n in sentences:
            words = text.split(" ")
            for w in words:
                got = seen.get(w)
                if got is None:
                    got = seen[w] = self.shape_hashes(self.shape(w))
                shapes.append(got[0])
                classes.append(got[1])
            item.append(bool(ITEM.match(words[0])))
            length.append(len(words))
            weight.append(n)
            is_open.append(kind >= OPEN)
        if not shapes:
            return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        length = np.array(length)
        kinds = np.repeat(np.where(item, *(np.uint64(_word_hash(k)) for k in ("<item>", "<text>"))), length)
        last = np.cumsum(length) - 1
        place = np.arange(last[-1] + 1) - np.repeat(last + 1 - length, length)
        start = np.uint64(_word_hash("<s>"))
        views = []
        for column in (shapes, classes):
            column = np.array(column, np.uint64)
            views.append([column] + [np.where(place >= k, np.roll(column, k), start) for k in (1, 2)])
        end = np.zeros(len(kinds))
        end[last] = np.array(weight) * np.where(is_open, 0.5, 1.0)  # an open end may be cut right here
        more = np.repeat(np.array(weight, float), length)
        more[last] = 0
        keys = self.contexts(kinds, *views[0], *views[1][1:])
        return np.concatenate(keys), np.tile(more, len(keys)), np.tile(end, len(keys))

    def shape_hashes(self, shape: str) -> tuple[int, int]:
        """Of a shape and of its class: a frequent word itself or <x>."""
        h = _word_hash(shape)
        return h, h if shape in self.common else _word_hash("<x>")

    @staticmethod
    def contexts(kind, last, before, second, before_class, second_class) -> list[np.ndarray]:
        """From the least to the most specific, as hashes; that of the last word alone is odd, the others are even."""
        one, even = np.uint64(1), ~np.uint64(1)
        rest = (
            (kind, before), (kind, before_class, last), (kind, before, last), (kind, second_class, before, last), (kind, second, before, last),
        )
        return [_mixed(np.uint64(1), kind, last) | one] + [_mixed(np.uint64(i), *g) & even for i, g in enumerate(rest, 2)]

    def shape(self, raw: str, one_case: bool = False) -> str:
        key = _key(raw)
        if not key or self.words.get(_word_hash(key))[0] >= self.MIN_WORD:
            return key or raw
        core = raw.strip(EDGE)
        return "<C>" if core[:1].isupper() or (one_case and core[:1].isalpha()) else "<0>" if core[:1].isdigit() else "<w>"

    # -- judging -----------------------------------------------------------------------------------------------
    def partial_word(self, raw: str) -> bool:
        key = _key(raw)
        if not key or not key[-1].isalpha():
            return False
        known, longer = self.words.get(_word_hash(key))[0], self.prefixes.get(_word_hash(key))[0]
        return (known == 0 and longer >= 1) or (known <= self.rare and longer > 25 * known)

    def known_whole(self, stem: str) -> bool:
        """A few words that many texts consist of, and that seldom go on."""
        tokens = TOKEN.findall(stem[:400])
        keys = tuple(map(_key, tokens))
        return len(tokens) <= self.FEW_WORDS and 2 * self.short.get(keys, 0) >= self.begins.get(keys, 1)

    def p_end(self, stem: str, one_case: bool | None = None) -> float:
        """Probability that the last word of a stem without terminator ends a sentence or item.

        ``one_case``: that all of the text is, where the stem is its last line only.
        """
        line = stem.rsplit("\n", 1)[-1].strip()
        head = re.match(r"(?:[-*•]|\d+[.)])\s+", line)
        sentences = re.split(r"(?<=[.!?])\s+", line[head.end() :] if head else line)
        tokens = TOKEN.findall(sentences[-1])
        if head and len(sentences) == 1:
            tokens.insert(0, head.group().strip())
        if not tokens:
            return 1.0
        if self.partial_word(tokens[-1]):
            return self.IN_WORD
        if one_case is None:
            one_case = stem == stem.lower() or stem == stem.upper()
        shapes = ["<s>", "<s>", *(self.shape(t, one_case) for t in tokens[-3:])][-3:]
        (second, second_class), (before, before_class), (last, _) = (map(np.uint64, self.shape_hashes(x)) for x in shapes)
        kind = np.uint64(_word_hash("<item>" if ITEM.match(tokens[0]) else "<text>"))
        p = self.prior
        for g in self.contexts(kind, last, before, second, before_class, second_class):
            c, b = self.grams.get(g)
            p = (b + p * 1.5) / (b + c + 1.5)
        return p

    def source_prior(self, rate: float, pooled: float) -> float:
        """The prior of a source of which so many texts end without terminator, where all sources together have pooled.

        Sources are taken to be cut alike (pooled x (1 - prior) of all texts); what a source omits beyond that is habit.
        """
        return min(0.95, max(0.05, 1 - pooled * (1 - self.prior) / rate)) if rate > 0 else self.prior

    def is_cut(self, text: str | None, prior: float | None = None) -> bool:
        """``prior``: that of the text's source, in place of that of all texts."""
        if text is None:
            return False
        text = text.rstrip()
        if text[-1:] in PLAIN_END and text[-2:-1].isalnum() and not STRUCTURED.search(text):
            if not LAST_NUMBER.search(text, max(0, len(text) - 8)):
                return False  # the common case, without any scan of the text
        if not text.strip(EMPTY_MARKS) or STAND_IN.fullmatch(text):
            return False
        mark = cut_mark(text)
        stem = text[: mark.start()].rstrip() if mark else text
        hard = bool(mark and HARD_MARK.search(mark.group()))
        if not stem:
            return False
        state, end = json_scan(stem)
        rest = stem[end:].lstrip()  # prose after the last closed object
        if state == 1 and not re.search(r"\w", rest):
            return rest.endswith(",")
        if state == 2 or (stem.startswith("{") and "}" not in stem):
            return True
        if stem.count("```") % 2:
            return True
        if stem.endswith("```"):
            return False
        if left_open(rest):
            return True
        bare = DECOR.sub("", rest).rstrip() or rest
        if LIST_MARK.search(bare):
            return True
        if TERMINATED.search(bare):
            return False
        if stem.endswith("\ufffd") or (mark and "\ufffd" in mark.group()):
            return True
        if bare[-1] in ",;:(-–—/&" or (bare[-1] == "[" or bare.endswith("\\")):
            return True
        if not mark and self.known_whole(bare):
            return False
        p = self.p_end(bare)
        if not mark and p > self.FIELD_END and FIELD.match(LAST_SEGMENT.search(bare).group()):
            return False
        if prior is not None and p > self.IN_WORD:
            shift = prior * (1 - self.prior) / (self.prior * (1 - prior))
            p = p * shift / (p * shift + 1 - p)
        return p < (0.9 if hard else 0.5)


def word_counts(sentences: Iterable[tuple[int, str, int]]) -> Counter:
    """How often each word occurs, but for last words that may be cut."""
    raw: Counter = Counter()
    for kind, text, n in sentences:
        words = text.split(" ")
        for w in words[: len(words) - (kind & UNCOUNTED)]:
            raw[w] += n
    out: Counter = Counter()
    for w, n in raw.items():
        out[_key(w)] += n
    return out


def prefix_counts(words: Iterable[tuple[str, int]]) -> Counter:
    out: Counter = Counter()
    for w, n in words:
        for i in range(1, min(len(w), BoundaryModel.LONGEST_WORD)):
            out[w[:i]] += n
    return out


def _openings(head: str) -> list[str]:
    keys = head.split(" ")
    return [" ".join(keys[:i]) for i in range(1, len(keys) + 1)]


def _word_rows(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])


def _gram_rows(counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    keys, c, b = counts
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c), pa.array(b)], names=["g", "c", "b"])

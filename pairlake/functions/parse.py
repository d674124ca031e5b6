"""Parsing expressions: answers, numbers, JSON in prose, yes/no, hashes. Built-in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cues of a final answer, in order of priority, and the shape of a number.
ANSWER_CUES = (
    r"####\s*(-?[\d,]*\.?\d+)",
    r"(?i)answer is[:\s]*\$?\\?(?:boxed\{)?\s*(-?[\d,]*\.?\d+)",
    r"\\boxed\{\s*\$?(-?[\d,]*\.?\d+)",
)
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"


def hash32(c: Column) -> Column:
    """First 32 bits of md5 as a long; the same number in any engine."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def request_key(fields: dict[str, Column]) -> Column:
    """sha256 of the whole request as JSON with sorted keys: nulls are kept, so no two requests run into one another."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def last_match(c: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def plain_number(c: Column) -> Column:
    """A number without separators, dollar signs and trailing dots; integral values without decimals."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"[,$]", ""), r"\.+$", "")
    d = F.try_cast(s, "double") if hasattr(F, "try_cast") else s.try_cast("double")
    return F.when(d.isNotNull() & (d == F.floor(d)), F.floor(d).cast("long").cast("string")).otherwise(
        F.when(d.isNotNull(), d.cast("string")).otherwise(s)
    )


def final_number(c: Column) -> Column:
    """The last match of the first cue that matches, else the last number, else null."""
    cues = [last_match(c, p, 1) for p in ANSWER_CUES]
    return plain_number(F.coalesce(*cues, last_match(c, NUMBER, 0)))


def gold_number(c: Column) -> Column:
    """What follows #### at the end of a solution; null where there is none."""
    got = F.regexp_extract(F.regexp_replace(c, r"\s+$", ""), r"####\s*(.+)$", 1)
    return F.when(got != "", plain_number(got))


def same_number(a: Column, b: Column) -> Column:
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(a.isNull(), False).when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < 1e-6).otherwise(a == b)


def json_object(c: Column) -> Column:
    """The first JSON object of a text as a string: each fenced block, then the whole; outermost braces; else null."""
    blocks = F.concat(F.regexp_extract_all(c, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1)), F.array(c))
    outer = F.transform(blocks, lambda b: F.regexp_extract(b, r"(?s)(\{.*\})", 1))
    good = F.filter(outer, lambda o: (o != "") & F.expr("true") & F.try_parse_json(o).isNotNull())
    return F.when(F.size(good) > 0, F.element_at(good, 1))


def yes_no(c: Column) -> Column:
    """A leading yes or no, null if absent or if both occur."""
    lead = F.lower(F.regexp_extract(c, r"(?i)^\s*(yes|no)\b", 1))
    every = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\b(yes|no)\b"), F.lit(1)))
    return F.when((lead != "") & (F.size(every) == 1), lead)

"""Text expressions on columns; all are built-in Spark expressions, so they stay inside codegen.

Null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named fields: "key": "value" of a JSON object.
JSON_FIELD = r'(?U)"([^"\\]{1,60})"\s*:\s*("(?:[^"\\]|\\.)*"|[^,{}\[\]"]+)'
#: A segment that starts with a field name of one to three words.
FIELD_SEGMENT = r"(?U)^[^\p{L}\p{N}]*\p{L}[\p{L}\p{N}_-]*(?: \p{L}[\p{L}\p{N}_-]*){0,2}\s*[:=]\s*\S"


def strip(c: Column) -> Column:
    """Remove all white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold(c: Column) -> Column:
    """Lower case, with the sharp s as two letters so that upper-cased copies fold alike."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def letters_digits(c: Column) -> Column:
    """Case-folded text without any mark that is neither letter nor digit (white space included)."""
    return F.regexp_replace(fold(c), r"[^\p{L}\p{M}\p{N}]+", "")


def words(c: Column) -> Column:
    """Array of case-folded words (runs of letters and digits); an empty text has none."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def normalize(c: Column) -> Column:
    """Lower, delete what is neither word character nor white space, collapse white space, trim."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0)))


def canonical_record(c: Column) -> Column:
    """One key for all copies of a record that differ in white space, letter case, punctuation or field order.

    Running text becomes its letters and digits. A record of named fields (a JSON object of scalars, or
    "Name: value" segments parted by line breaks, semicolons or bars, at least two and nothing else)
    becomes its sorted fields, each as letters and digits. Empty and punctuation-only texts become ''.
    """
    t = strip(c)
    is_json = t.rlike(r"(?s)^[^\p{L}\p{N}]*\{.*\}[^\p{L}\p{N}]*$")
    json_parts = F.transform(
        F.regexp_extract_all(t, F.lit(JSON_FIELD), F.lit(0)), lambda x: letters_digits(x)
    )
    segments = F.filter(F.split(t, r"(?U)\s*[;\n\r|]+\s*"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    is_fields = (F.size(segments) >= 2) & F.forall(segments, lambda x: x.rlike(FIELD_SEGMENT))
    line_parts = F.transform(segments, lambda x: letters_digits(x))
    whole = letters_digits(t)
    joined = F.array_join(F.array_sort(json_parts), "\u0001")
    # the fields must carry every letter and digit of the text, else it is running text
    complete = F.length(F.replace(joined, F.lit("\u0001"), F.lit(""))) == F.length(whole)
    return (
        F.when(is_json & (F.size(json_parts) >= 2) & complete, joined)
        .when(is_fields, F.array_join(F.array_sort(line_parts), "\u0001"))
        .otherwise(whole)
    )

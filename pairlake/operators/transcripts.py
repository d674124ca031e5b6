"""Dialogue transcripts: split at the last reply, accept single-turn pairs only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

HUMAN, ASSISTANT = "\n\nHuman:", "\n\nAssistant:"


def occurrences(c: Column, marker: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(marker), F.lit("")))) / len(marker)).cast("int")


def split_last_reply(c: Column) -> tuple[Column, Column]:
    """(prefix, reply) around the last assistant marker; the reply is stripped."""
    tail = F.substring_index(c, ASSISTANT, -1)
    return F.substring(c, F.lit(1), F.length(c) - F.length(tail) - len(ASSISTANT)), strip(tail)


def single_turn(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """prompt, chosen and rejected replies of pairs with one human and one assistant turn and a common prefix."""
    prefix, good = split_last_reply(F.col(chosen))
    other, bad = split_last_reply(F.col(rejected))
    rows = df.withColumns({"__p": prefix, "__c": good, "__o": other, "__r": bad})
    prompt = strip(F.substring(F.col("__p"), F.lit(len(HUMAN) + 1), F.length("__p")))
    return rows.filter(
        (occurrences(F.col(chosen), HUMAN) == 1) & (occurrences(F.col(chosen), ASSISTANT) == 1)
        & F.col(rejected).contains(ASSISTANT) & (F.col("__p") == F.col("__o")) & (F.col("__c") != "") & (F.col("__r") != "")
        & (F.col("__c") != F.col("__r")) & F.col("__p").startswith(HUMAN) & (prompt != "")
    ).select(*[c for c in df.columns if c not in (chosen, rejected)], prompt.alias("prompt"), F.col("__c").alias("chosen"), F.col("__r").alias("rejected"))

"""The judging protocol as DataFrame steps around a pluggable model: single judge, two-round panel, re-asking, resumable work.

A model is any object with ``chat(request: dict) -> dict`` (text, finish_reason, prompt_tokens, completion_tokens) that can be
shipped to the executors. Requests are rows; calls run over Arrow batches where the rows are. Nothing here is a real model.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import hash32, json_object
from ..runtime import materialise
from .judging import coerced_score

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RATIONALE = 1_000  # fixed value: characters that are kept of a rationale


class Retryable(Exception):
    """A failure that may pass: limits, time-outs, lost connections, server errors."""


class NoJsonMode(Exception):
    """The model cannot be held to JSON; it is asked again without."""


class Model(Protocol):
    def chat(self, request: dict) -> dict: ...


class FirstShown:
    """A model without any taste: it always prefers what it is shown first. A baseline for position bias, and for dry runs."""

    def __init__(self, criteria: list[str]) -> None:
        self.criteria = criteria

    def chat(self, request: dict) -> dict:
        letters: list[str] = []
        for letter in re.findall(r"(?m)^Response ([A-Z]):$", request["user"]):
            if letter == LETTERS[len(letters)]:
                letters.append(letter)
        scores = {a: dict.fromkeys(self.criteria, 1 if i else 5) for i, a in enumerate(letters)}
        reply = {"scores": scores, "best": letters[0] if letters else None, "worst": letters[-1] if letters else None, "rationale": ""}
        return {"text": json.dumps(reply), "finish_reason": "stop", "prompt_tokens": len(request["user"]) // 4, "completion_tokens": 1}


def ask(model: Model, request: dict, tries: int = 4, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One answer: waits double after each passing failure, the last one is raised; without JSON mode where there is none."""
    for i in range(tries):
        try:
            return model.chat(request)
        except NoJsonMode:
            request = {**request, "json_mode": False}
        except Retryable:
            if i == tries - 1:
                raise
            sleep(wait * 2**i)
    return model.chat(request)


def answers(requests: DataFrame, model: Model, keep: list[str], tries: int = 4, wait: float = 1.0) -> DataFrame:
    """keep + text, finish_reason, prompt_tokens, completion_tokens, error: one row per request, in the request's partition.

    ``requests`` has a column ``request`` (JSON). A request that fails for good gets its error and no text; the others go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for text in b.column(b.num_columns - 1).to_pylist():
                try:
                    r = ask(model, json.loads(text), tries, wait)
                    got.append((r.get("text"), r.get("finish_reason"), r.get("prompt_tokens"), r.get("completion_tokens"), None))
                except Exception as e:  # noqa: BLE001 - the item stays undone, with its reason
                    got.append((None, None, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*got)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=[*keep, "text", "finish_reason", "prompt_tokens", "completion_tokens", "error"])

    narrow = requests.select(*keep, "request")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{schema}, text string, finish_reason string, prompt_tokens long, completion_tokens long, error string")


def shuffled_labels(n: Column, key: Column, seed: int = 1234) -> Column:
    """The order in which a call shows n candidates: their indices by a hash of (seed, key, index)."""
    of = lambda i: F.struct(hash32(F.concat_ws("|", F.lit(str(seed)), key, i.cast("string"))).alias("h"), i.cast("int").alias("i"))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.transform(every, of))["i"]


def generation_plan(prompts: DataFrame, personas: list[str], source: str, system: str) -> DataFrame:
    """(prompt_id, source, cand, request): one request per prompt and persona, whose text is put behind the system text."""
    who = F.posexplode(F.array(*[F.lit(p) for p in personas])).alias("cand", "persona")
    rows = prompts.select(F.col("id").alias("prompt_id"), "prompt", who)
    request = F.to_json(F.struct(F.concat_ws("\n\n", F.lit(system), F.when(F.col("persona") != "", F.col("persona"))).alias("system"), F.col("prompt").alias("user"), F.lit(False).alias("json_mode")))
    return rows.select("prompt_id", F.lit(source).alias("source"), "cand", request.alias("request"))


def shown(texts: Column, permutation: Column) -> Column:
    """Candidates as a call shows them, under letters in the call's order."""
    part = lambda p, i: F.concat(F.lit("Response "), F.char(F.lit(65) + i), F.lit(":\n"), F.get(texts, p))
    return F.array_join(F.transform(permutation, part), "\n\n")


def relabel(permutation: Column, cand: Column) -> Column:
    """The letter of a candidate in a call; null if it was not shown."""
    at = F.array_position(permutation, cand)
    return F.when(at > 0, F.char(F.lit(64) + at))


def parsed_verdicts(replies: DataFrame, criteria: list[str], low: int = 1, high: int = 5) -> DataFrame:
    """Adds valid, scores (array of maps by candidate), best, worst, rationale to replies with text and permutation.

    Valid: a JSON object whose scores cover exactly the shown letters with whole numbers in range for every criterion (digits
    in quotes and whole decimals count), and a best and a worst letter that differ.
    """
    o = F.from_json(json_object(F.col("text")), "best string, worst string, rationale string, scores map<string,map<string,string>>")
    n = F.size("permutation")
    r = replies.withColumn("__o", o)
    letters = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.char(F.lit(65) + i))
    score = lambda m, c: coerced_score(F.try_element_at(m, F.lit(c)))
    per = lambda letter: F.try_element_at(F.col("__o.scores"), letter)
    fits = F.forall(letters, lambda a: per(a).isNotNull() & F.reduce(F.array(*[score(per(a), c).between(low, high) for c in criteria]), F.lit(True), lambda x, y: x & F.coalesce(y, F.lit(False))))
    at = lambda f: F.array_position(letters, F.col(f"__o.{f}")).cast("int")
    ok = (n > 0) & (F.size("__o.scores") == n) & fits & (at("best") > 0) & (at("worst") > 0) & (F.col("__o.best") != F.col("__o.worst"))
    # position of candidate i in the permutation gives its letter
    cand_scores = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.map_from_arrays(
        F.array(*[F.lit(c) for c in criteria]), F.array(*[score(per(F.char(F.lit(64) + F.array_position("permutation", i))), c) for c in criteria])))
    ok = F.coalesce(ok, F.lit(False))
    return r.select(
        *replies.columns, ok.alias("valid"), F.when(ok, cand_scores).alias("scores"),
        F.when(ok, F.element_at("permutation", F.when(ok, at("best")))).alias("best"), F.when(ok, F.element_at("permutation", F.when(ok, at("worst")))).alias("worst"),
        F.left(F.coalesce("__o.rationale", F.lit("")), F.lit(RATIONALE)).alias("rationale"),
    )


CALL = ["prompt_id", "judge", "round", "sample_idx", "key", "permutation"]


def calls(plan: DataFrame, model: Model, criteria: list[str], retries: int = 2) -> DataFrame:
    """Verdicts of planned calls (CALL, user): asked again with the attempt in the request while no valid verdict comes.

    (CALL, scores, best, worst, rationale, attempts, valid, error); attempts is 1 + the asks in vain, at most 1 + retries.
    """
    todo, done = plan, None
    for attempt in range(1 + retries):
        request = F.to_json(F.struct(F.col("judge").alias("model"), F.col("user"), F.lit(True).alias("json_mode"), "sample_idx", F.lit(attempt).alias("attempt"), F.concat_ws(":", F.lit("judge"), F.concat(F.lit("r"), F.col("round").cast("string")), "key").alias("tag")))
        got = parsed_verdicts(answers(todo.withColumn("request", request), model, [*CALL, "user"]), criteria).withColumn("attempts", F.lit(attempt + 1))
        got = materialise(got)
        last = attempt == retries
        part = got if last else got.filter("valid")
        done = part if done is None else done.unionByName(part)
        todo = got.filter("NOT valid").select(*CALL, "user")
        if last or todo.limit(1).count() == 0:
            break
    return done.select(*CALL, "scores", "best", "worst", "rationale", "attempts", "valid", "error")


def single_judge(items: DataFrame, model: Model, judge: str, samples: int, criteria: list[str], retries: int = 2, seed: int = 1234) -> DataFrame:
    """One judge, several samples, all final. items: prompt_id, prompt, texts (array of candidates)."""
    plan = items.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_idx")).withColumns({"judge": F.lit(judge), "round": F.lit(1)})
    plan = plan.withColumn("key", F.concat_ws("|", "prompt_id", F.lit("single"), F.col("sample_idx").cast("string")))
    return calls(_rendered(plan, seed), model, criteria, retries).withColumn("final", F.col("valid"))


def _rendered(plan: DataFrame, seed: int, views: Column | None = None) -> DataFrame:
    p = plan.withColumn("permutation", shuffled_labels(F.size("texts"), F.col("key"), seed))
    user = F.concat_ws("\n\n", F.trim("prompt"), shown(F.col("texts"), F.col("permutation")), *([views] if views is not None else []))
    return p.withColumn("user", user).select(*CALL, "user")


def peer_view(permutation: Column, k: Column, own: Column, v: Column) -> Column:
    """One peer's verdict in the letters of this call: its number, whether it is one's own, totals, best, worst, rationale."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda a, x: a + x)
    scores = F.array_join(F.transform(permutation, lambda p: F.concat(relabel(permutation, p), F.lit("="), total(F.get(v["scores"], p)).cast("string"))), " ")
    return F.concat(
        F.lit("Judge "), k.cast("string"), F.when(own, " (you)").otherwise(""), F.lit(": "), scores, F.lit("; best "), relabel(permutation, v["best"]),
        F.lit(", worst "), relabel(permutation, v["worst"]), F.when(v["rationale"] != "", F.concat(F.lit("\n"), v["rationale"])).otherwise(""),
    )


def panel(items: DataFrame, model: Model, judges: list[str], criteria: list[str], retries: int = 2, devils_advocate: bool = True, seed: int = 1234) -> DataFrame:
    """Two rounds: each judge alone, then each judge seeing all valid verdicts of round one; only round two is final.

    An item without a valid verdict in round one has no round two. The first judge of round two also gets the candidate with
    the lowest mean score as the one to speak up for. An item's verdicts are as many as its judges, so arrays of them are short.
    """
    who = F.posexplode(F.array(*[F.lit(j) for j in judges])).alias("seat", "judge")
    plan = items.select("*", who).withColumns({"round": F.lit(1), "sample_idx": F.lit(0)})
    key = lambda r: F.concat_ws("|", "prompt_id", F.lit("panel"), F.lit(r), F.col("seat").cast("string"))
    first = materialise(calls(_rendered(plan.withColumn("key", key("r1")), seed), model, criteria, retries))
    seat = F.element_at(F.split("key", r"\|"), -1).cast("int")
    v = F.struct(seat.alias("seat"), F.struct("judge", "scores", "best", "worst", "rationale").alias("v"))  # maps have no order, seats do
    peers = first.filter("valid").groupBy("prompt_id").agg(F.array_sort(F.collect_list(v), lambda x, y: x["seat"] - y["seat"])["v"].alias("peers"))
    second = plan.join(peers, "prompt_id").withColumns({"round": F.lit(2), "key": key("r2")})
    second = second.withColumn("permutation", shuffled_labels(F.size("texts"), F.col("key"), seed))
    views = F.array_join(F.transform(F.col("peers"), lambda v, k: peer_view(F.col("permutation"), k + 1, v["judge"] == F.col("judge"), v)), "\n\n")
    mean_of = lambda i: F.aggregate("peers", F.lit(0.0), lambda a, v: a + F.aggregate(F.map_values(F.get(v["scores"], i)), F.lit(0), lambda s, x: s + x))
    lowest = F.array_min(F.transform(F.sequence(F.lit(0), F.size("texts") - 1), lambda i: F.struct(mean_of(i).alias("m"), i.alias("i"))))["i"]
    advocate = F.when(F.lit(devils_advocate) & (F.col("seat") == 0), F.concat(F.lit("Speak up for response "), relabel(F.col("permutation"), lowest.cast("int")), F.lit(" first.")))
    user = F.concat_ws("\n\n", F.trim("prompt"), shown(F.col("texts"), F.col("permutation")), views, advocate)
    last = calls(second.withColumn("user", user).select(*CALL, "user"), model, criteria, retries)
    return first.withColumn("final", F.lit(False)).unionByName(last.withColumn("final", F.col("valid")))


#: Judging methods by their names in a plan.
METHODS: dict[str, Callable[..., DataFrame]] = {"single_judge": single_judge, "panel": panel}


def results(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """(prompt_id, n_candidates, n_calls, failed_calls, n_final): every item, also one without any valid verdict."""
    one = lambda c: F.count(F.when(c, 1))
    per = verdicts.groupBy("prompt_id").agg(one(F.col("valid")).alias("n_calls"), one(~F.col("valid")).alias("failed_calls"), one(F.col("final")).alias("n_final"))
    every = items.select("prompt_id", F.size("texts").alias("n_candidates"))
    return every.join(per, "prompt_id", "left").fillna(0, ["n_calls", "failed_calls", "n_final"])


def peer_summary(verdicts: DataFrame) -> DataFrame:
    """For each verdict of round two, round one in its own letters: (verdict_id, shown), 'A:best/worst/mean' per shown candidate.

    Round one is summed per candidate first, so a hot item costs its candidates, not its pairs of verdicts.
    """
    from .judging import with_totals

    v = with_totals(verdicts).filter("valid")
    first = v.filter("round = 1").select("prompt_id", "source", "best", "worst", F.posexplode("totals").alias("cand", "t"))
    one = lambda c: F.sum((F.col(c) == F.col("cand")).cast("int"))
    text = F.concat_ws("/", one("best").cast("string"), one("worst").cast("string"), F.format_string("%.2f", F.round(F.sum("t") / F.count("t"), 2)))
    per = first.groupBy("prompt_id", "source", "cand").agg(text.alias("x"))
    seen = per.groupBy("prompt_id", "source").agg(F.map_from_entries(F.collect_list(F.struct("cand", "x"))).alias("m"))
    second = v.filter("round = 2").select("verdict_id", "prompt_id", "source", "permutation")
    line = F.transform("permutation", lambda p, i: F.concat(F.char(F.lit(65) + i), F.lit(":"), F.coalesce(F.try_element_at("m", p), F.lit("-"))))
    return second.join(seen, ["prompt_id", "source"]).select("verdict_id", F.array_join(line, " ").alias("shown"))

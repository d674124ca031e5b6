"""All core queries with their SQL equivalents (each written on its own, over whole tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import normalize, strip, word_count
from ..operators import evalstats, judging, labels, panel, prep, reports, reward, transcripts, usage
from ..runtime import table
from ..streaming.usage import usage_stream
from . import config, planning

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HELD = "('dev','eval','label_agreement','gsm8k_label')"
WEIGHTS = {"log_word_count": 0.8, "hedge_count": -0.3, "refusal_count": -1.2, "question_count": 0.1, "list_item_count": 0.25}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# -- views of the tables, each key once --------------------------------------------------------------------------
def prompts(s, d):
    return prep.once(table(s, d, "prompts"), "id")


def pairs(s, d):
    return prep.once(table(s, d, "pairs"), "pair_id")


def responses(s, d):
    return prep.once(table(s, d, "llm_responses"), "resp_id")


def verdicts(s, d):
    return prep.once(table(s, d, "verdicts"), "verdict_id")


def winrate(s, d):
    return prep.once(table(s, d, "winrate"), ["x", "y", "prompt_id"])


P = "p AS (SELECT DISTINCT ON (id) * FROM prompts ORDER BY id, loaded_at)"
PA = "pa AS (SELECT DISTINCT ON (pair_id) * FROM pairs ORDER BY pair_id, loaded_at)"
R = "r AS (SELECT DISTINCT ON (resp_id) * FROM llm_responses ORDER BY resp_id, loaded_at)"
V = "v0 AS (SELECT DISTINCT ON (verdict_id) * FROM verdicts ORDER BY verdict_id, loaded_at)"
W = "w AS (SELECT DISTINCT ON (x, y, prompt_id) * FROM winrate ORDER BY x, y, prompt_id, loaded_at)"
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
SP = "\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x0b"
WORDS = "len(regexp_extract_all({0}, '[^" + SP + "]+'))"
STRIP = "regexp_replace({0}, '^[" + SP + "]+|[" + SP + "]+$', '', 'g')"
H = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
VALID = (
    V + ", v AS (SELECT *, list_transform(scores, lambda m: list_sum(map_values(m))) AS totals FROM v0 WHERE len(scores) >= 2 "
    "AND len(list_filter(scores, lambda m: len(map_values(m)) = 3 AND len(list_filter(map_values(m), lambda s: s BETWEEN 1 AND 5)) = 3)) = len(scores) "
    "AND best BETWEEN 0 AND len(scores) - 1 AND worst BETWEEN 0 AND len(scores) - 1 AND best <> worst)"
)
LONG = VALID + ", l AS (SELECT verdict_id, prompt_id, source, judge, round, unnest(range(len(totals)))::INT AS cand, unnest(totals) AS total FROM v)"
GEN = (
    R + ", c AS (SELECT prompt_id, split_part(tag, ':', 2) AS source, (row_number() OVER (PARTITION BY prompt_id, split_part(tag, ':', 2) ORDER BY resp_id) - 1)::INT AS cand, text "
    "FROM r WHERE tag LIKE 'gen:%' AND text IS NOT NULL AND " + STRIP.format("text") + " <> '' AND coalesce(finish_reason, 'stop') <> 'length')"
)
F_SQL = {
    "log_word_count": "ln(1 + " + WORDS.format("{0}") + ")",
    "hedge_count": "len(regexp_extract_all(replace(lower({0}), '’', ''''), '\\b(might|possibly|perhaps|maybe|probably|not sure|i think|i believe|it seems)\\b'))",
    "refusal_count": "len(regexp_extract_all(replace(lower({0}), '’', ''''), '\\b(i can''t|i cannot|i won''t|i''m not able|i am not able|i''m sorry|i apologize|as an ai)\\b'))",
    "question_count": "(length({0}) - length(replace({0}, '?', '')))",
    "list_item_count": "len(regexp_extract_all({0}, '(?m)^\\s*(?:[-*•]|\\d+[.)])\\s+'))",
}


def _vote_sql(where: str, name: str = "vote") -> str:
    coin = H.format("concat_ws('|', '1234', coalesce(prompt_id,''), coalesce(source,''), cand::VARCHAR)")
    return (
        LONG + f", per AS (SELECT prompt_id, source, cand, avg(total::DOUBLE) AS t FROM l WHERE {where} GROUP BY ALL), "
        f"b AS (SELECT prompt_id, source, first(cand ORDER BY t DESC, {coin}, cand) AS chosen, first(cand ORDER BY t, {coin}, cand) AS rejected, "
        "max(t) AS hi, min(t) AS lo, count(*) AS k FROM per GROUP BY ALL), "
        f"{name} AS (SELECT v.prompt_id, v.source, first(chosen)::BIGINT AS chosen, first(rejected)::BIGINT AS rejected, count(*) AS n_final, "
        "round(sum(CASE WHEN coalesce(totals[chosen+1],-1) > coalesce(totals[rejected+1],-1) THEN 1.0::DOUBLE WHEN coalesce(totals[chosen+1],-1) = coalesce(totals[rejected+1],-1) THEN 0.5 ELSE 0 END) / count(*), 6) AS agreement "
        f"FROM v JOIN b ON v.prompt_id = b.prompt_id AND v.source = b.source WHERE k >= 2 AND hi > lo AND ({where.replace('source', 'v.source')}) GROUP BY v.prompt_id, v.source)"
    )


# -- prompts -----------------------------------------------------------------------------------------------------
@query(f"WITH {P}, k AS (SELECT *, {NORM.format('prompt')} AS key FROM p WHERE prompt IS NOT NULL) SELECT key, count(*) AS n_copies, min(id) AS id FROM k GROUP BY key")
def normalized_dedup(s, d):
    return prep.first_per_key(prompts(s, d).select("id", "prompt"), "prompt", ["id"]).select("key", "n_copies", "id")


@query(f"WITH {P} SELECT id, {WORDS.format('prompt')}::INT AS n_words FROM p WHERE {WORDS.format('prompt')} BETWEEN 4 AND 48")
def length_band(s, d):
    return prep.length_band(prompts(s, d), "prompt", 4, 48).select("id", "n_words")


@query(
    f"WITH {PA}, t AS (SELECT pair_id, prompt, chosen, rejected FROM pa WHERE chosen IS NOT NULL AND rejected IS NOT NULL) SELECT pair_id, {STRIP.format('prompt')} AS prompt, {STRIP.format('chosen')} AS chosen, {STRIP.format('rejected')} AS rejected FROM t "
    f"WHERE NOT contains(prompt || chosen, E'\\n\\nHuman:') AND NOT contains(prompt || chosen, E'\\n\\nAssistant:') AND NOT contains(prompt || rejected, E'\\n\\nAssistant:') AND {STRIP.format('chosen')} <> '' AND {STRIP.format('rejected')} <> '' "
    f"AND {STRIP.format('chosen')} <> {STRIP.format('rejected')} AND {STRIP.format('prompt')} <> ''"
)
def single_turn_parse(s, d):
    head = F.concat(F.lit("\n\nHuman: "), F.col("prompt"), F.lit("\n\nAssistant: "))
    t = pairs(s, d).select("pair_id", F.concat(head, "chosen").alias("chosen"), F.concat(head, "rejected").alias("rejected"))
    return transcripts.single_turn(t)


@query(
    f"WITH {P}, k AS (SELECT subset, split, prompt, {WORDS.format('prompt')} BETWEEN 4 AND 48 AS fit, {NORM.format('prompt')} AS key FROM p) SELECT subset, split, count(*) AS raw, count(prompt) AS with_text, "
    "count(*) FILTER (WHERE fit) AS length_ok, count(DISTINCT key) FILTER (WHERE fit) AS distinct_texts FROM k GROUP BY ALL"
)
def prep_funnel(s, d):
    return prep.funnel(prompts(s, d), "prompt", ["subset", "split"], 4, 48)


@query(
    f"WITH {P}, g AS (SELECT id, subset, row_number() OVER (PARTITION BY subset ORDER BY {H.format(chr(39) + '1234|' + chr(39) + ' || id')}, id) AS rk FROM p), "
    "q AS (SELECT subset, 500 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY subset) <= 500 % count(*) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT DISTINCT subset FROM p)) "
    "SELECT id, g.subset AS subset, rk AS rank FROM g JOIN q ON g.subset = q.subset WHERE rk <= quota"
)
def stratified_split(s, d):
    got = prep.stratified(prompts(s, d).select("id", "subset"), "subset", "id", 500)
    return got.select("id", "subset", F.col("rank").cast("long").alias("rank"))


@query(
    f"WITH {P}, g AS (SELECT id, subset, row_number() OVER (PARTITION BY subset ORDER BY {H.format(chr(39) + '1234|' + chr(39) + ' || id')}, id) AS rk FROM p) "
    "SELECT id, subset, CASE WHEN rk <= 60 THEN 'eval' WHEN rk <= 90 THEN 'label_agreement' ELSE 'train_head' END AS band FROM g WHERE rk <= 270"
)
def oversampled_heads(s, d):
    got = prep.disjoint_bands(prompts(s, d).select("id", "subset"), "subset", "id", {"eval": 60, "label_agreement": 30, "train_head": 180})
    return got.select("id", "subset", "band")


@query(
    f"WITH {P}, h AS (SELECT DISTINCT {NORM.format('prompt')} AS key FROM p WHERE split IN {HELD}) SELECT id, subset FROM p WHERE split = 'train' AND {NORM.format('prompt')} IN (SELECT key FROM h WHERE key IS NOT NULL)"
)
def exact_decontam(s, d):
    p = prompts(s, d)
    return prep.leaked_texts(p.filter("split = 'train'"), p.filter("split <> 'train'"), "prompt").select("id", "subset")


@query(
    f"WITH {P}, h AS (SELECT DISTINCT {NORM.format('prompt')} AS key FROM p WHERE split IN {HELD}) SELECT subset, count(*) AS n_clean FROM p WHERE split = 'train' AND {NORM.format('prompt')} NOT IN (SELECT key FROM h WHERE key IS NOT NULL) GROUP BY ALL"
)
def clean_pool(s, d):
    p = prompts(s, d)
    train = p.filter("split = 'train'")
    leaked = prep.leaked_texts(train, p.filter("split <> 'train'"), "prompt").select("id")
    return train.filter(F.col("prompt").isNotNull()).join(leaked, "id", "left_anti").groupBy("subset").agg(F.count("*").alias("n_clean"))


@query(
    "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e), "
    "c AS (SELECT a.vec_id AS id, b.vec_id AS ref, list_dot_product(a.v, b.v) / (a.n * b.n) AS cosine FROM u a, u b WHERE a.vec_id % 50 <> 0 AND b.vec_id % 50 = 0), "
    "m AS (SELECT id, max(cosine) AS cosine FROM c GROUP BY id) SELECT id, round(cosine, 4) AS cosine FROM m WHERE cosine >= 0.4"
)
def near_dup_cosine(s, d):
    e = table(s, d, "embeddings")
    got = prep.near_vectors(e.filter("vec_id % 50 <> 0"), e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 0.4)
    return got.select("id", F.round("cosine", 4).alias("cosine"))


@query(f"WITH {P}, h AS (SELECT id, subset, row_number() OVER (PARTITION BY subset ORDER BY {H.format(chr(39) + '1234|' + chr(39) + ' || id')}, id) AS rk FROM p WHERE subset <> 'gsm8k') SELECT id, subset FROM h WHERE rk <= 100")
def balanced_sample(s, d):
    return prep.disjoint_bands(prompts(s, d).filter("subset <> 'gsm8k'").select("id", "subset"), "subset", "id", {"all": 100}).select("id", "subset")


@query(f"WITH {P} SELECT split, count(*) AS n_bad FROM p WHERE subset NOT IN ('helpful-base','harmless-base','gsm8k') OR split NOT IN ('train','dev','eval','label_agreement','gsm8k_label') OR prompt IS NULL OR prompt_tokens IS NULL OR prompt_tokens < 1 GROUP BY ALL")
def prompt_invariants(s, d):
    p = prompts(s, d)
    ok = F.col("subset").isin("helpful-base", "harmless-base", "gsm8k") & F.col("split").isin("train", "dev", "eval", "label_agreement", "gsm8k_label") & F.col("prompt").isNotNull() & (F.col("prompt_tokens") >= 1)
    return p.filter(~F.coalesce(ok, F.lit(False))).groupBy("split").agg(F.count("*").alias("n_bad"))


@query(f"WITH {PA} SELECT condition, count(*) AS n, count(*) FILTER (WHERE chosen IS NULL OR rejected IS NULL) AS n_null, count(*) FILTER (WHERE {STRIP.format('chosen')} = {STRIP.format('rejected')}) AS n_same, count(*) FILTER (WHERE agreement < 0 OR agreement > 1) AS n_range FROM pa GROUP BY ALL")
def pair_invariants(s, d):
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return pairs(s, d).groupBy("condition").agg(
        F.count("*").alias("n"), one(F.col("chosen").isNull() | F.col("rejected").isNull()).alias("n_null"),
        one(strip(F.col("chosen")) == strip(F.col("rejected"))).alias("n_same"), one(~F.col("agreement").between(0, 1)).alias("n_range"),
    )


# -- parsing -----------------------------------------------------------------------------------------------------
NUMBER_SQL = (
    "coalesce(list_extract(regexp_extract_all(text, '####\\s*(-?[\\d,]*\\.?\\d+)', 1), -1), "
    "list_extract(regexp_extract_all(text, '(?i)answer is[:\\s]*\\$?\\\\?(?:boxed\\{{)?\\s*(-?[\\d,]*\\.?\\d+)', 1), -1), "
    "list_extract(regexp_extract_all(text, '\\\\boxed\\{{\\s*\\$?(-?[\\d,]*\\.?\\d+)', 1), -1), list_extract(regexp_extract_all(text, '-?\\d[\\d,]*(?:\\.\\d+)?'), -1))"
).replace("{{", "{")
PLAIN_SQL = "CASE WHEN try_cast({0} AS DOUBLE) = floor(try_cast({0} AS DOUBLE)) THEN floor(try_cast({0} AS DOUBLE))::BIGINT::VARCHAR ELSE {0} END"
CLEAN = "regexp_replace(replace(replace(trim({0}), ',', ''), '$', ''), '\\.+$', '')"


@query(f"WITH {R}, n AS (SELECT resp_id, {CLEAN.format(NUMBER_SQL)} AS raw FROM r WHERE tag LIKE 'gen:%') SELECT resp_id, {PLAIN_SQL.format('raw')} AS number FROM n WHERE raw IS NOT NULL")
def numeric_answer(s, d):
    got = responses(s, d).filter("tag LIKE 'gen:%'").select("resp_id", parse.final_number(F.col("text")).alias("number"))
    return got.filter(F.col("number").isNotNull())


@query(
    f"WITH {R}, {P}, n AS (SELECT prompt_id, model, {CLEAN.format(NUMBER_SQL)} AS raw FROM r WHERE tag LIKE 'gen:%'), j AS (SELECT n.model, coalesce(abs(try_cast(raw AS DOUBLE) - try_cast(gold_answer AS DOUBLE)) < 1e-6, false) AS hit "
    "FROM n JOIN p ON n.prompt_id = p.id WHERE gold_answer IS NOT NULL) SELECT model, count(*) AS n, sum(hit::INT)::BIGINT AS n_right, round(sum(hit::INT) / count(*), 6) AS accuracy FROM j GROUP BY ALL"
)
def gsm8k_label_accuracy(s, d):
    gold = prompts(s, d).filter(F.col("gold_answer").isNotNull()).select(F.col("id").alias("prompt_id"), "gold_answer")
    got = responses(s, d).filter("tag LIKE 'gen:%'").select("prompt_id", "model", parse.final_number(F.col("text")).alias("n")).join(gold, "prompt_id")
    hit = F.coalesce(parse.same_number(F.col("n"), F.col("gold_answer")), F.lit(False)).cast("long")
    return got.groupBy("model").agg(F.count("*").alias("n"), F.sum(hit).alias("n_right"), F.round(F.sum(hit) / F.count("*"), 6).alias("accuracy"))


@query(
    f"WITH {R}, o AS (SELECT resp_id, list_concat(regexp_extract_all(text, '(?s)```(?:json)?\\s*(.*?)```', 1), [text]) AS parts FROM r WHERE tag NOT LIKE 'gen:%' AND text IS NOT NULL), "
    "g AS (SELECT resp_id, list_filter(list_transform(parts, lambda b: regexp_extract(b, '(?s)(\\{.*\\})', 1)), lambda o: o <> '' AND json_valid(o)) AS good FROM o) "
    "SELECT resp_id, json_extract_string(good[1], '$.best') AS best, json_extract_string(good[1], '$.winner') AS winner FROM g WHERE len(good) > 0"
)
def tolerant_json(s, d):
    got = responses(s, d).filter("tag NOT LIKE 'gen:%' AND text IS NOT NULL").select("resp_id", parse.json_object(F.col("text")).alias("o"))
    return got.filter(F.col("o").isNotNull()).select("resp_id", F.get_json_object("o", "$.best").alias("best"), F.get_json_object("o", "$.winner").alias("winner"))


REPLY = "CASE WHEN chosen IS NULL THEN 'unknown' WHEN len(chosen) % 4 = 0 THEN 'Yes, ' || chosen WHEN len(chosen) % 4 = 1 THEN ' no. ' || chosen WHEN len(chosen) % 4 = 2 THEN chosen ELSE 'Yes or no: ' || chosen END"
REPLIES = f"{PA}, y AS (SELECT pair_id, {REPLY} AS t FROM pa), z AS (SELECT pair_id, CASE WHEN regexp_extract(t, '(?i)^\\s*(yes|no)\\b', 1) <> '' AND len(list_distinct(regexp_extract_all(lower(t), '\\b(yes|no)\\b', 1))) = 1 THEN lower(regexp_extract(t, '(?i)^\\s*(yes|no)\\b', 1)) END AS label FROM y)"


def _replies(s, d):
    k = F.length("chosen") % 4
    t = (
        F.when(F.col("chosen").isNull(), "unknown").when(k == 0, F.concat(F.lit("Yes, "), "chosen")).when(k == 1, F.concat(F.lit(" no. "), "chosen"))
        .when(k == 2, F.col("chosen")).otherwise(F.concat(F.lit("Yes or no: "), "chosen"))
    )
    return pairs(s, d).select("pair_id", "condition", parse.yes_no(t).alias("label"))


@query(f"WITH {REPLIES} SELECT pair_id, label FROM z")
def yes_no_parse(s, d):
    return _replies(s, d).select("pair_id", "label")


@query(
    f"WITH {REPLIES}, a AS (SELECT condition, count(*)::DOUBLE AS n, sum(coalesce(label = CASE WHEN pa.pair_id % 2 = 0 THEN 'yes' ELSE 'no' END, false)::INT)::DOUBLE AS k, count(label) AS valid FROM z JOIN pa USING (pair_id) GROUP BY ALL) "
    "SELECT condition, n::BIGINT AS n, round(k / n, 6) AS accuracy, round(greatest(0, (k/n + 1.959963984540054^2/(2*n)) / (1 + 1.959963984540054^2/n) - 1.959963984540054 * sqrt(k/n*(1-k/n)/n + 1.959963984540054^2/(4*n*n)) / (1 + 1.959963984540054^2/n)), 6) AS ci_low, "
    "round(least(1, (k/n + 1.959963984540054^2/(2*n)) / (1 + 1.959963984540054^2/n) + 1.959963984540054 * sqrt(k/n*(1-k/n)/n + 1.959963984540054^2/(4*n*n)) / (1 + 1.959963984540054^2/n)), 6) AS ci_high, round(valid / n, 6) AS valid_rate FROM a"
)
def wilson_accuracy(s, d):
    r = _replies(s, d)
    hit = F.coalesce(F.col("label") == F.when(F.col("pair_id") % 2 == 0, "yes").otherwise("no"), F.lit(False)).cast("double")
    a = r.groupBy("condition").agg(F.count("*").alias("n"), F.sum(hit).alias("k"), F.count("label").alias("v"))
    low, high = evalstats.wilson(F.col("k") / F.col("n"), F.col("n").cast("double"))
    return a.select("condition", "n", F.round(F.col("k") / F.col("n"), 6).alias("accuracy"), F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"), F.round(F.col("v") / F.col("n"), 6).alias("valid_rate"))


@query(f"WITH {R} SELECT model, count(*) AS n, sum(floor(length(text) / 3.5)::BIGINT + completion_tokens // 2)::BIGINT AS estimate FROM r WHERE text IS NOT NULL AND completion_tokens IS NOT NULL GROUP BY ALL")
def token_estimate(s, d):
    r = responses(s, d).filter("text IS NOT NULL AND completion_tokens IS NOT NULL")
    return r.groupBy("model").agg(F.count("*").alias("n"), F.sum(F.floor(F.length("text") / 3.5) + F.expr("completion_tokens DIV 2")).cast("long").alias("estimate"))


_J = "coalesce(to_json({0})::VARCHAR, 'null')"
REQUEST_SQL = "'{\"cached\":' || " + _J.format("cached") + " || ',\"model\":' || " + _J.format("model") + " || ',\"prompt_id\":' || " + _J.format("prompt_id") + " || ',\"tag\":' || " + _J.format("tag") + " || '}'"


@query(f"WITH {R} SELECT sha256({REQUEST_SQL}) AS request_key, count(*) AS n, min(resp_id) AS first_id FROM r GROUP BY 1")
def request_key(s, d):
    key = parse.request_key({c: F.col(c) for c in ("model", "tag", "prompt_id", "cached")})
    return responses(s, d).groupBy(key.alias("request_key")).agg(F.count("*").alias("n"), F.min("resp_id").alias("first_id"))


@query(f"WITH {GEN}, {P} SELECT c.prompt_id, c.source, first(left({STRIP.format('p.prompt')}, 160)) || E'\\n\\n' || string_agg('Response ' || chr(65 + cand) || E':\\n' || left(text, 900), E'\\n\\n' ORDER BY cand) AS rendered FROM c JOIN p ON c.prompt_id = p.id GROUP BY ALL")
def judge_prompts(s, d):
    body = F.concat(F.lit("Response "), F.char(F.lit(65) + F.col("cand")), F.lit(":\n"), F.left("text", F.lit(900)))
    c = labels.candidates(responses(s, d)).groupBy("prompt_id", "source").agg(F.array_sort(F.collect_list(F.struct("cand", body.alias("b")))).alias("x"))
    p = prompts(s, d).select(F.col("id").alias("prompt_id"), F.left(strip(F.col("prompt")), F.lit(160)).alias("head"))
    return c.join(p, "prompt_id").select("prompt_id", "source", F.concat("head", F.lit("\n\n"), F.array_join(F.col("x.b"), "\n\n")).alias("rendered"))


@query(f"WITH {GEN}, {P} SELECT c.prompt_id, c.source, first({STRIP.format('p.prompt')}) || E'\\n\\n' || string_agg('Response ' || chr(65 + cand) || E':\\n' || text, E'\\n\\n' ORDER BY cand) AS rendered FROM c JOIN p ON c.prompt_id = p.id GROUP BY ALL")
def judge_prompts_whole(s, d):
    """What a judge is shown: the whole request and whole answers (judge_prompts has F15's cuts, for display)."""
    body = F.concat(F.lit("Response "), F.char(F.lit(65) + F.col("cand")), F.lit(":\n"), "text")
    c = labels.candidates(responses(s, d)).groupBy("prompt_id", "source").agg(F.array_sort(F.collect_list(F.struct("cand", body.alias("b")))).alias("x"))
    p = prompts(s, d).select(F.col("id").alias("prompt_id"), strip(F.col("prompt")).alias("head"))
    return c.join(p, "prompt_id").select("prompt_id", "source", F.concat("head", F.lit("\n\n"), F.array_join(F.col("x.b"), "\n\n")).alias("rendered"))


# -- verdicts ----------------------------------------------------------------------------------------------------
@query(f"WITH {VALID} SELECT judge, count(*) AS n, count(v.verdict_id) AS n_valid FROM v0 LEFT JOIN v USING (verdict_id, judge) GROUP BY ALL")
def verdict_validity(s, d):
    v = judging.with_totals(verdicts(s, d))
    return v.groupBy("judge").agg(F.count("*").alias("n"), F.sum(F.col("valid").cast("long")).alias("n_valid"))


@query(f"WITH {LONG} SELECT prompt_id, source, cand, count(*) AS n, sum(total)::BIGINT AS total, round(sum(total) / (3 * count(*)), 6) AS mean_score FROM l GROUP BY ALL")
def overall_scores(s, d):
    return judging.score_rows(verdicts(s, d)).groupBy("prompt_id", "source", "cand").agg(
        F.count("*").alias("n"), F.sum("total").cast("long").alias("total"), F.round(F.sum("total") / (3 * F.count("*")), 6).alias("mean_score")
    )


@query(f"WITH {_vote_sql('round = 2')} SELECT * FROM vote")
def panel_vote(s, d):
    return judging.vote(verdicts(s, d).filter("round = 2"))


@query("WITH " + _vote_sql("judge = 'heron-120b' AND round = 1") + " SELECT * FROM vote")
def single_judge_vote(s, d):
    return judging.vote(verdicts(s, d).filter("judge = 'heron-120b' AND round = 1"))


@query(f"WITH {LONG}, per AS (SELECT prompt_id, source, cand, avg(total::DOUBLE) AS t FROM l WHERE round = 1 GROUP BY ALL) SELECT prompt_id, source, first(cand ORDER BY t, cand)::BIGINT AS target FROM per GROUP BY ALL")
def devils_advocate_target(s, d):
    return judging.devils_advocate(verdicts(s, d))


@query(
    f"WITH {LONG}, jd AS (SELECT DISTINCT prompt_id, source, judge FROM l WHERE round = 1), "
    "o AS (SELECT jd.prompt_id, jd.source, jd.judge, l.cand, avg(l.total::DOUBLE) AS t FROM jd JOIN l ON l.prompt_id = jd.prompt_id AND l.source = jd.source AND l.judge <> jd.judge WHERE l.round = 1 GROUP BY ALL) "
    "SELECT prompt_id, source, judge, first(cand ORDER BY t, cand)::BIGINT AS target FROM o GROUP BY ALL"
)
def peer_targets(s, d):
    return judging.peer_targets(verdicts(s, d))


@query(f"WITH {VALID} SELECT verdict_id, chr(64 + list_position(permutation, best)::INT) AS best_label, chr(64 + list_position(permutation, worst)::INT) AS worst_label, array_to_string(list_transform(permutation, lambda p: totals[p + 1]::BIGINT), ',') AS shown_totals FROM v")
def permutation_remap(s, d):
    return judging.relabelled(verdicts(s, d))


@query(f"WITH {V} SELECT judge, len(permutation) AS n_shown, list_position(permutation, best)::BIGINT - 1 AS position, count(*) AS n FROM v0 WHERE list_position(permutation, best) > 0 GROUP BY ALL")
def position_bias(s, d):
    v = verdicts(s, d).select("judge", F.size("permutation").cast("long").alias("n_shown"), judging.shown_position(F.col("permutation"), F.col("best")).alias("position"))
    return v.filter(F.col("position").isNotNull()).groupBy("judge", "n_shown", "position").agg(F.count("*").alias("n"))


@query(
    f"WITH {V}, b AS (SELECT prompt_id, source, judge, last(best ORDER BY verdict_id) FILTER (WHERE round = 1) AS b1, last(best ORDER BY verdict_id) FILTER (WHERE round = 2) AS b2 FROM v0 WHERE best IS NOT NULL GROUP BY ALL) "
    "SELECT judge, count(*) AS n, sum((b1 <> b2)::INT)::BIGINT AS changed FROM b WHERE b1 IS NOT NULL AND b2 IS NOT NULL GROUP BY ALL"
)
def round2_change_rate(s, d):
    return judging.round_changes(verdicts(s, d))


AGREE = "j AS (SELECT v0.prompt_id, CASE WHEN vote.chosen IS NULL THEN 0.5::DOUBLE WHEN vote.chosen = 0 THEN 1 ELSE 0 END AS hit, CASE WHEN agreement = 1 THEN 'unanimous' WHEN agreement IS NOT NULL THEN 'split' END AS confidence FROM (SELECT DISTINCT prompt_id, source FROM v0 WHERE source = 'human_pair') v0 LEFT JOIN vote ON vote.prompt_id = v0.prompt_id AND vote.source = v0.source)"


@query(
    "WITH " + _vote_sql("source = 'human_pair'") + f", {P}, {AGREE}, k AS (SELECT j.*, coalesce(p.subset, 'unknown') AS subset FROM j LEFT JOIN p ON j.prompt_id = p.id) "
    "SELECT 'overall' AS grp, 'all' AS name, count(*) AS n, round(sum(hit) / count(*), 6) AS rate FROM k UNION ALL SELECT 'subset', subset, count(*), round(sum(hit) / count(*), 6) FROM k GROUP BY subset "
    "UNION ALL SELECT 'confidence', confidence, count(*), round(sum(hit) / count(*), 6) FROM k WHERE confidence IS NOT NULL GROUP BY confidence"
)
def agreement_summary(s, d):
    """Grouping sets over one expanded pass: overall, by subset, by confidence (ties left out of the last)."""
    v = verdicts(s, d).filter("source = 'human_pair'")
    votes = judging.vote(v)
    every = v.select("prompt_id", "source").distinct().join(votes, ["prompt_id", "source"], "left")
    k = every.join(prompts(s, d).select(F.col("id").alias("prompt_id"), "subset"), "prompt_id", "left").select(
        F.when(F.col("chosen").isNull(), 0.5).otherwise((F.col("chosen") == 0).cast("double")).alias("hit"),
        F.coalesce("subset", F.lit("unknown")).alias("subset"),
        F.when(F.col("agreement") == 1, "unanimous").when(F.col("agreement").isNotNull(), "split").alias("confidence"),
    )
    keys = F.array(
        F.struct(F.lit("overall").alias("grp"), F.lit("all").alias("name")), F.struct(F.lit("subset").alias("grp"), F.col("subset").alias("name")),
        F.struct(F.lit("confidence").alias("grp"), F.col("confidence").alias("name")),
    )
    long = k.select("hit", F.explode(keys).alias("k")).filter("k.name IS NOT NULL")
    return long.groupBy("k.grp", "k.name").agg(F.count("*").alias("n"), F.round(F.sum("hit") / F.count("*"), 6).alias("rate"))


@query(f"WITH {V} SELECT judge, round, count(*) AS n, round(avg((best = 0)::INT), 6) AS rate FROM v0 WHERE source = 'human_pair' AND best IS NOT NULL GROUP BY ALL")
def judge_round_rates(s, d):
    v = verdicts(s, d).filter("source = 'human_pair' AND best IS NOT NULL")
    return v.groupBy("judge", "round").agg(F.count("*").alias("n"), F.round(F.avg((F.col("best") == 0).cast("double")), 6).alias("rate"))


# -- labels ------------------------------------------------------------------------------------------------------
@query(f"WITH {R}, g AS (SELECT split_part(tag, ':', 2) AS source, text IS NULL OR {STRIP.format('text')} = '' OR coalesce(finish_reason, 'stop') = 'length' AS bad FROM r WHERE tag LIKE 'gen:%') SELECT source, count(*) AS n_asked, sum(bad::INT)::BIGINT AS n_dropped FROM g GROUP BY ALL")
def candidate_drops(s, d):
    return labels.dropped(responses(s, d))


@query(f"WITH {P} SELECT 'human' AS condition, id AS prompt_id, human_chosen AS chosen, human_rejected AS rejected FROM p WHERE human_chosen IS NOT NULL AND human_rejected IS NOT NULL AND {STRIP.format('human_chosen')} <> {STRIP.format('human_rejected')}")
def label_human(s, d):
    return labels.human_pairs(prompts(s, d)).drop("agreement")


RANDOM = f"h AS (SELECT *, {H.format('concat_ws(' + chr(39) + '|' + chr(39) + ', ' + chr(39) + '1234' + chr(39) + ', prompt_id, source, cand::VARCHAR)')} AS h FROM c), k AS (SELECT prompt_id, source, first(text ORDER BY h, cand) AS chosen, first(text ORDER BY h DESC, cand DESC) AS rejected, count(*) AS n FROM h GROUP BY ALL)"


@query(f"WITH {GEN}, {RANDOM} SELECT 'random' AS condition, prompt_id, chosen, rejected FROM k WHERE n >= 2 AND {STRIP.format('chosen')} <> {STRIP.format('rejected')}")
def label_random(s, d):
    return labels.random_pairs(labels.candidates(responses(s, d))).drop("agreement")


LONGER = f"q AS (SELECT *, {WORDS.format('text')} AS nw FROM c), lg AS (SELECT prompt_id, source, first(text ORDER BY nw DESC, cand) AS chosen, first(text ORDER BY nw, cand) AS rejected, count(*) AS n, max(nw) AS hi, min(nw) AS lo FROM q GROUP BY ALL)"


@query(f"WITH {GEN}, {LONGER} SELECT 'longer' AS condition, prompt_id, chosen, rejected FROM lg WHERE n >= 2 AND hi > lo AND {STRIP.format('chosen')} <> {STRIP.format('rejected')}")
def label_longer(s, d):
    return labels.longer_pairs(labels.candidates(responses(s, d))).drop("agreement")


JUDGED = f"jp AS (SELECT vote.prompt_id, a.text AS chosen, b.text AS rejected, agreement FROM vote JOIN c a ON a.prompt_id = vote.prompt_id AND a.source = vote.source AND a.cand = vote.chosen JOIN c b ON b.prompt_id = vote.prompt_id AND b.source = vote.source AND b.cand = vote.rejected WHERE {STRIP.format('a.text')} <> {STRIP.format('b.text')})"


@query("WITH " + _vote_sql("round = 2") + f", {GEN}, {JUDGED} SELECT 'panel' AS condition, prompt_id, chosen, rejected, agreement FROM jp")
def label_judged(s, d):
    return labels.judged_pairs(labels.candidates(responses(s, d)), judging.vote(verdicts(s, d).filter("round = 2")), "panel")


@query(f"WITH {PA}, k AS (SELECT prompt_id FROM pa WHERE condition IN ('multi_panel','multi_single') GROUP BY prompt_id HAVING count(DISTINCT condition) = 2) SELECT condition, count(*) AS n_valid, count(k.prompt_id) AS n_common FROM pa LEFT JOIN k USING (prompt_id) WHERE condition IN ('multi_panel','multi_single') GROUP BY ALL")
def common_prompt_pairs(s, d):
    two = pairs(s, d).filter("condition IN ('multi_panel','multi_single')").select("condition", "prompt_id")
    common = labels.common_prompts(two).groupBy("condition").agg(F.count("*").alias("n_common"))
    return two.groupBy("condition").agg(F.count("*").alias("n_valid")).join(common, "condition", "left").select("condition", "n_valid", F.coalesce("n_common", F.lit(0)).alias("n_common"))


@query(f"WITH {PA}, u AS (SELECT DISTINCT condition, prompt_id FROM pa), g AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY {H.format(chr(39) + '1234|' + chr(39) + ' || prompt_id')}, prompt_id) AS rk FROM u) SELECT condition, prompt_id, (CASE WHEN rk <= 25 THEN 25 WHEN rk <= 50 THEN 50 ELSE 100 END)::BIGINT AS size FROM g WHERE rk <= 100")
def nested_prefixes(s, d):
    return labels.nested_prefixes(pairs(s, d), prep.shuffled(F.col("prompt_id")), [25, 50, 100])


@query(f"WITH {PA}, e AS (SELECT pair_id, condition, least(0.5, greatest(0.0, 0.4 * (1 - agreement))) AS eps FROM pa WHERE agreement IS NOT NULL) SELECT pair_id, round(eps, 6) AS eps, round((1 - eps) * ln(1 + exp(-0.7)) + eps * ln(1 + exp(0.7)), 6) AS loss FROM e")
def disagreement_smoothing(s, d):
    p = pairs(s, d).filter(F.col("agreement").isNotNull()).withColumn("eps", labels.smoothing(F.col("agreement"), 0.4))
    return p.select("pair_id", F.round("eps", 6).alias("eps"), F.round(labels.smoothed_loss(F.col("eps"), F.lit(0.7)), 6).alias("loss"))


@query(f"WITH {PA} SELECT pair_id, 'user' AS role_in, prompt, 'assistant' AS role_out, chosen, rejected FROM pa WHERE chosen IS NOT NULL AND rejected IS NOT NULL")
def training_rows(s, d):
    t = labels.training_rows(pairs(s, d).filter("chosen IS NOT NULL AND rejected IS NOT NULL"))
    return t.select("pair_id", F.col("prompt")[0]["role"].alias("role_in"), F.col("prompt")[0]["content"].alias("prompt"), F.col("chosen")[0]["role"].alias("role_out"), F.col("chosen")[0]["content"].alias("chosen"), F.col("rejected")[0]["content"].alias("rejected"))


@query(f"WITH {P}, {PA} SELECT id, subset FROM p WHERE id NOT IN (SELECT prompt_id FROM pa WHERE condition = 'multi_panel' AND prompt_id IS NOT NULL)")
def resume_todo(s, d):
    done = pairs(s, d).filter("condition = 'multi_panel'").select(F.col("prompt_id").alias("id"))
    return prompts(s, d).select("id", "subset").join(done, "id", "left_anti")


@query(f"WITH {P}, {GEN} SELECT split, count(*) AS n_missing FROM p WHERE id NOT IN (SELECT prompt_id FROM c WHERE prompt_id IS NOT NULL) GROUP BY ALL")
def missing_candidates(s, d):
    have = labels.candidates(responses(s, d)).select(F.col("prompt_id").alias("id"))
    return prompts(s, d).join(have, "id", "left_anti").groupBy("split").agg(F.count("*").alias("n_missing"))


@query(
    f"WITH {_vote_sql('round = 2')}, {GEN}, lens AS (SELECT vote.source, {WORDS.format('a.text')} AS wc, {WORDS.format('b.text')} AS wr, agreement FROM vote JOIN c a ON a.prompt_id = vote.prompt_id AND a.source = vote.source AND a.cand = vote.chosen "
    "JOIN c b ON b.prompt_id = vote.prompt_id AND b.source = vote.source AND b.cand = vote.rejected) SELECT source, count(*) AS pairs, round(avg(agreement), 6) AS agreement_mean, round(avg((agreement = 1)::INT), 6) AS unanimous, round(avg(wc), 6) AS len_chosen, round(avg(wr), 6) AS len_rejected, round(avg((wc > wr)::INT), 6) AS longer_chosen FROM lens GROUP BY ALL"
)
def label_stats(s, d):
    c = labels.candidates(responses(s, d)).select("prompt_id", "source", F.col("cand").cast("long").alias("cand"), word_count(F.col("text")).alias("w"))
    v = judging.vote(verdicts(s, d).filter("round = 2"))
    j = v.join(c.withColumnRenamed("cand", "chosen").withColumnRenamed("w", "wc"), ["prompt_id", "source", "chosen"]).join(c.withColumnRenamed("cand", "rejected").withColumnRenamed("w", "wr"), ["prompt_id", "source", "rejected"])
    one = lambda x: F.round(F.avg(x.cast("double")), 6)
    return j.groupBy("source").agg(F.count("*").alias("pairs"), one(F.col("agreement")).alias("agreement_mean"), one(F.col("agreement") == 1).alias("unanimous"), one(F.col("wc")).alias("len_chosen"), one(F.col("wr")).alias("len_rejected"), one(F.col("wc") > F.col("wr")).alias("longer_chosen"))


# -- win rates ---------------------------------------------------------------------------------------------------
JUROR = (
    W + ", js AS (SELECT x, y, prompt_id, unnest(json_keys(jurors)) AS juror, jurors FROM w WHERE jurors IS NOT NULL), "
    "od AS (SELECT x, y, prompt_id, juror, unnest(json_extract(jurors, '$.\"' || juror || '\".orders')::JSON[]) AS o FROM js), "
    "sd AS (SELECT x, y, prompt_id, juror, CASE WHEN o->>'pick' = 'tie' THEN 'tie' WHEN (o->>'pick' = 'a') = (o->>'order' = 'xy') THEN 'x' ELSE 'y' END AS side FROM od), "
    "jw AS (SELECT x, y, prompt_id, juror, CASE WHEN count(DISTINCT side) = 1 THEN min(side) ELSE 'tie' END AS winner FROM sd GROUP BY ALL)"
)


@query(f"WITH {JUROR} SELECT * FROM jw")
def juror_verdict(s, d):
    return evalstats.juror_rows(winrate(s, d))


@query(f"WITH {JUROR} SELECT x, y, prompt_id, count(*) AS n_jurors, (CASE WHEN sum((winner = 'x')::INT) * 2 > count(*) THEN 1 WHEN sum((winner = 'y')::INT) * 2 > count(*) THEN 0 ELSE 0.5 END)::DOUBLE AS outcome FROM jw GROUP BY ALL")
def jury_outcome(s, d):
    return evalstats.jury_outcomes(evalstats.juror_rows(winrate(s, d)))


@query(f"WITH {JUROR}, k AS (SELECT x, y, prompt_id, count(DISTINCT winner) AS k, count(*) AS n FROM jw GROUP BY ALL) SELECT x, y, count(*) AS n_prompts, CASE WHEN max(n) >= 2 THEN round(avg((k = 1)::INT), 6) END AS juror_agreement FROM k GROUP BY ALL")
def juror_agreement(s, d):
    return evalstats.juror_agreement(evalstats.juror_rows(winrate(s, d)))


@query(f"WITH {W} SELECT x, y, count(*) AS n, round(avg((outcome = 1)::INT), 6) AS win, round(avg((outcome = 0.5)::INT), 6) AS tie, round(avg((outcome = 0)::INT), 6) AS loss, round(avg(outcome), 6) AS win_rate, round(avg(len_x), 6) AS words_x, round(avg(len_y), 6) AS words_y FROM w WHERE outcome IS NOT NULL GROUP BY ALL")
def winrate_report(s, d):
    return evalstats.win_report(winrate(s, d))


@query()
def bootstrap_ci(s, d):
    return evalstats.bootstrap_draws(winrate(s, d), ["x"], "outcome")


def _newton_sql(steps: int = 8) -> str:
    out = (
        W + ", cn AS (SELECT x, (len_x - len_y)::DOUBLE AS d, count(*)::DOUBLE AS n, sum(outcome) AS w FROM w WHERE outcome IN (0, 1) AND len_x IS NOT NULL AND len_y IS NOT NULL GROUP BY ALL), "
        "st AS (SELECT x, sum(n) AS m, sum(w) AS wins, sqrt(sum(n*d*d)/sum(n) - (sum(n*d)/sum(n))^2) AS sd FROM cn GROUP BY x), f0 AS (SELECT *, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM st)"
    )
    for i in range(steps):
        p = "(1 / (1 + exp(-(a + b * d / sd))))"
        out += (
            f", s{i} AS (SELECT x, first(m) AS m, first(wins) AS wins, first(sd) AS sd, first(a) AS a, first(b) AS b, sum(w - n*{p}) AS g0, sum((w - n*{p})*d/sd) AS g1, sum(n*{p}*(1-{p})) AS h00, sum(n*{p}*(1-{p})*d/sd) AS h01, sum(n*{p}*(1-{p})*d/sd*d/sd) AS h11 "
            f"FROM cn JOIN f{i} USING (x) WHERE m >= 10 AND wins > 0 AND wins < m AND sd > 0 GROUP BY x), "
            f"f{i + 1} AS (SELECT x, m, wins, sd, a + (h11*g0 - h01*g1)/(h00*h11 - h01*h01) AS a, b + (h00*g1 - h01*g0)/(h00*h11 - h01*h01) AS b FROM s{i})"
        )
    return out


@query(f"WITH {_newton_sql()} SELECT st.x, st.m::BIGINT AS n, CASE WHEN abs(f8.a - f7.a) < 1e-6 AND abs(f8.b - f7.b) < 1e-6 THEN round(1 / (1 + exp(-f8.a)), 4) END AS lc_win_rate FROM st LEFT JOIN f8 USING (x) LEFT JOIN f7 USING (x)")
def length_controlled_wr(s, d):
    return evalstats.length_controlled(winrate(s, d), ["x"])


@query(f"WITH {PA}, m AS (SELECT condition, ((hash_c % 1000) - (hash_r % 1000)) / 100.0::DOUBLE AS margin FROM (SELECT condition, {H.format('chosen')} AS hash_c, {H.format('rejected')} AS hash_r FROM pa WHERE chosen IS NOT NULL AND rejected IS NOT NULL)) SELECT condition, count(*) AS n, round(avg((margin > 0)::INT), 6) AS accuracy, round(avg(margin), 6) AS mean_margin FROM m GROUP BY ALL")
def reward_margin_accuracy(s, d):
    """Implicit-reward accuracy over a table of log-probability margins (here seeded from the texts)."""
    p = pairs(s, d).filter("chosen IS NOT NULL AND rejected IS NOT NULL")
    m = p.select("condition", ((parse.hash32(F.col("chosen")) % 1000 - parse.hash32(F.col("rejected")) % 1000) / 100.0).alias("margin"))
    return m.groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg((F.col("margin") > 0).cast("double")), 6).alias("accuracy"), F.round(F.avg("margin"), 6).alias("mean_margin"))


# -- reward model ------------------------------------------------------------------------------------------------
@query(f"WITH {PA} SELECT pair_id, " + ", ".join(f"round({q.replace('{0}', 'chosen')}, 6)::DOUBLE AS {f}" for f, q in F_SQL.items()) + " FROM pa WHERE chosen IS NOT NULL")
def text_features(s, d):
    f = reward.text_features(F.col("chosen"))
    return pairs(s, d).filter("chosen IS NOT NULL").select("pair_id", *[F.round(c, 6).alias(k) for k, c in f.items()])


DIFF = "df AS (SELECT pair_id, condition, " + ", ".join(f"({q.replace('{0}', 'chosen')} - {q.replace('{0}', 'rejected')})::DOUBLE AS {f}" for f, q in F_SQL.items()) + " FROM pa WHERE chosen IS NOT NULL AND rejected IS NOT NULL)"


@query(f"WITH {PA} SELECT condition, count(*) AS n, round(avg(CASE WHEN {WORDS.format('chosen')} > {WORDS.format('rejected')} THEN 1.0 WHEN {WORDS.format('chosen')} = {WORDS.format('rejected')} THEN 0.5 ELSE 0 END::DOUBLE), 6) AS accuracy FROM pa WHERE chosen IS NOT NULL AND rejected IS NOT NULL GROUP BY ALL")
def longer_wins_baseline(s, d):
    p = pairs(s, d).filter("chosen IS NOT NULL AND rejected IS NOT NULL")
    return reward.accuracy(p.withColumn("margin", word_count(F.col("chosen")) - word_count(F.col("rejected"))), ["condition"])


@query(f"WITH {PA}, {DIFF}, mg AS (SELECT condition, " + " + ".join(f"({w}) * {f}" for f, w in WEIGHTS.items()) + " AS margin FROM df) SELECT condition, count(*) AS n, round(avg(CASE WHEN margin > 0 THEN 1.0 WHEN margin = 0 THEN 0.5 ELSE 0 END::DOUBLE), 4) AS accuracy FROM mg GROUP BY ALL")
def fixed_margin_accuracy(s, d):
    p = pairs(s, d)
    got = reward.margins(reward.feature_differences(p), WEIGHTS).join(p.select("pair_id", "condition"), "pair_id")
    return reward.accuracy(got, ["condition"]).withColumn("accuracy", F.round("accuracy", 4))


@query()
def pairwise_reward_fit(s, d):
    return reward.cross_validated(pairs(s, d))


@query()
def embedding_pca(s, d):
    return reward.component_extremes(table(s, d, "embeddings"), "vec_id", "embedding")


@query(
    f"WITH {PA}, {DIFF}, mu AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}" for f in WEIGHTS) + " FROM df), im AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg(abs(({w}) * ({f} - m_{f}))) AS v FROM df, mu" for f, w in WEIGHTS.items())
    + ") SELECT feature, round(v, 6) AS importance, row_number() OVER (ORDER BY v DESC, feature) AS place FROM im"
)
def linear_shap(s, d):
    return reward.importance(reward.feature_differences(pairs(s, d)), WEIGHTS)


# -- usage -------------------------------------------------------------------------------------------------------
@query(f"WITH {R} SELECT model, count(*) AS calls, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens FROM r GROUP BY ALL")
def usage_by_model(s, d):
    return usage.usage_by_model(responses(s, d))


@query(f"WITH {R} SELECT model, count(*) AS calls, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens FROM r GROUP BY ALL")
def usage_by_model_stream(s, d):
    return usage_stream(s, f"{d}/llm_responses.parquet")


@query("WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t, value::BIGINT AS v0, floor(value)::BIGINT AS v FROM events) SELECT event_id, event_type, (sum(v) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW) - v)::BIGINT AS used FROM e")
def rolling_tokens(s, d):
    e = table(s, d, "events").withColumn("tokens", F.floor("value"))
    return usage.rolling_sum(e, "event_type", "ts", "tokens", "event_id", seconds=1800)


@query("WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t, floor(value)::BIGINT AS v FROM events) SELECT event_id, event_type, (sum(v) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN 10799999999 PRECEDING AND CURRENT ROW) - v)::BIGINT AS used FROM e")
def rolling_tokens_long(s, d):
    """A window of three hours, longer than the default bucket."""
    e = table(s, d, "events").withColumn("tokens", F.floor("value"))
    return usage.rolling_sum(e, "event_type", "ts", "tokens", "event_id", seconds=10_800)


@query(
    "WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t, floor(value)::BIGINT AS v FROM events), u AS (SELECT event_id, event_type, v, (sum(v) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW) - v)::BIGINT AS used FROM e) "
    "SELECT event_id, event_type, used, used = 0 OR used + v <= 100 AS admit FROM u"
)
def token_admission(s, d):
    e = table(s, d, "events").withColumn("tokens", F.floor("value"))
    return usage.admissions(e, "event_type", "ts", "tokens", "event_id", limit=100, seconds=1800)


@query("WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) SELECT event_id, event_type, (max(t - k * 1200000000) OVER (PARTITION BY event_type ORDER BY k ROWS UNBOUNDED PRECEDING) + k * 1200000000)::BIGINT AS start_us FROM e")
def spaced_starts(s, d):
    return usage.spaced_starts(table(s, d, "events"), "event_type", "ts", "event_id", 1_200_000_000)


@query("WITH q AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, resp_id DESC) AS rn FROM (SELECT DISTINCT ON (resp_id) * FROM llm_responses ORDER BY resp_id, loaded_at) WHERE cache_key IS NOT NULL) SELECT cache_key, resp_id, model, text FROM q WHERE rn = 1")
def cache_newest(s, d):
    r = responses(s, d).select("cache_key", "resp_id", "model", "text", "created_at")
    return usage.newest(r, "cache_key", ["created_at", "resp_id"]).select("cache_key", "resp_id", "model", "text")


@query(f"WITH {PA}, {R}, k AS (SELECT DISTINCT cache_key FROM r) SELECT condition, count(chosen_key) AS n_keys, count(k.cache_key) AS n_found FROM pa LEFT JOIN k ON pa.chosen_key = k.cache_key GROUP BY ALL")
def cache_lookup(s, d):
    keys = responses(s, d).select(F.col("cache_key").alias("chosen_key")).filter("chosen_key IS NOT NULL").distinct().withColumn("hit", F.lit(1))
    return pairs(s, d).join(keys, "chosen_key", "left").groupBy("condition").agg(F.count("chosen_key").alias("n_keys"), F.count("hit").alias("n_found"))


PLAN = (
    "cond(name, train, candidates, labels, scaling) AS (VALUES ('human',NULL,'hh_rlhf','human',false),('random',NULL,'multi_persona','random',false),('length',NULL,'multi_persona','longer',false),"
    "('single_single',NULL,'single_persona','single_judge',false),('single_panel',NULL,'single_persona','panel',false),('multi_single',NULL,'multi_persona','single_judge',false),"
    "('multi_panel',true,'multi_persona','panel',true),('untrained',false,'other_source','panel',true)), "
    "used AS (SELECT candidates AS source, labels, CASE WHEN scaling THEN 2000 ELSE 1000 END AS n FROM cond WHERE coalesce(train, true) AND candidates NOT IN ('hh_rlhf','policy_samples')), "
    "need AS (SELECT source, NULL AS method, max(n)::BIGINT AS n FROM used GROUP BY source UNION ALL SELECT source, labels, max(n)::BIGINT FROM used WHERE labels IN ('panel','single_judge') GROUP BY source, labels), "
    "pl AS (SELECT 'train' AS split, source, method, n FROM need UNION ALL SELECT 'dev', source, method, 200::BIGINT FROM need)"
)


@query(f"WITH {PLAN} SELECT split, source, method, n FROM pl")
def label_plan(s, d):
    return planning.label_plan(planning.example_conditions(s), 1000, 2000, 200)


@query(f"WITH {PLAN}, c AS (SELECT 'heron-20b' AS model, n * 4 AS calls FROM pl WHERE method IS NULL UNION ALL SELECT 'heron-120b', n * 6 FROM pl WHERE method = 'single_judge' UNION ALL SELECT m, n * 2 FROM pl, (VALUES ('heron-120b'),('heron-20b'),('quartz-27b')) t(m) WHERE method = 'panel') SELECT model, sum(calls)::BIGINT AS calls, CASE model WHEN 'quartz-27b' THEN NULL ELSE ceil(sum(calls) / 1000.0) END::BIGINT AS days FROM c GROUP BY model")
def api_budget(s, d):
    judges = s.createDataFrame([("single_judge", "heron-120b", 6), ("panel", "heron-120b", 2), ("panel", "heron-20b", 2), ("panel", "quartz-27b", 2)], "method string, model string, calls_per_prompt int")
    quotas = s.createDataFrame([("heron-120b", 1000), ("heron-20b", 1000), ("quartz-27b", None)], "model string, rpd int")
    return planning.api_budget(label_plan(s, d), judges, quotas, "heron-20b", 4)


@query(f"WITH {PLAN} SELECT split, source, method, n, row_number() OVER (PARTITION BY split ORDER BY method IS NOT NULL, source, method) AS place FROM pl")
def plan_order(s, d):
    """Answers are generated before they are judged; a plan has a few rows a split."""
    return planning.ordered_plan(label_plan(s, d))


@query("SELECT v.variant, t.task FROM variants v, (VALUES ('gsm8k'),('halueval'),('truthful')) t(task)")
def variant_tasks(s, d):
    tasks = s.createDataFrame([("gsm8k",), ("halueval",), ("truthful",)], "task string")
    return table(s, d, "variants").select("variant").crossJoin(F.broadcast(tasks))  # three constant rows


@query("SELECT policy_model, max(variant) AS last_variant, arg_max(train_condition, variant) AS train_condition, count(*) AS n FROM variants GROUP BY ALL")
def last_run_per_model(s, d):
    return table(s, d, "variants").groupBy("policy_model").agg(F.max("variant").alias("last_variant"), F.max_by("train_condition", "variant").alias("train_condition"), F.count("*").alias("n"))


@query(f"WITH {PA}, m AS (SELECT condition, json_extract_string(meta, '$.method') AS method, json_extract(meta, '$.n_final')::INT AS n_final FROM pa) SELECT condition, coalesce(method, 'none') AS method, count(*) AS n, max(n_final) AS most_final FROM m GROUP BY ALL")
def pair_meta(s, d):
    m = pairs(s, d).select("condition", F.coalesce(F.get_json_object("meta", "$.method"), F.lit("none")).alias("method"), F.get_json_object("meta", "$.n_final").cast("int").alias("n_final"))
    return m.groupBy("condition", "method").agg(F.count("*").alias("n"), F.max("n_final").alias("most_final"))


# -- reports, protocol and layouts ---------------------------------------------------------------------------------
@query()
def agreement_report(s, d):
    """Overall, by subset, by confidence, per judge and round, first shown, no preference: with intervals from 10,000 resamples."""
    v = verdicts(s, d).filter("source = 'human_pair'")
    values = reports.agreement_values(v.select("prompt_id", "source").distinct(), v, judging.vote(v), prompts(s, d))
    return reports.rates(values, ["grp", "name"], "value")


@query(
    "WITH " + _vote_sql("source = 'human_pair'") + f", {P}, {AGREE}, k AS (SELECT j.*, coalesce(p.subset, 'unknown') AS subset FROM j LEFT JOIN p ON j.prompt_id = p.id), "
    "x AS (SELECT *, CASE WHEN hit = 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS none FROM k), hv AS (SELECT * FROM v0 WHERE source = 'human_pair' AND best IS NOT NULL), "
    "r AS (SELECT 'overall' AS grp, 'all' AS name, hit AS value FROM x UNION ALL SELECT 'subset', subset, hit FROM x UNION ALL SELECT 'confidence', confidence, hit FROM x UNION ALL SELECT 'no_preference', 'all', none FROM x "
    "UNION ALL SELECT 'judge_round', coalesce(judge, 'unknown') || ' r' || round, (best = 0)::INT::DOUBLE FROM hv UNION ALL SELECT 'first_shown', 'all', (list_position(permutation, best) = 1)::INT::DOUBLE FROM hv WHERE list_position(permutation, best) > 0) "
    "SELECT grp, name, count(value) AS n, round(avg(value), 6) AS rate FROM r WHERE name IS NOT NULL AND value IS NOT NULL GROUP BY ALL"
)
def agreement_values(s, d):
    v = verdicts(s, d).filter("source = 'human_pair'")
    values = reports.agreement_values(v.select("prompt_id", "source").distinct(), v, judging.vote(v), prompts(s, d))
    return values.groupBy("grp", "name").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("rate"))


NK = "greatest(coalesce(len(scores), 0), coalesce(len(permutation), 0))"


@query(
    "WITH " + _vote_sql("round = 2") + f", {R}, it AS (SELECT prompt_id, source, max({NK}) AS k FROM v0 GROUP BY ALL), g AS (SELECT split_part(tag, ':', 2) AS source, sum((text IS NULL OR {STRIP.format('text')} = '' OR coalesce(finish_reason, 'stop') = 'length')::INT) AS dropped FROM r WHERE tag LIKE 'gen:%' GROUP BY ALL) "
    "SELECT it.source, count(*) AS prompts, count(vote.prompt_id) AS pairs, count(*) FILTER (WHERE k < 2) AS too_few, count(*) FILTER (WHERE k >= 2 AND vote.prompt_id IS NULL) AS ties, coalesce(any_value(g.dropped), 0)::BIGINT AS dropped "
    "FROM it LEFT JOIN vote ON it.prompt_id = vote.prompt_id AND it.source = vote.source LEFT JOIN g ON g.source = it.source GROUP BY it.source"
)
def label_counts(s, d):
    v = verdicts(s, d)
    return reports.label_stats(v, judging.vote(v.filter("round = 2")), labels.dropped(responses(s, d)))


@query("WITH " + _vote_sql("round = 2") + ", h AS (SELECT source, 'chosen' AS role, chosen AS cand FROM vote UNION ALL SELECT source, 'rejected', rejected FROM vote) SELECT source, role, cand, count(*) AS n FROM h GROUP BY ALL")
def choice_histogram(s, d):
    return reports.choice_histogram(judging.vote(verdicts(s, d).filter("round = 2")))


@query("WITH " + _vote_sql("round = 2") + ", c AS (SELECT source, count(DISTINCT prompt_id) AS n_items, count(*) FILTER (WHERE v.verdict_id IS NULL) AS failed_calls FROM v0 LEFT JOIN v USING (verdict_id, source, prompt_id) GROUP BY source), a AS (SELECT source, count(*) AS n_pairs, round(avg(agreement), 6) AS mean_agreement FROM vote GROUP BY source) SELECT c.source, n_items, coalesce(n_pairs, 0) AS n_pairs, failed_calls, mean_agreement FROM c LEFT JOIN a ON c.source = a.source")
def spot_check(s, d):
    v = verdicts(s, d)
    return reports.spot_check(judging.with_totals(v), judging.vote(v.filter("round = 2")))


@query()
def winrate_intervals(s, d):
    """Shares, interval from 10,000 resamples, length-controlled rate and juror agreement of each compared pair."""
    w = winrate(s, d)
    return reports.win_report(w, evalstats.juror_rows(w))


@query(f"WITH {W}, sd AS (SELECT x AS variant, len_x AS w FROM w UNION ALL SELECT y, len_y FROM w) SELECT variant, count(w) AS n, round(avg(w), 6) AS words FROM sd WHERE w IS NOT NULL GROUP BY variant")
def variant_words(s, d):
    return reports.mean_words(winrate(s, d))


@query(
    f"WITH {PA}, a AS (SELECT min(pair_id) AS i FROM pa WHERE agreement = 1 AND prompt_id LIKE '%helpful%'), b AS (SELECT min(pair_id) AS i FROM pa WHERE agreement < 0.8 AND pair_id NOT IN (SELECT i FROM a WHERE i IS NOT NULL)), "
    "c AS (SELECT min(pair_id) AS i FROM pa WHERE prompt_id LIKE '%harmless%' AND pair_id NOT IN (SELECT i FROM a WHERE i IS NOT NULL UNION ALL SELECT i FROM b WHERE i IS NOT NULL)) "
    "SELECT * FROM (SELECT 'agreed' AS want, i AS pair_id FROM a UNION ALL SELECT 'split', i FROM b UNION ALL SELECT 'harmless', i FROM c) WHERE pair_id IS NOT NULL"
)
def first_examples(s, d):
    wants = {"agreed": (F.col("agreement") == 1) & F.col("prompt_id").contains("helpful"), "split": F.col("agreement") < 0.8, "harmless": F.col("prompt_id").contains("harmless")}
    return reports.first_examples(pairs(s, d), wants, "pair_id")


@query(f"WITH {VALID}, {GEN}, {P} SELECT v.verdict_id, p.prompt, a.text AS best_text, b.text AS worst_text FROM v JOIN c a ON a.prompt_id = v.prompt_id AND a.source = v.source AND a.cand = v.best JOIN c b ON b.prompt_id = v.prompt_id AND b.source = v.source AND b.cand = v.worst JOIN p ON p.id = v.prompt_id")
def walkthrough(s, d):
    return reports.walkthrough(judging.with_totals(verdicts(s, d)).filter("valid"), labels.candidates(responses(s, d)), prompts(s, d))


@query(f"WITH {PA}, g AS (SELECT DISTINCT condition, prompt_id FROM pa), m AS (SELECT prompt_id, count(*) AS k FROM g GROUP BY ALL), n AS (SELECT count(DISTINCT condition) AS k FROM g), f AS (SELECT count(*) AS n FROM m WHERE k = (SELECT k FROM n)) SELECT 'main' AS grp, condition, count(*) AS n_valid, (SELECT n FROM f) AS n_prompts FROM g GROUP BY condition")
def pairs_manifest(s, d):
    """The manifest of all conditions as rows (driver document: reports.build_manifest, write_pairs)."""
    p = pairs(s, d)
    names = sorted(r.condition for r in p.select("condition").distinct().collect())
    manifest, _ = reports.build_manifest(p, {"main": names})
    rows = [(g, c, n, m["n_prompts"]) for g, m in manifest["groups"].items() for c, n in m["per_condition_valid"].items()]
    return s.createDataFrame(rows, "grp string, condition string, n_valid long, n_prompts long")


@query(
    f"WITH {P}, i AS (SELECT id, unnest(range(4))::INT AS i FROM p), h AS (SELECT id, i, {H.format('concat_ws(' + chr(39) + '|' + chr(39) + ', ' + chr(39) + '1234' + chr(39) + ', id, i::VARCHAR)')} AS h FROM i) "
    "SELECT id, string_agg(i::VARCHAR, ',' ORDER BY h, i) AS shown FROM h GROUP BY id"
)
def label_shuffle(s, d):
    """The order in which a call on each prompt shows four candidates."""
    p = prompts(s, d).filter(F.col("id").isNotNull())
    return p.select("id", F.array_join(panel.shuffled_labels(F.lit(4), F.col("id")).cast("array<string>"), ",").alias("shown"))


@query(
    f"WITH {VALID}, f AS (SELECT prompt_id, source, best, worst, unnest(range(len(totals)))::INT AS cand, unnest(totals) AS t FROM v WHERE round = 1), "
    "per AS (SELECT prompt_id, source, cand, sum((best = cand)::INT)::VARCHAR || '/' || sum((worst = cand)::INT)::VARCHAR || '/' || printf('%.2f', round(avg(t::DOUBLE), 2)) AS x FROM f GROUP BY ALL), "
    "s AS (SELECT verdict_id, prompt_id, source, unnest(permutation) AS cand, unnest(range(len(permutation))) AS place FROM v WHERE round = 2), "
    "k AS (SELECT DISTINCT prompt_id, source FROM per) "
    "SELECT s.verdict_id, string_agg(chr(65 + s.place::INT) || ':' || coalesce(per.x, '-'), ' ' ORDER BY s.place) AS shown FROM s JOIN k ON k.prompt_id = s.prompt_id AND k.source = s.source LEFT JOIN per ON per.prompt_id = s.prompt_id AND per.source = s.source AND per.cand = s.cand GROUP BY s.verdict_id"
)
def peer_views(s, d):
    """Round one, in the letters of each verdict of round two."""
    return panel.peer_summary(verdicts(s, d))


@query(
    f"WITH {GEN}, {P}, it AS (SELECT c.prompt_id || '|' || c.source AS item, count(*) AS n FROM c JOIN p ON p.id = c.prompt_id GROUP BY ALL HAVING count(*) >= 2), "
    "js(judge, seat) AS (VALUES ('heron-120b', 0), ('heron-20b', 1), ('quartz-27b', 2)), "
    f"sh AS (SELECT item, judge, round, i, {H.format('concat_ws(' + chr(39) + '|' + chr(39) + ', ' + chr(39) + '1234' + chr(39) + ', item, ' + chr(39) + 'panel' + chr(39) + ', ' + chr(39) + 'r' + chr(39) + ' || round, seat::VARCHAR, i::VARCHAR)')} AS h "
    "FROM (SELECT item, judge, seat, round, unnest(range(n))::INT AS i FROM it, js, (VALUES (1), (2)) r(round))) "
    "SELECT item, judge, round::INT AS round, first(i ORDER BY h, i) AS best, last(i ORDER BY h, i) AS worst, round = 2 AS final FROM sh GROUP BY item, judge, round"
)
def panel_rounds(s, d):
    """The two-round protocol over all candidate groups, with a model that prefers what it is shown first."""
    c = labels.candidates(responses(s, d)).groupBy("prompt_id", "source").agg(F.array_sort(F.collect_list(F.struct("cand", "text")))["text"].alias("texts"))
    p = prompts(s, d).select(F.col("id").alias("prompt_id"), "prompt")
    items = c.join(p, "prompt_id").select(F.concat_ws("|", "prompt_id", "source").alias("prompt_id"), "prompt", "texts")
    criteria = ["helpfulness", "correctness", "harmlessness"]
    got = panel.panel(items, panel.FirstShown(criteria), ["heron-120b", "heron-20b", "quartz-27b"], criteria, retries=1)
    return got.filter("valid").select(F.col("prompt_id").alias("item"), "judge", "round", "best", "worst", "final")


@query(f"WITH {P}, g AS (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY id) AS rk FROM p) SELECT id, split, rk AS place FROM g WHERE rk <= 50")
def first_slice(s, d):
    """The first fifty records of each split in file order."""
    got = prep.lowest_per_group(prompts(s, d).select("id", "split"), ["split"], F.lit(0), "id", 50)
    return got.select("id", "split", F.col("rank").cast("long").alias("place"))


@query(
    f"WITH {P}, {PA}, u AS (SELECT 'human_labels' AS source, subset FROM p WHERE human_chosen IS NOT NULL AND human_rejected IS NOT NULL AND {STRIP.format('human_chosen')} <> {STRIP.format('human_rejected')} AND {STRIP.format('human_chosen')} <> '' AND {STRIP.format('human_rejected')} <> '' "
    f"UNION ALL SELECT 'preference_pairs', NULL FROM pa WHERE chosen IS NOT NULL AND rejected IS NOT NULL AND {STRIP.format('chosen')} <> {STRIP.format('rejected')} AND {STRIP.format('chosen')} <> '' AND {STRIP.format('rejected')} <> '') "
    "SELECT source, subset, count(*) AS n, 'mixed:human_labels+preference_pairs' AS label_source FROM u GROUP BY ALL"
)
def two_layouts(s, d):
    """Rows of both layouts as pairs, and the tag of their sources; unusable rows are left out before, as they raise."""
    fits = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & (strip(F.col(a)) != strip(F.col(b))) & (strip(F.col(a)) != "") & (strip(F.col(b)) != "")
    a = prompts(s, d).select("human_chosen", "human_rejected", "subset").filter(fits("human_chosen", "human_rejected"))
    b = pairs(s, d).select("chosen", "rejected").filter(fits("chosen", "rejected"))
    rows = reward.preference_rows(a.unionByName(b, allowMissingColumns=True))
    return rows.groupBy("source", "subset").agg(F.count("chosen").alias("n")).withColumn("label_source", F.lit(reward.label_source(rows)))


@query(f"WITH {GEN}, x AS (SELECT prompt_id, {WORDS.format('text')} AS w FROM c WHERE source = 'multi_persona' AND cand = 0), y AS (SELECT prompt_id, {WORDS.format('text')} AS w FROM c WHERE source = 'single_persona' AND cand = 0) SELECT x.prompt_id, x.w::INT AS words_x, y.w::INT AS words_y FROM x JOIN y ON x.prompt_id = y.prompt_id")
def answer_duels(s, d):
    """First answers of two sources on the same prompts, with their lengths."""
    c = labels.candidates(responses(s, d)).filter("cand = 0")
    of = lambda source, n: c.filter(F.col("source") == source).select("prompt_id", word_count(F.col("text")).alias(n))
    return of("multi_persona", "words_x").join(of("single_persona", "words_y"), "prompt_id")


@query(f"WITH {P}, {PA}, cs AS (SELECT DISTINCT condition FROM pa), done AS (SELECT DISTINCT condition, prompt_id FROM pa) SELECT cs.condition, p.split, count(*) AS todo FROM cs, p WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.condition = cs.condition AND done.prompt_id = p.id) GROUP BY ALL")
def condition_tasks(s, d):
    """Conditions x prompts that have no pair yet: counted from what is done, without forming the product."""
    p, done = prompts(s, d).select(F.col("id").alias("prompt_id"), "split"), pairs(s, d).select("condition", "prompt_id").distinct()
    every = p.groupBy("split").agg(F.count("*").alias("n"))
    have = done.join(p, "prompt_id").groupBy("condition", "split").agg(F.count("*").alias("k"))
    grid = F.broadcast(done.select("condition").distinct()).crossJoin(every)  # one row a condition and split
    return grid.join(have, ["condition", "split"], "left").select("condition", "split", (F.col("n") - F.coalesce("k", F.lit(0))).alias("todo")).filter("todo > 0")


@query(f"WITH {PA}, g AS (SELECT pair_id, condition, row_number() OVER (PARTITION BY condition ORDER BY {H.format(chr(39) + '7|' + chr(39) + ' || pair_id::VARCHAR')}, pair_id) AS rk FROM pa) SELECT pair_id, condition FROM g WHERE rk <= 20")
def spot_sample(s, d):
    """Twenty pairs of each condition by a seeded order."""
    return prep.lowest_per_group(pairs(s, d).select("pair_id", "condition"), ["condition"], prep.shuffled(F.col("pair_id").cast("string"), seed=7), "pair_id", 20).select("pair_id", "condition")


@query(f"WITH {P} SELECT id, gold_answer AS gold FROM p WHERE gold_answer IS NOT NULL")
def gold_parse(s, d):
    """The answer behind #### of a worked solution, here made from the prompt and its answer."""
    solution = F.concat_ws("\n#### ", "prompt", "gold_answer")
    return prompts(s, d).filter("gold_answer IS NOT NULL").select("id", parse.gold_number(solution).alias("gold"))


@query("SELECT variant, CASE WHEN policy_model LIKE 'Qwen/%' THEN 'qwen' WHEN policy_model LIKE 'HuggingFaceTB/SmolLM%' THEN 'smollm' WHEN policy_model LIKE 'microsoft/Phi%' THEN 'phi' ELSE 'unknown' END AS family FROM variants")
def variant_families(s, d):
    start = F.lit("unknown")
    for prefix, name in config.FAMILIES.items():
        start = F.when(F.col("policy_model").startswith(prefix), name).otherwise(start)
    return table(s, d, "variants").select("variant", start.alias("family"))


@query()
def subset_reward_models(s, d):
    """Reward models on the human pairs: all, and each subset with enough pairs."""
    p = prompts(s, d).filter("human_chosen IS NOT NULL AND human_rejected IS NOT NULL")
    return reward.subset_models(p.select(F.col("id").alias("pair_id"), "subset", F.col("human_chosen").alias("chosen"), F.col("human_rejected").alias("rejected")), folds=3)

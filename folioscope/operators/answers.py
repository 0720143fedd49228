"""Raw model answers to typed rows: prompts, candidates, parsing, normalisation, choice, call logs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folioscope.functions.text import clean_prose, clip, escape_data_tags, once, to_score, trimmed, without_emphasis
from folioscope.operators.repair import repair
from folioscope.params import CHECK_WEIGHTS, WS_CHARS, AnswerLimits

ANSWER = (
    "atsChecks array<struct<id:string,score:string,detail:string>>, weaknesses array<string>, "
    "suggestions array<struct<title:string,description:string,category:string,priority:string,targetTextSnippet:string>>, "
    "suggestedJobs array<struct<title:string,matchScore:string,reason:string,keyStrengths:array<string>,missingSkills:array<string>>>"
)
CATEGORIES = ("keywords", "skills", "structure", "format", "achievements", "readability", "general")


def build_prompts(texts: DataFrame, postings: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, posting_id, language, system, user): ``texts`` has mode, language, posting_id, partial.

    ``templates`` (mode, language, system) is a parameter table of a few rows. A partial answer that
    was cut off becomes a block of its own.
    """
    posting = postings.select("posting_id", F.col("text").alias("posting"))
    rows = texts.join(posting, "posting_id", "left").join(F.broadcast(templates), ["mode", "language"], "left")
    block = lambda tag, c: F.concat(F.lit(f"<{tag}>\n"), escape_data_tags(c), F.lit(f"\n</{tag}>"))
    parts = F.array_compact(F.array(block("cv", F.col("text")), F.when(F.col("mode") == "mode-a", block("posting", F.col("posting"))), F.when(F.coalesce("partial", F.lit("")) != "", block("output", F.col("partial")))))
    return rows.select("doc_id", "posting_id", "mode", "language", "system", F.array_join(parts, "\n\n").alias("user"))


#: What matters to the nesting of braces; all else is skipped by the pattern.
BRACE_TOKENS = re.compile(r'\\.|["{}]', re.S)


def objects_in(raw: str) -> list[str]:
    """Top-level {...} spans, by a fold over braces, quotes and escapes; quotes and escapes count only inside an object."""
    found, depth, start, quoted = [], 0, 0, False
    for m in BRACE_TOKENS.finditer(raw):
        at, c = m.start(), m[0]
        if len(c) == 2:  # an escape; outside a string the character after the backslash counts
            if quoted or c[1] not in '"{}':
                continue
            at, c = at + 1, c[1]
        if quoted:
            quoted = c != '"'
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            start = at if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                found.append(raw[start : at + 1])
    return found


@F.arrow_udf(ArrayType(StringType()))
def top_level_objects(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for raw in batches:
        yield pa.array([objects_in(r.as_py() or "") for r in raw], pa.list_(pa.string()))


FENCE = r"(?is)```(?:json)?\s*(.*?)```"


def fenced(text):
    """The text has a fenced block; most have no fence at all, so no pattern is matched against them."""
    return text.contains("```") & text.rlike(FENCE)


def blank(text):
    """Nothing but white space; looks no further than the first other character."""
    return F.ltrim(text, F.lit(WS_CHARS)) == ""


def candidates_of(text, objects):
    """A fenced block, the whole text, each object."""
    return F.concat(F.when(fenced(text), F.array(F.regexp_extract(text, FENCE, 1))).otherwise(F.array().cast("array<string>")), F.array(text), objects)


def answer_candidates(answers: DataFrame, limits: AnswerLimits = AnswerLimits()) -> DataFrame:
    """(answer_id, mode, language, cand_ord, candidate): a fenced block, the whole text, each object."""
    text = F.substring("raw", 1, limits.raw)
    held = answers.where(~blank(F.coalesce("raw", F.lit("")))).withColumn("__objects", top_level_objects(text))
    return held.select("answer_id", "mode", "language", F.posexplode(candidates_of(text, F.col("__objects"))).alias("cand_ord", "candidate"))


def valid(c):
    """The text is an object as it stands."""
    ends = lambda x: x.endswith("}")
    return F.coalesce(F.ltrim(c, F.lit(WS_CHARS)).startswith("{") & (ends(c) | ends(F.rtrim(c, F.lit(WS_CHARS)))) & F.get_json_object(c, "$").isNotNull(), F.lit(False))


def with_readings(rows: DataFrame, candidates: str) -> DataFrame:
    """Turns ``candidates``, an array of texts, into ``__readings`` (cand_ord, variant, text): all that are objects, in their row."""
    kept = [c for c in rows.columns if c != candidates]

    def both(text):
        mended = F.replace(F.replace(text, F.lit("','"), F.lit('","')), F.lit("{'"), F.lit('{"'))
        return F.struct(F.struct(text.alias("text"), valid(text).alias("ok")).alias("c"), F.when(mended != text, F.struct(mended.alias("text"), valid(mended).alias("ok"))).alias("m"))

    rows = rows.select(*kept, once(F.transform(candidates, both), "__pairs"))
    wrong = lambda n: F.transform("__pairs", lambda p: F.when(~p[n]["ok"], p[n]["text"]))
    wrong = F.when(F.exists("__pairs", lambda p: F.coalesce(~p["c"]["ok"] | ~p["m"]["ok"], F.lit(False))), F.concat(wrong("c"), wrong("m")))
    rows = rows.select(*kept, "__pairs", once(wrong, "__wrong")).withColumn("__mended", repair("__wrong"))
    repaired = lambda i: F.when(F.get("__mended", i).isNotNull(), F.struct(F.get("__mended", i).alias("text"), valid(F.get("__mended", i)).alias("ok")))

    def readings(p, i):
        distinct = F.array_distinct(F.array_compact(F.array(F.when(p["c"]["text"].isNotNull(), p["c"]), p["m"], repaired(i), repaired(F.size("__pairs") + i))))
        return F.filter(F.transform(distinct, lambda r, variant: F.struct(i.alias("cand_ord"), variant.alias("variant"), r["text"].alias("text"), r["ok"].alias("ok"))), lambda r: r["ok"])

    return rows.select(*kept, once(F.flatten(F.transform("__pairs", readings)), "__readings"))


def parse_variants(candidates: DataFrame) -> DataFrame:
    """Adds ``variant`` and ``answer`` for every reading of a candidate that is an object.

    Readings in order, equal ones once: as it is, with two apostrophe patterns mended, and both of
    them repaired, where they are not valid. A null candidate has no reading.
    """
    kept = [c for c in candidates.columns if c != "candidate"]
    rows = with_readings(candidates.select(*kept, F.array("candidate").alias("__texts")), "__texts")
    rows = rows.select(*kept, F.explode("__readings").alias("__r"))
    return rows.select(*kept, F.col("__r.variant").alias("variant"), once(F.from_json("__r.text", ANSWER, {"mode": "PERMISSIVE"}), "answer")).where(F.col("answer").isNotNull())


def by_language(col, language):
    return F.when(language == "id", clean_prose(col, "id")).otherwise(clean_prose(col, "en"))


def prose(col, n: int, language):
    return F.when(col.isNotNull(), clip(by_language(col, language), n)).otherwise("")


KEYS = ["answer_id", "mode", "language", "cand_ord", "variant"]


def normalize_checks(parsed: DataFrame, limits: AnswerLimits = AnswerLimits()) -> DataFrame:
    """The first entry of each known check that has a score. As all that follow here, decided in the answer's row."""
    scored = F.filter(F.transform("answer.atsChecks", lambda c: F.struct(F.lower(trimmed(c["id"])).alias("check_id"), to_score(c["score"]).alias("score"), c["detail"].alias("detail"))), lambda c: c["score"].isNotNull())
    rows = parsed.select(*KEYS, once(scored, "__scored")).where("__scored IS NOT NULL")
    first = F.transform(F.array(*map(F.lit, CHECK_WEIGHTS)), lambda k: F.get(F.filter("__scored", lambda c: c["check_id"] == k), F.lit(0)))
    rows = rows.select(*KEYS, F.explode(F.array_compact(first)).alias("f"))
    return rows.select(*KEYS, "f.check_id", "f.score", prose(F.col("f.detail"), limits.detail, F.col("language")).alias("detail"))


def normalize_suggestions(parsed: DataFrame, limits: AnswerLimits = AnswerLimits()) -> DataFrame:
    lang = F.col("language")

    def told(s):
        category = F.lower(trimmed(s["category"]))
        return F.struct(
            prose(s["title"], limits.title, lang).alias("title"), prose(s["description"], limits.description, lang).alias("description"),
            F.when(category.isin(*CATEGORIES), category).otherwise("general").alias("category"), F.when(s["priority"].isin("high", "low"), s["priority"]).otherwise("medium").alias("priority"),
            F.coalesce(clip(s["targetTextSnippet"], limits.snippet), F.lit("")).alias("snippet"),
        )

    good = F.filter(F.transform("answer.suggestions", told), lambda s: (s["title"] != "") & (s["description"] != ""))
    rows = parsed.select(*KEYS, F.posexplode(F.slice(good, 1, limits.suggestions)).alias("at", "s"))
    return rows.select(*KEYS, "s.*", (F.col("at") + 1).alias("sug_ord"))


def string_list(col, n: int, chars: int, language):
    kept = F.filter(F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x: prose(x, chars, language)), lambda x: x != "")
    return F.slice(kept, 1, n)


def normalize_jobs(parsed: DataFrame, limits: AnswerLimits = AnswerLimits()) -> DataFrame:
    """Jobs with title, score and reason; the five best, equal scores in the answer's order."""
    lang = F.col("language")
    items = lambda c: string_list(c, limits.items, limits.item, lang)
    told = lambda j, pos: F.struct((-to_score(j["matchScore"])).alias("down"), pos.alias("pos"), prose(j["title"], limits.title, lang).alias("job_title"), prose(j["reason"], limits.reason, lang).alias("reason"), items(j["keyStrengths"]).alias("key_strengths"), items(j["missingSkills"]).alias("missing_skills"))
    good = F.filter(F.transform("answer.suggestedJobs", told), lambda j: (j["job_title"] != "") & j["down"].isNotNull() & (j["reason"] != ""))
    rows = parsed.select(*KEYS, F.posexplode(F.slice(F.array_sort(good), 1, limits.jobs)).alias("at", "j"))
    return rows.select(*KEYS, "j.job_title", (-F.col("j.down")).alias("match_score"), "j.reason", "j.key_strengths", "j.missing_skills", (F.col("at") + 1).alias("job_ord"))


def normalize_weaknesses(parsed: DataFrame, limits: AnswerLimits = AnswerLimits()) -> DataFrame:
    return parsed.select(*KEYS, F.posexplode(string_list(F.col("answer.weaknesses"), limits.weaknesses, limits.weakness, F.col("language"))).alias("weak_ord", "weakness"))


def is_complete(answer, mode, limits: AnswerLimits):
    """Mode-b needs keyword, skills and five jobs, mode-a any check of the model's.

    Decided in the row, as ``normalize_checks`` and ``normalize_jobs`` would: prose with a letter or digit never
    cleans to nothing, and of what has neither only marks of emphasis go.
    """
    scored = lambda *names: F.coalesce(F.exists(answer["atsChecks"], lambda c: F.lower(trimmed(c["id"])).isin(*names) & to_score(c["score"]).isNotNull()), F.lit(False))
    told = lambda x, n: x.isNotNull() & (x.rlike(r"[\p{L}\p{N}]") | (clip(without_emphasis(x), n) != ""))
    good = F.filter(answer["suggestedJobs"], lambda j: to_score(j["matchScore"]).isNotNull() & told(j["title"], limits.title) & told(j["reason"], limits.reason))
    b = scored("keyword") & scored("skills") & (F.coalesce(F.size(good), F.lit(0)) >= limits.jobs)
    return F.when(mode == "mode-b", b).otherwise(scored("keyword", "skills", "sections", "quantified", "readability"))


def answer_complete(parsed: DataFrame, limits: AnswerLimits = AnswerLimits()) -> DataFrame:
    """Adds ``complete``, see ``is_complete``."""
    return parsed.withColumn("complete", is_complete(F.col("answer"), F.col("mode"), limits))


def read_answers(answers: DataFrame, limits: AnswerLimits = AnswerLimits()) -> DataFrame:
    """Per answer the first complete reading (cand_ord, variant) with its ``answer``, or the ``reason`` there is none.

    One pass without a shuffle. Most answers are complete as they come, in their first candidate; only
    the others are taken apart into all candidates and readings, in their row too.
    """
    keys = ["answer_id", "mode", "language"]
    text = F.substring("raw", 1, limits.raw)
    empty = blank(F.coalesce("raw", F.lit("")))
    first = F.when(~empty, F.when(fenced(text), F.regexp_extract(text, FENCE, 1)).otherwise(text))
    parse = lambda c: F.from_json(c, ANSWER, {"mode": "PERMISSIVE"})
    rows = answers.select(*keys, text.alias("__text"), once(F.struct(first.alias("first"), empty.alias("empty")), "__r"))
    rows = rows.select(*keys, "__text", F.col("__r.empty").alias("__empty"), once(F.when(valid(F.col("__r.first")), parse("__r.first")), "__first"))
    complete = F.coalesce(is_complete(F.col("__first"), F.col("mode"), limits), F.lit(False))
    rows = rows.select(*keys, "__text", "__empty", "__first", once(complete, "__complete"))
    rows = rows.select(*keys, "__empty", "__complete", F.when(F.col("__complete"), F.col("__first")).alias("__first"), F.when(~F.col("__complete") & ~F.col("__empty"), F.col("__text")).alias("__text"))
    rows = rows.withColumn("__objects", top_level_objects("__text"))
    held = [*keys, "__empty", "__complete", "__first"]
    rows = with_readings(rows.select(*held, F.when(F.col("__text").isNotNull(), candidates_of(F.col("__text"), F.col("__objects"))).alias("__texts")), "__texts")
    read = F.transform("__readings", lambda r: F.struct(r["cand_ord"].alias("cand_ord"), r["variant"].alias("variant"), parse(r["text"]).alias("answer")))
    rows = rows.select(*held, once(F.filter(read, lambda r: r["answer"].isNotNull()), "__read"))
    best = F.get(F.filter("__read", lambda r: F.coalesce(is_complete(r["answer"], F.col("mode"), limits), F.lit(False))), F.lit(0))
    at_once = F.struct(F.lit(0).alias("cand_ord"), F.lit(0).alias("variant"), F.col("__first").alias("answer"))
    rows = rows.select(*keys, "__empty", (F.size("__read") > 0).alias("__parsed"), once(F.when(F.col("__complete"), at_once).otherwise(best), "__best"))
    reason = F.when(F.col("__best").isNotNull(), None).when(F.col("__empty"), "empty").when(F.col("__parsed"), "incomplete").otherwise("no-json")
    return rows.select(*keys, "__best.cand_ord", "__best.variant", "__best.answer", reason.alias("reason"))


def pick_answer(answers: DataFrame, limits: AnswerLimits = AnswerLimits()) -> DataFrame:
    """``read_answers`` without what was read."""
    return read_answers(answers, limits).drop("answer")


# fixed values: results must agree on which provider messages mean no credit or a bad key
NO_CREDIT = r"(?i)insufficient_quota|insufficient balance|credit balance|out of credits|no credits|doesn't have any credits"
BAD_KEY = r'(?i)API_KEY_INVALID|(invalid|incorrect|not valid|pass a valid)[^"]{0,40}api[ _-]?key|api[ _-]?key[^"]{0,40}(invalid|incorrect|not valid)'


def call_outcome(calls: DataFrame) -> DataFrame:
    """Adds ``outcome``, ``code`` and ``content`` to call logs (provider, key_owner, status, body)."""
    status, body = F.col("status"), F.coalesce("body", F.lit(""))
    told = F.when(status.isin(400, 403, 429), body).otherwise("")
    routed = F.col("provider") == "openrouter"
    bad_key = F.when(F.col("key_owner") == "user", "AUTH_INVALID_KEY").otherwise("SERVICE_NOT_CONFIGURED")
    no_credit = (status == 402) | (~routed & told.rlike(NO_CREDIT))
    refused = F.when(routed, status == 401).otherwise(status.isin(401, 403) | ((status == 400) & told.rlike(BAD_KEY)))
    blocked = routed & (status == 403)
    ok = (status >= 200) & (status < 300)
    error = F.coalesce(F.get_json_object(body, "$.error.code"), F.get_json_object(body, "$.choices[0].error.code"))
    finish = F.get_json_object(body, "$.choices[0].finish_reason")
    content = F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), F.lit(""))
    inside = (
        F.when(F.get_json_object(body, "$").isNull(), "unavailable")
        .when(error == "429", "rate-limited")
        .when(error.isNotNull(), "unavailable")
        .when(finish == "length", "truncated")
        .when(finish.isin("error", "content_filter") | (trimmed(content) == ""), "unavailable")
        .otherwise("content")
    )
    rejected = F.when(routed, status == 400).otherwise(status.isin(400, 404) | ((status >= 300) & (status < 400)))
    outcome = F.when(ok, inside).when(no_credit | refused | blocked, "stop").when(status == 429, "rate-limited").when(rejected, "rejected").otherwise("unavailable")
    code = F.when(~ok & no_credit, "CREDITS_EXHAUSTED").when(~ok & refused, bad_key).when(~ok & blocked, "CONTENT_BLOCKED")
    return calls.withColumn("outcome", outcome).withColumn("code", code).withColumn("content", F.when(outcome.isin("content", "truncated"), content))


def resolve_attempts(attempts: DataFrame, budget_ms: int = 120_000) -> DataFrame:
    """One row an analysis: the first parseable answer, or the error that ends the run.

    ``attempts``: analysis_id, attempt_ord, model, outcome, parsed (boolean), content, code, elapsed_ms.
    """
    by = Window.partitionBy("analysis_id").orderBy("attempt_ord")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = attempts.withColumn("spent", F.coalesce(F.sum("elapsed_ms").over(before), F.lit(0)))
    kind = F.when(F.col("spent") >= budget_ms, "timeout").when((F.col("outcome") == "content") & F.col("parsed"), "done").when(F.col("outcome") == "stop", "stop")
    partial = (F.col("outcome") == "truncated") & (trimmed(F.coalesce("content", F.lit(""))) != "")
    rows = rows.withColumn("ends", kind).withColumn("partial_before", F.coalesce(F.bool_or(partial).over(before), F.lit(False))).withColumn("first_model", F.first("model").over(by))
    failure = F.when(F.col("outcome") == "unavailable", "MODEL_UNAVAILABLE").when(F.col("outcome") == "truncated", "TOKEN_LENGTH_EXCEEDED").when(F.col("outcome") == "content", "JSON_PARSE_FAILED")
    out = rows.groupBy("analysis_id").agg(
        F.min_by(F.struct("ends", "model", "first_model", "partial_before", "code"), F.when(F.col("ends").isNotNull(), F.col("attempt_ord"))).alias("e"),
        F.count("*").alias("n"), F.count_if(F.col("outcome") == "rejected").alias("rejected"), F.count_if(F.col("outcome").isin("rejected", "rate-limited")).alias("limited"),
        F.max_by(failure, F.when(failure.isNotNull(), F.col("attempt_ord"))).alias("last_failure"),
    )
    done = F.coalesce(F.col("e.ends") == "done", F.lit(False))
    error = (
        F.when(done, None).when(F.col("e.ends") == "timeout", "NETWORK_TIMEOUT").when(F.col("e.ends") == "stop", F.col("e.code"))
        .when(F.col("rejected") == F.col("n"), "INVALID_INPUT").when(F.col("limited") == F.col("n"), "RATE_LIMITED_429").otherwise(F.coalesce("last_failure", F.lit("MODEL_UNAVAILABLE")))
    )
    return out.select("analysis_id", F.when(done, F.col("e.model")).alias("model_used"), F.when(done, F.col("e.model") != F.col("e.first_model")).alias("failover"), F.when(done, F.col("e.partial_before")).alias("continuation"), error.alias("error_code"))

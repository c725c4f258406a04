"""Checks of where answers come from. Each gives every violation as a row, none if all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.answers import equivalent
from corpusloom.functions.text import leaks_credentials
from corpusloom.operators.contain import occurrences

# What a follow-up search is asked for by, the models allowed and the states of a call.
FOLLOW_UP = "补充检索[:：]\\s*([^\\n]+)"
CALL_STATES = ("ok", "request_error")


def _problems(rows: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """``key, problem``: a row for each check that a row fails; a check that is null fails."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return rows.select(*key, F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("problem"))


def allowed_model(model: Column, pattern: str) -> Column:
    """Whether a model's whole name fits the pattern."""
    return F.coalesce(model.rlike(f"^(?:{pattern})$"), F.lit(False))


def call_shape(calls: DataFrame, models: str) -> DataFrame:
    """``line, problem`` of call records that lack what each must have.

    Takes ``line, status, qid, model, attempt, started_at, finished_at, n_messages, max_tokens, total_tokens, error_type, error``. A failed call
    has an error and no usage, and its message no credential; a good one has a usage and no error. Times are finite. See call_fields() for the
    fields of the record itself.
    """
    failed = F.col("status") == "request_error"
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")  # noqa: E731  (NaN is larger than infinity here)
    return _problems(
        calls,
        ["line"],
        {
            "status": F.col("status").isin(*CALL_STATES),
            "model": allowed_model(F.col("model"), models),
            "qid": F.trim(F.col("qid").cast("string")) != "",
            "attempt": F.col("attempt") >= 1,
            "timestamps": finite("started_at") & finite("finished_at") & (F.col("finished_at") >= F.col("started_at")),
            "messages": F.col("n_messages") >= 1,
            "max_tokens": F.col("max_tokens") >= 1,
            "usage": F.when(failed, F.col("total_tokens").isNull()).otherwise(F.col("total_tokens").isNotNull()),
            "error": F.when(failed, (F.trim("error_type") != "") & F.col("error").isNotNull()).otherwise(F.col("error").isNull()),
            "credential": ~leaks_credentials(F.col("error")),
        },
    )


# The fields of a call's record, those that its outcome adds, and those of its request.
CALL_FIELDS, OK_FIELDS, ERROR_FIELDS = ("status", "qid", "tag", "model", "attempt", "started_at", "finished_at", "request"), ("response", "usage"), ("error",)
REQUEST_FIELDS = ("messages", "max_tokens", "temperature", "extra_body")


def call_fields(records: DataFrame) -> DataFrame:
    """``line, problem`` of records ``line, record`` (JSON text) that have other fields than a call must have, or fields of another kind.

    Numbers are no booleans or strings; attempts and most tokens are whole and 1 at least.
    """
    v = F.col("v")
    at = lambda path: F.try_variant_get(v, path, "variant")
    kind = lambda path: F.schema_of_variant(at(path))
    keys = lambda c: F.array_sort(F.json_object_keys(c))
    names = lambda *n: F.array(*[F.lit(x) for x in sorted(n)])
    counted = lambda path: (kind(path) == "BIGINT") & (F.try_variant_get(v, path, "bigint") >= 1)
    number = lambda path: kind(path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    good = F.try_variant_get(v, "$.status", "string") == "ok"
    rows = records.select("line", "record", F.try_parse_json("record").alias("v"))
    return _problems(
        rows,
        ["line"],
        {
            "fields": keys(F.col("record")) == F.when(good, names(*CALL_FIELDS, *OK_FIELDS)).otherwise(names(*CALL_FIELDS, *ERROR_FIELDS)),
            "attempt": counted("$.attempt"),
            "timestamps": number("$.started_at") & number("$.finished_at"),
            "request fields": keys(F.get_json_object("record", "$.request")) == names(*REQUEST_FIELDS),
            "messages": kind("$.request.messages").startswith("ARRAY") & at("$.request.messages[0]").isNotNull(),
            "controls": counted("$.request.max_tokens") & number("$.request.temperature") & kind("$.request.extra_body").startswith("OBJECT"),
        },
    )


def concrete_evidence(entries: DataFrame) -> DataFrame:
    """``qid, problem`` of evidence that isn't there, isn't whole, is of no selected document, or is in another order than its ids.

    Takes ``qid, selected array<string>, evidence_ids array<string>, chunks array<struct<evidence_id,doc_id,quoted_clause,missing>>``.
    """
    chunks, blank = F.col("chunks"), lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return _problems(
        entries,
        ["qid"],
        {
            "selected": (F.size("selected") > 0) & ~F.exists("selected", blank),
            "evidence_ids": (F.size("evidence_ids") > 0) & ~F.exists("evidence_ids", blank),
            "chunks": F.size("chunks") > 0,
            "missing": ~F.exists(chunks, lambda c: F.coalesce(c["missing"], F.lit(False))),
            "fields": ~F.exists(chunks, lambda c: blank(c["evidence_id"]) | blank(c["doc_id"]) | blank(c["quoted_clause"])),
            "unselected": F.forall(chunks, lambda c: F.array_contains("selected", c["doc_id"])),
            "order": F.transform(chunks, lambda c: c["evidence_id"]) == F.col("evidence_ids"),
        },
    )


def signature(qid: Column, model: Column, tag: Column, usage: Column) -> Column:
    """A call in one string: its usage is a map, taken in the order of its keys."""
    entries = F.transform(F.array_sort(F.map_entries(usage)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return F.concat_ws("|", qid.cast("string"), F.coalesce(model, F.lit("")), F.coalesce(tag, F.lit("")), F.array_join(entries, ","))


def follow_ups(content: Column) -> Column:
    """The searches that a response asks for."""
    return F.transform(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(FOLLOW_UP), F.lit(1)), F.trim)


def query_surface(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """``qid, surface array<string>``: the question, its options and the follow-ups of its responses, each once, as they first come.

    Takes ``qid, question, options array<string>`` and ``qid, call_no, content``.
    """
    more = responses.groupBy("qid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("call_no", follow_ups(F.col("content")).alias("f")))), lambda x: x["f"])).alias("more"))
    none = F.array().cast("array<string>")
    joined = questions.join(more, "qid", "left")
    return joined.select("qid", F.array_distinct(F.filter(F.concat(F.array("question"), F.coalesce("options", none), F.coalesce("more", none)), lambda x: F.trim(x) != "")).alias("surface"))


def reasoning_origin(finals: DataFrame, calls: DataFrame) -> DataFrame:
    """``qid, problem``: answers whose reasoning no good call of the question contains, word for word, or that another question's call has alone.

    Takes ``qid, reasoning`` and ``qid, status, content`` with, if there is one, ``reasoning_content``: either may contain it. A reasoning is looked
    for in the question's own calls; what is not there is searched for in all others at once.
    """
    fields = [c for c in ("content", "reasoning_content") if c in calls.columns]
    said = calls.filter("status = 'ok'").select("qid", F.explode(F.array(*fields)).alias("said")).filter("said is not null")
    own = finals.select("qid", F.trim(F.coalesce("reasoning", F.lit(""))).alias("reasoning"))
    found = own.join(said, "qid").filter((F.col("reasoning") != "") & F.contains("said", F.col("reasoning"))).select("qid").distinct()
    rest = own.join(found, "qid", "left_anti")
    elsewhere = occurrences(said, rest, "qid", "said", "reasoning").select("reasoning").distinct().withColumn("others", F.lit(True))
    problem = F.when(F.col("reasoning") == "", "blank").when(F.col("others"), "another question").otherwise("no call")
    return rest.join(elsewhere, "reasoning", "left").select("qid", problem.alias("problem"))


def reasoning_provenance(finals: DataFrame, sources: DataFrame) -> DataFrame:
    """``qid, problem``: what is wrong with where an answer's reasoning is said to come from.

    Takes finals ``qid, answer, reasoning`` and sources ``qid, reasoning, stage, evidence_ids, raw_answer, traces array<struct<stage,content,answer,evidence_ids>>``.
    A source tells the submitted reasoning and its stage; of its traces, which all have a stage, a content and evidence, some have just that stage and
    content, and among these are one with an equivalent answer and one with just the source's evidence. A raw answer, if there is one, says the same as the final one.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    listed = lambda c: (F.size(c) > 0) & ~F.exists(c, blank)
    rows = finals.select("qid", "answer", F.col("reasoning").alias("submitted"), F.lit(True).alias("asked")).join(sources.withColumn("told", F.lit(True)), "qid", "full")
    both = F.col("asked") & F.col("told")
    rows = rows.withColumn("chosen", F.filter("traces", lambda t: (t["stage"] == F.col("stage")) & (t["content"] == F.col("reasoning"))))
    whole = lambda t: ~blank(t["stage"]) & t["content"].isNotNull() & (F.size(t["evidence_ids"]) >= 0) & ~F.exists(t["evidence_ids"], blank)
    # null where a question or its source is missing, which the first two checks tell alone
    alone = lambda ok: F.when(~F.coalesce(both, F.lit(False)), True).otherwise(ok)
    return _problems(
        rows,
        ["qid"],
        {
            "source": F.col("told"),
            "question": F.col("asked"),
            "reasoning": alone(F.col("reasoning").eqNullSafe(F.col("submitted"))),
            "stage": alone(~blank(F.col("stage")) & (F.size("traces") > 0)),
            "traces": alone(F.forall("traces", whole)),
            "no trace": alone(F.size("chosen") > 0),
            "answer": alone(F.exists("chosen", lambda t: equivalent(t["answer"], F.col("answer")))),
            "evidence": alone(listed(F.col("evidence_ids")) & F.exists("chosen", lambda t: t["evidence_ids"] == F.col("evidence_ids"))),
            "raw answer": alone(blank(F.col("raw_answer")) | equivalent(F.col("raw_answer"), F.col("answer"))),
        },
    )


def evidence_sent(traces: DataFrame, responses: DataFrame, chunks: DataFrame) -> DataFrame:
    """``qid, stage, problem`` of traces and responses that don't go with each other, one for one, and of evidence that was not sent.

    Takes traces ``qid, stage, content, evidence_ids``, good responses ``qid, tag, content, prompt`` and chunks ``evidence_id, rendered``. Contents meet by their digests: as many
    responses as traces have a question's tag and content. Each chunk that a trace cites is there, and in the prompt of a response to it.
    """
    key = F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("digest")
    t = traces.select("qid", "stage", key, "evidence_ids")
    r = responses.select("qid", F.col("tag").alias("stage"), key, "prompt")
    by = ["qid", "stage", "digest"]
    both = t.groupBy(*by).agg(F.count(F.lit(1)).alias("a")).join(r.groupBy(*by).agg(F.count(F.lit(1)).alias("b")), by, "full").na.fill(0)
    counted = both.select("qid", "stage", F.when(F.col("a") > F.col("b"), "no response").when(F.col("b") > F.col("a"), "no trace").alias("problem")).filter("problem is not null")
    cited = t.select(*by, F.explode("evidence_ids").alias("evidence_id")).distinct().join(chunks, "evidence_id", "left")
    gone = cited.filter("rendered is null").select("qid", "stage", F.lit("no chunk").alias("problem"))
    sent = cited.filter("rendered is not null").join(r, by).groupBy(*by, "evidence_id").agg(F.max(F.contains("prompt", F.col("rendered"))).alias("sent"))
    unsent = sent.filter(~F.coalesce("sent", F.lit(False))).select("qid", "stage", F.lit("not sent").alias("problem"))
    return counted.unionByName(gone).unionByName(unsent).distinct()


def config_differences(entries: DataFrame, config: dict[str, str]) -> DataFrame:
    """``qid, key, problem``: entries ``qid, config map<string,string>`` that lack a key of the checked run, have another, or another value."""
    run = F.create_map(*[F.lit(x) for pair in sorted(config.items()) for x in pair]).cast("map<string,string>")
    keys = F.array_distinct(F.concat(F.map_keys(run), F.coalesce(F.map_keys("config"), F.array().cast("array<string>"))))
    rows = entries.select("qid", "config", F.explode(keys).alias("key")).withColumn("own", F.try_element_at("config", F.col("key"))).withColumn("run", F.try_element_at(run, F.col("key")))
    problem = F.when(F.col("own").isNull(), "missing").when(F.col("run").isNull(), "added").when(F.col("own") != F.col("run"), "changed")
    return rows.select("qid", "key", problem.alias("problem")).filter("problem is not null")


def route_differences(logged: DataFrame, replayed: DataFrame) -> DataFrame:
    """``qid, problem``: questions whose logged picks ``qid, picked array<string>`` a second routing doesn't give again, in the same order."""
    joined = logged.select("qid", F.col("picked").alias("a")).join(replayed.select("qid", F.col("picked").alias("b")), "qid", "full_outer")
    problem = F.when(F.col("b").isNull(), "not replayed").when(F.col("a").isNull(), "not logged").when(F.col("a") != F.col("b"), "changed")
    return joined.select("qid", problem.alias("problem")).filter("problem is not null")


def letters_changed(before: Column, after: Column) -> Column:
    """Letters that only one of two answers has, in order."""
    of = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return F.array_sort(F.concat(F.array_except(of(before), of(after)), F.array_except(of(after), of(before))))

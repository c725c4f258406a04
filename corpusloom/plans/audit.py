"""Audit queries. Conversations stand for questions, their turns for calls, text lengths for token counts; events for retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import audit as A
from corpusloom.operators import flow
from corpusloom.plans.catalogue import register
from corpusloom.session import spread, table


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    n = F.length("text").cast("long")
    return c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("call_no"), F.col("role").alias("tag"), F.when(F.col("role") != "assistant", n).otherwise(0).alias("prompt_tokens"), F.when(F.col("role") == "assistant", n).otherwise(0).alias("completion_tokens"), "text")


CALLS = "calls AS (SELECT conv_id AS qid, turn AS call_no, role AS tag, CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END AS prompt_tokens, CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS completion_tokens, text FROM conversations)"


@register(f"WITH {CALLS} SELECT qid, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens, count(*)::BIGINT AS n_calls FROM calls GROUP BY qid")
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ledger(_calls(spark, sf_dir))


@register(f"WITH {CALLS} SELECT CASE WHEN grouping(qid) = 1 THEN 'summary' ELSE qid::VARCHAR END AS qid, CASE WHEN grouping(qid) = 1 THEN 0 ELSE 1 END AS place, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens FROM calls GROUP BY ROLLUP (qid)")
def submission_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.submission(_calls(spark, sf_dir))


@register(f"WITH {CALLS}, a AS (SELECT qid, sum(prompt_tokens + completion_tokens)::BIGINT AS calls FROM calls GROUP BY qid), b AS (SELECT qid, sum(length(replace(text, '  ', ' ')))::BIGINT AS texts FROM calls WHERE tag <> 'system' GROUP BY qid) SELECT qid, calls, texts FROM a FULL JOIN b USING (qid) WHERE calls IS DISTINCT FROM texts")
def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _calls(spark, sf_dir)
    texts = c.filter("tag <> 'system'").select("qid", F.length(F.replace("text", F.lit("  "), F.lit(" "))).cast("long").alias("total"))
    return A.reconcile({"calls": c.select("qid", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total")), "texts": texts})


@register("SELECT role, n_words, sum(x)::BIGINT AS surplus FROM (SELECT role, len(string_split(text, ' '))::INT AS n_words, 1 AS x FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT role, len(string_split(text, ' '))::INT, -1 FROM conversations WHERE turn % 2 = 1) GROUP BY ALL HAVING sum(x) <> 0")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("turn", "role", F.size(F.split("text", " ", -1)).alias("n_words"))
    return A.multiset_diff(c.filter("turn % 2 = 0").drop("turn"), c.filter("turn % 2 = 1").drop("turn"))


@register("WITH d AS (SELECT doc_id FROM documents), l AS (SELECT DISTINCT doc_id + doc_id % 3 AS doc_id FROM labels) SELECT doc_id, 'missing' AS problem FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT doc_id, 'unexpected' FROM l WHERE doc_id NOT IN (SELECT doc_id FROM d)")
def coverage_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") + F.col("doc_id") % 3).alias("doc_id"))
    return A.coverage(table(spark, sf_dir, "documents").select("doc_id"), labels, "doc_id")


@register(
    """WITH c AS (SELECT user_id AS qid, event_type AS tag, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) + CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END)::INT AS attempt, value > 50 AS ok, user_id % 5 AS request FROM events),
g AS (SELECT qid, tag, count(*)::BIGINT AS n, max(attempt) AS most, min(attempt) AS least, count(DISTINCT attempt) AS kinds, count(*) FILTER (ok) AS oks, arg_max(ok, attempt) AS last_ok FROM c GROUP BY ALL)
SELECT * FROM (SELECT qid, tag, n, CASE WHEN least <> 1 OR most <> n OR kinds <> n THEN 'attempts' WHEN NOT last_ok THEN 'not answered' WHEN oks > 1 THEN 'answered twice' END AS problem FROM g) WHERE problem IS NOT NULL"""
)
def retry_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("tag"), "ts", "event_id", (F.col("value") > 50).alias("ok"), (F.col("user_id") % 5).alias("request"))
    calls = A.sequence_numbers(e, ["qid", "tag"], ["ts", "event_id"], "attempt").withColumn("attempt", F.col("attempt") + F.when(F.col("qid") % 7 == 0, 1).otherwise(0))
    return A.retries(calls)


@register("WITH a AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS s FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 10 = 4 THEN text || '.' ELSE text END) AS s FROM documents WHERE doc_id % 10 <> 5) SELECT path, CASE WHEN b.s IS NULL THEN 'missing' WHEN a.s IS NULL THEN 'added' ELSE 'changed' END AS problem FROM a FULL JOIN b USING (path) WHERE a.s IS DISTINCT FROM b.s")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    text = F.when(F.col("doc_id") % 10 == 4, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return A.manifest_diff(A.manifest(d.filter("doc_id % 10 <> 3"), content="text"), A.manifest(d.filter("doc_id % 10 <> 5").withColumn("text", text), content="text"))


@register(
    """WITH e AS (SELECT source, doc_id::VARCHAR AS path, sha256(text) AS s FROM documents),
b AS (SELECT source, left(md5(path), 2) AS block, count(*) AS n, sha256(string_agg(path || chr(0) || s || chr(10), '' ORDER BY path)) AS digest FROM e GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS n, sha256(string_agg(digest, '' ORDER BY block)) AS tree_sha256 FROM b GROUP BY source"""
)
def tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    entries = d.select("source", F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return A.tree_hash(entries, "source")


@register(
    """WITH q AS (SELECT DISTINCT conv_id AS qid FROM conversations), u AS (SELECT conv_id AS qid, string_agg(turn || ':' || length(text), ',' ORDER BY turn) AS asked, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1),
a AS (SELECT conv_id AS qid, string_agg(turn || ':' || length(text), ',' ORDER BY turn) AS answered FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT qid, coalesce(asked, '') AS asked, coalesce(answered, '') AS answered, coalesce(n, 0)::BIGINT AS n_asked FROM q LEFT JOIN u USING (qid) LEFT JOIN a USING (qid)"""
)
def evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), "turn", "role", F.length("text").alias("n"))
    part = lambda role: (c.filter(F.col("role") == role).drop("role"), "turn")
    out = A.assembled(c.select("qid").distinct(), {"u": part("user"), "a": part("assistant")})
    shown = lambda x: F.array_join(F.transform(x, lambda r: F.concat(r["turn"].cast("string"), F.lit(":"), r["n"].cast("string"))), ",")
    return out.select("qid", shown("u").alias("asked"), shown("a").alias("answered"), F.size("u").cast("long").alias("n_asked"))


@register("WITH t AS (SELECT conv_id AS qid, unnest([conv_id, conv_id * 5, conv_id * 50]) AS chunk_id, generate_subscripts([conv_id, conv_id * 5, conv_id * 50], 1) - 1 AS ord FROM conversations WHERE turn = 0) SELECT qid, ord::INT AS ord, chunk_id, chunk_id NOT IN (SELECT doc_id FROM documents) AS missing FROM t")
def cited_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("conv_id")
    traces = table(spark, sf_dir, "conversations").filter("turn = 0").select(i.alias("qid"), F.array(i, i * 5, i * 50).alias("evidence_ids"))
    return A.cited(traces, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")))


@register("SELECT source, count(*)::BIGINT AS n, count(l.doc_id)::BIGINT AS n_labelled, sum(quality)::BIGINT AS n_good, sum(toxic)::BIGINT AS n_toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def label_quality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").withColumn("there", F.lit(1)), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("there").alias("n_labelled"), F.sum("quality").alias("n_good"), F.sum("toxic").alias("n_toxic"))


@register("SELECT lang AS domain, source AS kind, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ALL")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("domain"), F.col("source").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@register(f"WITH {CALLS}, t AS (SELECT qid, call_no, text AS content, tag AS stage, left(text, 4) AS answer FROM calls), f AS (SELECT qid, arg_max(answer, call_no) AS final FROM t WHERE stage <> 'system' GROUP BY qid) SELECT qid, arg_max(stage, call_no) AS stage, max(call_no)::INT AS n_evidence FROM t JOIN f USING (qid) WHERE answer = final AND call_no > 0 AND trim(content) <> '' GROUP BY qid")
def select_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _calls(spark, sf_dir)
    traces = c.select("qid", F.col("call_no").alias("ord"), F.col("tag").alias("stage"), F.col("text").alias("content"), F.substring("text", 1, 4).alias("answer"), F.when(F.col("call_no") > 0, F.array_repeat(F.lit("e"), F.col("call_no").cast("int"))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"))
    finals = traces.filter("stage <> 'system'").groupBy("qid").agg(F.max_by("answer", "ord").alias("final"))
    return A.reasoning(finals, traces).select("qid", "stage", F.size("evidence_ids").alias("n_evidence"))


@register(
    """WITH q AS (SELECT DISTINCT conv_id AS qid FROM conversations), l AS (SELECT qid, chr((65 + qid % 4)::INT) AS r1, chr((65 + qid % 3)::INT) AS r2, chr((65 + qid % 2)::INT) AS r3 FROM q)
SELECT qid, CASE WHEN r1 <> r2 THEN r3 ELSE r2 END AS final, (CASE WHEN r1 <> r2 THEN 3 ELSE 2 END)::BIGINT AS n_calls FROM l"""
)
def staged_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as single-choice questions whose recorded answers come from their numbers; evidence is their longest turn."""
    c = table(spark, sf_dir, "conversations")
    q = c.select(F.col("conv_id").alias("qid"), F.lit("mcq").alias("answer_format")).distinct()
    letter = lambda n: F.char(F.lit(65) + F.col("qid") % n)
    said = q.select("qid", F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.concat(F.lit("答案: "), letter(n)).alias("content")) for t, n in (("r1", 4), ("r2", 3), ("r3", 2))])).alias("s")).select("qid", "s.*")
    block = c.groupBy(F.col("conv_id").alias("qid")).agg(F.max_by("text", F.struct(F.length("text"), "turn")).alias("block"))
    evidence = lambda asked: asked.join(block, "qid").select("qid", "block", F.array(F.concat(F.col("qid").cast("string"), F.lit("#c0"))).alias("evidence_ids"))
    final, traces = flow.choices(q, flow.replay(said), evidence)
    return final.join(traces.groupBy("qid").agg(F.count(F.lit(1)).alias("n_calls")), "qid")

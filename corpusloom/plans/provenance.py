"""Queries of gathered evidence and of where answers come from. Conversations stand for questions and calls, their turns for records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunk, gather, index, prompts
from corpusloom.operators import provenance as P
from corpusloom.plans.catalogue import register
from corpusloom.session import Scratch, ship, spread, table

HEADER = "(?i)(?:authorization|x-api-key|api[_ -]?key)[\"'']?\\s*[:=]\\s*[\"'']?"
LEAK = f"(regexp_matches({{0}}, '\\bsk-[A-Za-z0-9_-]{{{{8,}}}}\\b') OR regexp_matches(regexp_replace({{0}}, '{HEADER}\\[REDACTED\\]', '', 'g'), '{HEADER}[^\\s,;}}}}''\"]+'))"


@register(f"SELECT doc_id, {LEAK.format('text')} AS leaks FROM documents")
def credential_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", T.leaks_credentials(F.col("text")).alias("leaks"))


CALLS = """c AS (SELECT conv_id * 100 + turn AS line, CASE WHEN turn % 5 = 4 THEN 'request_error' WHEN turn % 5 = 3 THEN 'odd' ELSE 'ok' END AS status, conv_id AS qid, role AS model, turn % 3 AS attempt,
  turn AS started_at, turn + length(text) % 7 - 1 AS finished_at, length(text) % 4 AS n_messages, length(text) % 50 AS max_tokens, CASE WHEN turn % 2 = 0 THEN length(text) END AS total_tokens,
  CASE WHEN length(text) % 3 = 0 THEN ' ' ELSE role END AS error_type, CASE WHEN turn % 5 = 4 OR turn % 7 = 2 THEN text END AS error FROM conversations)"""


@register(
    f"""WITH {CALLS}, p AS (SELECT line, unnest([
  CASE WHEN status NOT IN ('ok', 'request_error') THEN 'status' END, CASE WHEN model NOT IN ('user', 'assistant') THEN 'model' END, CASE WHEN attempt < 1 THEN 'attempt' END,
  CASE WHEN finished_at < started_at THEN 'timestamps' END, CASE WHEN n_messages < 1 THEN 'messages' END, CASE WHEN max_tokens < 1 THEN 'max_tokens' END,
  CASE WHEN (status = 'request_error') = (total_tokens IS NOT NULL) THEN 'usage' END,
  CASE WHEN CASE WHEN status = 'request_error' THEN trim(error_type) = '' OR error IS NULL ELSE error IS NOT NULL END THEN 'error' END,
  CASE WHEN {LEAK.format("coalesce(error, '')")} THEN 'credential' END]) AS problem FROM c)
SELECT line, problem FROM p WHERE problem IS NOT NULL"""
)
def call_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, turn = F.length("text"), F.col("turn")
    calls = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + turn).alias("line"), F.when(turn % 5 == 4, "request_error").when(turn % 5 == 3, "odd").otherwise("ok").alias("status"), F.col("conv_id").alias("qid"), F.col("role").alias("model"), (turn % 3).alias("attempt"),
        turn.alias("started_at"), (turn + n % 7 - 1).alias("finished_at"), (n % 4).alias("n_messages"), (n % 50).alias("max_tokens"), F.when(turn % 2 == 0, n).alias("total_tokens"),
        F.when(n % 3 == 0, " ").otherwise(F.col("role")).alias("error_type"), F.when((turn % 5 == 4) | (turn % 7 == 2), F.col("text")).alias("error"),
    )
    return P.call_shape(calls, "user|assistant")


@register(
    """SELECT line, problem FROM (SELECT conv_id * 100 + turn AS line, turn, unnest([CASE WHEN turn % 3 = 2 THEN 'fields' END, CASE WHEN turn % 4 = 3 THEN 'attempt' END, CASE WHEN turn % 5 = 4 THEN 'timestamps' END, CASE WHEN turn % 6 = 5 THEN 'request fields' END,
  CASE WHEN turn = 6 THEN 'messages' END, CASE WHEN turn % 6 = 1 THEN 'controls' END]) AS problem FROM conversations) WHERE problem IS NOT NULL"""
)
def call_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as records of calls, with a surplus field, an attempt that is true, a time as text, a surplus control, no messages or a temperature that is text here and there."""
    turn = F.col("turn")
    attempt = F.when(turn % 4 == 3, "true").otherwise("1")
    began = F.when(turn % 5 == 4, '"1.5"').otherwise("1.5")
    request = F.concat(F.lit('{"messages":['), F.when(turn == 6, "").otherwise(F.to_json(F.struct("role", "text"))), F.lit('],"max_tokens":9,"extra_body":{},"temperature":'), F.when(turn % 6 == 1, '"0"').otherwise("0.5"), F.when(turn % 6 == 5, ',"top_p":1').otherwise(""), F.lit("}"))
    outcome = F.when(turn % 2 == 0, '"status":"ok","response":{},"usage":{}').otherwise('"status":"request_error","error":{}')
    record = F.concat(F.lit("{"), outcome, F.lit(',"qid":"q","tag":"t","model":"m","finished_at":2,"attempt":'), attempt, F.lit(',"started_at":'), began, F.lit(',"request":'), request, F.when(turn % 3 == 2, ',"more":1').otherwise(""), F.lit("}"))
    return P.call_fields(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + turn).alias("line"), record.alias("record")))


@register(
    """WITH g AS (SELECT conv_id AS qid, list(struct_pack(e := conv_id || ':' || turn || ':' || role, d := role, q := CASE WHEN length(text) % 9 = 0 THEN ' ' ELSE text END, m := turn % 6 = 5) ORDER BY turn, role) AS chunks,
  list(DISTINCT role) FILTER (turn < 3 AND conv_id % 11 <> 0) AS selected FROM conversations GROUP BY conv_id),
i AS (SELECT *, CASE WHEN qid % 4 = 0 THEN list_reverse(list_transform(chunks, lambda c: c.e)) ELSE list_transform(chunks, lambda c: c.e) END AS ids FROM (SELECT qid, chunks, coalesce(selected, []) AS selected FROM g)),
p AS (SELECT qid, unnest([CASE WHEN len(selected) = 0 THEN 'selected' END, CASE WHEN len(list_filter(chunks, lambda c: c.m)) > 0 THEN 'missing' END, CASE WHEN len(list_filter(chunks, lambda c: trim(c.q) = '')) > 0 THEN 'fields' END,
  CASE WHEN len(list_filter(chunks, lambda c: NOT list_contains(selected, c.d))) > 0 THEN 'unselected' END, CASE WHEN list_transform(chunks, lambda c: c.e) <> ids THEN 'order' END]) AS problem FROM i)
SELECT qid, problem FROM p WHERE problem IS NOT NULL"""
)
def concrete_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    e = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role")
    row = F.struct("turn", "role", F.struct(e.alias("evidence_id"), F.col("role").alias("doc_id"), F.when(F.length("text") % 9 == 0, " ").otherwise(F.col("text")).alias("quoted_clause"), (F.col("turn") % 6 == 5).alias("missing")).alias("c"))
    g = c.groupBy(F.col("conv_id").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["c"]).alias("chunks"), F.collect_set(F.when((F.col("turn") < 3) & (F.col("conv_id") % 11 != 0), F.col("role"))).alias("selected"))
    ids = F.transform("chunks", lambda x: x["evidence_id"])
    return P.concrete_evidence(g.select("qid", "selected", "chunks", F.when(F.col("qid") % 4 == 0, F.reverse(ids)).otherwise(ids).alias("evidence_ids")))


@register("SELECT conv_id AS qid, turn, conv_id || '|m|' || role || '|completion_tokens=' || turn || ',prompt_tokens=' || length(text) AS signature FROM conversations")
def call_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = F.create_map(F.lit("prompt_tokens"), F.length("text").cast("long"), F.lit("completion_tokens"), F.col("turn"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), "turn", P.signature(F.col("conv_id"), F.lit("m"), F.col("role"), usage).alias("signature"))


@register(
    """WITH s AS (SELECT conv_id AS qid, turn, role, CASE WHEN role = 'user' THEN [text] ELSE list_transform(regexp_extract_all('补充检索: ' || text, '补充检索[:：]\\s*([^\\n]+)', 1), lambda x: trim(x)) END AS l FROM conversations WHERE role IN ('user', 'assistant')),
e AS (SELECT qid, turn, role, unnest(l) AS t FROM s), o AS (SELECT qid, t, min(CASE WHEN role = 'user' THEN 0 ELSE 1000 END + turn) AS place FROM e WHERE trim(t) <> '' GROUP BY ALL)
SELECT q.qid, coalesce(len(l), 0)::BIGINT AS n, md5(coalesce(array_to_string(l, chr(10)), '')) AS surface_md5
FROM (SELECT DISTINCT conv_id AS qid FROM conversations WHERE role = 'user') q LEFT JOIN (SELECT qid, list(t ORDER BY place) AS l FROM o GROUP BY qid) USING (qid)"""
)
def query_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user turn as the question, the others as options; what the assistant says as follow-up searches."""
    c = table(spark, sf_dir, "conversations")
    said = c.filter("role = 'user'").groupBy(F.col("conv_id").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    questions = said.select("qid", F.get("t", F.lit(0)).alias("question"), F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))).alias("options"))
    responses = c.filter("role = 'assistant'").select(F.col("conv_id").alias("qid"), F.col("turn").alias("call_no"), F.concat(F.lit("补充检索: "), "text").alias("content"))
    out = P.query_surface(questions, responses)
    return out.select("qid", F.size("surface").cast("long").alias("n"), F.md5(F.array_join("surface", "\n").cast("binary")).alias("surface_md5"))


@register(
    """WITH a AS (SELECT conv_id AS qid, trim(text) AS t, turn FROM conversations WHERE role = 'assistant'), f AS (SELECT qid, max_by(t, turn) AS r FROM a GROUP BY qid),
m AS (SELECT qid, CASE WHEN qid % 5 = 0 THEN coalesce((SELECT g.r FROM f g WHERE g.qid = f.qid + 1), '') WHEN qid % 7 = 0 THEN r || '.' ELSE r END AS r FROM f),
p AS (SELECT qid, CASE WHEN r = '' THEN 'blank' WHEN EXISTS (SELECT 1 FROM a WHERE a.qid = m.qid AND contains(a.t, m.r)) THEN NULL WHEN EXISTS (SELECT 1 FROM a WHERE contains(a.t, m.r)) THEN 'another question' ELSE 'no call' END AS problem FROM m)
SELECT qid, problem FROM p WHERE problem IS NOT NULL"""
)
def reasoning_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last answers as reasoning: that of the next conversation for one in five, a changed one for one in seven of the rest."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    last = c.groupBy(F.col("conv_id").alias("qid")).agg(F.max_by(F.trim("text"), "turn").alias("r"))
    following = last.select((F.col("qid") - 1).alias("qid"), F.col("r").alias("next"))
    r = F.when(F.col("qid") % 5 == 0, F.coalesce("next", F.lit(""))).when(F.col("qid") % 7 == 0, F.concat("r", F.lit("."))).otherwise(F.col("r"))
    finals = last.join(following, "qid", "left").select("qid", r.alias("reasoning"))
    return P.reasoning_origin(finals, c.select(F.col("conv_id").alias("qid"), F.lit("ok").alias("status"), F.col("text").alias("content")))


@register(
    """WITH a AS (SELECT conv_id AS qid, turn, text, 'r' || turn AS stage, substr('ABCD', 1 + turn % 4, 1) AS answer FROM conversations WHERE role = 'assistant'),
f AS (SELECT qid, max_by(struct_pack(t := text, s := stage, a := answer, n := turn), turn) AS x FROM a GROUP BY qid)
SELECT qid, problem FROM (SELECT qid, unnest([CASE WHEN qid % 9 = 8 THEN 'source' END, CASE WHEN qid % 9 <> 8 AND qid % 5 = 1 THEN 'reasoning' END, CASE WHEN qid % 9 <> 8 AND qid % 7 = 2 THEN 'stage' END,
  CASE WHEN qid % 9 <> 8 AND (qid % 5 = 1 OR qid % 7 = 2) THEN 'no trace' END, CASE WHEN qid % 9 <> 8 AND (qid % 5 = 1 OR qid % 7 = 2 OR qid % 6 = 3) THEN 'answer' END, CASE WHEN qid % 9 <> 8 AND (qid % 5 = 1 OR qid % 7 = 2 OR qid % 8 = 4) THEN 'evidence' END,
  CASE WHEN qid % 9 <> 8 AND qid % 6 <> 3 AND qid % 4 = 1 THEN 'raw answer' WHEN qid % 9 <> 8 AND qid % 6 = 3 AND qid % 4 <> 1 AND qid % 4 <> 3 THEN 'raw answer' END]) AS problem FROM f) WHERE problem IS NOT NULL"""
)
def reasoning_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last assistant turns as reasonings, all such turns as traces; sources are missing, changed, without stage or evidence, and answers differ, here and there."""
    a = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    qid, turn = F.col("qid"), F.col("turn")
    letter = F.substring(F.lit("ABCD"), (1 + turn % 4).cast("int"), F.lit(1))
    trace = F.struct("turn", F.concat(F.lit("r"), turn.cast("string")).alias("stage"), F.col("text").alias("content"), letter.alias("answer"), F.array(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))).alias("evidence_ids"))
    g = a.groupBy(F.col("conv_id").alias("qid")).agg(F.array_sort(F.collect_list(trace)).alias("all"))
    g = g.withColumn("last", F.element_at("all", -1))
    finals = g.select("qid", F.when(qid % 6 == 3, "CD").otherwise(F.col("last.answer")).alias("answer"), F.col("last.content").alias("reasoning"))
    traces = F.transform("all", lambda t: F.struct(t["stage"].alias("stage"), t["content"].alias("content"), t["answer"].alias("answer"), t["evidence_ids"].alias("evidence_ids")))
    raw = F.when(qid % 4 == 1, "AB").when(qid % 4 == 3, "").otherwise(F.lower("last.answer"))
    sources = g.filter(qid % 9 != 8).select(
        "qid", F.when(qid % 5 == 1, F.concat("last.content", F.lit("!"))).otherwise(F.col("last.content")).alias("reasoning"), F.when(qid % 7 == 2, " ").otherwise(F.col("last.stage")).alias("stage"),
        F.when(qid % 8 == 4, F.array(F.lit("x"))).otherwise(F.col("last.evidence_ids")).alias("evidence_ids"), F.when(qid % 6 == 3, F.when(qid % 4 == 1, "DC").otherwise(raw)).otherwise(raw).alias("raw_answer"), traces.alias("traces"),
    )
    return P.reasoning_provenance(finals, sources)


@register(
    """WITH c AS (SELECT conv_id AS qid, turn, text FROM conversations WHERE role = 'assistant'),
p AS (SELECT DISTINCT qid, 'r' || turn AS stage, unnest([CASE WHEN turn % 7 = 5 THEN 'no response' WHEN turn % 6 = 1 THEN 'no trace' END, CASE WHEN turn % 4 = 2 THEN 'no chunk' END, CASE WHEN turn % 4 <> 2 AND turn % 7 <> 5 AND turn % 5 = 3 THEN 'not sent' END]) AS problem FROM c)
SELECT qid, stage, problem FROM p WHERE problem IS NOT NULL"""
)
def evidence_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as traces that cite a chunk; responses are missing or doubled, chunks missing, prompts without the chunk here and there."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    turn, stage = F.col("turn"), F.concat(F.lit("r"), F.col("turn").cast("string"))
    chunk = F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rendered = F.concat(F.lit("【"), chunk, F.lit("】"), F.reverse("text"))
    traces = c.select(F.col("conv_id").alias("qid"), stage.alias("stage"), F.col("text").alias("content"), F.array(chunk).alias("evidence_ids"))
    prompt = F.concat(F.lit("read: "), F.when(turn % 5 == 3, "").otherwise(rendered), F.lit(" and answer"))
    times = F.when(turn % 7 == 5, 0).when(turn % 6 == 1, 2).otherwise(1)
    responses = c.select(F.col("conv_id").alias("qid"), stage.alias("tag"), F.col("text").alias("content"), prompt.alias("prompt"), F.explode(F.array_repeat(F.lit(1), times)).alias("n")).drop("n")
    return P.evidence_sent(traces, responses, c.filter(turn % 4 != 2).select(chunk.alias("evidence_id"), rendered.alias("rendered")))


@register(
    """WITH t AS (SELECT doc_id, regexp_replace(text, '[^0-9A-Za-z一-鿿]+', '', 'g') AS a, regexp_replace(lang || source || (doc_id % 97), '[^0-9A-Za-z一-鿿]+', '', 'g') AS b FROM documents)
SELECT doc_id, coalesce(len(list_filter(range(1, length(b) - 2), lambda i: contains(a, substr(b, i, 4)))) > 0, false) AS named FROM t"""
)
def option_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text, as an option, names a title made of language, source and number."""
    title = F.concat("lang", "source", (F.col("doc_id") % 97).cast("string"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", T.names_title(F.col("text"), title).alias("named"))


def _gathered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items as questions, their sentences as options, the three best documents of each as its own."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    best = index.top(index.scores(docs.select(F.lit("all").alias("index_key"), F.col("doc_id").alias("unit"), "text"), items.select("qid", F.col("question").alias("query")), most=3), 3)
    best = Scratch(spark, "gathered").keep(best.select("qid", "unit", "rank"), "best")
    best = best.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "unit"))), lambda x: x["unit"]).alias("doc_ids"))
    options = F.transform(F.slice(F.split("question", "\\. "), 1, 4), lambda t, i: F.struct(F.substr(F.lit("ABCD"), i + 1, F.lit(1)).alias("letter"), t.alias("text")))
    questions = items.join(best, "qid").select("qid", "question", options.alias("options"), "doc_ids")
    titles = docs.select("doc_id", gather.preferred_title(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("source"), F.col("doc_id")).alias("title"))
    # several joins read the chunks, of the questions' documents alone
    wanted = docs.join(questions.select(F.explode("doc_ids").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chunks = Scratch(spark, "gathered").keep(chunk.chunks(spread(wanted)).select("doc_id", "ord", "page", "text"), "chunks")
    return questions, titles, gather.gather(questions, chunks, titles, 4600)


@register()
def evidence_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _gathered(spark, sf_dir)[2]
    return out.select(F.col("qid").alias("item_id"), "ord", "doc_id", "chunk", F.length("text").cast("long").alias("n"), "protected")


@register()
def evidence_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, titles, found = _gathered(spark, sf_dir)
    out = gather.blocks(questions, found, titles)
    return out.select(F.col("qid").alias("item_id"), F.length("block").cast("long").alias("n_chars"), F.md5(F.col("block").cast("binary")).alias("block_md5"))


@register(
    f"""WITH d AS (SELECT doc_id, text, source, CASE doc_id % 3 WHEN 0 THEN 'insurance' WHEN 1 THEN 'financial_reports' ELSE 'regulatory' END AS domain FROM documents)
SELECT doc_id, domain <> 'regulatory' AS reasons, md5(concat_ws(chr(10) || chr(10), source, concat_ws(chr(10), coalesce(text, ''), 'A. ' || source || chr(10) || 'B. ' || domain),
  concat_ws(chr(10), '{prompts.BASE}', CASE WHEN regexp_matches(text, '{prompts.HAS_NUMBER}') THEN '{prompts.NUMBERS}' END, CASE domain {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in prompts.BY_DOMAIN.items())} END,
  CASE WHEN doc_id % 2 = 0 THEN '{prompts.SEVERAL}' END), '{prompts.REPLY}')) AS prompt_md5 FROM d"""
)
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with documents as questions, of domains and with options made of their columns."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    d = d.withColumn("domain", F.element_at(F.array(F.lit("insurance"), F.lit("financial_reports"), F.lit("regulatory")), (F.col("doc_id") % 3 + 1).cast("int")))
    options = F.array(F.struct(F.lit("A").alias("key"), F.col("source").alias("text")), F.struct(F.lit("B").alias("key"), F.col("domain").alias("text")))
    rule = prompts.rules(F.col("text"), F.array("domain"), F.col("doc_id") % 2 == 0)
    made = prompts.prompt(F.col("source"), prompts.question_text(F.col("text"), options), rule)
    return d.select("doc_id", prompts.reasons(F.col("domain")).alias("reasons"), F.md5(made.cast("binary")).alias("prompt_md5"))


@register(
    """WITH f AS (SELECT doc_id, source || '-' || doc_id // 4 AS family FROM documents), g AS (SELECT family, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM f GROUP BY family)
SELECT doc_id, family, n, first_id FROM f JOIN g USING (family)"""
)
def attachment_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of a source, four to a family: one and its attachments."""
    i = F.col("doc_id")
    stem = F.concat("source", F.lit("-"), F.floor(i / 4).cast("string"))
    suffix = F.when(i % 4 == 0, F.lit("")).when(i % 4 == 1, F.lit("_att")).when(i % 4 == 2, F.lit("-Annex_2")).otherwise(F.lit("_附件3"))
    family = T.source_family(i.cast("string"), F.concat(F.lit("raw/"), stem, suffix, F.lit(".pdf")))
    docs = table(spark, sf_dir, "documents").select("doc_id", family.alias("family"))
    return docs.join(docs.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")), "family").select("doc_id", "family", "n", "first_id")

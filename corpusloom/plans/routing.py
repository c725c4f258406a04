"""Routing queries: companies, policies and names that occur in questions, and the replay of logged decisions.

Conversations or benchmark items stand for questions. Names are words of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import index, replay, route
from corpusloom.operators.contain import occurrences
from corpusloom.plans.catalogue import register
from corpusloom.plans.retrieval import bm25_sql
from corpusloom.session import Scratch, table

SEVERAL = "两家公司"


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, said``: all turns of a conversation, joined."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("qid")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("qid", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("said"))


SPOKEN = "spoken AS (SELECT conv_id AS qid, string_agg(text, ' ' ORDER BY turn, role) AS said FROM conversations GROUP BY conv_id)"
#: A company is four documents whose ids follow each other; its aliases are each one's first word of nine letters or more.
COMPANIES = """company AS (SELECT doc_id, doc_id // 4 AS company, lower(regexp_extract(text, '[A-Za-z]{9,}')) AS alias, '20' || (20 + doc_id % 4)::VARCHAR AS year FROM documents)"""


def _companies(spark: SparkSession, sf_dir: str, domain: str) -> DataFrame:
    i = F.col("doc_id")
    alias = F.lower(F.regexp_extract("text", "[A-Za-z]{9,}", 0))
    return table(spark, sf_dir, "documents").select(
        "doc_id", i.alias("pos"), F.lit(domain).alias("domain"), F.floor(i / 4).alias("company_key"), F.filter(F.array(alias), lambda a: a != "").alias("aliases"), F.concat(F.lit("20"), (20 + i % 4).cast("string")).alias("year")
    )


def _asked(spark: SparkSession, sf_dir: str, domain: str, more: Column) -> DataFrame:
    q = _spoken(spark, sf_dir)
    return q.select("qid", F.lit(domain).alias("domain"), F.concat("said", more).alias("text"), F.lower("said").alias("normal"), (F.col("qid") % 3).alias("n_options"))


def company_sql(year: str) -> str:
    return f"""WITH {SPOKEN}, {COMPANIES},
q AS (SELECT qid, lower(said) AS t, qid % 4 = 1 AS several, qid % 3 AS n_options, {year} AS asked FROM spoken),
named AS (SELECT DISTINCT qid, company FROM q JOIN company ON alias <> '' AND contains(t, alias)),
docs AS (
  SELECT named.qid, company, doc_id, year = asked AS in_year, max(year = asked) OVER (PARTITION BY named.qid, company) AS dated, count(*) OVER (PARTITION BY named.qid) AS n, several, n_options
  FROM named JOIN company USING (company) JOIN q ON q.qid = named.qid),
grouped AS (SELECT qid, count(DISTINCT company) AS groups FROM named GROUP BY qid)
SELECT qid AS conv_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM docs JOIN grouped USING (qid)
WHERE (n_options > 0 OR several OR groups = 1) AND (in_year OR NOT dated) GROUP BY qid, several HAVING count(*) <= 8 AND NOT (several AND count(*) < 2)"""


def _routed(found: DataFrame) -> DataFrame:
    return found.select(F.col("qid").alias("conv_id"), F.array_join(F.transform("doc_ids", lambda d: d.cast("string")), ",").alias("doc_ids"))


@register(company_sql("''"))
def alias_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("qid") % 4 == 1, SEVERAL).otherwise("")
    return _routed(route.by_company(_asked(spark, sf_dir, "contracts", more), _companies(spark, sf_dir, "contracts")))


@register(company_sql("'20' || (20 + qid % 5)::VARCHAR"))
def year_filter_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies' documents of the year that is asked for, where a company has any; one question in five asks for a year that none has."""
    more = F.concat(F.when(F.col("qid") % 4 == 1, SEVERAL).otherwise(""), F.lit(" 20"), (20 + F.col("qid") % 5).cast("string"))
    asked = _asked(spark, sf_dir, "financial_reports", more).withColumn("text", F.regexp_replace("text", "20\\d{2}(?=.* 20\\d{2}$)", ""))
    return _routed(route.by_company(asked, _companies(spark, sf_dir, "financial_reports")))


@register(
    f"""WITH {SPOKEN}, {COMPANIES}
SELECT qid AS conv_id, company, first(alias ORDER BY length(alias) DESC, alias) AS alias FROM spoken JOIN company ON alias <> '' AND contains(lower(said), alias) GROUP BY qid, company"""
)
def alias_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = route.named_companies(_asked(spark, sf_dir, "contracts", F.lit("")), _companies(spark, sf_dir, "contracts"))
    return found.select(F.col("qid").alias("conv_id"), F.col("company_key").alias("company"), "alias")


@register(
    f"""WITH {SPOKEN}, q AS (SELECT qid, lower(regexp_replace(said, '[^A-Za-z]+', '', 'g')) AS t, qid % 4 = 1 AS several FROM spoken),
policy AS (SELECT doc_id, lower(regexp_extract(text, '[A-Za-z]{{11,}}')) AS product, lower(regexp_extract(text, '([A-Za-z]{{2,}}) ([A-Za-z]{{7,}})', 1)) AS brand, lower(regexp_extract(text, '([A-Za-z]{{2,}}) ([A-Za-z]{{7,}})', 2)) AS alias FROM documents),
owned AS (SELECT alias, count(*) AS owners FROM policy WHERE alias <> '' GROUP BY alias),
met AS (SELECT qid, doc_id, alias, owners, contains(t, brand || alias) AS branded FROM q JOIN policy ON alias <> '' AND contains(t, alias) JOIN owned USING (alias)),
found AS (
  SELECT qid, doc_id FROM (SELECT *, max(branded) OVER (PARTITION BY qid, alias) AS claimed FROM met) WHERE branded OR owners = 1 OR NOT claimed
  UNION SELECT qid, doc_id FROM q JOIN policy ON product <> '' AND contains(t, product))
SELECT qid AS conv_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM found JOIN q USING (qid) GROUP BY qid, several HAVING count(*) <= 10 AND NOT (several AND count(*) < 2)"""
)
def policy_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies by their products, their branded aliases or their bare ones."""
    part = lambda pattern, group: F.lower(F.regexp_extract("text", pattern, group))
    known = lambda c: F.filter(F.array(c), lambda x: x != "")
    both = "([A-Za-z]{2,}) ([A-Za-z]{7,})"
    policies = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("pos"), part("[A-Za-z]{11,}", 0).alias("product"), known(part(both, 2)).alias("aliases"), known(part(both, 1)).alias("brands"))
    q = _spoken(spark, sf_dir).select("qid", F.concat("said", F.when(F.col("qid") % 4 == 1, SEVERAL).otherwise("")).alias("text"), F.lower(F.regexp_replace("said", "[^A-Za-z]+", "")).alias("normal"))
    return _routed(route.by_policy(q, policies))


NAMES = """named AS (SELECT doc_id, lang, unnest([regexp_extract(text, '[A-Za-z]{9,}'), regexp_extract(text, '[A-Z][a-z]{5,}')]) AS name FROM documents)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array(F.regexp_extract("text", "[A-Za-z]{9,}", 0), F.regexp_extract("text", "[A-Z][a-z]{5,}", 0))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain"), F.col("doc_id").alias("pos"), F.explode(both).alias("name"))


@register(
    f"""WITH {SPOKEN}, {NAMES}, langs AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
q AS (SELECT qid, said, lang FROM spoken JOIN langs ON qid % n = k),
taken AS (SELECT qid, 3 * qid AS doc_id FROM q WHERE qid % 2 = 0),
found AS (SELECT DISTINCT qid, doc_id FROM q JOIN named USING (lang) WHERE length(name) >= 2 AND contains(said, name)),
placed AS (SELECT f.qid, f.doc_id, row_number() OVER (PARTITION BY f.qid ORDER BY f.doc_id) + CASE WHEN f.qid % 2 = 0 THEN 1 ELSE 0 END AS ord FROM found f ANTI JOIN taken USING (qid, doc_id))
SELECT qid AS conv_id, doc_id, ord::INT AS ord FROM placed WHERE ord <= 4"""
)
def alias_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a conversation names as they are written, behind the one that every second conversation has."""
    langs = table(spark, sf_dir, "documents").select("lang").filter("lang is not null").distinct().agg(F.array_sort(F.collect_list("lang")).alias("langs"))
    q = _spoken(spark, sf_dir).withColumn("langs", langs.scalar())
    q = q.select("qid", F.get("langs", (F.col("qid") % F.size("langs")).cast("int")).alias("domain"), F.col("said").alias("text"))
    selected = q.filter(F.col("qid") % 2 == 0).select("qid", (3 * F.col("qid")).alias("doc_id"))
    return route.append_named(q, selected, _names(spark, sf_dir)).select(F.col("qid").alias("conv_id"), "doc_id", "ord")


def _once(values: str) -> str:
    """SQL for a list's values, each once, in their order."""
    return f"list_reduce(list_transform({values}, lambda v: [v]), lambda a, v: CASE WHEN list_contains(a, v[1]) THEN a ELSE list_append(a, v[1]) END, []::VARCHAR[])"


@register(
    bm25_sql(
        "'all'",
        f""", c AS (SELECT qid, unit, rank FROM ranked WHERE rank <= CASE WHEN qid % 7 = 0 THEN 2 ELSE 6 END AND score > 0),
cl AS (SELECT qid, list(unit::VARCHAR ORDER BY rank) AS c FROM c GROUP BY qid),
text_of AS (SELECT item_id AS qid, text AS t FROM benchmark),
fast AS (SELECT qid, min(doc_id)::VARCHAR AS doc FROM text_of JOIN documents d ON contains(lower(d.text), lower(t)) GROUP BY qid HAVING count(*) = 1),
said AS (SELECT qid, c, CASE WHEN qid % 3 <> 0 THEN list_filter([c[3], right(c[2], 2), '7', 'zz'], lambda v: v IS NOT NULL) ELSE [] END AS v FROM cl),
parsed AS (SELECT qid, c, {_once("list_filter(list_transform(v, lambda v: CASE WHEN list_contains(c, v) THEN v WHEN len(list_filter(c, lambda x: suffix(x, v))) = 1 THEN list_filter(c, lambda x: suffix(x, v))[1] END), lambda v: v IS NOT NULL)")} AS p FROM said),
start AS (SELECT qid, c, CASE WHEN len(p) > 0 THEN p[1:4] ELSE c[1:1] END AS s FROM parsed),
fam AS (SELECT DISTINCT x.qid, d.source FROM (SELECT qid, unnest(s)::BIGINT AS unit FROM start) x JOIN documents d ON d.doc_id = x.unit),
member AS (SELECT c.qid, list(unit::VARCHAR ORDER BY rank) AS f FROM c JOIN documents d ON d.doc_id = c.unit JOIN fam ON fam.qid = c.qid AND fam.source = d.source JOIN start ON start.qid = c.qid WHERE NOT list_contains(s, unit::VARCHAR) GROUP BY c.qid),
named AS (SELECT c.qid, list(unit::VARCHAR ORDER BY unit) AS m FROM c JOIN documents d ON d.doc_id = c.unit JOIN text_of USING (qid) WHERE regexp_matches(d.text, '[A-Za-z]{{9,}}') AND contains(lower(t), lower(regexp_extract(d.text, '[A-Za-z]{{9,}}'))) GROUP BY c.qid),
best AS (SELECT qid, list(unit::VARCHAR ORDER BY lang) AS o FROM (SELECT r.qid, r.unit, d.lang, row_number() OVER (PARTITION BY r.qid, d.lang ORDER BY r.score DESC, r.unit) AS k FROM ranked r JOIN documents d ON d.doc_id = r.unit WHERE r.score > 0 AND d.lang IS NOT NULL) WHERE k = 1 GROUP BY qid),
more AS (SELECT qid, start.c, s, list_concat(list_concat(s, coalesce(f, [])), list_concat(coalesce(m, []), start.c[1:1])) AS l, coalesce(o, []) AS o FROM start LEFT JOIN member USING (qid) LEFT JOIN named USING (qid) LEFT JOIN best USING (qid)),
full_ AS (SELECT qid, c, s, {_once("list_concat(l, list_filter(o, lambda x: NOT list_contains(l, x))[1:2])")}[1:4] AS p FROM more),
final AS (SELECT qid, CASE WHEN len(p) = 1 AND qid % 4 = 1 THEN list_concat(p, list_filter(c, lambda x: x <> s[1])[1:1]) ELSE p END AS p FROM full_),
expected AS (
  SELECT q.qid, coalesce(c, []) AS c, CASE WHEN q.qid % 5 = 0 THEN 'input' WHEN doc IS NOT NULL THEN 'code' ELSE 'model' END AS selector,
    CASE WHEN q.qid % 5 = 0 THEN [q.qid::VARCHAR] WHEN doc IS NOT NULL THEN [doc] WHEN len(coalesce(c, [])) <= 2 THEN coalesce(c, []) ELSE p END AS picked, q.qid % 5 = 0 OR doc IS NOT NULL OR len(coalesce(c, [])) <= 2 AS silent, doc
  FROM q LEFT JOIN cl USING (qid) LEFT JOIN fast USING (qid) LEFT JOIN final USING (qid)),
logged AS (
  SELECT *, CASE WHEN qid % 13 = 0 THEN 'code' ELSE selector END AS as_logged, CASE WHEN selector = 'model' AND qid % 2 = 0 THEN c[1:3] WHEN selector = 'code' THEN [doc] WHEN selector = 'input' THEN [qid::VARCHAR] ELSE picked END AS picked_logged,
    CASE WHEN qid % 11 = 0 THEN 2 WHEN selector = 'model' AND qid % 7 <> 0 THEN 1 ELSE 0 END AS calls FROM expected),
problems AS (SELECT qid, unnest([
  CASE WHEN qid % 17 = 0 THEN 'decisions' END, CASE WHEN qid % 17 <> 0 AND selector <> as_logged THEN 'selector' END, CASE WHEN calls <> CASE WHEN silent THEN 0 ELSE 1 END THEN 'calls' END, CASE WHEN qid % 17 <> 0 AND picked <> picked_logged THEN 'picked' END]) AS problem FROM logged)
SELECT e.qid AS item_id, e.selector, array_to_string(e.picked, ',') AS picked, coalesce(string_agg(problem, ',' ORDER BY problem), '') AS problems FROM expected e LEFT JOIN problems x ON x.qid = e.qid AND problem IS NOT NULL GROUP BY ALL""",
    )
)
def routing_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items' routing replayed from their hits, code's decisions and responses made of the hits, against a log that differs here and there.

    Of the log, every thirteenth selector is code, every seventeenth decision is missing, the model's even ones have the first three hits, every eleventh item has two calls.
    """
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "replay")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    qid = F.col("qid")
    hits = index.scores(docs.select(F.lit("all").alias("index_key"), F.col("doc_id").alias("unit"), "text", "lang"), items.select("qid", F.col("text").alias("query")), most=6, part="lang")
    hits = scratch.keep(hits, "hits")
    candidates = index.top(hits, 6).filter((qid % 7 != 0) | (F.col("rank") <= 2)).select("qid", "unit", F.col("rank").alias("ord"))
    tops = index.top(candidates.select("qid", F.lit("all").alias("index_key"), "unit", (-F.col("ord")).alias("minus")).withColumn("score", F.col("minus") + 100.0), 1).select("qid", F.lit("surface").alias("part"), F.lit("").alias("opt"), "unit")
    tops = tops.unionByName(index.top(hits.filter("lang is not null"), 1, by=("qid", "lang")).select("qid", F.lit("option").alias("part"), F.col("lang").alias("opt"), "unit"))
    words = docs.select("doc_id", F.lower(F.regexp_extract("text", "[A-Za-z]{9,}", 0)).alias("word")).filter("word <> ''")
    named = occurrences(items.select("qid", F.lower("text").alias("text")), words, "qid", "text", "word").join(words, "word").select("qid", F.col("doc_id").alias("unit"), F.col("doc_id").alias("pos"))
    code = route.quoted(items.select("qid", F.array(F.lower("text")).alias("anchors")), docs.select("doc_id", F.lower("text").alias("surface")))
    questions = items.select("qid", F.when(qid % 5 == 0, F.array(qid.cast("string"))).alias("doc_ids"), (qid % 4 == 1).alias("several"))

    lists = candidates.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "unit"))), lambda x: x["unit"].cast("string")).alias("c"))
    c = F.coalesce("c", F.array().cast("array<string>"))
    values = F.filter(F.array(F.get(c, F.lit(2)), F.right(F.get(c, F.lit(1)), F.lit(2)), F.lit("7"), F.lit("zz")), lambda v: v.isNotNull())
    content = F.when(qid % 3 != 0, F.concat(F.lit("I take "), F.to_json(values), F.lit(" of these, not [1]"))).otherwise("none")
    asked = questions.join(lists, "qid", "left").join(code.select("qid", F.lit(True).alias("by_code")), "qid", "left")
    calls = F.when(qid % 11 == 0, 2).when(F.col("doc_ids").isNull() & F.col("by_code").isNull() & (qid % 7 != 0), 1).otherwise(0)
    responses = scratch.keep(asked.select("qid", content.alias("content"), F.explode(F.array_repeat(F.lit(1), calls)).alias("n")).select("qid", "content"), "responses")
    expected = scratch.keep(replay.replay(questions, code, candidates, responses, docs.select(F.col("doc_id").alias("unit"), F.col("source").alias("family")), tops, named), "expected")

    changed = F.when((F.col("selector") == "model") & (qid % 2 == 0), F.slice(c, 1, 3)).otherwise(F.col("picked"))
    decisions = expected.join(lists, "qid", "left").filter(qid % 17 != 0).select("qid", F.when(qid % 13 == 0, "code").otherwise(F.col("selector")).alias("selector"), changed.alias("picked"))
    problems = replay.differences(expected, decisions, responses).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("problem")), ",").alias("problems"))
    return expected.join(problems, "qid", "left").select(qid.alias("item_id"), "selector", F.array_join("picked", ",").alias("picked"), F.coalesce("problems", F.lit("")).alias("problems"))

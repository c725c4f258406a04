"""Structuring queries: HTML text, cleaning, pages and clauses, statement cells, topics and cards over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import cards, chunk, evidence, facts, identity, index, titles
from corpusloom.plans.catalogue import register
from corpusloom.plans.retrieval import bm25_sql
from corpusloom.session import Scratch, spread, table
from corpusloom.sources import html

UNESCAPE = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


@register(
    f"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?is)<head\\b.*?</head\\s*>', '', 'g') AS b FROM pages),
n AS (SELECT page_id, list_filter(list_transform(string_split_regex(b, '<[^>]*>'), lambda x: {STRIP.format(UNESCAPE.format('x'))}), lambda x: x <> '') AS n FROM b)
SELECT page_id, length(array_to_string(n, chr(10)))::BIGINT AS n_chars, md5(array_to_string(n, chr(10))) AS text_md5 FROM n"""
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "pages")).select("page_id", html.visible_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@register(
    f"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?is)<head\\b.*?</head\\s*>', '', 'g') AS b FROM pages),
n AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(b, '<[^>]*>'), lambda x: {STRIP.format(UNESCAPE.format('x'))}), lambda x: x <> ''), chr(10)) AS n FROM b),
d AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'page-' || page_id ELSE 'A & ' || page_id END AS title, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'c' || page_id % 5 END AS col, '2024-01-0' || (1 + page_id % 9) AS day, n FROM n)
SELECT page_id, title, day AS pub_date, col AS page_column, md5('标题：' || title || chr(10) || '栏目：' || col || chr(10) || '发布日期：' || day || chr(10) || chr(10) || regexp_replace(n, '\\n{{3,}}', chr(10) || chr(10), 'g')) AS text_md5 FROM d"""
)
def html_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as documents with a header, their descriptions put into their heads: no title for one in three, an empty column for one in four."""
    i = F.col("page_id")
    named = F.concat(F.when(i % 3 != 0, F.concat(F.lit("<META content='A &amp; "), i.cast("string"), F.lit("' name=\"ArticleTitle\">"))).otherwise(""), F.lit("<meta name=ColumnName content=\""), F.when(i % 4 != 0, F.concat(F.lit("c"), (i % 5).cast("string"))).otherwise(" "), F.lit("\"><meta name='PubDate' content=2024-01-0"), (1 + i % 9).cast("string"), F.lit("><meta name=PubDate content=later>"))
    rows = spread(table(spark, sf_dir, "pages")).select("page_id", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), named)).alias("html"))
    rows = rows.select("page_id", html.document(F.col("html"), F.concat(F.lit("page-"), i.cast("string"))).alias("d"))
    return rows.select("page_id", "d.title", "d.pub_date", F.col("d.column").alias("page_column"), F.md5(F.col("d.text").cast("binary")).alias("text_md5"))


@register(f"SELECT page_id, trim({UNESCAPE.format(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)')}) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).select("page_id", html.title(F.col("html")).alias("title"))


@register(
    """WITH p AS (SELECT page_id, list_transform(regexp_extract_all(regexp_replace(html, '<a href="([^"]*)">', '<meta name="description" content="\\1">', 'g'), '<meta\\s[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)["'']', 1), lambda d: trim(d)) AS d FROM pages)
SELECT page_id, left(list_sort(list_transform(list_filter(d, lambda x: x <> ''), lambda x: struct_pack(n := length(x), d := x)))[-1].d, 160) AS description FROM p"""
)
def html_meta_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.regexp_replace("html", '<a href="([^"]*)">', '<meta name="description" content="$1">')
    return spread(table(spark, sf_dir, "pages")).select("page_id", html.description(named).alias("description"))


@register(
    """WITH l AS (SELECT doc_id, list_transform(string_split(replace(text, ' of ', chr(10)), chr(10)), lambda x: rtrim(x)) AS l FROM documents),
f AS (SELECT doc_id, list_reduce(list_transform(list_append(l, chr(0)), lambda x: {'out': [x], 'run': []::VARCHAR[]}),
  lambda a, x: CASE WHEN length(trim(x.out[1])) = 1 AND x.out[1] <> chr(0) AND NOT regexp_matches(trim(x.out[1]), '^[0-9]$') THEN {'out': a.out, 'run': list_append(a.run, trim(x.out[1]))}
    ELSE {'out': list_append(list_concat(a.out, CASE WHEN len(a.run) >= 3 THEN [array_to_string(a.run, '')] ELSE a.run END), x.out[1]), 'run': []::VARCHAR[]} END,
  {'out': []::VARCHAR[], 'run': []::VARCHAR[]}) AS r FROM l)
SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(r.out[1:len(r.out)-1], chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS clean_md5 FROM f"""
)
def line_glue_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.md5(T.clean_page(F.replace("text", F.lit(" of "), F.lit("\n"))).cast("binary")).alias("clean_md5"))


@register(
    f"""WITH p AS (SELECT doc_id, page, {STRIP.format('line')} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents) WHERE {STRIP.format('line')} <> ''),
SELECT 1""".replace(",\nSELECT 1", "\nSELECT doc_id, count(*)::BIGINT AS n_pages, min(page)::INT AS first_page, max(page)::INT AS last_page, sum(length(t))::BIGINT AS n_chars FROM p GROUP BY doc_id")
)
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a page mark before each line: every line is a page of its own."""
    d = table(spark, sf_dir, "documents")
    marked = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lit("[P"), (i + 1).cast("string"), F.lit("]\n"), x)), "\n")
    rows = chunk.chunks(spread(d).select("doc_id", marked.alias("text")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sum(F.length("text")).alias("n_chars"))


@register(
    f"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\\. ') AS s FROM documents),
SELECT 1""".replace(",\nSELECT 1", "\nSELECT doc_id, len(s)::BIGINT AS n_clauses FROM s WHERE len(s) > 5 AND length(list_sort(list_transform(s, lambda x: length(x)))::VARCHAR) > 0")
)
def clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a clause heading before each sentence but the first are cut into as many clauses as they have sentences."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.regexp_replace("text", "\\. ", "\n第1条").alias("text"))
    rows = d.select("doc_id", F.size(F.split("text", chunk.CLAUSE, -1)).cast("long").alias("n_clauses"))
    return rows.filter(F.col("n_clauses") > chunk.LEAST_CLAUSES)


TOPICS = (("time", "(?i)the|der"), ("place", "(?i)on|de"), ("manner", "(?i)er|la"))


@register("SELECT doc_id, len(regexp_extract_all(text, '(?i)the|der'))::BIGINT AS time, len(regexp_extract_all(text, '(?i)on|de'))::BIGINT AS place, len(regexp_extract_all(text, '(?i)er|la'))::BIGINT AS manner FROM documents")
def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cards.topic_scores(F.col("text"), F.lit(""), TOPICS)
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", s.alias("s"))
    return rows.select("doc_id", *[(-F.get("s", F.lit(i))["minus"]).cast("long").alias(k) for i, (k, _) in enumerate(TOPICS)])


#: No constant: the optimizer would take it out of keys, and what is dealt out by document and page would be dealt out again.
DOC = "floor(l_orderkey / 1000)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as word boxes: an order is a page, a thousand orders a document, a line number a row, quantity, price, discount and tax its numbers."""
    li = table(spark, sf_dir, "lineitem")
    y = 10.0 * F.col("l_linenumber")
    cell = lambda v, x: F.struct(F.lit(x - 20.0).alias("x0"), y.alias("y0"), (F.lit(x) + F.col("l_suppkey") % 5).alias("x1"), (y + 4).alias("y1"), F.format_string("%.2f", v).alias("word"))
    b = F.explode(F.array(cell(F.col("l_quantity"), 100.0), cell(F.col("l_extendedprice"), 200.0), cell(F.col("l_discount"), 300.0), cell(F.col("l_tax"), 400.0))).alias("b")
    return li.select(F.expr(DOC).alias("doc"), F.col("l_orderkey").alias("page"), b).select("doc", "page", "b.*")


BOXES = """boxes AS (SELECT l_orderkey AS page, 10.0::DOUBLE * l_linenumber AS y0, x - 20.0::DOUBLE AS x0, x + l_suppkey % 5 AS x1, printf('%.2f', v) AS word
  FROM (SELECT l_orderkey, l_linenumber, l_suppkey, unnest([100.0::DOUBLE, 200.0::DOUBLE, 300.0::DOUBLE, 400.0::DOUBLE]) AS x, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem)),
rowed AS (SELECT *, sum(CASE WHEN y0 - prev > 4.5 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, x0, x1, word) AS row FROM (SELECT *, lag(y0) OVER (PARTITION BY page ORDER BY y0, x0, x1, word) AS prev FROM boxes))"""
CENTRES = """, many AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY page) AS n FROM boxes) WHERE n >= 15),
clustered AS (SELECT *, sum(CASE WHEN x1 - prev > 28 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x1) AS c FROM (SELECT *, lag(x1) OVER (PARTITION BY page ORDER BY x1) AS prev FROM many)),
centres AS (SELECT page, c, avg(x1) AS centre, row_number() OVER (PARTITION BY page ORDER BY c DESC) AS r FROM clustered GROUP BY page, c),
kept AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY c) - 1 AS col, centre FROM centres WHERE r <= 4)"""


@register(f"WITH {BOXES} SELECT page, count(DISTINCT row)::BIGINT AS n_rows, count(*)::BIGINT AS n_words FROM rowed GROUP BY page")
def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.with_rows(_boxes(spark, sf_dir)).groupBy("page").agg(F.countDistinct("row").alias("n_rows"), F.count(F.lit(1)).alias("n_words"))


def _columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    boxes = _boxes(spark, sf_dir)
    pages = table(spark, sf_dir, "lineitem").select(F.expr(DOC).alias("doc"), F.col("l_orderkey").alias("page")).distinct()
    titles = Scratch(spark, "pages").keep(pages.withColumn("title", F.lit("合并及公司利润表")), "titles")
    return boxes, facts.columns(boxes, titles)


@register(f"WITH {BOXES} {CENTRES} SELECT page, col::INT AS col, round(1000 * centre)::BIGINT AS centre_milli FROM kept")
def fact_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(spark, sf_dir)[1].select("page", "col", F.round(1000 * F.col("centre")).cast("long").alias("centre_milli"))


@register(f"WITH {BOXES} {CENTRES}, near AS (SELECT b.page, b.row, b.word, b.x0, arg_min(k.col, struct_pack(d := abs(k.centre - b.x1), c := k.col)) AS col FROM rowed b JOIN kept k USING (page) GROUP BY ALL) SELECT page, col::INT AS col, count(DISTINCT row)::BIGINT AS n FROM near GROUP BY ALL")
def fact_nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes, cols = _columns(spark, sf_dir)
    of = cols.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("col", "centre"))).alias("cols"))
    w = facts.with_rows(boxes).join(of, "page")
    near = F.array_min(F.transform("cols", lambda c: F.struct(F.abs(c["centre"] - F.col("x1")).alias("d"), c["col"].alias("col"))))["col"]
    return w.withColumn("col", near).groupBy("page", "col").agg(F.countDistinct("row").alias("n"))


@register(
    """WITH e AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, event_type AS t, value FROM events),
s AS (SELECT *, max(CASE WHEN t = (SELECT min(event_type) FROM events) THEN page END) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e)
SELECT doc, count(*)::BIGINT AS n_carried, sum(page - last)::BIGINT AS distance FROM s WHERE t <> (SELECT min(event_type) FROM events) AND page - last <= 3 GROUP BY doc"""
)
def fact_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the pages of a document: those of the first type start something that goes on for three pages."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("first_type"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pages = e.join(F.broadcast(first)).select(F.col("user_id").alias("doc"), F.row_number().over(order).alias("page"), (F.col("event_type") == F.col("first_type")).alias("starts"))
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("last", F.last(F.when(F.col("starts"), F.col("page")), ignorenulls=True).over(before))
    on = pages.filter(~F.col("starts") & (F.col("page") - F.col("last") <= facts.CARRY_PAGES))
    return on.groupBy("doc").agg(F.count(F.lit(1)).alias("n_carried"), F.sum(F.col("page") - F.col("last")).alias("distance"))


@register(
    """WITH r AS (SELECT source AS qid, lang AS bucket, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS ord FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY qid, bucket ORDER BY ord) AS turn, min(ord) OVER (PARTITION BY qid, bucket) AS first FROM r)
SELECT qid, bucket, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY turn, first)::INT AS place FROM d) WHERE place <= 40"""
)
def fact_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("qid"), F.col("lang").alias("bucket"), "doc_id", F.row_number().over(order).alias("ord"))
    return evidence.round_robin(rows).select("qid", "bucket", "doc_id", "place")


@register(
    """WITH s AS (SELECT source AS qid, doc_id, lang, length(regexp_replace(text, '[^.]', '', 'g'))::DOUBLE AS score, length(text) AS n FROM documents),
r AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY lang) AS doc_pos, row_number() OVER (PARTITION BY qid, lang ORDER BY score DESC, doc_id::VARCHAR) AS turn FROM s WHERE score > 0),
o AS (SELECT qid, list(struct_pack(id := doc_id::VARCHAR, n := n) ORDER BY least(turn, 3), CASE WHEN turn <= 2 THEN doc_pos ELSE 0 END, score DESC, doc_id::VARCHAR) AS c FROM r WHERE turn <= 56 GROUP BY qid),
f AS (SELECT qid, list_reduce(list_transform(c, lambda x: {'used': x.n, 'ids': [x.id]}), lambda a, x: CASE WHEN len(a.ids) < 24 AND a.used + x.used + 150 <= 8500 THEN {'used': a.used + x.used + 150, 'ids': list_append(a.ids, x.ids[1])} ELSE a END, {'used': 0::BIGINT, 'ids': []::VARCHAR[]}) AS r FROM o)
SELECT qid, (generate_subscripts(r.ids, 1) - 1)::INT AS ord, unnest(r.ids) AS id FROM f"""
)
def card_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    langs = F.dense_rank().over(Window.partitionBy("source").orderBy("lang"))
    rows = d.select(F.col("source").alias("qid"), "lang", "source", F.col("doc_id").cast("string").alias("id"), F.regexp_count("text", F.lit("\\.")).cast("double").alias("score"), F.length("text").alias("n"))
    rows = rows.filter("score > 0").withColumn("doc_pos", langs)
    return cards.select(rows.select("qid", "doc_pos", "id", "score", "n")).select("qid", "ord", "id")


CODE, DECIMAL = "^(第[零〇一二三四五六七八九十百千万两0-9]+条)[\\s\\p{Z}]*(.*)$", "^([0-9]{1,2}(?:\\.[0-9]{1,2}){1,2})[\\s\\p{Z}]*(.*)$"
TITLED = "(length({0}) BETWEEN 1 AND {1} AND NOT regexp_matches({0}, '[。；，：]'))"


NUMBERS = "list_distinct(list_transform(regexp_extract_all(replace({0}, '％', '%'), '-?[0-9][0-9,]*(?:\\.[0-9]+)?\\s*%'), lambda x: regexp_replace(x, '\\s+', '', 'g')))"
CARDS_SQL = f"""t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, '. '), lambda x, i: '第' || i || '条 ' || x || '。'), chr(10)) AS t FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_transform(string_split_regex(t, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {STRIP.format("x")}) AS x FROM t)),
c AS (SELECT *, CASE WHEN regexp_matches(line, '{CODE}') THEN regexp_extract(line, '{CODE}', 1) WHEN regexp_matches(line, '{DECIMAL}') THEN regexp_extract(line, '{DECIMAL}', 1) END AS code,
  {STRIP.format(f"CASE WHEN regexp_matches(line, '{CODE}') THEN regexp_extract(line, '{CODE}', 2) WHEN regexp_matches(line, '{DECIMAL}') THEN regexp_extract(line, '{DECIMAL}', 2) END")} AS rest FROM l WHERE line <> ''),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, count(code) OVER (PARTITION BY doc_id) AS codes, sum(len(regexp_extract_all(line, '[.。·…]{{5,}}'))) OVER (PARTITION BY doc_id) AS leaders FROM c)
  WHERE NOT (codes >= 7 AND leaders >= 3) AND NOT (r = 1 AND regexp_matches(line, '^[0-9]+$')) AND NOT regexp_matches(line, '^-[0-9]+-$')),
a AS (SELECT *, code IS NOT NULL AND CASE WHEN starts_with(code, '第') THEN {TITLED.format("rest", 32)} ELSE {TITLED.format("rest", 50)} END AS entitled, code IS NULL AND coalesce(lag(rest = '') OVER w, false) AS awaited FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, CASE WHEN entitled THEN rest WHEN awaited AND {TITLED.format("line", 50)} THEN line END AS begun FROM a),
g AS (SELECT *, lag(begun) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM b),
h AS (SELECT *, coalesce(code IS NULL AND begun IS NULL AND length(prev) <= 12 AND length(line) <= 12 AND {TITLED.format("line", 50)} AND NOT regexp_matches(line, '^[（(]?[0-9一二三四五六七八九十]+[）)．.]'), false) AS goes_on FROM g),
m AS (SELECT *, last_value(CASE WHEN begun IS NOT NULL THEN begun WHEN goes_on THEN prev || line WHEN code IS NOT NULL OR awaited THEN '' END IGNORE NULLS) OVER w AS title, last_value(code IGNORE NULLS) OVER w AS clause,
  count(*) FILTER (code IS NOT NULL OR goes_on) OVER w AS turn, CASE WHEN code IS NOT NULL THEN rest ELSE line END AS said FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
body AS (SELECT doc_id, turn, any_value(clause) AS clause, any_value(title) AS title, list(said ORDER BY i) AS lines FROM m WHERE clause IS NOT NULL AND begun IS NULL AND NOT goes_on AND said <> '' GROUP BY doc_id, turn, title),
piece AS (SELECT doc_id, turn, clause, title, flatten(list_transform(lines, lambda x: CASE WHEN length(x) <= 520 THEN [x] ELSE flatten(list_transform(regexp_extract_all(x, '[^。；！？]*[。；！？]|[^。；！？]+'), lambda y: list_transform(range(0, length(y), 520), lambda j: substr(y, j + 1, 520)))) END)) AS p FROM body),
packed AS (SELECT doc_id, turn, clause, title, list_reduce(list_transform(p, lambda x: [x]), lambda o, x: CASE WHEN length(o[-1]) + 1 + length(x[1]) <= 520 THEN list_append(o[1:len(o)-1], o[-1] || chr(10) || x[1]) ELSE list_append(o, x[1]) END) AS o FROM piece),
v AS (SELECT doc_id, turn, clause, title, unnest(o) AS verbatim, generate_subscripts(o, 1) AS part FROM packed),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, clause, replace(regexp_replace(verbatim, '[\\s\\p{{Z}}]+', '', 'g'), '％', '%') ORDER BY turn, part) AS again FROM v) WHERE again = 1),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, part) AS seq FROM once)"""


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents whose sentences are numbered as clauses."""
    numbered = F.array_join(F.transform(F.split("text", "\\. ", -1), lambda s, i: F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("条 "), s, F.lit("。"))), "\n")
    return docs.select("doc_id", numbered.alias("text"))


@register(f"""WITH {CARDS_SQL}
SELECT doc_id || ':p0:' || lpad(seq::VARCHAR, 4, '0') AS id, doc_id::VARCHAR AS doc_id, 0 AS page, clause, 'other_clause' AS topic,
  len({NUMBERS.format("verbatim")})::INT AS n_numbers, length(verbatim)::INT AS n_chars FROM s""")
def clause_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of documents whose sentences are numbered as clauses."""
    d = spread(table(spark, sf_dir, "documents"))
    return cards.cards(_numbered(d)).select("id", "doc_id", "page", "clause", "topic", F.size("numbers").alias("n_numbers"), F.length("verbatim").alias("n_chars"))


@register()
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each source's documents in a budget, with one for every language."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("qid"), F.col("doc_id").alias("unit"), F.crc32(F.col("lang").cast("binary")).alias("doc"), F.length("text").alias("n"), "lang")
    order = Window.partitionBy("qid").orderBy("n", "unit")
    kept = rows.withColumn("r", F.row_number().over(order)).filter("r <= 3").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("unit", "doc", "n", (F.col("r") == 1).alias("forced")))).alias("kept"))
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("qid", "doc").orderBy("n", "unit"))).filter("r = 1").select("qid", "unit", "doc", "n", F.col("doc").alias("pos"))
    return evidence.cover(kept, best, 3600).select("qid", F.explode("kept").alias("k")).select("qid", "k.unit", "k.doc", "k.n", "k.forced")


@register(
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(left(text, 3000), chr(10)), lambda x: {STRIP.format('x')}), lambda x: length(x) >= 6 AND NOT starts_with(x, '[P') AND NOT regexp_matches(x, '^[0-9]+$|^P[0-9]+$|@')) AS l FROM documents),
f AS (SELECT doc_id, list_reduce(list_transform(l, lambda x: {{'kept': [x], 'n': length(x)}}), lambda a, x: CASE WHEN a.n >= 120 THEN a ELSE {{'kept': list_append(a.kept, x.kept[1]), 'n': a.n + x.n}} END, {{'kept': []::VARCHAR[], 'n': 0::BIGINT}}) AS r FROM l)
SELECT doc_id, left(regexp_replace(array_to_string(r.kept, ' '), '[\\s\\p{{Z}}]+', ' ', 'g'), 120) AS head FROM f"""
)
def content_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", titles.content_head(F.col("text")).alias("head"))


@register(
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(left(text, 8000), chr(10)), lambda x: {STRIP.format('x')}), lambda x: length(x) BETWEEN 6 AND 80 AND NOT starts_with(x, '[P') AND NOT regexp_matches(x, '^[0-9]+$|^P[0-9]+$|@')) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l),
c AS (SELECT doc_id, x, count(*) AS n, min(i) AS i FROM e GROUP BY ALL),
b AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS r FROM c)
SELECT doc_id, coalesce(x, doc_id::VARCHAR) AS title FROM documents LEFT JOIN (SELECT doc_id, x FROM b WHERE r = 1) USING (doc_id)"""
)
def display_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", titles.display_title(F.lit(None).cast("string"), F.col("text"), F.col("doc_id").cast("string")).alias("title"))


@register("SELECT doc_id, length(repeat(source || chr(10), 3) || left(text, 30000))::BIGINT AS n_chars, md5(repeat(source || chr(10), 3) || left(text, 30000)) AS text_md5, doc_id || ': 《' || source || '》 栏目:' || lang AS card FROM documents")
def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents")).withColumn("t", titles.index_text(F.col("source"), F.col("text")))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"), titles.card(F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.lit(None).cast("string")).alias("card"))


@register(
    """WITH q AS (SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%?|[A-Za-z]+'), lambda x: lower(x))) AS tok FROM benchmark),
d AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%?|[A-Za-z]+'), lambda x: lower(x))) AS tok FROM documents),
a AS (SELECT item_id, tok, count(*) AS n FROM q GROUP BY ALL), b AS (SELECT doc_id, tok, count(*) AS m FROM d GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(sum(least(n, m) * CASE WHEN regexp_matches(tok, '^[0-9]|%$') THEN 4.0 ELSE 0.6 END), 3)::DOUBLE AS overlap FROM a JOIN b USING (tok) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS place FROM s)
SELECT item_id, doc_id, overlap, place::INT AS place FROM r WHERE place <= 24"""
)
def card_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share most tokens with each benchmark item, as cards are ranked, among all documents."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return cards.overlaps(items, docs, cards.MOST_CARDS).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "overlap", "place")


PHRASES = """list_filter(list_distinct(flatten(list_transform(regexp_extract_all(regexp_replace(q, '[\\s\\p{Z}]+', '', 'g'), '[A-Za-z0-9.%％一-鿿]+'),
  lambda r: flatten(list_transform(range(1, length(r)), lambda i: list_transform(range(2, least(10, length(r) - i + 1) + 1), lambda n: substr(r, i, n))))))), lambda p: contains(verbatim, p))"""


@register(
    bm25_sql(
        "'all'",
        f""", {CARDS_SQL},
card AS (SELECT doc_id || ':p0:' || lpad(seq::VARCHAR, 4, '0') AS id, doc_id, title, verbatim FROM s),
pair AS (SELECT r.qid, r.rank AS doc_pos, card.*, q FROM ranked r JOIN card ON card.doc_id = r.unit JOIN q ON q.qid = r.qid WHERE r.rank <= 4 AND r.score > 0),
toks AS (SELECT qid, id, [lower(x) FOR x IN regexp_extract_all(q, '[0-9]+(?:\\.[0-9]+)?%?|[A-Za-z]+')] AS a, regexp_extract_all(verbatim, '[0-9]+(?:\\.[0-9]+)?%?|[A-Za-z]+|[一-鿿]+') AS b FROM pair),
tok AS (SELECT qid, id, t, len(list_filter(a, lambda x: x = t)) AS n, len(list_filter(b, lambda x: lower(x) = t)) AS m FROM (SELECT *, unnest(list_distinct(a)) AS t FROM toks)),
overlap AS (SELECT qid, id, sum(least(n, m) * CASE WHEN regexp_matches(t, '^[0-9]|%$') THEN 4.0 ELSE 0.6 END) AS v FROM tok GROUP BY ALL),
phrased AS (SELECT qid, id, list_sum(list_transform(list_filter(p, lambda x: len(list_filter(p, lambda y: y <> x AND contains(y, x))) = 0), lambda x: 4 * length(x) * length(x))) AS v FROM (SELECT qid, id, {PHRASES} AS p FROM pair)),
valued AS (
  SELECT qid, id, doc_pos, length(verbatim) AS n, round(coalesce(overlap.v, 0) + coalesce(phrased.v, 0) + 6 * len(list_intersect({NUMBERS.format("q")}, {NUMBERS.format("verbatim")}))
    + CASE WHEN length(regexp_replace(title, '[\\s：:（）()]+', '', 'g')) >= 2 AND contains(regexp_replace(q, '\\s+', '', 'g'), regexp_replace(title, '[\\s：:（）()]+', '', 'g')) THEN 24 ELSE 0 END
    + 60 * len(list_filter(list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all(q, '[“"]([^”"]{{2,80}})[”"]', 1), lambda x: string_split_regex(x, '[、,，/]|或|以及|等'))), lambda x: regexp_replace(x, '^[\\s‘’''（(]+|[\\s‘’''）)]+$', '', 'g')), lambda x: length(x) >= 2)), lambda x: contains(verbatim, x))), 3)::DOUBLE AS score
  FROM pair LEFT JOIN overlap USING (qid, id) LEFT JOIN phrased USING (qid, id)),
turned AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_pos ORDER BY score DESC, id) AS turn FROM valued WHERE score > 0),
ordered AS (SELECT qid, list(struct_pack(id := id, n := n, score := score) ORDER BY least(turn, 3), CASE WHEN turn <= 2 THEN doc_pos ELSE 0 END, score DESC, id) AS c FROM turned WHERE turn <= 56 GROUP BY qid),
taken AS (SELECT qid, list_reduce(list_transform(c, lambda x: {{'used': x.n, 'ids': [struct_pack(id := x.id, score := x.score)]}}), lambda a, x: CASE WHEN len(a.ids) < 24 AND a.used + x.used + 150 <= 8500 THEN {{'used': a.used + x.used + 150, 'ids': list_append(a.ids, x.ids[1])}} ELSE a END, {{'used': 0::BIGINT, 'ids': []::STRUCT(id VARCHAR, score DOUBLE)[]}}) AS r FROM ordered)
SELECT qid AS item_id, (i - 1)::INT AS ord, e.id AS id, e.score AS score FROM (SELECT qid, unnest(r.ids) AS e, generate_subscripts(r.ids, 1) AS i FROM taken)""",
    )
)
def card_rank_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clause cards that each item takes of the four documents that fit it best, by tokens, topics, numbers, titles, phrases and anchors."""
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    best = index.top(index.scores(docs.select(F.lit("all").alias("index_key"), F.col("doc_id").alias("unit"), "text"), items, most=4), 4)
    chosen = Scratch(spark, "chosen").keep(best.select("qid", F.col("unit").alias("doc_id"), F.col("rank").cast("long").alias("doc_pos")), "chosen")
    wanted = docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    found = cards.ranked(items, chosen, cards.cards(_numbered(wanted)))
    return cards.select(found.select("qid", "doc_pos", "id", "score", "n")).select(F.col("qid").alias("item_id"), "ord", "id", "score")


LATIN, AS_CJK = "abcdefghijklmnopqrstuvwxyz", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥金木水火"
PAIRS = "list_distinct(flatten(list_transform(regexp_extract_all({0}, '[一-鿿]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"


@register(
    bm25_sql(
        "'all'",
        f""", l AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) - 1 AS row FROM (SELECT doc_id, string_split(text, '. ') AS x FROM documents)),
line AS (SELECT doc_id, row, length(t) % 7 AS bucket, t, {PAIRS.format(f"translate(lower(left(t, 40)), '{LATIN}', '{AS_CJK}')")} AS p FROM l),
asked AS (SELECT r.qid, r.unit AS doc_id, r.rank AS doc_pos, {PAIRS.format(f"translate(lower(q), '{LATIN}', '{AS_CJK}')")} AS p FROM ranked r JOIN q ON q.qid = r.qid WHERE r.rank <= 4 AND r.score > 0),
hit AS (SELECT qid, doc_pos, row, bucket, t, len(list_intersect(line.p, asked.p)) AS overlap FROM line JOIN asked USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, doc_pos, row) AS ord FROM hit WHERE overlap >= 3),
d AS (SELECT *, row_number() OVER (PARTITION BY qid, bucket ORDER BY ord) AS turn, min(ord) OVER (PARTITION BY qid, bucket) AS first FROM o),
b AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY first) AS no FROM d), m AS (SELECT *, max(no) OVER (PARTITION BY qid) AS n FROM b),
z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY turn, first) AS place FROM m WHERE (turn - 1) * n + no - 1 <= 400)
SELECT qid AS item_id, place::INT AS place, bucket::VARCHAR AS bucket, md5(t) AS line_md5 FROM z WHERE place <= 40""",
    )
)
def fact_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the four documents that fit an item best as lines of seven tables, their letters and the item's as CJK characters."""
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    cjk = lambda c: F.translate(F.lower(c), LATIN, AS_CJK)
    best = index.top(index.scores(docs.select(F.lit("all").alias("index_key"), F.col("doc_id").alias("unit"), "text"), items, most=4), 4)
    questions = best.join(items, "qid").groupBy("qid").agg(cjk(F.first("query")).alias("text"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "unit"))), lambda x: x["unit"]).alias("doc_ids"))
    questions = Scratch(spark, "facts").keep(questions, "questions")
    wanted = docs.join(questions.select(F.explode("doc_ids").alias("doc_id")).distinct(), "doc_id", "left_semi")
    rows = wanted.select(F.col("doc_id").alias("doc"), F.lit(0).alias("page"), F.posexplode(F.split("text", "\\. ", -1)).alias("row", "line"))
    lines = rows.select("doc", "page", "row", "line", cjk(F.left("line", F.lit(40))).alias("label"), (F.length("line") % 7).cast("string").alias("title"))
    found = facts.block(facts.ranked(lines, questions))
    return found.select(F.col("qid").alias("item_id"), "place", "bucket", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@register()
def policy_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of documents under a cover that names an insurer by the source's number and a product by the document's."""
    digits = lambda c: F.translate(c, "0123456789src", "甲乙丙丁戊己庚辛壬癸")
    insurer = F.concat(F.lit("山海"), digits(F.col("source")), F.lit("人寿保险股份有限公司"))
    product = F.concat(F.lit("山海福"), digits(F.col("doc_id").cast("string")), F.lit("号终身寿险条款"))
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.concat(insurer, F.lit("\n"), product, F.lit("\n"), F.col("text")).alias("text"))
    return identity.policies(docs).select("doc_id", "company", "product", F.array_join("alias", "|").alias("aliases"))

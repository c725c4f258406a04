"""Answer queries over conversations and documents: slots, letters, parsing, comparison and redaction of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.functions import text as T
from corpusloom.plans.catalogue import register
from corpusloom.session import spread, table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


KIND_SQL = "CASE WHEN {0} LIKE '%\\%' ESCAPE '\\' THEN 'percent' WHEN contains({0}, '>') THEN 'ranking' WHEN regexp_full_match({0}, '[0-9.]+') THEN 'number' WHEN regexp_matches({0}, '[0-9]{{4}}年') THEN 'date' WHEN regexp_full_match({0}, '[A-D]+') THEN 'letter' ELSE 'text' END"


@register(f"SELECT kind, count(*)::BIGINT AS n, count(DISTINCT w)::BIGINT AS n_kinds FROM (SELECT w, {KIND_SQL.format('w')} AS kind FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '') GROUP BY kind")
def slot_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spread(table(spark, sf_dir, "documents")).select(F.explode(F.split("text", " ", -1)).alias("w")).filter("w <> ''")
    # each distinct word once: a frequent word is summed before it is shuffled
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", A.slot_kind(F.col("w")))
    return counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_kinds"))


@register(
    """WITH w AS (SELECT conv_id, turn, text, [CASE WHEN length(text) % 2 = 0 THEN 'number' ELSE 'text' END] AS kinds FROM conversations)
SELECT conv_id, turn, CASE WHEN kinds[1] = 'number' AND regexp_matches(text, '哪一天|何时|什么日期|日期为多少') THEN 'date'
 WHEN kinds[1] = 'number' AND regexp_matches(text, '(?:同比|环比|较[^，。；]{0,16})(?:增长率|下降率|增速)|(?:百分比|百分率|毛利率|收益率|增值率)[^，。；]{0,12}(?:多少|为)') AND NOT regexp_matches(text, '不带\\s*[%％]|不带单位|百分点') THEN 'percent' ELSE kinds[1] END AS kind FROM w"""
)
def slot_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.when(F.length("text") % 2 == 0, "number").otherwise("text"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.get(A.refine_kinds(kinds, F.col("text")), F.lit(0)).alias("kind"))


STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


@register(
    f"""WITH c AS (SELECT conv_id, turn, string_split_regex({STRIP.format('text')}, '[;；]') AS a, string_split_regex({STRIP.format('text')}, '[,，]') AS b, 2 + turn % 2 AS n FROM conversations),
p AS (SELECT conv_id, turn, n, list_filter(list_transform(CASE WHEN len(a) < n AND len(b) >= n THEN b ELSE a END, lambda x: {STRIP.format('x')}), lambda x: x <> '') AS parts FROM c)
SELECT conv_id, turn, least(len(parts), n)::BIGINT AS n_filled, array_to_string(list_resize(parts[1:n], n, ''), '|') AS slots FROM p"""
)
def slot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (2 + F.col("turn") % 2).cast("int")
    rows = _turns(spark, sf_dir).select("conv_id", "turn", A.split_slots(F.col("text"), n, F.lit(False)).alias("s"))
    return rows.select("conv_id", "turn", F.size(F.filter("s", lambda x: x != "")).cast("long").alias("n_filled"), F.array_join("s", "|").alias("slots"))


@register(
    """WITH l AS (SELECT conv_id, turn, role, regexp_extract_all(upper(text), '[A-D]') AS l FROM conversations)
SELECT conv_id, turn, role, CASE WHEN len(l) = 0 THEN '' WHEN role = 'user' THEN l[1] ELSE array_to_string(list_sort(list_distinct(l)), '') END AS letters FROM l"""
)
def letters_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = F.when(F.col("role") == "user", "mcq").otherwise("multi")
    return _turns(spark, sf_dir).select("conv_id", "turn", "role", A.letters(F.col("text"), fmt).alias("letters"))


@register(
    """WITH c AS (SELECT conv_id, turn, regexp_replace(text, '(?i)the ', '答案: A, ', 'g') AS text FROM conversations),
m AS (SELECT conv_id, turn, regexp_extract_all(text, '答案[:：]\\s*([A-D](?:[\\s,，、;/；]*[A-D]){0,3})', 1) AS m, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) <= 12) AS short FROM c),
l AS (SELECT conv_id, turn, m, list_filter(list_transform(short, lambda x: array_to_string(list_sort(list_distinct(regexp_extract_all(upper(x), '[A-D]'))), '')), lambda x: x <> '') AS f FROM m)
SELECT conv_id, turn, CASE WHEN len(m) > 0 THEN array_to_string(list_sort(list_distinct(regexp_extract_all(m[-1], '[A-D]'))), '') ELSE coalesce(f[-1], '') END AS answer FROM l"""
)
def parse_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.regexp_replace("text", "(?i)the ", "答案: A, ")
    return _turns(spark, sf_dir).select("conv_id", "turn", A.parse_choice(content, F.lit("multi")).alias("answer"))


@register(
    f"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '\\. ', chr(10) || '答案: ', 'g') AS text FROM conversations),
m AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '(?m)^\\s*答案[:：]\\s*(.+)$', 1), lambda x: {STRIP.format('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '<[^>]+>')) AS m FROM c)
SELECT conv_id, turn, coalesce(m[-1], '') AS answer FROM m"""
)
def parse_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.regexp_replace("text", "\\. ", "\n答案: ")
    return _turns(spark, sf_dir).select("conv_id", "turn", A.parse_calc(content).alias("answer"))


@register(
    """WITH l AS (SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice) || ';' || CASE WHEN l_tax > 0.04 THEN printf('%.1f', 100 * l_tax) || '%' ELSE 'none' END AS answer FROM lineitem)
SELECT l_orderkey, l_linenumber, regexp_full_match(split_part(answer, ';', 1), '-?[0-9,]+(?:\\.[0-9]+)?') AND regexp_full_match(split_part(answer, ';', 2), '-?[0-9,]+(?:\\.[0-9]+)?\\s*[%％]') AS valid FROM l"""
)
def valid_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.format_string("%.2f", "l_extendedprice"), F.lit(";"), F.when(F.col("l_tax") > 0.04, F.concat(F.format_string("%.1f", 100 * F.col("l_tax")), F.lit("%"))).otherwise("none"))
    kinds = F.array(F.lit("number"), F.lit("percent"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", A.valid_calc(answer, kinds).alias("valid"))


@register("SELECT o_orderkey, printf('%.2f', o_totalprice) AS as_number, printf('%.2f', o_totalprice) || '%' AS as_percent FROM orders")
def slot_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("o_totalprice").cast("decimal(18,6)").cast("string")
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", A.format_slot(value, F.lit("number")).alias("as_number"), A.format_slot(value, F.lit("percent")).alias("as_percent"))


@register(
    """WITH o AS (SELECT o_orderkey, printf('%.2f', o_totalprice) AS a, printf('%.2f', round(o_totalprice)) AS b, strftime(o_orderdate, '%Y-%m-%d') AS d1, strftime(o_orderdate, '%Y年%-m月%-d日') AS d2 FROM orders)
SELECT o_orderkey, a::DECIMAL(18,2) = b::DECIMAL(18,2) AS same_number, false AS same_percent, true AS same_date FROM o"""
)
def answer_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    a, b = F.format_string("%.2f", price), F.format_string("%.2f", F.round(price))
    d = F.col("o_orderdate")
    spelt = F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日"))
    return table(spark, sf_dir, "orders").select("o_orderkey", A.equivalent(a, b).alias("same_number"), A.equivalent(a, F.concat(a, F.lit("%"))).alias("same_percent"), A.equivalent(F.date_format(d, "yyyy-MM-dd"), spelt).alias("same_date"))


@register(
    """SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\bsk-[A-Za-z0-9_-]{8,}\\b', '[REDACTED]', 'g'), '(?i)((?:authorization|x-api-key|api[_ -]?key)["'']?\\s*[:=]\\s*["'']?)(?:bearer\\s+)?([^\\s,;}''"]+)', '\\1[REDACTED]', 'g')) AS text_md5 FROM documents"""
)
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.md5(T.redact(F.col("text")).cast("binary")).alias("text_md5"))


@register(
    """SELECT doc_id, len(regexp_extract_all(text, 'token = "[0-9a-f]{40}"'))::BIGINT AS n_tokens, len(regexp_extract_all(text, '\\bsk-[A-Za-z0-9_-]{8,}\\b'))::BIGINT AS n_keys FROM documents"""
)
def leak_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return spread(table(spark, sf_dir, "documents")).select("doc_id", count('token = "[0-9a-f]{40}"').alias("n_tokens"), count("\\bsk-[A-Za-z0-9_-]{8,}\\b").alias("n_keys"))


@register(
    """SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '[0-9]{4}\\s*年(?:\\s*[0-9]{1,2}\\s*月(?:\\s*[0-9]{1,2}\\s*日)?)?|-?[0-9][0-9,]*(?:\\.[0-9]+)?\\s*(?:%|天|元|年)'), lambda x: regexp_replace(x, '\\s+', '', 'g'))))::BIGINT AS n_numbers FROM documents"""
)
def numbers_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.size(T.numbers_with_units(F.col("text"))).cast("long").alias("n_numbers"))


@register(
    """WITH q AS (SELECT doc_id, regexp_extract_all(text, '[“"]([^”"]{2,80})[”"]', 1) AS q FROM documents),
p AS (SELECT doc_id, list_transform(flatten(list_transform(q, lambda x: string_split_regex(x, '[、,，/]|或|以及|等'))), lambda x: regexp_replace(x, '^[\\s‘’''（(]+|[\\s‘’''）)]+$', '', 'g')) AS p FROM q)
SELECT doc_id, len(list_distinct(list_filter(p, lambda x: length(x) >= 2)))::BIGINT AS n_anchors FROM p"""
)
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.size(T.anchors(F.col("text"))).cast("long").alias("n_anchors"))


@register(
    """WITH q AS (SELECT a.item_id, regexp_replace(a.text, '\\s+', '', 'g') AS q, b.text AS t FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
r AS (SELECT item_id, t, unnest(regexp_extract_all(q, '[A-Za-z0-9.%％一-鿿]+')) AS run FROM q),
c AS (SELECT DISTINCT item_id, substr(run, i, n) AS p, t FROM r, (SELECT unnest(range(1, 1001)) AS i), (SELECT unnest(range(2, 11)) AS n) WHERE i + n - 1 <= length(run)),
hit AS (SELECT item_id, p FROM c WHERE contains(t, p)),
top AS (SELECT a.item_id, a.p FROM hit a WHERE NOT EXISTS (SELECT 1 FROM hit b WHERE b.item_id = a.item_id AND b.p <> a.p AND contains(b.p, a.p)))
SELECT item_id, coalesce(string_agg(p, ' ' ORDER BY p), '') AS phrases FROM benchmark LEFT JOIN top USING (item_id) GROUP BY item_id"""
)
def phrase_maximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that each item shares with the next one; the SQL reads runs of up to 1,000 characters, over twice the longest item."""
    items = spread(table(spark, sf_dir, "benchmark"))
    following = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    pairs = items.join(following, "item_id", "left").select("item_id", T.shared_phrases(F.col("text"), F.col("next")).alias("p"))
    return pairs.select("item_id", F.array_join(F.array_sort(F.coalesce("p", F.array().cast("array<string>"))), " ").alias("phrases"))

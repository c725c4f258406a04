"""Titles, cards and heads of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import all_matches, strip

# Page furniture, weak titles, and what titles and products end in.
FURNITURE = "免责声明|目录|页码|分析师|研究助理|联系人|电子邮件|邮箱|电话|声明|提示|执业证书|^\\d+$|^P\\d+$|@"
WEAK = "声明|提示|指引|目录|信息披露"
ENDING = "(?:条款|办法|规定|决定|报告书|说明书|年度报告|全文|摘要|指引|准则|细则|保险|年金|寿险|研究报告|点评|深度报告)$"
NOISE = "^(?:第[一二三四五六七八九十百]+[条章]|目\\s*录|[\\d\\s.]+$|注册号|阅读指引|总\\s*则)"
PRODUCT = "[一-鿿A-Za-z0-9]{2,18}(?:养老年金保险|年金保险|终身寿险|两全保险|养老保险|人寿保险|财产保险|责任保险|医疗保险|疾病保险|意外伤害保险)(?:（[^）]{1,14}）){0,2}"
CONTRACT = "^[^。；]{0,40}(?:募集说明书|重大资产重组报告书|报告书)[^。；]{0,10}$"
SIZE_SLACK = 0.6


def lines(text: Column, least: int, most: int) -> Column:
    """Stripped lines of some length that are no page marks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\R", -1), strip), lambda x: (F.length(x) >= least) & (F.length(x) <= most) & ~F.startswith(x, F.lit("[P")))


def content_head(text: Column, limit: int = 120) -> Column:
    """The first informative lines near the start, up to ``limit`` characters."""
    good = F.filter(lines(F.substring(text, 1, 3000), 6, 1 << 20), lambda x: ~x.rlike(FURNITURE))
    zero = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(a["n"] >= limit, a).otherwise(F.struct(F.concat(a["kept"], F.array(x)).alias("kept"), (a["n"] + F.length(x)).alias("n")))
    return F.substring(F.regexp_replace(F.array_join(F.aggregate(good, zero, step, lambda a: a["kept"]), " "), "(?U)\\s+", " "), 1, limit)


def most_frequent(items: Column) -> Column:
    """The most frequent item of an array, the first seen of several; null if empty."""
    kinds = F.array_distinct(items)
    return F.array_min(F.transform(kinds, lambda k, i: F.struct((-F.size(F.filter(items, lambda x: x == k))).alias("n"), i.alias("i"), k.alias("k"))))["k"]


def display_title(title: Column, text: Column, doc_id: Column) -> Column:
    """The title, if it is no page furniture; else the most frequent of the quoted titles and informative lines near the start."""
    bare = strip(F.regexp_replace(F.coalesce(title, F.lit("")), "^标题[:：]", ""))
    head = F.substring(text, 1, 8000)
    found = F.concat(all_matches(F.coalesce(head, F.lit("")), "《([^》]{4,80})》", 1), F.filter(lines(head, 6, 80), lambda x: ~x.rlike(FURNITURE)))
    return F.when((bare != "") & ~bare.rlike(WEAK), bare).otherwise(F.coalesce(most_frequent(found), F.when(bare != "", bare), doc_id))


def card(doc_id: Column, title: Column, section: Column, date: Column) -> Column:
    part = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label), x))
    return F.concat_ws(" ", F.concat(doc_id, F.lit(": 《"), title, F.lit("》")), part("栏目:", section), part("日期:", F.substring(date, 1, 10)))


def index_text(title: Column, text: Column, head: int = 30_000) -> Column:
    """What routing indexes: the title three times before the head of the text."""
    return F.concat(F.repeat(F.concat(F.coalesce(title, F.lit("")), F.lit("\n")), F.lit(3)), F.substring(F.coalesce(text, F.lit("")), 1, head))


def by_font(spans: DataFrame) -> DataFrame:
    """``doc, title``: the largest lines of the first of two pages that has any, the first three of them joined.

    Takes ``doc, page, ord, size, text`` of lines (size: that of a line's largest span).
    """
    t = spans.withColumn("text", strip(F.col("text"))).filter((F.col("page") < 2) & F.length("text").between(5, 60) & ~F.col("text").rlike(NOISE))
    doc = Window.partitionBy("doc")
    t = t.withColumn("size", F.round("size", 1)).withColumn("first", F.min("page").over(doc)).filter("page = first")
    t = t.withColumn("most", F.max("size").over(doc)).filter(F.col("size") >= F.col("most") - SIZE_SLACK)
    t = t.withColumn("k", F.row_number().over(doc.orderBy("ord"))).filter("k <= 3")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "")
    return t.groupBy("doc").agg(F.substring(joined, 1, 70).alias("title"))


def product_name(text: Column, least: int = 3) -> Column:
    """The product that a text names most, by count times length, ``least`` times at least; null without one."""
    found = F.filter(all_matches(F.coalesce(text, F.lit("")), PRODUCT), lambda x: ~x.rlike("本合同|条款"))
    counted = F.transform(F.array_distinct(found), lambda k: F.struct(F.size(F.filter(found, lambda x: x == k)).alias("n"), k.alias("k")))
    return F.array_max(F.transform(F.filter(counted, lambda c: c["n"] >= least), lambda c: F.struct((c["n"] * F.length(c["k"])).alias("score"), c["k"].alias("k"))))["k"]


def rewritten(domain: Column, doc_id: Column, title: Column, found: Column, text: Column) -> Column:
    """A document's title by its domain's rules, from the title it has and the one found in its source."""
    now = F.coalesce(found, title)
    product = product_name(text)
    policy = F.when(~now.rlike(PRODUCT) & product.isNotNull(), F.concat(product, F.lit("条款"))).otherwise(now)
    year = F.regexp_extract(doc_id, "(20\\d\\d)", 1)
    report = F.when(year != "", F.concat(F.substring_index(now, "20", 1), year, F.lit("年年度报告"))).otherwise(now)
    extra = F.get(F.filter(F.slice(lines(F.substring(text, 1, 2000), 1, 1 << 20), 1, 20), lambda x: x.rlike(CONTRACT)), F.lit(0))
    contract = F.when(found.isNotNull() & ~found.rlike("说明书|报告书") & extra.isNotNull() & ~F.contains(found, extra), F.substring(F.concat(found, extra), 1, 80)).otherwise(now)
    return F.when(domain == "insurance", policy).when(domain == "financial_reports", report).when(domain == "financial_contracts", contract).otherwise(now)

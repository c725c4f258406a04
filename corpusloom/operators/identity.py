"""Identities of documents: companies, products, aliases and years, by which questions find them. Columns throughout but for NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import text as T
from corpusloom.session import Scratch

# Legal suffixes, labels, markers and product kinds of policies.
INSURER = "[一-鿿]{2,32}(?:保险股份有限公司|保险有限责任公司)"
INSURER_END = "(?:保险股份有限公司|保险有限责任公司)$"
COMPANY = "[一-鿿A-Za-z0-9（）()]{2,42}?(?:股份有限公司|集团有限公司|有限责任公司|有限公司)"
COMPANY_END = "(?:股份有限公司|集团有限公司|有限责任公司|有限公司)$"
SHORT_NAME = "(?:股票|证券|公司)简称\\s*[:：]\\s*([A-Za-z0-9一-鿿]{2,16})"
GLOSSARY = "(?m)^\\s*([^\\n]{2,48})\\s*\\n\\s*指\\s+([^\\n]{2,80}?(?:股份有限公司|集团有限公司|有限责任公司|有限公司))"
NO_ALIAS = (
    "股份有限公司", "有限公司", "集团有限公司", "上市公司", "公司", "本公司", "发行人", "标的公司", "目标公司", "交易对方", "标的资产", "交易标的", "债务人", "债权人",
    "主承销商", "独立财务顾问", "年度报告", "募集说明书",
)
MEANS = ("均指", "我们指", "本公司指", "保险人指", "是指", "指")
BOUNDS = ("为", "由", "和", "与", "，", "。", "（", "(")
PRODUCTS = (
    "专属商业养老保险", "家庭财产综合保险", "商业保险示范条款", "养老年金保险", "重大疾病保险", "意外伤害保险", "家庭财产保险", "终身寿险", "医疗保险", "责任保险", "商业保险", "财产保险", "年金保险", "健康保险",
)
NO_TITLE = "本保险合同由|保险合同由|本保险条款、|以下简称|内容的解释|本阅读指引|我们提供的保障|产品提供|合同|保险公司|保险责任"
PROSE = "适用|依据|若|未经|包括|取得补偿|赔付|结算|颁布|定义|给付|另有|被保险人|投保人|受益人|我们|本公司"
STOPS = ("内容的解释", "以下简称", "本阅读指引", "注册号")
GENERAL = ("保险", "保险条款", "商业", "财产", "责任", "医疗", "意外伤害", "重大疾病", "养老年金", "终身寿", "个人", "团体")
GENERAL_COMPANY = (*GENERAL, "本公司", "公司", "集团", "股份", "有限", "在线")
SECTORS = "(?:保险|财产|人寿|健康|养老|在线|集团)$"
COUNTRY = "^(?:中华人民共和国|中国)"
KINDS = "(?:专属商业养老保险|养老年金保险|终身寿险|重大疾病保险|意外伤害保险|医疗保险|综合保险|责任保险|商业保险|保险|团体)$"
POLICY_ALIAS = "险种简称\\s*[:：]\\s*[“\"']?([^\\s，。；;”\"']{2,24})"
COMPANY_ALIAS = "(?:公司中文简称|公司的中文简称|公司简称|企业简称)\\s*[:：]?\\s*[“\"']?([^\\s，。；;”\"']{2,24})"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normal(text: Column) -> Column:
    """Letters, digits, CJK characters and percent signs in lower case after NFKC, which only Python has: an Arrow-batched UDF."""
    return F.lower(F.regexp_replace(_nfkc(F.coalesce(text, F.lit(""))), "[^0-9a-zA-Z一-鿿%]+", ""))


def _longest_first(values: Column) -> Column:
    return F.transform(F.array_sort(F.transform(F.array_distinct(values), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


def plain_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\\R", -1), lambda x: ~F.trim(x).rlike("^\\[P\\d+\\]$"))
    return F.filter(F.transform(lines, T.title_compact), lambda x: x != "")


def _clean_insurer(found: Column) -> Column:
    for marker in MEANS:
        found = F.substring_index(found, marker, -1)
    bounds = F.array(*[F.lit(b) for b in BOUNDS])

    def shorter(name: Column, bound: Column) -> Column:
        tail = F.element_at(F.split(name, F.concat(F.lit("\\Q"), bound, F.lit("\\E")), -1), -1)
        return F.when(tail.rlike(INSURER_END) & (F.length(tail) >= 8), tail).otherwise(name)

    return F.aggregate(bounds, F.regexp_extract(found, INSURER, 0), shorter)


def insurer(lines: Column) -> Column:
    """The first line that is an insurer's name alone; else of all names in lines the first, shortest and smallest. Null without one."""
    alone = F.get(F.filter(lines, lambda x: x.rlike(f"^{INSURER}$")), F.lit(0))
    named = F.flatten(F.transform(lines, lambda x, i: F.transform(T.all_matches(x, INSURER), lambda m: F.struct(i.alias("i"), _clean_insurer(m).alias("name")))))
    found = F.transform(named, lambda f: F.struct(f["i"].alias("i"), F.length(f["name"]).alias("n"), f["name"].alias("name")))
    return F.coalesce(alone, F.array_min(F.filter(found, lambda f: f["name"] != ""))["name"])


def _without_company(title: Column, company: Column) -> Column:
    rest = F.when(F.startswith(title, company) & (company != ""), F.substr(title, F.length(company) + 1)).otherwise(title)
    return F.ltrim(rest, F.lit("：:，,。-—"))


def canonical_title(found: Column, company: Column) -> Column:
    edges = "【】[]“”\"'，,。；;：:"
    title = F.regexp_replace(T.title_compact(found), "^(?:第?[〇零一二三四五六七八九十百\\d]+页|-?\\d+-?)", "")
    title = T.trim_of(_without_company(title, company), edges)
    title = F.regexp_replace(title, "(?:(?:利益)?条款)?（第[〇零一二三四五六七八九十百\\d]+页）$|（第[〇零一二三四五六七八九十百\\d]+页$", "")
    for stop in STOPS:
        title = F.substring_index(title, stop, 1)
    return T.trim_of(F.regexp_replace(title, "利益条款$", ""), edges)


def product_like(title: Column) -> Column:
    n = F.length(title)
    kind = title.rlike("|".join(PRODUCTS))
    return (n >= 5) & (n <= 90) & kind & ~title.rlike(f"{INSURER}|[（(]$|[，。；：“”]|{PROSE}|{NO_TITLE}")


def title_score(title: Column, line: Column, quoted: Column) -> Column:
    n = F.length(title)
    longest = F.greatest(*[F.when(F.contains(title, F.lit(k)), len(k)).otherwise(0) for k in PRODUCTS])
    return (
        F.when(quoted, 95).otherwise(100)
        + F.greatest(F.lit(0), 15 - F.least(line, F.lit(15)))
        + longest
        + F.least(n, F.lit(30))
        - F.when(n < 12, (12 - n) * 5).otherwise(0)
        + F.when(title.endswith("条款"), 12).otherwise(0)
        + F.when(title.rlike("20\\d{2}版|[A-ZＥ]款|互联网|分红型|万能型"), 6).otherwise(0)
        - F.greatest(F.lit(0), n - 55)
    )


def product(text: Column, lines: Column, company: Column) -> Column:
    """The best product title among lines and quotations; ties go to the earlier, the shorter and the smaller. Null without one."""
    quotes = T.all_matches(T.title_compact(F.substring(text, 1, 16000)), "[“\"]([^”\"]{5,100}(?:保险|寿险)[^”\"]{0,30})[”\"]", 1)
    row = lambda t, i, q: F.struct((-title_score(t, i, q)).alias("minus"), i.alias("line"), F.length(t).alias("n"), t.alias("title"))
    titles = lambda a: F.transform(a, lambda x: canonical_title(x, company))
    of_lines = F.transform(titles(lines), lambda t, i: F.when(product_like(t), row(t, i, F.lit(False))))
    of_quotes = F.transform(titles(quotes), lambda t: F.when(product_like(t), row(t, F.lit(25), F.lit(True))))
    return F.array_min(F.filter(F.concat(of_lines, of_quotes), lambda s: s.isNotNull()))["title"]


def company_aliases(text: Column, company: Column) -> Column:
    """Short names that a text gives its company, by labels or in brackets after the name."""
    head = F.substring(text, 1, 20_000)
    context = F.concat(F.lit("(?s)"), company, F.lit(".{0,80}?(?:以下简称|简称(?:为)?)\\s*[“\"']([^\\s，。；;”\"']{2,24})"))
    found = F.concat(T.all_matches(head, COMPANY_ALIAS, 1), F.regexp_extract_all(head, context, F.lit(1)))
    bare = F.transform(found, T.title_compact)
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: (F.length(x) >= 2) & (F.length(x) <= 24) & ~x.isin(*GENERAL_COMPANY))))


def _peeled(text: Column, pattern: str, rounds: int = 12) -> Column:
    """A text and what is left of it each time that a suffix is taken off."""
    step = lambda a, _: F.concat(a, F.array(F.regexp_replace(F.element_at(a, -1), pattern, "")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(text), step)


def in_order(needle: Column, text: Column) -> Column:
    """Whether a text has the characters of another in their order."""
    rest = F.aggregate(F.split(text, ""), needle, lambda left, c: F.when((left != "") & F.startswith(left, c) & (c != ""), F.substr(left, F.lit(2))).otherwise(left))
    return rest == ""


def brands(company: Column, product_: Column, aliases: Column) -> Column:
    """Names by which a company goes, longest first: its own, its aliases, without legal and sector suffixes or country, and a product's prefix."""
    core = F.regexp_replace(company, INSURER_END, "")
    names = F.concat(F.array(company), aliases, _peeled(core, SECTORS))
    names = F.concat(names, F.transform(names, lambda x: F.regexp_replace(x, COUNTRY, "")))
    prefixes = F.transform(F.sequence(F.lit(6), F.lit(2), F.lit(-1)), lambda n: F.when(F.length(product_) >= n, F.substr(product_, F.lit(1), n)))
    short = F.get(F.filter(prefixes, lambda p: p.isNotNull() & (F.contains(company, p) | ((F.length(p) <= 4) & in_order(p, company)))), F.lit(0))
    names = F.filter(F.concat(names, F.array(short)), lambda x: x.isNotNull() & (F.length(x) >= 2) & (F.length(x) <= 32) & ~x.isin(*GENERAL_COMPANY))
    return _longest_first(names)


def product_stem(product_: Column, company: Column, names: Column) -> Column:
    """A product's name without its company, brackets and kinds."""
    stem = F.regexp_replace(F.regexp_replace(_without_company(T.title_compact(product_), company), "（[^（）]{1,30}）", ""), "条款$", "")
    brand = F.get(F.filter(names, lambda b: F.startswith(stem, b)), F.lit(0))
    stem = F.when(brand.isNotNull(), F.substr(stem, F.length(brand) + 1)).otherwise(stem)
    return T.trim_of(F.element_at(_peeled(stem, KINDS), -1), "（）()【】[]-—_，,。")


def product_aliases(text: Column, product_: Column, company: Column, stem: Column) -> Column:
    kind = F.regexp_extract(product_, "|".join(PRODUCTS), 0)
    first = F.coalesce(*[F.when(F.contains(product_, F.lit(k)), F.lit(k)) for k in PRODUCTS], kind)
    category = F.regexp_replace(first, "(?:综合|商业|示范条款|保险)$", "")
    longer = F.when((stem != "") & (category != "") & ~F.endswith(stem, category), F.concat(stem, category))
    found = F.concat(T.all_matches(text, POLICY_ALIAS, 1), F.array(stem, F.regexp_replace(stem, "^(?:个人|团体)", ""), longer))
    bare = F.transform(F.filter(found, lambda x: x.isNotNull()), T.title_compact)
    return F.array_distinct(F.filter(bare, lambda x: (F.length(x) >= 2) & (F.length(x) <= 24) & ~x.isin(*GENERAL) & (x != product_) & (x != company)))


def policies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, company, company_aliases, product, alias, brands``, a written table.

    Company or product are null where a text names none; see failures().
    """
    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("lines", plain_lines(F.col("text")))
    d = d.withColumn("company", insurer(F.col("lines")))
    c = F.coalesce("company", F.lit(""))
    d = d.withColumn("product", product(F.col("text"), F.col("lines"), c)).withColumn("company_aliases", F.when(c != "", company_aliases(F.col("text"), c)).otherwise(F.array().cast("array<string>")))
    p = F.coalesce("product", F.lit(""))
    d = d.withColumn("brands", brands(c, p, F.col("company_aliases")))
    d = d.withColumn("stem", product_stem(p, c, F.col("brands")))
    found = d.select("doc_id", "company", "company_aliases", "product", product_aliases(F.col("text"), p, c, F.col("stem")).alias("alias"), "brands")
    return Scratch(docs.sparkSession, "policies").keep(found, "policies")


def failures(found: DataFrame) -> DataFrame:
    """``doc_id, missing``: policies without a company or a product."""
    missing = F.concat_ws(",", F.when(F.col("company").isNull(), "company"), F.when(F.col("product").isNull(), "product"))
    return found.select("doc_id", missing.alias("missing")).filter("missing <> ''")


HEADS = {"financial_reports": 50_000, "financial_contracts": 20_000}


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id, domain, company_key, aliases, year, surface`` from ``doc_id, domain, title, text``: what company routing needs."""
    head = F.substring("text", F.lit(1), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in HEADS.items() for x in kv]), F.col("domain")), F.lit(8_000)))
    d = docs.select("doc_id", "domain", F.coalesce("title", F.lit("")).alias("title"), head.alias("head"))
    both = F.concat("title", F.lit("\n"), "head")
    clean = lambda x: T.trim_of(F.regexp_replace(x, "^(?:标题|股票简称|证券简称|公司简称)[:：]?", ""), "。；;,: ")
    d = d.withColumn("company", F.coalesce(clean(F.get(T.all_matches(both, COMPANY), F.lit(0))), F.lit("")))
    shorts = F.when(F.col("company") != "", T.all_matches(F.substring(both, 1, 12_000), SHORT_NAME, 1)).otherwise(F.array().cast("array<string>"))
    base = F.regexp_replace("company", COMPANY_END, "")
    names = F.filter(F.concat(shorts, F.array("company", base)), lambda x: x != "")
    # glossaries: a short form counts if it is part of the legal name
    defined = F.arrays_zip(T.all_matches(F.col("head"), GLOSSARY, 1).alias("left"), T.all_matches(F.col("head"), GLOSSARY, 2).alias("legal"))
    defined = F.when(F.col("domain") == "financial_contracts", defined).otherwise(F.array().cast("array<struct<left:string,legal:string>>"))
    bare = lambda x: F.lower(F.regexp_replace(x, "[^0-9a-zA-Z一-鿿%]+", ""))

    def of(z: Column) -> Column:
        legal = F.regexp_replace(z["legal"], COMPANY_END, "")
        short = F.filter(F.transform(F.split(z["left"], "[、,，/；;]"), F.trim), lambda s: (bare(s) != "") & (F.contains(bare(legal), bare(s)) | F.contains(bare(s), bare(legal))))
        return F.concat(short, F.array(z["legal"], legal))

    d = d.withColumn("names", F.concat(names, F.flatten(F.transform(defined, of)))).withColumn("base", base)
    d = d.withColumn("year", T.year_of(F.col("title"), F.col("head"), F.col("doc_id"))).withColumn("surface", normal(F.substring(both, 1, 12_000)))
    d = d.withColumn("key", normal(F.col("base")))
    n = d.select("doc_id", F.explode("names").alias("name")).select("doc_id", normal(F.col("name")).alias("alias")).filter((F.length("alias") >= 3) & ~F.col("alias").isin(*NO_ALIAS))
    aliases = n.groupBy("doc_id").agg(_longest_first(F.collect_set("alias")).alias("aliases"))
    out = d.join(aliases, "doc_id", "left")
    return out.select("doc_id", "domain", F.when(F.col("key") != "", F.col("key")).otherwise(F.col("doc_id")).alias("company_key"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "year", "surface")


def brand_forms(found: DataFrame) -> DataFrame:
    """Policies in normal form for routing: ``doc_id, pos, product, aliases, brands``."""
    natural = Window.orderBy(~F.col("doc_id").rlike("^\\d+$"), F.col("doc_id").try_cast("bigint"), "doc_id")
    flat = found.withColumn("pos", F.row_number().over(natural))
    names = flat.select("doc_id", "pos", F.explode(F.concat(F.array(F.struct(F.lit("p").alias("k"), F.coalesce("product", F.lit("")).alias("x"))), F.transform("alias", lambda a: F.struct(F.lit("a").alias("k"), a.alias("x"))), F.transform("brands", lambda b: F.struct(F.lit("b").alias("k"), b.alias("x"))))).alias("n"))
    names = names.select("doc_id", "pos", F.col("n.k").alias("k"), normal(F.col("n.x")).alias("x"))
    of = lambda k: F.coalesce(_longest_first(F.collect_set(F.when((F.col("k") == k) & (F.length("x") >= 2), F.col("x")))), F.array().cast("array<string>"))
    return names.groupBy("doc_id", "pos").agg(F.max(F.when(F.col("k") == "p", F.col("x"))).alias("product"), of("a").alias("aliases"), of("b").alias("brands"))

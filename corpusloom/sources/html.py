"""HTML pages as Spark columns: descriptions, titles and visible text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import all_matches, strip

# The named entities of common pages.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def title(html: Column) -> Column:
    return F.trim(unescape(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))


def meta(html: Column, name: str) -> Column:
    """Contents of the meta elements of a name, in order."""
    return F.transform(all_matches(html, f"(?is)<meta\\s[^>]*name=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1), unescape)


def description(html: Column, most: int = 160) -> Column:
    """The longest description, white space collapsed, cut to ``most`` characters; null without one."""
    found = F.transform(meta(html, "description"), lambda d: F.regexp_replace(strip(d), "(?U)\\s+", " "))
    best = F.try_element_at(F.array_sort(F.transform(found, lambda d: F.struct(F.length(d).alias("n"), d.alias("d")))), F.lit(-1))["d"]
    return F.substring(F.when(best != "", best), 1, most)


def visible_text(html: Column) -> Column:
    """Text nodes outside scripts, styles and the head, stripped, on lines of their own."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<!--.*?-->|<(script|style|head)\\b.*?</\\1\\s*>", "")
    nodes = F.transform(F.split(bare, "<[^>]*>", -1), lambda x: strip(unescape(x)))
    return F.array_join(F.filter(nodes, lambda x: x != ""), "\n")


# The descriptions of a page that count, and the labels of the header that its text gets.
METAS = ("ArticleTitle", "PubDate", "ColumnName", "description", "Description")
HEADER = ("标题：", "栏目：", "发布日期：")


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, in quotation marks of either kind or none; '' without it."""
    value = F.regexp_extract(tag, f"(?is)\\s{name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)", 1)
    return strip(unescape(F.btrim(value, F.lit("\"'"))))


def metas(html: Column) -> Column:
    """A map of the METAS that a page has: the first one with a content, whatever the order of its attributes."""
    tags = F.transform(all_matches(F.coalesce(html, F.lit("")), "(?is)<meta\\b[^>]*>", 0), lambda t: F.struct(_attribute(t, "name").alias("name"), _attribute(t, "content").alias("content")))
    some = F.filter(tags, lambda t: t["name"].isin(*METAS) & (t["content"] != ""))
    firsts = F.filter(F.transform(some, lambda t, i: F.struct(t["name"].alias("name"), t["content"].alias("content"), (F.array_position(F.transform(some, lambda u: u["name"]), t["name"]) == i + 1).alias("first"))), lambda t: t["first"])
    return F.map_from_entries(F.transform(firsts, lambda t: F.struct(t["name"], t["content"])))


def document(html: Column, stem: Column) -> Column:
    """A page's ``text, title, pub_date, column``: a header of three lines, a blank one, and the visible text; the title is the stem where the page names none."""
    named = metas(html)
    get = lambda name: F.coalesce(F.try_element_at(named, F.lit(name)), F.lit(""))
    title_ = F.coalesce(F.try_element_at(named, F.lit("ArticleTitle")), stem)
    lines = [F.concat(F.lit(label), value, F.lit("\n")) for label, value in zip(HEADER, (title_, get("ColumnName"), get("PubDate")), strict=True)]
    body = F.regexp_replace(visible_text(html), "\n{3,}", "\n\n")
    return F.struct(F.concat(*lines, F.lit("\n"), body).alias("text"), title_.alias("title"), get("PubDate").alias("pub_date"), get("ColumnName").alias("column"))

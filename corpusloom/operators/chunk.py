"""Chunking of documents by pages, clauses and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

MOST, LEAST = 1400, 120
LEAST_CLAUSES = 5
# The marker before a page, and a clause's heading at the start of a line.
PAGE = "\\[P(\\d+)\\]\\n"
CLAUSE = "(?=\\n第[一二三四五六七八九十百零\\d]+条)"


def split_long(text: Column) -> Column:
    """Parts of a text over MOST characters: whole lines packed until the next would pass MOST, parts of LEAST characters at least.

    A text within MOST stays whole; a line is never cut.
    """
    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("parts"), F.lit("").alias("buf"))

    def step(a: Column, line: Column) -> Column:
        full = (F.length(a["buf"]) + F.length(line) > MOST) & (F.length(a["buf"]) >= LEAST)
        longer = F.when(a["buf"] == "", line).otherwise(F.concat(a["buf"], F.lit("\n"), line))
        return F.when(full, F.struct(F.concat(a["parts"], F.array(a["buf"])).alias("parts"), line.alias("buf"))).otherwise(F.struct(a["parts"].alias("parts"), longer.alias("buf")))

    end = lambda a: F.when(a["buf"] != "", F.concat(a["parts"], F.array(a["buf"]))).otherwise(a["parts"])
    return F.when(F.length(text) <= MOST, F.array(text)).otherwise(F.aggregate(F.split(text, "\n", -1), zero, step, end))


def _pieces(texts: Column) -> Column:
    return F.filter(F.transform(F.flatten(F.transform(texts, split_long)), strip), lambda p: p != "")


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ord, page, text``: chunks in order, numbered from 0 in each document.

    A text with page markers is cut at them, and what stands before the first is left out; one with LEAST_CLAUSES clause headings is cut
    before each of them; both are then cut as split_long() does. A chunk under LEAST characters takes the next
    one of its page. Null and blank texts have no chunks.
    """
    text = F.col("_text")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    numbers = F.regexp_extract_all(text, F.lit(PAGE), F.lit(1))
    bodies = F.slice(F.split(text, PAGE, -1), 2, F.greatest(F.size(numbers), F.lit(0)))
    piece = "array<struct<page:int,text:string>>"
    paged = F.flatten(F.transform(F.arrays_zip(numbers.alias("n"), bodies.alias("b")), lambda z: F.transform(_pieces(F.array(z["b"])), lambda p: F.struct(z["n"].cast("int").alias("page"), p.alias("text")))))
    clauses = F.split(text, CLAUSE, -1)
    whole = F.when(F.regexp_count(text, F.lit(CLAUSE)) >= LEAST_CLAUSES, clauses).otherwise(F.array(text))
    plain = F.transform(_pieces(whole), lambda p: F.struct(F.lit(None).cast("int").alias("page"), p.alias("text")))
    d = d.withColumn("pieces", F.when(F.size(numbers) > 0, paged.cast(piece)).otherwise(plain.cast(piece)))

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        joins = (F.size(a) > 0) & (F.length(last["text"]) < LEAST) & last["page"].eqNullSafe(x["page"])
        more = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(x["page"].alias("page"), F.concat(last["text"], F.lit("\n"), x["text"]).alias("text"))))
        return F.when(joins, more).otherwise(F.concat(a, F.array(x)))

    merged = F.aggregate("pieces", F.array().cast(piece), step)
    return d.select("doc_id", F.posexplode(merged).alias("ord", "c")).select("doc_id", "ord", F.col("c.page").alias("page"), F.col("c.text").alias("text"))

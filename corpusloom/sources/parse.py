"""The parse driver: raw files to documents, each of which gives a row or an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources import html
from corpusloom.sources.files import text_title

#: Stands for a replacement character that a file has itself; Unicode keeps it out of texts.
_OWN = "\ufdd0"


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text without those that are none; replacement characters that are there stay."""
    kept = F.replace(content.cast("string"), F.lit("\ufffd"), F.lit(_OWN))
    return F.replace(F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")), F.lit(_OWN), F.lit("\ufffd"))


def parse(spark: SparkSession, files: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``domain, doc_id, path, text, title, n_pages, pub_date, column, n_chars, error`` of files ``domain, doc_id, path, kind, place``, a row for each.

    Texts and HTML are read from their paths. Other kinds come decoded as ``pages (path, text, title, n_pages)``; one that isn't there is an error. Of files that
    share an id, all but the first by domain and place are errors. A row with an error has no text.
    """
    order = Window.partitionBy("doc_id").orderBy("domain", "place", "path")
    rows = files.withColumn("again", F.row_number().over(order) > 1)
    paths = [r.path for r in files.filter(F.col("kind").isin("txt", "html")).select("path").collect()]  # as many as Spark lists to read them
    none = spark.createDataFrame([], "path string, content binary")
    raw = (spark.read.format("binaryFile").load(paths).select("path", "content") if paths else none).select("path", decoded(F.col("content")).alias("raw"))
    rows = rows.join(raw, "path", "left")
    pages = pages if pages is not None else spark.createDataFrame([], "path string, text string, title string, n_pages int")
    rows = rows.join(pages.select("path", F.struct("text", "title", "n_pages").alias("page")), "path", "left")
    plain, marked = F.col("kind") == "txt", F.col("kind") == "html"
    page = html.document(F.col("raw"), F.col("doc_id"))
    rows = rows.withColumn("html", F.when(marked, page))
    error = F.when(F.col("again"), "duplicate id").when((plain | marked) & F.col("raw").isNull(), "not readable").when(~plain & ~marked & F.col("page.text").isNull(), F.concat(F.lit("no decoded "), "kind"))
    text = F.when(plain, F.col("raw")).when(marked, F.col("html.text")).otherwise(F.col("page.text"))
    title = F.when(plain, text_title(F.col("raw"), F.col("doc_id"))).when(marked, F.col("html.title")).otherwise(F.coalesce("page.title", "doc_id"))
    rows = rows.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), c)
    return rows.select("domain", "doc_id", "path", good(text).alias("text"), good(title).alias("title"), good(F.col("page.n_pages")).alias("n_pages"), good(F.col("html.pub_date")).alias("pub_date"), good(F.col("html.column")).alias("column"), good(F.length(text)).alias("n_chars"), "error")


def publish_parsed(rows: DataFrame, to: str, strict: bool = True, shown: int = 20) -> DataFrame:
    """Writes what was parsed by domain into the new folder ``to``, and returns the errors ``path, error``.

    If ``strict``, any error stops it before anything is written, with the number of errors and the first ``shown``.
    """
    errors = rows.filter("error is not null").select("path", "error")
    if strict and (n := errors.count()):
        first = errors.orderBy("path").limit(shown).collect()
        raise ValueError(f"{n} files were not parsed: " + "; ".join(f"{r.path}: {r.error}" for r in first))
    rows.filter("error is null").drop("error").write.mode("errorifexists").partitionBy("domain").parquet(to)
    return errors

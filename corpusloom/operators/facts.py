"""Statement facts from word boxes: rows and columns by gaps, cells by nearest column, titles carried over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import Scratch

ROW_GAP, COLUMN_GAP, LEFT_SLACK = 4.5, 28.0, 60.0
LEAST_CELLS, LEAST_FACTS, CARRY_PAGES = 15, 4, 3
#: Titled pages that a task takes at most, about: with more pages tasks grow in number, not in size.
TASK_PAGES = 1 << 15
# Statement titles, the numbers of a statement, and words of running text.
TITLE = "(合并及公司|合并及母公司|合并|母公司|公司)(资产负债表|利润表|损益表|现金流量表)"
NUMBER = "^\\(?-?[\\d,]+(?:\\.\\d+)?\\)?$|^-$"
FOOTNOTE = "附注|[一二三四五六七八九十]+\\([\\d一-鿿()a-z]*\\)?"
PROSE = "。|审计|错报"


def with_rows(words: DataFrame) -> DataFrame:
    """Adds ``row``: words of a page whose vertical centres follow each other within ROW_GAP share one. Takes ``doc, page, x0, y0, x1, y1, word``."""
    order = Window.partitionBy("doc", "page").orderBy("yc", "x0", "x1", "word")
    w = words.withColumn("yc", (F.col("y0") + F.col("y1")) / 2)
    w = w.withColumn("break", (F.col("yc") - F.lag("yc").over(order) > ROW_GAP).cast("int"))
    return w.withColumn("row", F.sum(F.coalesce("break", F.lit(0))).over(order)).drop("break", "yc")


def is_number(word: Column) -> Column:
    return word.rlike(NUMBER) & word.rlike("\\d")


def columns(words: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc, page, col, centre``: the value columns of each titled page with LEAST_CELLS numbers and two columns, from the left.

    Right edges that follow each other within COLUMN_GAP share a column; the last two are value columns, the last four if the title joins two
    scopes. Takes ``doc, page, title`` of pages.
    """
    page, order = Window.partitionBy("doc", "page"), Window.partitionBy("doc", "page").orderBy("x1")
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // TASK_PAGES))
    cells = words.filter(is_number(F.col("word"))).select("doc", "page", "x1").repartition(tasks, "doc", "page")
    cells = cells.join(pages.select("doc", "page", "title"), ["doc", "page"])
    # columns of a page are numbered from 0 without gaps; in this order the windows share one sort
    cells = cells.withColumn("c", F.sum(F.coalesce((F.col("x1") - F.lag("x1").over(order) > COLUMN_GAP).cast("int"), F.lit(0))).over(order))
    cells = cells.withColumn("n", F.count(F.lit(1)).over(page)).filter(F.col("n") >= LEAST_CELLS)
    centres = cells.groupBy("doc", "page", "title", "c").agg(F.avg("x1").alias("centre"))
    centres = centres.withColumn("of", F.count(F.lit(1)).over(page)).filter("of >= 2")
    keep = F.when(F.contains("title", F.lit("及")), 4).otherwise(2)
    col = F.col("c") - F.greatest(F.col("of") - keep, F.lit(0))
    return centres.withColumn("col", col.cast("int")).filter("col >= 0").select("doc", "page", "title", "col", "centre")


def heads(title: Column) -> Column:
    names = lambda *x: F.array(*[F.lit(y) for y in x])
    return (
        F.when(F.contains(title, F.lit("及")), names("合并本期", "合并上期", "公司本期", "公司上期"))
        .when(title.rlike("^(母公司|公司)"), names("母公司本期", "母公司上期"))
        .otherwise(names("合并本期", "合并上期"))
    )


def page_facts(words: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc, page, title, row, label, cells``: the rows of statement pages with a label and at least one cell.

    A number belongs to the nearest value column, the left one of two as near; the first of a row in a column counts.
    """
    w = with_rows(words)
    cols = columns(words, pages)
    of = cols.groupBy("doc", "page", "title").agg(F.array_sort(F.collect_list(F.struct("col", "centre"))).alias("cols"))
    w = w.join(of, ["doc", "page"])
    number = F.col("word").rlike(NUMBER)
    near = F.array_min(F.transform("cols", lambda c: F.struct(F.abs(c["centre"] - F.col("x1")).alias("d"), c["col"].alias("col"))))["col"]
    cell = F.when(number & (F.col("x1") >= F.get("cols", F.lit(0))["centre"] - LEFT_SLACK), near)
    w = w.withColumn("col", cell)
    place = F.struct("x0", "x1", "word")
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~number, place))), lambda x: x["word"]), "")
    firsts = w.filter("col is not null").groupBy("doc", "page", "row", "col").agg(F.min(place)["word"].alias("word"))
    firsts = firsts.groupBy("doc", "page", "row").agg(F.array_sort(F.collect_list(F.struct("col", "word"))).alias("cells"))
    rows = w.groupBy("doc", "page", "title", "row").agg(label.alias("label"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("label", "(?U)^\\s+|\\s+$", ""), FOOTNOTE, ""), "^[|、 ]+|[|、 ]+$", "")
    rows = rows.withColumn("label", clean).join(firsts, ["doc", "page", "row"])
    return rows.filter((F.length("label") >= 1) & (F.length("label") <= 40) & F.col("label").rlike("[一-鿿]{2}") & ~F.col("label").rlike(PROSE))


def statements(words: DataFrame, heads_of_pages: DataFrame) -> DataFrame:
    """``doc, page, title, continued, row, label, scope, value``: the facts of all statement pages.

    Takes word boxes and ``doc, page, head`` (the first characters of each page). A page whose head has a statement's
    title starts it; the CARRY_PAGES pages after it go on with it, unless it has under LEAST_FACTS facts: then nothing is carried on.
    """
    bare = F.regexp_replace(F.substring("head", 1, 400), " ", "")
    found, year = F.regexp_extract(bare, TITLE, 0), F.regexp_extract(F.substring("head", 1, 400), "20\\d{2}", 0)
    pages = heads_of_pages.select("doc", "page", F.when(found != "", F.concat(found, year)).alias("own"))
    own = page_facts(words, pages.filter("own is not null").select("doc", "page", F.col("own").alias("title")))
    good = own.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_FACTS).select("doc", "page", F.lit(True).alias("good"))
    pages = pages.join(good, ["doc", "page"], "left")
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.when(F.col("own").isNotNull(), F.struct("page", "own", F.coalesce("good", F.lit(False)).alias("good")))
    pages = pages.withColumn("last", F.last(start, ignorenulls=True).over(before))
    pages = Scratch(words.sparkSession, "statements").keep(pages, "pages")  # counted and joined
    goes_on = F.col("own").isNull() & F.col("last.good") & (F.col("page") - F.col("last.page") <= CARRY_PAGES)
    later = page_facts(words, pages.filter(goes_on).select("doc", "page", F.col("last.own").alias("title")))
    every = own.withColumn("continued", F.lit(False)).unionByName(later.withColumn("continued", F.lit(True)))
    cells = every.select("doc", "page", "title", "continued", "row", "label", F.explode("cells").alias("c"))
    return cells.select("doc", "page", "title", "continued", "row", "label", F.get(heads(F.col("title")), F.col("c.col")).alias("scope"), F.col("c.word").alias("value")).filter("scope is not null")


def lines(facts: DataFrame) -> DataFrame:
    """``doc, page, row, label, title, line``: facts as lines of text."""
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "scope", "value"))), lambda c: F.concat(c["scope"], F.lit("="), c["value"])), " ")
    placed = facts.withColumn("place", F.array_position(heads(F.col("title")), F.col("scope")))
    shown = F.concat("title", F.when(F.col("continued"), F.lit("(续)")).otherwise(F.lit("")))
    g = placed.groupBy("doc", "page", "row", "label", shown.alias("title")).agg(cells.alias("cells"))
    return g.select("doc", "page", "row", "label", "title", F.concat(F.lit("["), "title", F.lit("] "), "label", F.lit(": "), "cells", F.lit(" (P"), F.col("page").cast("string"), F.lit(")")).alias("line"))


def char_pairs(text: Column) -> Column:
    """Distinct pairs of neighbouring CJK characters."""
    from corpusloom.functions.text import all_matches, pairs

    runs = all_matches(F.coalesce(text, F.lit("")), "[一-鿿]+")
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: pairs(F.filter(F.split(r, ""), lambda c: c != "")))))


def ranked(lines_: DataFrame, questions: DataFrame, least: int = 3) -> DataFrame:
    """``qid, bucket, ord, line, overlap``: lines of a question's documents whose labels share ``least`` character pairs with it, best first.

    Takes questions ``qid, text, doc_ids``; a line's bucket is its table's title. Pairs of labels are postings by document, which meet the questions'
    pairs for the same documents, so a label that shares none is not looked at.
    """
    asked = questions.select("qid", char_pairs(F.col("text")).alias("pairs"), F.posexplode("doc_ids").alias("doc_pos", "doc")).groupBy("qid", "doc").agg(F.min("doc_pos").alias("doc_pos"), F.first("pairs").alias("pairs"))
    postings = lines_.select("doc", "page", "row", F.explode(char_pairs(F.col("label"))).alias("pair"))
    met = postings.join(asked.select("qid", "doc", "doc_pos", F.explode("pairs").alias("pair")), ["doc", "pair"])
    hit = met.groupBy("qid", "doc", "doc_pos", "page", "row").agg(F.count(F.lit(1)).alias("overlap")).filter(F.col("overlap") >= least)
    hit = hit.join(lines_.select("doc", "page", "row", "title", "line"), ["doc", "page", "row"])
    order = Window.partitionBy("qid").orderBy(F.desc("overlap"), "doc_pos", "page", "row")
    return hit.select("qid", F.col("title").alias("bucket"), F.row_number().over(order).alias("ord"), "line", F.col("overlap").cast("int").alias("overlap"))


#: Lines of a block, and turns among its buckets, empty ones included, before it ends.
MOST_LINES, MOST_TURNS = 40, 400


def block(ranked_: DataFrame, most: int = MOST_LINES, turns: int = MOST_TURNS) -> DataFrame:
    """``qid, place, bucket, line``: a question's lines taken in turn from its buckets, which come in the order of their first lines."""
    by = Window.partitionBy("qid", "bucket")
    rows = ranked_.withColumn("turn", F.row_number().over(by.orderBy("ord"))).withColumn("first", F.min("ord").over(by))
    whole = Window.partitionBy("qid")
    rows = rows.withColumn("bucket_no", F.dense_rank().over(whole.orderBy("first"))).withColumn("buckets", F.max("bucket_no").over(whole))
    at = (F.col("turn") - 1) * F.col("buckets") + F.col("bucket_no") - 1
    rows = rows.filter(at <= turns).withColumn("place", F.row_number().over(whole.orderBy("turn", "first")))
    return rows.filter(F.col("place") <= most).select("qid", "place", "bucket", "line")

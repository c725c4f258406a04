"""Gathering of evidence for a question: its searches, the hits that are protected, their packing, and the block of all evidence.

Questions are ``qid, question, options array<struct<letter,text>>, doc_ids array<string>``; chunks ``doc_id, ord, page, text``; titles ``doc_id, title``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evidence, index
from corpusloom.session import Scratch

QUESTION_PART, FORCED_SCORE, KEYWORD_HITS = 40, 1e9, 2
_ORDS = 1 << 32


def searches(questions: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``qid, kind, n, query``: what a question is searched by.

    Kind ``core``: the question (n 0), then its start with each option; ``bare``: options without their numbers; ``extra``: rows
    ``qid, n, query`` of directed searches; ``keyword``: quoted terms; ``option``: each option alone, for the hit of its own.
    """
    option = F.transform("options", lambda o: o["text"])
    start = F.substring("question", 1, QUESTION_PART)
    of = lambda kind, texts: F.transform(texts, lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), t.alias("query")))
    core = of("core", F.concat(F.array("question"), F.transform(option, lambda t: F.concat(start, F.lit(" "), t))))
    bare = of("bare", F.filter(F.transform(option, T.without_numbers), lambda t: t.isNotNull()))
    keywords = of("keyword", T.quoted_keywords(T.question_surface(F.col("question"), F.col("options"), " ")))
    out = questions.select("qid", F.inline(F.concat(core, bare, keywords, of("option", option))))
    return out if extra is None else out.unionByName(extra.select("qid", F.lit("extra").alias("kind"), F.col("n").cast("int").alias("n"), "query"))


def forced_by_keyword(hits: DataFrame) -> DataFrame:
    """``qid, unit, doc_id``: of a keyword's first hits in each document that hold it, the one with a number on its line, else the first.

    Takes ``qid, n, query, doc_id, unit, rank, text``.
    """
    numbered = F.exists(F.split("text", "\n", -1), lambda x: F.contains(x, F.col("query")) & x.rlike("[0-9％%]"))
    held = hits.filter((F.col("rank") <= KEYWORD_HITS) & F.contains("text", F.col("query")))
    return held.groupBy("qid", "n", "doc_id").agg(F.min_by("unit", F.struct(~numbered, F.col("rank"))).alias("unit")).select("qid", "unit", "doc_id").distinct()


def forced_by_option(hits: DataFrame, titles: DataFrame) -> DataFrame:
    """``qid, unit, doc_id``: for each option the first hits of the documents whose titles it names, else the best of all first hits.

    Takes ``qid, n, query, doc_id, unit, rank, score, doc_pos``; equal scores go to the document that the question has first.
    """
    first = hits.filter("rank = 1").join(titles.select("doc_id", "title"), "doc_id", "left")
    first = first.withColumn("named", F.coalesce(T.names_title(F.col("query"), F.col("title")), F.lit(False)))
    option = Window.partitionBy("qid", "n")
    best = F.row_number().over(option.orderBy(F.desc("score"), "doc_pos")) == 1
    first = first.withColumn("best", best).withColumn("any_named", F.max("named").over(option))
    return first.filter(F.when(F.col("any_named"), F.col("named")).otherwise(F.col("best"))).select("qid", "unit", "doc_id").distinct()


def gather(questions: DataFrame, chunks: DataFrame, titles: DataFrame, budget: int, extra: DataFrame | None = None, k_question: int = 3, k_option: int = 2) -> DataFrame:
    """``qid, ord, doc_id, chunk, page, text, protected``: the chunks of a question's documents that go into ``budget`` characters.

    Each document is an index over its chunks. Searches give their first k chunks of each document, with scores that are relative to the
    document's best; a chunk has the highest of its scores. Protected are the best hit of each core and each directed search,
    the hits of quoted terms and those of options; the last two come first. Then come the other protected ones, then others than contents
    pages, by score, ties by document and chunk. What the budget has no room for is passed over, unless protected. Each document that has a hit
    but nothing kept gets its first that is no contents page, for which unprotected chunks of others make room, last first.
    """
    scratch = Scratch(questions.sparkSession, "gather")
    placed = questions.select("qid", F.posexplode("doc_ids").alias("doc_pos", "doc_id"))
    # a unit is a chunk's place in a question: its document's place, then its own
    units = chunks.select(F.col("doc_id").alias("index_key"), F.col("ord").cast("long").alias("unit"), "text")
    asked = searches(questions, extra).withColumn("search", F.concat_ws("#", F.col("qid").cast("string"), "kind", "n"))
    asked = scratch.keep(asked, "searches")
    within = asked.select("search", "qid").join(placed, "qid").select(F.col("search").alias("qid"), F.col("doc_id").alias("index_key"))
    used = units.join(placed.select(F.col("doc_id").alias("index_key")).distinct(), "index_key", "left_semi")
    scored = index.scores(used, asked.select(F.col("search").alias("qid"), "query"), within=within)
    most = max(k_question, k_option, KEYWORD_HITS)
    hits = index.search_documents(scored, most).withColumnRenamed("qid", "search").join(asked, "search")
    hits = hits.withColumnRenamed("index_key", "doc_id").join(placed, ["qid", "doc_id"])
    hits = hits.withColumn("key", F.col("doc_pos").cast("long") * _ORDS + F.col("unit")).join(chunks.select("doc_id", F.col("ord").cast("long").alias("unit"), "text"), ["doc_id", "unit"])
    hits = scratch.keep(hits, "hits")

    as_unit = lambda df: df.withColumn("unit", F.col("key"))
    forced = forced_by_keyword(as_unit(hits.filter("kind = 'keyword'"))).unionByName(forced_by_option(as_unit(hits.filter("kind = 'option'")), titles))
    k = F.when((F.col("kind") == "core") & (F.col("n") == 0), k_question).otherwise(k_option)
    main = hits.filter(F.col("kind").isin("core", "bare", "extra") & (F.col("rank") <= k))
    # the best hit of a search is the first of its documents' first hits
    leads = F.row_number().over(Window.partitionBy("search").orderBy(F.desc("norm"), "doc_pos", "rank")) == 1
    main = main.withColumn("lead", leads & (F.col("kind") != "bare")).select("qid", F.col("key").alias("unit"), "norm", "lead")
    found = main.unionByName(forced.select("qid", "unit", F.lit(FORCED_SCORE).alias("norm"), F.lit(True).alias("lead")))
    found = found.groupBy("qid", "unit").agg(F.max("norm").alias("score"), F.max("lead").alias("forced"))
    about = hits.select("qid", F.col("key").alias("unit"), "doc_pos", F.length("text").alias("n"), T.contents_like(F.col("text")).alias("contents")).distinct()
    found = scratch.keep(found.join(about, ["qid", "unit"]), "found")

    packed = evidence.pack(found.select("qid", "unit", "n", "score", "forced", "contents"), budget)
    with_doc = F.transform("kept", lambda x: F.struct(x["unit"].alias("unit"), F.floor(x["unit"] / _ORDS).alias("doc"), x["n"].alias("n"), x["forced"].alias("forced")))
    order = F.struct(~F.col("forced"), -F.col("score"), F.col("unit"))
    best = found.filter("not contents").groupBy("qid", F.col("doc_pos").alias("pos")).agg(F.min_by(F.struct("unit", "n"), order).alias("b"))
    best = best.select("qid", "pos", F.col("b.unit").alias("unit"), F.col("pos").cast("long").alias("doc"), F.col("b.n").alias("n"))
    kept = evidence.cover(packed.select("qid", with_doc.alias("kept")), best, budget).select("qid", F.explode("kept").alias("k"))
    kept = kept.select("qid", F.col("k.doc").cast("int").alias("doc_pos"), (F.col("k.unit") % _ORDS).alias("chunk"), F.col("k.unit").alias("unit")).join(placed, ["qid", "doc_pos"])
    kept = kept.join(found.select("qid", "unit", F.col("forced").alias("protected")), ["qid", "unit"])
    kept = kept.join(chunks.select("doc_id", F.col("ord").cast("long").alias("chunk"), "page", "text"), ["doc_id", "chunk"])
    place = F.row_number().over(Window.partitionBy("qid").orderBy("doc_id", F.coalesce("page", F.lit(0)), "chunk"))
    return kept.select("qid", (place - 1).alias("ord"), "doc_id", "chunk", "page", "text", "protected")


def preferred_title(company: Column, product: Column, title: Column, doc_id: Column) -> Column:
    """Company and product of an identity, else the title, else the id."""
    named = F.concat(F.coalesce(company, F.lit("")), F.coalesce(product, F.lit("")))
    return F.coalesce(F.when(F.trim(named) != "", named), F.when(F.trim(title) != "", title), doc_id)


def blocks(questions: DataFrame, gathered: DataFrame, titles: DataFrame, facts: DataFrame | None = None, cards: DataFrame | None = None) -> DataFrame:
    """``qid, block``: facts, cards, the titles of the question's documents and the gathered chunks, as far as there are any.

    ``facts`` and ``cards`` are ``qid, block`` with the text of theirs; ``gathered`` is what gather() gives, for a budget of evidence.cap().
    """
    placed = questions.select("qid", F.posexplode_outer("doc_ids").alias("doc_pos", "doc_id")).join(titles.select("doc_id", "title"), "doc_id", "left")
    line = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("- "), "doc_id", F.lit(": 《"), F.coalesce("title", "doc_id"), F.lit("》")))
    named = placed.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_pos", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    out = named.select("qid", F.concat(F.lit("涉及文档:\n"), F.array_join("lines", "\n")).alias("titles"))
    raw = evidence.rendered(gathered.select("qid", "doc_id", "page", F.col("chunk").alias("ord"), "text")).withColumnRenamed("block", "raw")
    out = out.join(raw, "qid", "left")
    parts = []
    for name, more in (("facts", facts), ("cards", cards)):
        if more is not None:
            out = out.join(more.select("qid", F.col("block").alias(name)), "qid", "left")
            parts.append(F.when(F.col(name) != "", F.col(name)))
    return out.select("qid", F.concat_ws("\n\n", *parts, "titles", F.concat(F.lit("原文片段证据:\n"), F.coalesce("raw", F.lit("")))).alias("block"))

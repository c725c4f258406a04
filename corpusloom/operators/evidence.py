"""Packing of evidence into a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = 20
HIT = "array<struct<unit:bigint,n:int,forced:boolean,contents:boolean,score:double>>"


def cap(n_docs: Column, has_cards: Column) -> Column:
    """Budget of a choice question: 1800 beside cards, else 3600 and 1000 for each document beyond two, 9000 at most."""
    return F.when(has_cards, F.lit(1800)).otherwise(F.least(F.lit(9000), 3600 + 1000 * F.greatest(n_docs - 2, F.lit(0))))


def pack(hits: DataFrame, budget: int | Column) -> DataFrame:
    """``qid, total, kept`` from hits ``qid, unit, n, score, forced, contents``.

    Forced hits come first and are kept whatever they measure; then others than contents pages, by score; a hit that doesn't fit is
    passed over and the next one tried. One question's hits, a few per document, are folded in one array.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    row = F.struct((~F.col("forced")).alias("o1"), F.col("contents").alias("o2"), (-F.col("score")).alias("o3"), F.col("unit").alias("unit"), F.col("n").cast("int").alias("n"), F.col("forced").alias("forced"))
    sorted_hits = hits.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("h"))
    kept = "array<struct<unit:bigint,n:int,forced:boolean>>"
    zero = F.struct(F.lit(0).alias("total"), F.array().cast(kept).alias("kept"))

    def step(a: Column, x: Column) -> Column:
        fits = x["forced"] | (a["total"] + x["n"] + SEPARATOR <= limit)
        size = a["total"] + x["n"] + SEPARATOR
        more = F.concat(a["kept"], F.array(F.struct(x["unit"].alias("unit"), x["n"].alias("n"), x["forced"].alias("forced"))))
        return F.when(fits, F.struct(size.alias("total"), more.alias("kept"))).otherwise(a)

    return sorted_hits.select("qid", F.aggregate("h", zero, step).alias("p")).select("qid", "p.total", "p.kept")


def cover(packed: DataFrame, best: DataFrame, budget: int) -> DataFrame:
    """Gives each document of a question a hit: ``qid, kept`` from ``qid, kept array<struct<unit,doc,n,forced>>`` and ``qid, unit, doc, n, pos``.

    ``best`` has each document's best hit. For a document with nothing kept, unforced hits of other documents go, last first, until its
    hit fits; it is added in any case. Documents come in the order of ``pos``.
    """
    missing = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "unit", "doc", "n"))).alias("b"))
    item = "struct<unit:bigint,doc:bigint,n:int,forced:boolean>"

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x["n"] + SEPARATOR)

    def step(kept: Column, x: Column) -> Column:
        there = F.exists(kept, lambda k: k["doc"] == x["doc"])
        removable = F.filter(F.transform(kept, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda z: ~z["k"]["forced"] & (z["k"]["doc"] != x["doc"]))
        over = total(kept) + x["n"] + SEPARATOR - F.lit(budget)
        # from the last, as many as are needed to make room
        gone = F.aggregate(
            F.reverse(removable),
            F.struct(F.lit(0).alias("freed"), F.array().cast("array<int>").alias("at")),
            lambda s, z: F.when(s["freed"] < over, F.struct((s["freed"] + z["k"]["n"] + SEPARATOR).alias("freed"), F.concat(s["at"], F.array(z["i"])).alias("at"))).otherwise(s),
            lambda s: s["at"],
        )
        rest = F.filter(kept, lambda k, i: ~F.array_contains(gone, i))
        new = F.array(F.struct(x["unit"].alias("unit"), x["doc"].alias("doc"), x["n"].alias("n"), F.lit(False).alias("forced")).cast(item))
        return F.when(there, kept).otherwise(F.concat(rest, new))

    joined = packed.join(missing, "qid", "left")
    folded = F.when(F.col("b").isNull(), F.col("kept").cast(f"array<{item}>")).otherwise(F.aggregate("b", F.col("kept").cast(f"array<{item}>"), step))
    return joined.select("qid", folded.alias("kept"))


def rendered(kept: DataFrame) -> DataFrame:
    """``qid, block`` from ``qid, doc_id, page, ord, text``: pieces in the order of document, page and chunk under their tags."""
    tag = F.when(F.coalesce("page", F.lit(0)) > 0, F.concat(F.lit(" P"), F.col("page").cast("string"))).otherwise(F.concat(F.lit("#c"), F.col("ord").cast("string")))
    piece = F.concat(F.lit("【"), "doc_id", tag, F.lit("】"), "text")
    row = F.struct(F.col("doc_id"), F.coalesce("page", F.lit(0)).alias("page"), F.col("ord"), piece.alias("piece"))
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["piece"]), "\n\n").alias("block"))


def round_robin(rows: DataFrame, most: int = 40) -> DataFrame:
    """The first ``most`` rows of each question, taken in turn from its buckets: ``qid, bucket, ord`` and any others; adds ``place``.

    Buckets come in the order of their first row.
    """
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("qid", "bucket").orderBy("ord"))
    first = F.min("ord").over(Window.partitionBy("qid", "bucket"))
    dealt = rows.withColumn("turn", turn).withColumn("first", first)
    return dealt.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("turn", "first"))).filter(F.col("place") <= most).drop("turn", "first")

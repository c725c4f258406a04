"""Mixing sources to target weights.

Rows get hash-random keys, are ranked within their source by a two-level distributed prefix sum of word counts, and each
source is cut at its exact budget; a budget over one source's size repeats whole epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.words import word_count, words
from corpusloom.session import Scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
ROWS_PER_BUCKET = 20_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets by source: ``(source, source_size, target)`` from ``(source, size)`` rows.

    Weights repeat over the sources in code-point order, null last. A target stops at ``most`` times its source's size and
    the excess is shared again by weight: sources sorted by how soon they stop, running sums give the level at which the
    budget is used up. One row per source is all that this handles; no text or row of the corpus reaches it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
    per = per.withColumn("cap", (F.col("source_size") * most).cast("double"))
    whole = Window.partitionBy()
    soonest = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(soonest), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(soonest), F.lit(0.0)))
        # the first source, in this order, that its share doesn't fill: from there on every share is weight times this level
        .withColumn("level", F.when(F.col("cap") * F.col("left_w") > F.col("left") * F.col("w"), F.col("left") / F.col("left_w")))
        .withColumn("level", F.max("level").over(whole))
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("level")))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per input row: ``doc_id, size, source, source_size, target, taken``.

    ``taken`` is the number of words that the mix takes of the row: ``size`` once for each whole epoch of its source, and in
    the last, partial epoch what fits of it before the budget is used up, rows coming in the order of md5(id). The words
    taken of a source sum to its target, rounded down. Null texts have size 0 and are never taken; a null source is a source of
    its own; equal ids tie by size, and rows equal in both are interchangeable. An empty table gives an empty table.
    """
    cols = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")]
    return _taken(Scratch(docs.sparkSession, "mix").keep(docs.select(*cols), "sizes"), **how)


def _taken(rows: DataFrame, **how) -> DataFrame:
    """The written table ``rows (doc_id, source, size)``, and what other columns it has, with ``source_size, target, taken``."""
    own = rows.columns
    targets = source_targets(rows, **how)
    digits, n = 1, rows.count()
    while 16**digits * ROWS_PER_BUCKET < n and digits < 6:
        digits += 1
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits))

    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
    # null-safe keys make the joins equi-joins for null sources as well
    sums = sums.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "in_bucket")

    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    b = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "target")
    rows = rows.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("before") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return rows.select(*own, "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: whole copies of a document for each epoch, then its part of the last one.

    A document at the very cut of its source's budget gives its first words, joined by single spaces; all others are whole. ``n_chars``,
    where it is a column, is that of the text given. Documents of which nothing is taken, null and blank texts among them, go. Rows have keys of their own: those that
    share an id, null included, are documents of their own, and repeated rows are taken as often as there are. A null source is
    a source. Columns of any name pass through; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"), word_count(F.col("text")).alias("size"))
    rows = scratch.keep(rows, "rows")
    plan = _taken(rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), "size"))
    plan = plan.filter("taken > 0").select("row", F.floor(F.col("taken") / F.col("size")).cast("int").alias("whole"), (F.col("taken") % F.col("size")).cast("int").alias("part"))
    parts = F.concat(F.array_repeat(F.lit(0), F.col("whole")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<int>")))
    out = rows.select("doc", "row").join(plan, "row").select("doc", F.explode(parts).alias("first"))
    text = F.col("doc")["text"]
    text = F.when(F.col("first") == 0, text).otherwise(F.array_join(F.slice(words(text), 1, F.greatest(F.col("first"), F.lit(1))), " "))
    out = out.select("doc", text.alias("text"))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[made[c].alias(c) if c in made else F.col("doc")[c].alias(c) for c in docs.columns])

"""Logs of JSON lines: lines numbered over all splits of a file, and everything that a strict reading objects to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import Scratch


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value``: the lines of text files, numbered from 1 in each file, however many splits Spark reads it in.

    A first pass counts the lines of each split, a row each; prefix sums over a file's splits say how many lines are before each. Lines of a split
    come one after another, so a line's place in it is how far it is from the split's first. Lines are not moved.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    raw = spark.read.text(path).select("value", at.alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = raw.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("split.file").orderBy("split.start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("split", "first", "before")
    splits = Scratch(spark, "log").keep(splits, "splits")
    placed = raw.join(splits, "split")
    return placed.select(F.col("split.file").alias("file"), (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def records(lines: DataFrame, schema: str) -> DataFrame:
    """``file, line``, the record's fields, and ``problem`` of each line: null, ``blank``, ``malformed`` or ``no object``.

    A lenient reader takes the rows without problem; a strict one takes none if log_problems() has any.
    """
    blank = F.trim(F.translate("value", "\t\r\n", "   ")) == ""
    parsed = F.try_parse_json("value")
    kind = F.schema_of_variant(parsed)
    problem = F.when(blank, "blank").when(parsed.isNull(), "malformed").when(~kind.startswith("OBJECT"), "no object")
    rows = lines.withColumn("problem", problem).withColumn("_r", F.from_json("value", schema))
    return rows.select("file", "line", "_r.*", "problem")


def log_problems(rows: DataFrame, key: list[str]) -> DataFrame:
    """``file, line, problem`` of records(): lines that are no records, records without a key, and records whose key an earlier line of any file has."""
    good = rows.filter("problem is null")
    keyless = good.filter(" or ".join(f"`{k}` is null" for k in key)).select("file", "line", F.lit("no key").alias("problem"))
    known = good.dropna(subset=key)
    firsts = known.groupBy(*key).agg(F.min(F.struct("file", "line")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = known.join(firsts, key).filter(F.struct("file", "line") > F.col("first")).select("file", "line", F.lit("duplicate").alias("problem"))
    return rows.filter("problem is not null").select("file", "line", "problem").unionByName(keyless).unionByName(again)


def strict(rows: DataFrame, key: list[str]) -> DataFrame:
    """The records of a log that has no problem; else raises with the first few and their number."""
    found = log_problems(rows, key)
    n = found.count()
    if n:
        some = found.orderBy("file", "line").limit(20).collect()
        raise ValueError(f"{n} problems: " + "; ".join(f"{r.file}:{r.line} {r.problem}" for r in some))
    return rows.drop("problem")

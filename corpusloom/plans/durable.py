"""Queries of what is published and resumed: artifacts rebuilt where documents changed, answers of a run that was stopped, a log read strictly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.catalogue import register
from corpusloom.session import Scratch, table
from corpusloom.sources import artifacts, logs
from corpusloom.streaming import answers


@register(
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN coalesce(text, '') || '!' ELSE text END AS t, source FROM documents)
SELECT doc_id, doc_id % 10 = 3 AS rebuilt, length(coalesce(t, ''))::INT AS n_chars,
  sha256(coalesce(t, '') || chr(0) || CASE WHEN source IS NULL THEN '{}' ELSE '{"source":"' || source || '"}' END) AS source_hash FROM d"""
)
def artifact_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of documents, published and refreshed after every tenth text has changed."""
    docs, at = table(spark, sf_dir, "documents").select("doc_id", "text", "source"), Scratch(spark, "artifact").path("lengths")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    lengths = lambda d: d.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    for version in (docs, changed):
        out = artifacts.refresh(version, at, "1", lengths, "n_chars int", identity=["source"])
    return out.select("doc_id", "rebuilt", "n_chars", "source_hash")


@register("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, role)) AS answer, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id")
def resumed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of conversations as answers: asked in six batches, stopped after two, resumed."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("qid")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    ask = lambda q: q.select("qid", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n").cast("binary")).alias("answer"), F.size("t").cast("long").alias("n"))
    at = Scratch(spark, "answers").path("answers")
    answers.answer_in_batches(turns, at, "first", ask, "qid long, answer string, n long", 6, stop_after=2)
    out = answers.answer_in_batches(turns, at, "first", ask, "qid long, answer string, n long", 6)
    return out.select(F.col("qid").alias("conv_id"), "answer", "n")


#: Files that the logs of all conversations lie in.
LOG_FILES = 32


@register(
    """WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS line FROM conversations)
SELECT conv_id, line::BIGINT AS line, problem FROM (SELECT conv_id, line, CASE WHEN line % 5 = 0 THEN 'blank' WHEN line % 7 = 0 THEN 'malformed' WHEN line % 6 = 0 THEN 'no object' WHEN line % 4 = 0 AND (line - 1) % 5 <> 0 AND (line - 1) % 6 <> 0 AND (line - 1) % 7 <> 0 THEN 'duplicate' END AS problem FROM r) WHERE problem IS NOT NULL"""
)
def log_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a log of its turns, some of them blank, cut off, no object, or with the key of the one before: what a strict reading objects to."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))

    def line(x, i):
        n = i + 1
        key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.when(n % 4 == 0, n - 1).otherwise(n).cast("string"))
        record = F.to_json(F.struct(key.alias("key"), x["role"].alias("role")))
        return F.when(n % 5 == 0, " ").when(n % 7 == 0, F.substring(record, 1, 9)).when(n % 6 == 0, F.to_json(F.array(x["role"]))).otherwise(record)

    # logs lie one after another in a fixed number of files: files for each log would be more than their lines are worth
    scratch = Scratch(spark, "logs")
    before = Window.partitionBy("file_no").orderBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("file_no", F.pmod(F.xxhash64("conv_id"), F.lit(LOG_FILES)).cast("int")).withColumn("before", F.coalesce(F.sum(F.size("t")).over(before), F.lit(0)))
    turns = scratch.keep(turns, "turns")
    at = scratch.path("logs")
    text = turns.select("file_no", "before", F.array_join(F.transform("t", line), "\n").alias("value")).repartition("file_no").sortWithinPartitions("file_no", "before")
    text.select("file_no", "value").write.partitionBy("file_no").option("maxRecordsPerFile", 0).text(at)
    rows = logs.records(logs.numbered_lines(spark, at), "key string, role string")
    found = logs.log_problems(rows, ["key"])
    found = found.select(F.regexp_extract("file", "file_no=(\\d+)", 1).cast("int").alias("file_no"), F.col("line").alias("in_file"), "problem")
    places = turns.select("file_no", "conv_id", "before", F.explode(F.sequence(F.lit(1), F.size("t")).cast("array<bigint>")).alias("line")).withColumn("in_file", F.col("before") + F.col("line"))
    return found.join(places, ["file_no", "in_file"]).select("conv_id", "line", "problem")

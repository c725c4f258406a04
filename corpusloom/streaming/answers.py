"""Answers and calls that survive a stop: batches appended once, resumed where they ended.

A batch is a folder by stage and number. It is written whole, under Spark's commit, over whatever a stopped run left of it, so a batch that is run twice is
there once. What has an answer is not asked again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from corpusloom.functions.text import redact

Ask = Callable[[DataFrame], DataFrame]


def saved(spark: SparkSession, at: str, schema: StructType) -> DataFrame:
    """All complete batches with ``stage`` and ``batch``; an empty table with the same columns before the first. A batch without Spark's success mark is not there."""
    whole = StructType([*schema.fields, *StructType.fromDDL("stage string, batch bigint").fields])
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    done = [str(s.getPath().getParent()) for s in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{at}/stage=*/batch=*/_SUCCESS")) or []]
    return spark.read.schema(whole).option("basePath", at).parquet(*done) if done else spark.createDataFrame([], whole)


def save(rows: DataFrame, at: str, stage: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{at}/stage={stage}/batch={batch}")


def pending(questions: DataFrame, answers: DataFrame, stage: str, key: str = "qid") -> DataFrame:
    """The questions that a stage has no answer to."""
    return questions.join(answers.filter(F.col("stage") == stage).select(key), key, "left_anti")


def answer_in_batches(questions: DataFrame, at: str, stage: str, ask: Ask, schema: str, batches: int, key: str = "qid", stop_after: int | None = None) -> DataFrame:
    """Asks the questions that have no answer yet, in batches by a hash of their key, and returns all answers of the stage.

    ``ask`` makes rows of ``schema``, with the key, from questions. A new batch has the number of complete ones before it, so it is written over what a
    stopped run left of its own. Questions with a null key are not asked. ``stop_after`` ends after so many batches, for tests.
    """
    spark, types = questions.sparkSession, StructType.fromDDL(schema)
    questions = questions.filter(F.col(key).isNotNull())
    asked = 0
    for b in range(batches):
        done = saved(spark, at, types).filter(F.col("stage") == stage)
        part = pending(questions.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(batches)) == b), done, stage, key)
        if part.isEmpty():
            continue
        if asked == stop_after:
            break
        last = done.agg(F.max("batch")).first()[0]
        save(ask(part).select(types.names), at, stage, 0 if last is None else last + 1)
        asked += 1
    return saved(spark, at, types).filter(F.col("stage") == stage)


def answer_stream(questions: DataFrame, at: str, stage: str, ask: Ask, schema: str, checkpoint: str, key: str = "qid") -> DataStreamWriter:
    """A writer that asks each question of a stream once: start() it. A batch that Spark gives again is written over itself."""
    types = StructType.fromDDL(schema)

    def take(rows: DataFrame, batch: int) -> None:
        others = saved(rows.sparkSession, at, types).filter(F.col("batch") != batch)
        save(ask(pending(rows.dropDuplicates([key]), others, stage, key)).select(types.names), at, stage, batch)

    return questions.filter(F.col(key).isNotNull()).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def audited(calls: DataFrame, message_col: str = "error") -> DataFrame:
    """Call records as they may be kept: without credentials in their messages."""
    return calls.withColumn(message_col, redact(F.col(message_col)))

"""The token ledger as a stream: calls are summed by question, or by window, as their log grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALL = "qid string, tag string, model string, prompt_tokens long, completion_tokens long, total_tokens long, ts timestamp"


def read_calls(spark: SparkSession, folder: str, schema: str = CALL) -> DataFrame:
    """New files of a folder of JSON lines, as they come."""
    return spark.readStream.schema(schema).json(folder)


def running_ledger(calls: DataFrame) -> DataFrame:
    """Sums by question of all calls so far; one row of state a question. For output mode complete or update."""
    return calls.groupBy("qid").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count(F.lit(1)).alias("n_calls"))


def windowed_usage(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sums by window and tag; windows close, and their state goes, once the watermark has passed them."""
    by = calls.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "tag")
    sums = by.agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count(F.lit(1)).alias("n_calls"))
    return sums.select(F.col("w.start").alias("start"), "tag", "prompt_tokens", "completion_tokens", "n_calls")

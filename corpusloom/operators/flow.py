"""Staged model flows. Each stage is one batch of calls whose responses are written before the next stage is planned.

A client is a function from requests ``(qid, tag, prompt)`` to responses ``(qid, tag, content)``. Replay takes them from a table;
a client that calls a service belongs behind mapInPandas and runs without task retries. A stage that has been written is never called again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.functions.text import strip
from corpusloom.session import Scratch

Client = Callable[[DataFrame], DataFrame]


def replay(responses: DataFrame) -> Client:
    """Responses from a table ``qid, tag, content``; a request without one gets an empty content."""

    def call(requests: DataFrame) -> DataFrame:
        return requests.select("qid", "tag").join(responses, ["qid", "tag"], "left").select("qid", "tag", F.coalesce("content", F.lit("")).alias("content"))

    return call


def choices(questions: DataFrame, client: Client, evidence: Callable[[DataFrame], DataFrame], slim: bool = False) -> tuple[DataFrame, DataFrame]:
    """Finals ``qid, final, stage`` and traces ``qid, ord, stage, content, answer, evidence_ids`` of choice questions.

    Takes ``qid, answer_format``; ``evidence`` maps ``qid, query`` to ``qid, block, evidence_ids``. A first answer may ask for
    a follow-up search and is then given again; unless ``slim`` and parsed it is reviewed; two answers that differ go to arbitration.
    The last stage with an answer decides, and the reasoning is its trace.
    """
    scratch = Scratch(questions.sparkSession, "flow")
    stages = []

    def stage(tag: str, asked: DataFrame) -> DataFrame:
        """Calls for ``qid, answer_format, query`` and their answers."""
        found = evidence(asked.select("qid", "query"))
        got = client(asked.join(found, "qid").select("qid", F.lit(tag).alias("tag"), F.col("block").alias("prompt")))
        out = got.join(asked.select("qid", "answer_format"), "qid").join(found.select("qid", "evidence_ids"), "qid")
        out = scratch.keep(out.select("qid", F.lit(tag).alias("stage"), "content", A.parse_choice(F.col("content"), F.col("answer_format")).alias("answer"), "evidence_ids"), tag)
        stages.append(out.withColumn("ord", F.lit(len(stages))))
        return out

    base = questions.select("qid", "answer_format")
    r1 = stage("r1", base.withColumn("query", F.lit(None).cast("string")))
    more = r1.select("qid", F.get(A.follow_ups(F.col("content")), F.lit(0)).alias("query")).filter("query is not null")
    r1b = stage("r1b", base.join(more, "qid"))
    first = r1.select("qid", "answer").join(r1b.select("qid", F.col("answer").alias("again")), "qid", "left").select("qid", F.when(F.coalesce("again", F.lit("")) != "", F.col("again")).otherwise(F.col("answer")).alias("a1"))
    review = base.join(first, "qid").filter((F.col("a1") == "") | (F.lit(not slim) & F.col("answer_format").isin("multi", "mcq")))
    r2 = stage("r2", review.select("qid", "answer_format").join(more, "qid", "left"))
    both = first.join(r2.select("qid", F.col("answer").alias("a2")), "qid", "left").fillna("", ["a2"])
    torn = both.filter("a1 <> '' and a2 <> '' and a1 <> a2")
    r3 = stage("r3", base.join(torn.select("qid", F.concat_ws(" ", "a1", "a2").alias("query")), "qid"))
    final = both.join(r3.select("qid", F.col("answer").alias("a3")), "qid", "left").fillna("", ["a3"])
    final = final.select("qid", F.when(F.col("a3") != "", F.col("a3")).when(F.col("a2") != "", F.col("a2")).otherwise(F.col("a1")).alias("final"))
    traces = stages[0]
    for s in stages[1:]:
        traces = traces.unionByName(s)
    return final, traces.select("qid", "ord", "stage", "content", "answer", "evidence_ids")


def calculations(questions: DataFrame, client: Client, evidence: Callable[[DataFrame], DataFrame], single: bool = False) -> tuple[DataFrame, DataFrame]:
    """Finals ``qid, final, stage, valid`` and traces of calculation questions ``qid, question, kinds``.

    A first answer that asks for a follow-up or isn't valid is given again over wider evidence; unless ``single`` it is verified; two valid answers
    that differ beyond white space go to arbitration. A later answer replaces an earlier one only if it is valid.
    """
    scratch = Scratch(questions.sparkSession, "calc")
    stages = []

    def stage(tag: str, asked: DataFrame) -> DataFrame:
        found = evidence(asked.select("qid", "query"))
        got = client(asked.join(found, "qid").select("qid", F.lit(tag).alias("tag"), F.col("block").alias("prompt")))
        answer = A.parse_calc(F.col("content"))
        out = got.join(asked.select("qid", "kinds"), "qid").join(found.select("qid", "evidence_ids"), "qid").withColumn("answer", answer)
        out = scratch.keep(out.select("qid", F.lit(tag).alias("stage"), "content", "answer", A.valid_calc(F.col("answer"), F.col("kinds")).alias("valid"), "evidence_ids"), tag)
        stages.append(out.withColumn("ord", F.lit(len(stages))))
        return out

    def better(now: DataFrame, later: DataFrame, replaces: Column) -> DataFrame:
        new = later.select("qid", *[F.col(c).alias(f"new_{c}") for c in ("stage", "answer", "valid")])
        joined = now.join(new, "qid", "left")
        take = F.coalesce(F.col("new_valid") & replaces, F.lit(False))
        return joined.select("qid", *[F.when(take, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("stage", "answer", "valid")])

    base = questions.select("qid", "kinds", "question")
    first = stage("primary", base.withColumn("query", F.lit(None).cast("string")))
    asks = F.get(A.follow_ups(F.col("content")), F.lit(0))
    again = first.select("qid", "valid", asks.alias("asks")).filter("asks is not null or not valid").join(base, "qid")
    retry = stage("evidence_retry", again.select("qid", "kinds", F.coalesce("asks", "question").alias("query")))
    now = better(first.select("qid", "stage", "answer", "valid"), retry, F.lit(True))
    if not single:
        queries = again.select("qid", F.coalesce("asks", "question").alias("query"))
        second = stage("verify", base.select("qid", "kinds").join(queries, "qid", "left"))
        pair = now.join(second.select("qid", F.col("answer").alias("other"), F.col("valid").alias("other_valid")), "qid")
        bare = lambda c: F.regexp_replace(c, "(?U)\\s+", "")
        torn = pair.filter(F.col("valid") & F.col("other_valid") & (bare("answer") != bare("other"))).select("qid")
        now = better(now, second, ~F.col("valid"))
        third = stage("arbitrate", base.select("qid", "kinds").join(torn, "qid").withColumn("query", F.lit(None).cast("string")))
        now = better(now, third, F.lit(True))
    traces = stages[0]
    for s in stages[1:]:
        traces = traces.unionByName(s)
    return now.select("qid", strip(F.col("answer")).alias("final"), "stage", "valid"), traces.select("qid", "ord", "stage", "content", "answer", "evidence_ids")

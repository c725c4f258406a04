"""Strict logs, published artifacts, and answers that survive a stop."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom import session
from corpusloom.plans import durable
from corpusloom.sources import artifacts, logs
from corpusloom.streaming import answers


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_of_many_splits(spark, tmp_path, small_splits):
    want = []
    for name, n in (("a.jsonl", 700), ("b.jsonl", 3), ("c.jsonl", 0)):
        lines = ["" if i % 50 == 7 else json.dumps({"qid": i, "pad": "x" * (i % 40)}) for i in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
        want += [(name, i + 1, x) for i, x in enumerate(lines)]
    got = logs.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert sorted((os.path.basename(r.file), r.line, r.value) for r in got.collect()) == sorted(want)


def test_strict_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"qid":"a","n":1}\n\n{"qid":"b"\n[1]\n"text"\n{"qid":"a","n":2}\n{"n":3}\n{"qid":"c","n":4}\n{"qid":"a"}\n  \t\n')
    rows = logs.records(logs.numbered_lines(spark, str(tmp_path)), "qid string, n int")
    assert [(r.line, r.problem) for r in logs.log_problems(rows, ["qid"]).orderBy("line", "problem").collect()] == [(2, "blank"), (3, "malformed"), (4, "no object"), (5, "no object"), (6, "duplicate"), (7, "no key"), (9, "duplicate"), (10, "blank")]
    assert [(r.qid, r.n) for r in rows.filter("problem is null").orderBy("line").collect()] == [("a", 1), ("a", 2), (None, 3), ("c", 4), ("a", None)]
    with pytest.raises(ValueError, match="8 problems.*:2 blank"):
        logs.strict(rows, ["qid"])
    (tmp_path / "log.jsonl").write_text('{"qid":"a","n":1}\n{"qid":"b","n":2}\n')
    fine = logs.records(logs.numbered_lines(spark, str(tmp_path)), "qid string, n int")
    assert [(r.qid, r.n) for r in logs.strict(fine, ["qid"]).orderBy("qid").collect()] == [("a", 1), ("b", 2)]


def test_artifact_rebuilds_what_changed(spark, tmp_path):
    at, seen = str(tmp_path / "cards"), []

    def build(docs):
        seen.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str))
        return docs.select("doc_id", F.explode(F.split("text", " ")).alias("word"))

    def run(rows, version="1", **more):
        docs = spark.createDataFrame(rows, "doc_id string, text string, name string")
        return bag(artifacts.refresh(docs, at, version, build, "word string", identity=["name"], **more).select("doc_id", "word", "rebuilt"))

    schema = StructType.fromDDL("doc_id string, word string, source_hash string, version string, rebuilt boolean")
    assert artifacts.published(spark, at, schema, "1").collect() == []
    rows = [("a", "x y", "n"), ("b", "z", "n"), ("c", None, None), (None, "q", "n")]
    assert run(rows) == [("a", "x", True), ("a", "y", True), ("b", "z", True)] and seen.pop() == ["a", "b", "c"]
    # c gives no row, so it is built again; b has another text, then another name; a is gone at last
    assert run([("a", "x y", "n"), ("b", "zz", "n")]) == [("a", "x", False), ("a", "y", False), ("b", "zz", True)] and seen.pop() == ["b"]
    assert run([("a", "x y", "n"), ("b", "zz", "m")]) == [("a", "x", False), ("a", "y", False), ("b", "zz", True)] and seen.pop() == ["b"]
    assert run([("b", "zz", "m")]) == [("b", "zz", False)] and seen.pop() == []
    with pytest.raises(artifacts.VersionError):
        run([("b", "zz", "m")], "2")
    os.remove(f"{at}/generation-4/_SUCCESS")  # a generation that was not finished is not read
    assert {r.doc_id for r in artifacts.published(spark, at, schema, "1").collect()} == {"a", "b"}
    assert run([("b", "zz", "m")], "2", forced=True) == [("b", "zz", True)] and seen.pop() == ["b"]


def test_stopped_run_is_resumed(spark, tmp_path):
    at, calls = str(tmp_path / "answers"), []

    def ask(questions):
        calls.extend(r.qid for r in questions.select("qid").collect())
        return questions.select("qid", F.upper("text").alias("answer"))

    q = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "qid long, text string")
    some = answers.answer_in_batches(q, at, "first", ask, "qid long, answer string", 5, stop_after=2)
    assert 0 < some.count() < 40
    os.remove(f"{at}/stage=first/batch=1/_SUCCESS")  # the second batch was cut off
    lost = [r.qid for r in spark.read.parquet(f"{at}/stage=first/batch=1").collect()]
    out = answers.answer_in_batches(q, at, "first", ask, "qid long, answer string", 5)
    assert bag(out.select("qid", "answer")) == sorted([(i, f"T{i}") for i in range(40)], key=str)
    assert sorted(calls) == sorted([*range(40), *lost])
    before = len(calls)
    answers.answer_in_batches(q, at, "first", ask, "qid long, answer string", 5)
    assert len(calls) == before
    answers.answer_in_batches(q.limit(3), at, "second", ask, "qid long, answer string", 2)
    assert len(calls) == before + 3


def test_answer_stream_asks_once(spark, tmp_path):
    folder, at, calls = tmp_path / "in", str(tmp_path / "out"), []

    def ask(questions):
        calls.extend(r.qid for r in questions.select("qid").collect())
        return questions.select("qid", F.length("text").alias("n"))

    def add(name, rows):
        spark.createDataFrame(rows, "qid long, text string").coalesce(1).write.json(str(tmp_path / "made" / name))
        made = next((tmp_path / "made" / name).glob("part-*"))
        os.makedirs(folder, exist_ok=True)
        made.rename(folder / f"{name}.json")

    def drain():
        source = spark.readStream.schema("qid long, text string").json(str(folder))
        answers.answer_stream(source, at, "s", ask, "qid long, n int", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    add("one", [(1, "a"), (2, "bb"), (2, "bb")])
    drain()
    add("two", [(2, "bb"), (3, "ccc"), (None, "d")])
    drain()
    drain()
    assert sorted(calls) == [1, 2, 3]
    assert bag(answers.saved(spark, at, StructType.fromDDL("qid long, n int")).select("qid", "n")) == [(1, 1), (2, 2), (3, 3)]


def test_audited_calls_hold_no_credentials(spark):
    df = spark.createDataFrame([("sk-abcdefgh12 failed",), (None,)], "error string")
    assert [r.error for r in answers.audited(df).collect()] == ["[REDACTED] failed", None]


def test_files_of_logs_do_not_grow_with_the_logs(spark, tmp_path):
    turns = spark.range(1_500).selectExpr("id % 300 as conv_id", "id div 300 as turn", "'user' as role", "'x' as text")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    with session.note() as noted:
        found = sorted(tuple(r) for r in durable.log_strict(spark, str(tmp_path)).collect())
    assert found == sorted((c, *p) for c in range(300) for p in [(4, "duplicate"), (5, "blank")])
    assert 0 < sum(len(list(Path(s.path("logs").removeprefix("file:")).rglob("*.txt"))) for s in noted) <= durable.LOG_FILES

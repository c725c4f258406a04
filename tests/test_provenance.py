"""Checks of reasoning, evidence and embedded records on planted cases."""

from corpusloom.operators import audit
from corpusloom.operators import provenance as P


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


TRACES = "array<struct<stage:string,content:string,answer:string,evidence_ids:array<string>>>"


def test_reasoning_provenance(spark):
    t = [("r1", "first", "A", ["a#1"]), ("r2", "second", "AB", ["a#2"])]
    finals = spark.createDataFrame([(i, "BA", "second") for i in range(8)], "qid long, answer string, reasoning string")
    rows = [
        (0, "second", "r2", ["a#2"], None, t), (1, "second", "r1", ["a#2"], "", t), (2, "second", "r2", ["a#1"], "AB", t), (3, "second", "r2", [], "A", t), (4, "second", "r2", ["a#2"], None, []),
        (5, "second", "r2", ["a#2"], None, [*t, ("", "x", "A", ["a"])]), (6, None, "r2", None, None, None), (9, "second", "r2", ["a#2"], None, t),
    ]
    sources = spark.createDataFrame(rows, f"qid long, reasoning string, stage string, evidence_ids array<string>, raw_answer string, traces {TRACES}")
    assert bag(P.reasoning_provenance(finals, sources)) == sorted(
        [(1, "no trace"), (1, "answer"), (1, "evidence"), (2, "evidence"), (3, "evidence"), (3, "raw answer"), (4, "stage"), (4, "no trace"), (4, "answer"), (4, "evidence"), (5, "traces"),
         (6, "reasoning"), (6, "stage"), (6, "traces"), (6, "no trace"), (6, "answer"), (6, "evidence"), (7, "source"), (9, "question")], key=str)


def test_evidence_sent(spark):
    traces = spark.createDataFrame([("q", "r1", "x", ["a", "b"]), ("q", "r1", "x", ["a"]), ("q", "r2", "y", ["zz"]), ("p", "r1", None, [])], "qid string, stage string, content string, evidence_ids array<string>")
    responses = spark.createDataFrame([("q", "r1", "x", "see A"), ("q", "r2", "y", "see B"), ("q", "r3", "y", "B"), ("p", "r1", None, None)], "qid string, tag string, content string, prompt string")
    chunks = spark.createDataFrame([("a", "A"), ("b", "B")], "evidence_id string, rendered string")
    assert bag(P.evidence_sent(traces, responses, chunks)) == [("q", "r1", "no response"), ("q", "r1", "not sent"), ("q", "r2", "no chunk"), ("q", "r3", "no trace")]


def test_embedded_records(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "line long, record string")
    embedded = spark.createDataFrame([(1, "a"), (1, "a"), (2, "x"), (4, "d")], "line long, record string")
    assert bag(audit.embedded_mismatch(embedded, source)) == [(1, "repeated"), (2, "changed"), (3, "not embedded"), (4, "not in the source")]


def test_reasoning_is_contained(spark):
    finals = spark.createDataFrame([(1, " short "), (2, "short"), (3, ""), (4, "thought"), (5, "nowhere")], "qid long, reasoning string")
    calls = spark.createDataFrame([(1, "ok", "a long answer with short in it", None), (2, "request_error", "short", None), (4, "ok", None, "a thought")], "qid long, status string, content string, reasoning_content string")
    assert bag(P.reasoning_origin(finals, calls)) == [(2, "another question"), (3, "blank"), (5, "no call")]


def test_calls_without_usage_or_with_endless_times(spark):
    rows = [(1, "ok", "q", "m", 1, 0.0, float("inf"), 1, 1, 5, None, None), (2, "ok", "q", "m", 1, 0.0, 1.0, 1, 1, None, None, None), (3, "ok", "q", "m", 1, float("nan"), 1.0, 1, 1, 5, None, None), (4, "ok", "q", "m", 1, 0.0, 1.0, 1, 1, 5, None, None)]
    calls = spark.createDataFrame(rows, "line int, status string, qid string, model string, attempt int, started_at double, finished_at double, n_messages int, max_tokens int, total_tokens int, error_type string, error string")
    assert bag(P.call_shape(calls, "m")) == [(1, "timestamps"), (2, "usage"), (3, "timestamps")]


def test_fields_of_a_broken_record(spark):
    df = spark.createDataFrame([(1, "not json"), (2, None), (3, "[]")], "line int, record string")
    assert {r.line for r in P.call_fields(df).collect()} == {1, 2, 3}

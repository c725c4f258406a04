"""Containment, routing by names and the replay of routing."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import contain, replay, route
from corpusloom.plans import catalogue


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("most_chars", [1, 7, 1 << 20])
def test_occurrences(spark, most_chars):
    rng = random.Random(2)
    texts = [(i % 9, "".join(rng.choice("abé 中🙂") for _ in range(rng.randrange(30)))) for i in range(60)] + [(None, "ab"), (3, None), (4, ""), (4, "")]
    patterns = sorted({"".join(rng.choice("abé 中🙂") for _ in range(rng.randrange(1, 4))) for _ in range(25)})
    got = contain.occurrences(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in [*patterns, *patterns, "", None]], "p string"), "id", "text", "p", most_chars)
    assert got.columns == ["id", "p"]
    assert bag(got) == sorted(((i, p) for i, t in texts for p in patterns if t and p in t), key=str)


def test_no_patterns(spark):
    texts = spark.createDataFrame([(1, "a")], "id long, text string")
    assert bag(contain.occurrences(texts, spark.createDataFrame([], "p string"), "id", "text", "p")) == []


@pytest.mark.parametrize("name", ["quoted_route", "alias_route", "year_filter_route", "policy_route", "alias_append"])
def test_no_nested_loops(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_longest_alias(spark):
    ids = spark.createDataFrame([("d", "k", ["sea", "seaside", "side"]), ("d", "m", ["side"]), ("e", "n", ["sea"])], "domain string, company_key string, aliases array<string>")
    q = spark.createDataFrame([(1, "d", "at the seaside"), (2, "e", "at sea"), (3, "d", None)], "qid long, domain string, normal string")
    assert bag(route.named_companies(q, ids)) == [(1, "d", "k", "seaside"), (1, "d", "m", "side"), (2, "e", "n", "sea")]


def test_many_documents_are_no_decision(spark):
    ids = spark.createDataFrame([(f"x{i}", i, "d", "k", ["sea"], None) for i in range(9)], "doc_id string, pos int, domain string, company_key string, aliases array<string>, year string")
    q = spark.createDataFrame([(1, "d", "sea", "sea", 0)], "qid long, domain string, text string, normal string, n_options int")
    assert bag(route.by_company(q, ids)) == []
    assert bag(route.by_company(q, ids.filter("pos > 0"))) == [(1, [f"x{i}" for i in range(1, 9)])]


def test_append_named(spark):
    names = spark.createDataFrame([(d, "d", p, n) for d, p, n in [("a", 3, "red"), ("b", 1, "blue"), ("b", 1, "sky"), ("c", 2, "r"), ("e", 4, "red sky"), ("f", 5, "sky"), ("g", 6, "sky")]], "doc_id string, domain string, pos int, name string")
    q = spark.createDataFrame([(1, "d", "a red sky"), (2, "x", "a red sky"), (3, "d", None)], "qid long, domain string, text string")
    chosen = spark.createDataFrame([(1, "a")], "qid long, doc_id string")
    assert bag(route.append_named(q, chosen, names)) == [(1, "b", 2), (1, "e", 3), (1, "f", 4)]
    some = spark.createDataFrame([(1, "g"), (1, "a"), (2, "g")], "qid long, doc_id string")
    assert bag(route.append_named(q, chosen, names, some)) == [(1, "g", 2)]


def test_code_applies(spark):
    rows = spark.createDataFrame([("calc", "a"), ("calc", "b"), ("mcq", "b"), (None, None)], "f string, d string")
    got = lambda *a: [r[0] for r in rows.select(replay.code_applies(F.col("f"), F.col("d"), *a)).collect()]
    assert got(True, True, ("a",)) == [True, False, True, True]
    assert got(True, False) == [False, False, True, True]
    assert got(True, True) == [True] * 4 and got(False, True) == [False] * 4


def test_replay(spark):
    frame = spark.createDataFrame
    q = frame([(1, ["z"], False), (2, None, False), (3, [], False), (4, None, False), (5, None, True), (6, None, False)], "qid long, doc_ids array<string>, several boolean")
    code = frame([(1, ["w"]), (2, ["x", "y"])], "qid long, doc_ids array<string>")
    cand = frame([(3, "a", 1), (3, "b", 2), *((4, u, i) for i, u in enumerate(["a_1", "b_2", "c_2", "d_4", "e_5"])), *((5, u, i) for i, u in enumerate(["a_1", "b_2", "c_2"]))], "qid long, unit string, ord int")
    said = frame([(4, "well [\"4\", \"2\", \"b_2\", \"q\", null] or []"), (5, "no list")], "qid long, content string")
    docs = frame([("a_1", "f"), ("b_2", "g"), ("c_2", "h"), ("d_4", "f"), ("e_5", "k")], "unit string, family string")
    tops = frame([(4, "surface", "", "e_5"), (4, "option", "A", "c_2"), (5, "surface", "", "a_1")], "qid long, part string, opt string, unit string")
    named = frame([(4, "zz", 0)], "qid long, unit string, pos int")
    out = replay.replay(q, code, cand, said, docs, tops, named)
    # question 4: the list names d_4 and b_2 (of two that end in 2 none); then d_4's family, the surface's best, and no room for the option's
    assert bag(out) == [(1, "input", ["z"], 0), (2, "code", ["x", "y"], 0), (3, "model", ["a", "b"], 0), (4, "model", ["d_4", "b_2", "a_1", "e_5"], 1), (5, "model", ["a_1", "b_2"], 1), (6, "model", [], 0)]
    log = frame([(1, "input", ["z"]), (2, "model", ["x", "y"]), (3, "model", ["b", "a"]), (4, "model", ["d_4", "b_2", "a_1", "e_5"]), (4, "model", ["d_4"]), (5, None, None), (9, "code", ["z"])], "qid long, selector string, picked array<string>")
    assert bag(replay.differences(out, log, said)) == [(2, "selector"), (3, "picked"), (4, "decisions"), (4, "picked"), (5, "picked"), (5, "selector"), (6, "decisions"), (9, "unknown")]


def test_repeated_responses_pick_as_one(spark):
    said = spark.createDataFrame([(1, '["7", "2"]'), (1, '["7", "2"]'), (2, '["2"]')], "qid long, content string")
    cand = spark.createDataFrame([(q, u) for q in (1, 2) for u in ("a_2", "b_7", "c_7x")], "qid long, unit string")
    assert bag(replay.parsed_picks(said, cand)) == [(1, ["b_7", "a_2"]), (2, ["a_2"])]


def test_common_names_meet_no_documents(spark, monkeypatch):
    sizes = []
    few = route._few
    monkeypatch.setattr(route, "_few", lambda found, most: sizes.append(found.count()) or few(found, most))
    # "sea" is of 30 companies, "side" of one with two years; two companies share the document x100
    ids = [(f"x{i}", i, "d", f"k{i}", ["sea"], "2020") for i in range(30)] + [("y", 50, "d", "one", ["side"], "2021"), ("z", 51, "d", "one", ["side"], "2022"), *(("x100", 100, "d", f"s{i}", ["both"], None) for i in range(12))]
    ids = spark.createDataFrame(ids, "doc_id string, pos int, domain string, company_key string, aliases array<string>, year string")
    q = spark.createDataFrame([(1, "d", "2022", "sea side", 1), (2, "d", "2022", "side", 1), (3, "d", "", "both", 1), (4, "d", "", "sea", 1)], "qid long, domain string, text string, normal string, n_options int")
    assert bag(route.by_company(q, ids, years=("d",))) == [(2, ["z"]), (3, ["x100"])]
    policies = [(i, i, "tide" if i < 20 else None, ["wave"], ["north"] if i == 3 else ["south"]) for i in range(30)] + [(40, 40, "reef", ["sand"], ["north"])]
    policies = spark.createDataFrame(policies, "doc_id long, pos long, product string, aliases array<string>, brands array<string>")
    q = spark.createDataFrame([(1, "", "atide"), (2, "", "wave"), (3, "", "northwave"), (4, "", "southwave"), (5, "", "sandreef"), (6, "", "reeftide")], "qid long, text string, normal string")
    assert bag(route.by_policy(q, policies)) == [(3, [3]), (5, [40])]
    assert sizes == [13, 2]

"""Decontamination against a plain search for every window of every item."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import decontaminate
from corpusloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, digest string, length int, window string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, met = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    met |= windows[x]
        out.append((doc, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, tmp_path, docs, items):
    spark.createDataFrame([(d, t, "x", 1, "y") for d, t in docs], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, t, "x") for d, t in items], "item_id long, text string, rep string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return sorted((tuple(r) for r in QUERIES["op11_decontamination"](spark, str(tmp_path)).collect()), key=str)


LONG = "One two three, four FIVE six. Seven eight nine ten éleven twelve thirteen fourteen"
ITEMS = [(1, LONG), (2, "seven EIGHT nine ten Éleven twelve"), (3, "alone"), (4, ""), (5, None), (6, " ... "), (7, "a b"), (7, "c d e"), (10, LONG), (None, "with no id"), (12, "a a a a a a a a a a a a")]
DOCS = [
    (1, LONG.upper()), (2, "zero " + LONG + " end"), (3, "six seven eight nine ten éleven twelve thirteen"), (4, None), (5, ""), (6, "!?"), (7, "Alone"), (8, "aLONE again alone"), (9, "a b c d e"), (9, "a b c d e"), (None, "b a b with NO id"),
    (11, "a " * 15), (12, "a " * 9), (13, ("filler words " * 500 + LONG + " ") * 20), (14, "one two three four five six seven eight nine eleven ten"), *((100 + i, LONG) for i in range(40)),
]


@pytest.mark.parametrize("docs,items", [(DOCS, ITEMS), (DOCS, []), ([], ITEMS), (DOCS, [(4, ""), (5, None)]), (DOCS, ITEMS[:1])])
def test_query(spark, tmp_path, docs, items):
    assert run(spark, tmp_path, docs, items) == expected(docs, items)


def test_full_bitmap_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(decontaminate, "BITS", decontaminate._MAP)
    monkeypatch.setattr(decontaminate, "_marked", lambda marks, least: least.isNotNull())
    assert run(spark, tmp_path, DOCS, ITEMS) == expected(DOCS, ITEMS)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab Z.\tÉé", max_size=60), max_size=8), st.lists(st.text("ab Z", max_size=40), max_size=4))
def test_random_texts(spark, tmp_path_factory, docs, items):
    docs, items = list(enumerate(docs)), list(enumerate(items))
    assert run(spark, tmp_path_factory.mktemp("random"), docs, items) == expected(docs, items)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op11_decontamination"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import periodic
from corpusloom.llm.queries import QUERIES


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if all(w[i] == w[i + p] for i in range(len(w) - p)))


def brute(w):
    """Maximal stretches for each period, of which those stay whose smallest period it is."""
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j + p - i
            if n >= max(6, 4 * p) and smallest_period(w[i : i + n]) == p:
                out.append((i, n, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(*texts):
    return [[tuple(int(v) for v in r) for r in x] for x in periodic.runs([np.array(t, dtype=np.int64) for t in texts])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_runs(texts):
    assert found(*texts) == [brute(t) for t in texts]


def test_planted_runs(monkeypatch):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        t = [rng.randrange(50) for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(4)):
            unit = [rng.randrange(5) for _ in range(rng.randrange(1, 20))]
            at = rng.randrange(len(t) + 1)
            t[at:at] = (unit * rng.randrange(2, 9))[: rng.randrange(1, 120)]
        texts.append(t)
    want = [brute(t) for t in texts]
    assert found(*texts) == want
    monkeypatch.setattr(periodic, "HELD", 7)  # candidates in many parts
    assert found(*texts) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=80), st.data())
def test_extensions(w, data):
    x, y = data.draw(st.lists(st.integers(0, len(w) - 1), min_size=2, max_size=2, unique=True))
    g = periodic.Grammar(np.array([-1, *w, -2]))
    after = next(n for n in range(len(w)) if max(x, y) + n == len(w) or w[x + n] != w[y + n])
    before = next(n for n in range(len(w) + 1) if min(x, y) - n < 0 or w[x - n] != w[y - n])
    a, b = np.array([x + 1]), np.array([y + 1])
    assert g.extensions(a, b).tolist() == [after]
    assert g.extensions(a, b, forward=False).tolist() == [before]


def test_long_text():
    """Half a million words: a run over a third of them, and one word a hundred thousand times."""
    rng = np.random.default_rng(3)
    unit, noise = rng.integers(0, 1000, 30_000), rng.integers(1000, 100_000, 200_000)
    t = np.concatenate((noise, np.tile(unit, 6), [7], np.full(100_000, 5), [8]))
    rows = {tuple(r) for r in periodic.runs([t])[0].tolist()}
    assert (200_000, 180_000, 30_000) in rows and (380_001, 100_000, 1) in rows


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs, gone = brute(w), set()
    for s, n, p in runs:
        gone |= set(range(s + p, s + n))
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("kind", ["given", "odd", "empty"])
def test_query(spark, tmp_path, sf_dir, kind):
    if kind == "given":
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
        rows = [(d, t) for d, t in rows if len((t or "").split()) < 1500]
    elif kind == "odd":
        rows = [(None, "a b " * 9), (1, None), (2, ""), (3, " \n\t "), (3, " \n\t "), (4, "x " * 50), (4, "x " * 50), (5, "a b " * 6), (6, "é ß é ß é ß é ß"), *((i, "p q r s " * 5 + "end") for i in range(20, 60))]
    else:
        rows = []
    spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id long, text string, runs int, collapsed string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()]
    assert order(got) == order([expected(d, t) for d, t in rows])

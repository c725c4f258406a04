"""SimHash fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import simhash
from corpusloom.llm.queries import QUERIES
from corpusloom.session import Scratch


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, most=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a = np.array(prints, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= most):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBÉ \n\t\x0b ß", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fingerprint(text)


def linked(spark, prints):
    rows = simhash.components(simhash.links(spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long"), scratch := Scratch(spark, "t")), scratch).collect()
    return {int(np.int64(r.node).view(np.uint64)): int(np.int64(r.root).view(np.uint64)) for r in rows}


def near(rng, p, n):
    for b in rng.sample(range(64), n):
        p ^= 1 << b
    return p


def made(seed):
    """Chains of 4-bit steps, tight clusters, just-too-far pairs and strangers."""
    rng = random.Random(seed)
    out = []
    for _ in range(6):
        p = rng.getrandbits(64)
        out.append(p)
        for _ in range(12):
            p = near(rng, p, 4)
            out.append(p)
    for _ in range(3):
        c = rng.getrandbits(64)
        out += [near(rng, c, rng.randrange(4)) for _ in range(60)]
    for _ in range(20):
        c = rng.getrandbits(64)
        out += [c, near(rng, c, 5)]
    return list(dict.fromkeys([*out, 0, 1, 2**64 - 1, *(rng.getrandbits(64) for _ in range(100))]))


@pytest.mark.parametrize("cell", [4096, 8])
def test_links_join_what_all_pairs_join(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)  # 8: most cells of clusters are searched by the cells within them
    prints = made(cell)
    got = linked(spark, prints)
    expect = components(list(range(len(prints))), prints)
    groups = {}
    for p, c in zip(prints, expect, strict=True):
        groups.setdefault(c, set()).add(p)
    for members in groups.values():
        assert len({got.get(p, p) for p in members}) == 1
    assert len({got.get(p, p) for p in prints}) == len(groups)


def test_a_cell_beyond_the_limit():
    rng = random.Random(5)
    base, few = rng.getrandbits(64), [1 << b for b in rng.sample(range(32), 14)]
    prints = np.unique(np.array([base ^ sum(m for m in few if rng.random() < 0.5) for _ in range(20_000)], dtype=np.uint64))
    strangers = np.array([(base >> 32 << 32) | rng.getrandbits(32) for _ in range(3000)], dtype=np.uint64)
    fp = np.unique(np.concatenate((prints, strangers)).view(np.int64))
    assert len(fp) > simhash.CELL
    choice = list(simhash.combinations(range(8), 4)).index((0, 1, 2, 3))  # bands of the upper 32 bits, which all share
    cell = choice * 81**4
    links = [(int(a), int(b)) for x, y in simhash._within(cell, fp) for a, b in zip(x, y, strict=True)]
    assert all((np.uint64(a & (2**64 - 1)) ^ np.uint64(b & (2**64 - 1))).bit_count() <= 4 for a, b in links)
    at = {int(x): i for i, x in enumerate(fp)}
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fp))] == components(list(range(len(fp))), fp.view(np.uint64))


def test_long_chains_end(spark):
    scratch = Scratch(spark, "chain")
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    assert {r.root for r in simhash.components(edges, scratch).collect()} == {0, 500}
    assert simhash.components(edges.limit(0), Scratch(spark, "none")).count() == 0


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = [fingerprint(d.text) for d in docs]
    expect = dict(zip([d.doc_id for d in docs], zip(prints, components([d.doc_id for d in docs], prints), strict=True), strict=True))
    rows = QUERIES["op9_simhash"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (int(r.fingerprint, 16), r.component_id) == expect[r.doc_id] and len(r.fingerprint) == 16


def test_edge_cases(spark):
    data = [(5, None), (3, " "), (9, ""), (7, "same text here now"), (7, "same text here now"), (2, "SAME text\there now"), (None, "alone"), (8, "x" * 50_000)]
    df = spark.createDataFrame([(*d, "c") for d in data], "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (2, 2), (3, 3), (5, 3), (7, 2), (7, 2), (8, 8), (9, 3)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.unique_documents(df)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3, 8] and kept.columns == df.columns


def test_text_ids(spark):
    df = spark.createDataFrame([("b", "same text here"), ("a", "same text here"), (None, "same text here")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()} == {("a", "a"), ("b", "a"), (None, "a")}


def test_unique_documents_with_odd_ids_and_clashing_names(spark):
    data = [(None, "first text of all"), (1, "second text of it"), (1, "another one with words"), (1, "second text of it"), (None, "nothing like the rest"), (2, "another one with words"), (None, None), (4, " ")]
    df = spark.createDataFrame([(*d, "c", 1, 2, 3, 4) for d in data], "doc_id long, text string, `a.b` string, row int, fp int, doc int, _keep int")
    kept = simhash.unique_documents(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "first text of all"), (0, "nothing like the rest"), (1, "another one with words"), (1, "second text of it"), (4, " ")]
    assert simhash.unique_documents(df.limit(0)).count() == 0

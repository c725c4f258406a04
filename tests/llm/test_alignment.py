"""Token alignment against the tokenizers' own libraries and a plain count of shared ends."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusloom.llm import alignment
from corpusloom.llm.queries import QUERIES
from corpusloom.session import Scratch

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PARTS = [" "] * 8 + list("abehtinrES .,'\n\t1é 　中🙂́ß") + ["\0", "\r", "<s>", "</s>", "<0x41>", "<unk>", "<|endoftext|>", "﻿", "ﬁ", "가", "'ll", "the ", " and", "  ", "ing", "\U0001fae0", "͸", "▁"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    with open(A, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    names = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xAC or 0xAE <= c <= 0xFF]
    shown = {chr(c): c for c in names} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in names)}
    a_bytes = {i: bytes(shown[c] for c in x) for x, i in vocab.items()}
    b_bytes = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    return a, b, a_bytes, b_bytes


def plain(text, tools):
    """Ids, groups and links of a text, by the ends of all tokens."""
    a, b, a_bytes, b_bytes = tools
    if not text:
        return [], [], [], []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if any(b"".join(names[i] for i in ids) != (" " + text).encode() for names, ids in ((a_bytes, x), (b_bytes, y))):
        return [], [], [], []
    ends = []
    for names, ids in ((a_bytes, x), (b_bytes, y)):
        at, out = 0, []
        for i in ids:
            at += len(names[i])
            out.append(at)
        ends.append(out)
    shared = sorted(set(ends[0]) & set(ends[1]))
    groups, before = [], 0
    for e in shared:
        groups.append(tuple(",".join(str(i) for i, z in zip(ids, of, strict=True) if before < z <= e) for ids, of in ((x, ends[0]), (y, ends[1]))))
        before = e
    links = [(i, j) for e in shared for i in [x[ends[0].index(e)]] for j in [y[ends[1].index(e)]]]
    return x, y, groups, links


def expected(rows, tools):
    done = [(d, plain(t, tools)) for d, t in rows]
    counts = Counter(link for _, (_, _, _, links) in done for link in links)
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(d, len(x), len(y), len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join("|".join(s) for s in g).encode()).hexdigest() if x else "") for d, (x, y, g, k) in done]


def test_ids(tools):
    a, b, _, _ = tools
    both, some = alignment.Both(alignment.ByteLevel(A), alignment.Pieces(B)), [*texts(4000), "x\n  y", "x\n ", "x\t y", "\n", "\n ", " ", "  ", "a \n b", "a\u3000  b", "a\x85  b"]
    for i in range(0, len(some), 100):
        part = some[i : i + 100]
        for t, x, y in zip(part, *both.encode([" " + t if t else "" for t in part]), strict=True):
            assert x.tolist() == (a.encode(" " + t, add_special_tokens=False).ids if t else [])
            assert "▁" in t or y.tolist() == b.encode(t)


def test_pools_start_anew(tools, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE", 5)
    tool = alignment.Aligner(alignment.ByteLevel(A), alignment.Pieces(B))
    some = texts(200, 7)
    for i in range(0, 200, 20):
        for t, *got in zip(some[i : i + 20], *tool.texts(some[i : i + 20]), strict=True):
            x, y, g, k = plain(t, tools)
            assert got[:4] == [len(x), len(y), len(g), ";".join("|".join(s) for s in g)]
            assert got[4].tolist() == [i * alignment.SECOND + j for i, j in k]


def order(rows):
    return sorted(rows, key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("kind", ["given", "odd", "empty"])
def test_query(spark, tmp_path, sf_dir, tools, kind):
    if kind == "given":
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 6000]
    elif kind == "odd":
        rows = [(None, "same words here"), (1, None), (2, ""), (3, " "), (3, " "), (4, "same words here"), (4, "same words here"), (5, "▁ is no blank"), (6, "x" * 5000), (7, "a " * 20000), *enumerate(texts(150, 3), 100)]
    else:
        rows = []
    spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id long, text string, row int, pairs string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op13_token_alignment"](spark, str(tmp_path))
    assert tuple(df.columns) == COLUMNS
    assert order(tuple(r) for r in df.collect()) == order(expected(rows, tools))


@pytest.mark.parametrize("frequent", [0, 20])
def test_rare_pairs_are_joined(spark, tmp_path, tools, frequent):
    rows = list(enumerate(["the cat and the dog", "the dog and a cat", "le chat et le chien", "the the the", ""]))
    scratch = Scratch(spark, "t")
    done = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    done = scratch.keep(done.selectExpr("doc_id as row", *done.columns), "rows")
    got = alignment.scored(done, scratch, frequent).select("doc_id", "n_links", "n_best", "count_sum").collect()
    assert order(tuple(r) for r in got) == order((d, n, best, total) for d, _, _, _, n, best, total, _ in expected(rows, tools))

"""BPE, language identification, LM scoring, licence scans and the pipeline."""

import base64
import collections
import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import bpe, language_id, licenses, lm_scoring
from corpusloom.llm.queries import ORACLE, QUERIES
from tests.rows import compare

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(reference, texts):
    for x, ids in zip(texts, bpe.tokenizer(PATH).encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(x), x
        assert bpe.tokenizer(PATH).decode(ids) == x.encode()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="'strevmld aZ9é  \n\t 　!中😀²Ⅷ\x1c\x85", max_size=24), max_size=5))
def test_pieces_of_any_text(reference, texts):
    same(reference, texts)


def test_every_code_point(reference):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 97 == 0)]
    same(reference, ["".join(f"a{c} {c}1{c}'s" for c in points[i : i + 200]) for i in range(0, len(points), 200)])


def test_long_pieces_and_chunks(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 1000)
    same(reference, ["a" * 5000, "ab" * 4000, "", " " * 3000 + "x", "'s" * 1500, "x" * 999 + "'re " + "y" * 995 + " 'll", "<|endoftext|>" * 9])


def test_cache_turns_over(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    same(reference, ["one two three four five one two three six seven eight"])


def test_documents_as_the_library_encodes_them(spark, sf_dir, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(reference.encode_ordinary(docs[r.doc_id] or ""), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_encode_then_decode(spark):
    df = spark.createDataFrame([("1", None, "c"), ("2", "", "c"), (None, "née 😀", "c"), ("2", "née 😀", "c")], "doc_id string, text string, ids string")
    rows = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted(bytes(r.decoded).decode() for r in rows) == ["", "", "née 😀", "née 😀"]
    assert all(np.frombuffer(r.ends, "<u4")[-1] == len(r.decoded) for r in rows if r.n_tokens)
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_held_out_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = QUERIES["op4_language_id"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) > 0


def test_languages_against_plain_counts(spark):
    texts = ["the cat and the dog", "der hund und die katze", "Le chat et le chien", "the end", "und so weiter"]
    langs = ["en", "de", "fr", "en", "de"]
    df = spark.createDataFrame([(i * 4, t, k) for i, (t, k) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")
    learn = [r.doc_id for r in df.filter(~language_id.held_out(F.col("doc_id"))).collect()]
    names, log = language_id.fit(df)
    counts = {k: collections.Counter() for k in names}
    for i, (t, k) in enumerate(zip(texts, langs, strict=True)):
        if i * 4 in learn:
            counts[k].update(b for x in language_id.grams(t) for b in x.tolist())
    for k, row in zip(names, log, strict=True):
        n = sum(counts[k].values())
        for b in list(counts[k])[:20]:
            assert row[b] == pytest.approx(math.log((counts[k][b] + 0.5) / (n + 0.5 * language_id.BUCKETS)), rel=1e-5)


def test_predictions_by_brute_force(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, log = language_id.fit(docs)
    monkeypatch.setattr(language_id, "_WINDOW", 1000)
    monkeypatch.setattr(language_id, "_PRODUCT", 2000)
    texts = [*(r.text for r in docs.collect()), "a", "é", "x" * 40_000, "der die das " * 3000, "zz top"]
    sums = language_id._batch_scores(texts, log.T)
    for t, row in zip(texts, sums, strict=True):
        points = [ord(c) for c in f" {t.lower()} "]
        total = log[:, -1].astype(float)
        count = collections.Counter()
        for n, primes in ((2, (0x9E3779B1, 0x85EBCA77)), (3, (0xC2B2AE3D, 0x27D4EB2F, 0x165667B1))):
            for i in range(len(points) - n + 1):
                x = 0
                for p, c in zip(primes, points[i : i + n], strict=True):
                    x ^= p * c & 0xFFFFFFFF
                count[((x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 16] += 1
        for b, n in count.items():
            total += n * log[:, b]
        assert row == pytest.approx(total, rel=1e-6)
    rows = language_id.predict(spark.createDataFrame([(t,) for t in texts[-5:]], "text string"), (langs, log)).collect()
    for r, total in zip(rows, sums[-5:], strict=True):
        p = np.exp(total - total.max())
        assert r.lang_pred == langs[int(p.argmax())] and r.score == pytest.approx(float(p.max() / p.sum()), rel=1e-6)


def test_windows_of_long_texts(monkeypatch):
    whole = np.sort(np.concatenate(list(language_id.grams("abc de" * 50))))
    monkeypatch.setattr(language_id, "_WINDOW", 7)
    assert (np.sort(np.concatenate(list(language_id.grams("abc de" * 50)))) == whole).all()


def test_unknown_languages(spark):
    df = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 1), (3, "12 !?", None, 1), (4, "words here", "en", 1), (None, "words", "de", 1), (4, "words here", "en", 1)], "doc_id long, text string, lang string, score int")
    rows = language_id.identify(df).collect()
    assert len(rows) == 6 and all((r.lang_pred == "und") == (r.score == 0) for r in rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} >= {1, 2, 3}
    assert language_id.identify(df.limit(0)).count() == 0
    nothing = language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.lang_pred == "und" for r in nothing)


def lm(docs):
    """Stupid backoff of ``[(doc_id, text)]`` rows, by plain counts of every word and pair."""
    rows = [(d, (t or "").encode().lower().split()) for d, t in docs]
    one = collections.Counter(w for _, x in rows for w in x)
    two = collections.Counter(p for _, x in rows for p in zip(x, x[1:]))
    holders = collections.defaultdict(set)
    for d, x in rows:
        for p in zip(x, x[1:]):
            holders[p].add(d)
    n = sum(one.values())
    out = collections.defaultdict(lambda: (0, 0.0))
    for d, x in rows:
        s = math.log(one[x[0]] / n) if x else 0.0
        for a, b in zip(x, x[1:]):
            s += math.log(two[a, b] / one[a]) if len(holders[a, b] - {None}) > 1 else math.log(0.4 * one[b] / n)
        out[d] = out[d][0] + len(x), out[d][1] + s
    return out


def same_scores(df, expect):
    rows = df.collect()
    assert len(rows) == len(expect)
    for r in rows:
        n, s = expect[r.doc_id]
        assert r.n_words == n and r.log_score == pytest.approx(s, rel=1e-9, abs=1e-9)
        assert r.mean_log_score is None if n == 0 else r.mean_log_score == pytest.approx(s / n)


ODD = [(-1, None), (-2, " "), (-3, "One"), (-4, "rareword otherword rareword otherword"), (-5, "thirdword rareword"), (-6, "onceword rareword otherword"), (-7, "onlyonce"), (-8, "a b " * 30_000)]


@pytest.mark.parametrize("frequent", [1 << 18, 200, 0])
def test_scores_by_brute_force(spark, sf_dir, frequent):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD
    df = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, pair string, n int")
    same_scores(lm_scoring.score(df, frequent=frequent), lm(docs))


def test_scores_of_a_larger_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    same_scores(lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string")), lm(docs))


def test_scores_with_more_words_than_the_short_cut(spark):
    texts = [" ".join(f"w{i * 1000 + j}" for j in range(1000)) for i in range(70)] + ["w5 w7", "w69999 w3"]
    docs = list(enumerate(texts * 2)) + [(-1, "w12 w13 w15")]
    same_scores(lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string"), frequent=50_000), lm(docs))


def test_a_hot_pair(spark):
    docs = [(i, "hot pair" if i % 3 else f"hot pair {i} {i % 50}") for i in range(3000)]
    same_scores(lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string"), frequent=1), lm(docs))


def test_scores_of_repeated_null_and_text_ids(spark):
    docs = [(1, "a b"), (1, "a b"), (None, "b a"), (None, None), (None, "b a c"), (2, "b a"), (3, "a b")]
    same_scores(lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string")), lm(docs))
    named = [("x", "a b c"), ("y", "a b"), (None, "b c")]
    same_scores(lm_scoring.score(spark.createDataFrame(named, "doc_id string, text string")), lm(named))
    assert lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string").limit(0)).count() == 0


def lm_plain(docs):
    """Plain stupid backoff, every pair counted, whichever documents have it."""
    rows = [(d, (t or "").encode().lower().split()) for d, t in docs]
    one = collections.Counter(w for _, x in rows for w in x)
    two = collections.Counter(p for _, x in rows for p in zip(x, x[1:]))
    n = sum(one.values())
    out = collections.defaultdict(lambda: (0, 0.0))
    for d, x in rows:
        s = math.log(one[x[0]] / n) if x else 0.0
        s += sum(math.log(two[p] / one[p[0]]) for p in zip(x, x[1:]))
        out[d] = out[d][0] + len(x), out[d][1] + s
    return out


def test_pairs_that_one_document_alone_has_are_counted(spark):
    docs = [(1, "a b a b a c"), (2, "a d"), (2, "e a d once"), (3, "once2 a d twice x twice y"), (None, "p q p r"), (None, "p q"), (4, None)]
    expect = lm_plain(docs)
    assert expect[1][1] == pytest.approx(math.log(6 / 25) + 2 * math.log(2 / 6) + math.log(1 / 6)) and expect[None][0] == 6
    for frequent in (1 << 18, 1, 0):
        same_scores(lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string"), frequent=frequent, own_pairs=True), expect)


@pytest.mark.parametrize("frequent", [1 << 18, 200, 0])
def test_plain_scores_by_brute_force(spark, sf_dir, frequent):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD
    same_scores(lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string"), frequent=frequent, own_pairs=True), lm_plain(docs))


def test_scores_sql(spark, sf_dir, duck):
    compare(QUERIES["op1_lm_scoring"](spark, sf_dir), duck, ORACLE["op1_lm_scoring"])


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [("r/LICENSE", gpl), ("r/a/x.txt", None), ("r/a/b/LICENSE.md", mit), ("r/a/b/c/y", "prose"), ("r/a/z", f"prose. {mit} More prose."), ("q/y", "the licence of this is unclear to all of us who read it here"), (None, mit), ("r/a/x.txt", None)]
    df = spark.createDataFrame([(*f, "c") for f in files], "path string, text string, licence string")
    got = {r.path: (r.licence, r.origin, r.from_dir) for r in licenses.scan(df).collect()}
    assert got == {
        "r/LICENSE": ("GPL-3.0", "own", None), "r/a/x.txt": ("GPL-3.0", "inherited", "r"), "r/a/b/LICENSE.md": ("MIT", "own", None), "r/a/b/c/y": ("MIT", "inherited", "r/a/b"),
        "r/a/z": ("MIT", "own", None), "q/y": (None, None, None), None: (None, None, None),
    }
    assert licenses.scan(df).count() == 8 and licenses.scan(df.limit(0)).count() == 0


def test_licence_headers_files_and_identifiers(spark):
    gpl = """
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
    mpl = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
int main() {}"""
    files = {
        "a/gpl.py": "#!/usr/bin/python\n# Copyright 2020 Somebody Or Other\n" + gpl + "\nimport os\n",
        "a/mpl.c": mpl, "a/s.py": "# SPDX-License-Identifier: GPL-3.0-only\nx = 1", "a/m.py": "// SPDX-License-Identifier: mit\nx", "a/w.c": "/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */",
        "l/agpl/LICENSE": (licenses.TEXTS / "AGPL-3.0.txt").read_text(), "l/gpl/COPYING": (licenses.TEXTS / "GPL-3.0.txt").read_text()[:20_000], "l/mit/LICENSE": "Copyright (c) 2020 A. Person\n\n" + (licenses.TEXTS / "MIT.txt").read_text(),
        "LICENSE": "Apache License\nVersion 2.0, January 2004", "b/c/x": "prose", "y": "prose",
    }
    got = {r.path: (r.licence, r.from_dir) for r in licenses.scan(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    assert got == {
        "a/gpl.py": ("GPL-3.0", None), "a/mpl.c": ("MPL-2.0", None), "a/s.py": ("GPL-3.0", None), "a/m.py": ("MIT", None), "a/w.c": ("GPL-2.0", None), "l/agpl/LICENSE": ("AGPL-3.0", None),
        "l/gpl/COPYING": ("GPL-3.0", None), "l/mit/LICENSE": ("MIT", None), "LICENSE": ("Apache-2.0", None), "b/c/x": ("Apache-2.0", ""), "y": ("Apache-2.0", ""),
    }


def test_cosines_by_brute_force(spark):
    notices = ["Released under the MIT License.", "Licensed under CC BY 4.0. Copyright somebody", "prose about a licence of nobody", "This work is licensed under the GNU General Public License, version 3. Yes", (licenses.TEXTS / "MIT.txt").read_text(), (licenses.TEXTS / "MPL-2.0.txt").read_text()[:4000], "Released under the MIT License."]
    count = lambda t: collections.Counter(re.findall(licenses.TERM, t.lower()))
    templates = [(name, count(text)) for name, text in licenses._templates()]
    known = {t for _, c in templates for t in c}
    idf = {t: math.log((1 + len(notices)) / (1 + sum(t in count(x) for x in notices))) + 1 for t in known}
    weigh = lambda c: {t: n * idf.get(t, math.log(1 + len(notices)) + 1) for t, n in c.items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    expect = {}
    for i, text in enumerate(notices):
        v = weigh(count(text))
        best = max((round(sum(v.get(t, 0) * x for t, x in w.items()) / length(v) / length(w), 6), name) for name, c in templates for w in [weigh(c)])
        if best[0] >= licenses.LEAST_COSINE:
            expect[str(i)] = best
    rows = licenses.matched(spark.createDataFrame([(str(i), t) for i, t in enumerate(notices)], "path string, notice string")).collect()
    assert {r.path: (r.cosine, r.licence) for r in rows} == {i: (pytest.approx(c, abs=2e-6), name) for i, (c, name) in expect.items()} and len(expect) >= 5


def test_licence_query_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = {r.doc_id: r for r in QUERIES["op7_license_scans"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    named = {"MIT License": "MIT", "Apache License": "Apache-2.0", "GNU General": "GPL-3.0", "CC BY-NC": "CC-BY-NC-4.0"}
    own = {d.doc_id: next((v for k, v in named.items() if k in d.text), None) for d in docs}
    for i, r in rows.items():
        assert (r.licence if r.origin == "own" else None) == own[i]
    given = {}
    for i in sorted((i for i in own if own[i] and i % 10 == 0), key=lambda i: rows[i].path):
        given.setdefault(rows[i].path.rpartition("/")[0], own[i])
    for r in rows.values():
        if r.origin != "own":
            steps = r.path.split("/")[:-1]
            near = next((given[p] for k in range(len(steps), 0, -1) if (p := "/".join(steps[:k])) in given), None)
            assert r.licence == near


def test_pipeline(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inputs, out = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir)
        if name != "tokens":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
            inputs.append(out)
    first, good, known, unique, mixture = ({r.doc_id: r.text for r in x.collect()} for x in inputs)
    kept = {r.doc_id for r in QUERIES["op2_quality_rules"](spark, sf_dir).filter("kept").collect()}
    assert set(good) == kept and set(known) <= set(good) and set(mixture) <= set(unique)
    from tests.llm.test_near_duplicates import components, fingerprint

    ids = sorted(known)
    assert set(unique) == set(components(ids, [fingerprint(known[i]) for i in ids]))
    rows = out.collect()
    mixed = collections.Counter((r.doc_id, r.text) for r in inputs[-1].collect())
    expect = collections.Counter({(i, hashlib.sha256(t.encode()).hexdigest(), len(reference.encode_ordinary(t))): n for (i, t), n in mixed.items()})
    assert collections.Counter((r.doc_id, r.decoded_sha256, r.n_tokens) for r in rows) == expect
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows)


def test_compound_licences_and_clashing_columns(spark):
    files = [("a/x.py", "# SPDX-License-Identifier: MIT OR Apache-2.0\n", 1), ("a/y.py", "# SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND MIT\n", 2), ("b/LICENSE", "SPDX-License-Identifier: MIT AND ISC", 3), ("b/z.py", "print()", 4), (None, "SPDX-License-Identifier: MIT", 5)]
    df = spark.createDataFrame([(p, t, n, n, n, n, n) for p, t, n in files], "path string, text string, p int, cosine int, licence int, dir int, kept int")
    out = licenses.scan(df, keep=("p", "cosine", "licence", "dir", "kept"))
    assert len(set(out.columns)) == len(out.columns)
    got = {r.p: (r.licence, r.origin, r.kept_cosine, r.kept_licence, r.dir, r.kept) for r in out.collect()}
    assert got == {1: ("Apache-2.0, MIT", "own", 1, 1, 1, 1), 2: ("GPL-2.0, MIT", "own", 2, 2, 2, 2), 3: ("ISC, MIT", "own", 3, 3, 3, 3), 4: ("ISC, MIT", "inherited", 4, 4, 4, 4), 5: (None, None, 5, 5, 5, 5)}

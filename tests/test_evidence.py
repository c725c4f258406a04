"""Gathered evidence by brute force, wording rules, and provenance checks with planted violations."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import cards, evidence, gather, prompts, route
from corpusloom.operators import provenance as P
from corpusloom.sources import files


def one(spark, f, *texts):
    df = spark.createDataFrame([texts], [f"c{i}" for i in range(len(texts))])
    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first().x


def test_quoted_terms(spark):
    assert one(spark, T.quoted_keywords, "‘现金价值’ 与 “ 等待期 ” 和 《条款》《条款》") == ["现金价值", "等待期", "条款"]


def test_numbers_go_as_runs(spark):
    assert one(spark, T.without_numbers, "增长12345678率") is None
    assert one(spark, T.without_numbers, "营业收入增长12.5%以上的公司") == "营业收入增长 以上的公司"


def test_wording_for_several_documents(spark):
    for t in ("两家公司的收入", "以下三份文件", "三家公司募集说明书", "几份合同", "各文件", "四家"):
        assert one(spark, T.wants_several_documents, t), t
    for t in ("这家公司", "两个数字", "三项"):
        assert not one(spark, T.wants_several_documents, t), t


def test_several_asked_for_need_several_documents(spark):
    policies = spark.createDataFrame([("a", 0, "安心福", ["安心福"], ["山海"])], "doc_id string, pos int, product string, aliases array<string>, brands array<string>")
    q = spark.createDataFrame([("1", "两家公司的安心福", "两家公司的安心福"), ("2", "安心福", "安心福")], "qid string, text string, normal string")
    assert [(r.qid, r.doc_ids) for r in route.by_policy(q, policies).collect()] == [("2", ["a"])]


def test_tags_leave_out_the_first_topic(spark):
    text = "保险条款\n1.1 保险责任\n" + "在保险期间内，我们承担保险责任，给付身故保险金，保险期间自生效日起，保险费的缴纳见条款。" * 3
    for r in cards.cards(spark.createDataFrame([("d", text)], "doc_id string, text string")).collect():
        assert r.topic not in r.tags and (r.tags or r.topic)


def test_tags_of_chunks_without_a_page(spark):
    kept = spark.createDataFrame([("q", "d", None, 3, "text"), ("q", "d", 2, 1, "more")], "qid string, doc_id string, page int, ord int, text string")
    assert evidence.rendered(kept).first().block == "【d#c3】text\n\n【d P2】more"


def test_credentials(spark):
    for t, leaks in (("sk-abcdefgh12", True), ("Authorization: Bearer x", True), ("authorization: [REDACTED]", False), ("api_key='[REDACTED]' x-api-key = 7", True), ("plain", False), (None, False)):
        df = spark.createDataFrame([(t,)], "t string")
        assert df.select(T.leaks_credentials(F.col("t")).alias("x")).first().x == leaks, t


def test_paths_and_lists_in_prose(spark):
    for p, ok in (("a/b.txt", True), ("/a", False), ("a/../b", False), ("./a", False), ("", False), ("C:/x", False), ("a//b", True), ("a/b/", True)):
        assert one(spark, T.safe_path, p) == ok, p
    assert one(spark, T.ids_in_prose, 'I pick ["a", "b"] and ["c"]') == ["a", "b"] and not one(spark, T.ids_in_prose, "none")


def test_titles_named_by_options(spark):
    assert one(spark, T.names_title, "山海科技股份有限公司的收入", "山海科技 2023 年度报告")
    assert not one(spark, T.names_title, "收入年度报告", "利润年度报告") and not one(spark, T.names_title, "abc", "abc")


def bm25(chunks, query):
    """Scores of one document's chunks."""
    toks = [T._tokens_of(c) for c in chunks]
    mean = sum(map(len, toks)) / len(toks) or 1.0
    terms = collections.Counter(T._tokens_of(query))
    for y in dict.fromkeys(re.findall(r"(?<!\d)20(\d\d)(?!\d)", query)):
        terms[y] += y not in terms
    out = []
    for x in toks:
        s = 0.0
        for t, q in terms.items():
            tf, df = x.count(t), sum(t in y for y in toks)
            if tf:
                w = 2.2 if t[0].isdigit() or t.endswith("%") else 1.6 if re.fullmatch("[一-鿿]{2}", t) else 1.0
                s += q * w * math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(x) / mean))
        out.append(round(s, 6))
    return out


def gathered(question, options, doc_ids, chunks, titles, budget):
    def top(d, query, k):
        s = bm25(chunks[d], query)
        order = sorted((i for i in range(len(s)) if s[i] > 0), key=lambda i: (-s[i], i))[:k]
        return [(d, i, s[i]) for i in order]

    best, protected = {}, set()
    bare = [b for b in (re.sub("[0-9.,%％]+", " ", o) for o in options) if len(b.strip()) >= 8]
    bare = [b for b, o in zip([re.sub("[0-9.,%％]+", " ", o) for o in options], options) if b != o and b in bare]
    queries = [(question, 3, True)] + [(question[:40] + " " + o, 2, True) for o in options] + [(b, 2, False) for b in bare]
    for q, k, core in queries:
        hits = []
        for n, d in enumerate(doc_ids):
            t = top(d, q, 3)
            hits += [(round(s / t[0][2], 6), -n, -r, d, i) for r, (d, i, s) in enumerate(t)]
        if hits and core:
            protected.add(max(hits)[3:])
        for s, _, r, d, i in hits:
            if -r < k:
                best[d, i] = max(s, best.get((d, i), 0))
    text = " ".join([question, *options])
    words = list(dict.fromkeys(w.strip() for w in re.findall("[‘’“\"《]([^’”\"》]{2,24})[’”\"》]", text) if w.strip()))[:8]
    forced = []
    for w in words:
        for d in doc_ids:
            held = [i for _, i, _ in top(d, w, 2) if w in chunks[d][i]]
            numbered = [i for i in held if any(w in x and re.search("[0-9％%]", x) for x in chunks[d][i].split("\n"))]
            forced += [(d, i) for i in (numbered or held)[:1]]
    for o in options:
        local = [top(d, o, 1)[0] for d in doc_ids if top(d, o, 1)]
        named = [x for x in local if any(o[j : j + 4] in titles[x[0]] for j in range(len(o) - 3))]
        forced += [x[:2] for x in named or local and [max(local, key=lambda x: x[2])]]
    for x in forced:
        protected.add(x)
        best[x] = 1e9
    toc = lambda x: chunks[x[0]][x[1]].count("……") >= 3
    order = sorted(best, key=lambda x: (x not in protected, toc(x), -best[x], doc_ids.index(x[0]), x[1]))
    size = lambda x: len(chunks[x[0]][x[1]]) + 20
    kept, total = [], 0
    for x in order:
        if x in protected or total + size(x) <= budget:
            kept.append(x)
            total += size(x)
    for d in doc_ids:
        mine = [x for x in order if x[0] == d and not toc(x)]
        if mine and not any(x[0] == d for x in kept):
            while sum(map(size, kept)) + size(mine[0]) > budget:
                victims = [x for x in kept if x not in protected and x[0] != d]
                if not victims:
                    break
                kept.remove(victims[-1])
            kept.append(mine[0])
    return sorted((d, i, (d, i) in protected) for d, i in kept)


CHUNKS = {
    "d1": ["alpha beta 现金价值 12%\nrest", "gamma delta " * 20, "现金价值 words only", "目录……一……二……三 alpha", "epsilon zeta 2023"],
    "d2": ["alpha theta iota " * 12, "kappa lambda 现金价值 7 元", "mu nu xi " * 15],
    "d3": ["omicron alpha " * 30, "pi rho alpha beta gamma"],
    "d4": ["nothing that is asked", "sigma tau"],
}
TITLES = {"d1": "山海科技", "d2": "riverbank", "d3": "hills", "d4": "lakes"}
QUESTIONS = [
    ("q1", "alpha beta gamma “现金价值” 2023", ["riverbank kappa lambda", "delta 12.5% of epsilon zeta"], ["d1", "d2", "d3"]),
    ("q2", "theta iota mu nu", ["omicron pi rho", "xi alpha"], ["d3", "d2"]),
    ("q3", "sigma", [], ["d4", "d1"]),
]


def test_gathering_by_brute_force(spark):
    q = spark.createDataFrame([(i, t, [(chr(65 + k), o) for k, o in enumerate(os)], d) for i, t, os, d in QUESTIONS], "qid string, question string, options array<struct<letter:string,text:string>>, doc_ids array<string>")
    c = spark.createDataFrame([(d, i, None, t) for d, cs in CHUNKS.items() for i, t in enumerate(cs)], "doc_id string, ord int, page int, text string")
    titles = spark.createDataFrame(list(TITLES.items()), "doc_id string, title string")
    for budget in (150, 420, 2000):
        out = gather.gather(q, c, titles, budget)
        got = collections.defaultdict(list)
        for r in out.orderBy("qid", "ord").collect():
            got[r.qid].append((r.doc_id, r.chunk, r.protected))
        for i, t, os, d in QUESTIONS:
            assert got[i] == gathered(t, os, d, CHUNKS, TITLES, budget), (i, budget)
    block = {r.qid: r.block for r in gather.blocks(q, out, titles, facts=spark.createDataFrame([("q1", "FACTS")], "qid string, block string")).collect()}
    assert block["q1"].startswith("FACTS\n\n涉及文档:\n- d1: 《山海科技》\n- d2: 《riverbank》") and "原文片段证据:\n【d1#c0】" in block["q1"]
    assert block["q3"].startswith("涉及文档:\n- d4")


def test_provenance(spark):
    entries = spark.createDataFrame(
        [("ok", ["d"], ["d#1"], [("d#1", "d", "x", False)]), ("bad", ["d"], ["e#2", "d#1"], [("d#1", "d", " ", True), ("e#2", "e", "y", None)]), ("none", None, None, None)],
        "qid string, selected array<string>, evidence_ids array<string>, chunks array<struct<evidence_id:string,doc_id:string,quoted_clause:string,missing:boolean>>",
    )
    got = collections.defaultdict(set)
    for r in P.concrete_evidence(entries).collect():
        got[r.qid].add(r.problem)
    assert got["bad"] == {"missing", "fields", "unselected", "order"} and "ok" not in got and {"selected", "chunks", "evidence_ids"} <= got["none"]
    config = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"a": "3", "c": "4"}), (3, None)], "qid int, config map<string,string>")
    assert sorted((r.qid, r.key, r.problem) for r in P.config_differences(config, {"a": "1", "b": "2"}).collect()) == [(2, "a", "changed"), (2, "b", "missing"), (2, "c", "added"), (3, "a", "missing"), (3, "b", "missing")]
    a = spark.createDataFrame([(1, ["x"]), (2, ["y", "z"]), (3, ["x"])], "qid int, picked array<string>")
    b = spark.createDataFrame([(1, ["x"]), (2, ["z", "y"]), (4, ["x"])], "qid int, picked array<string>")
    assert sorted((r.qid, r.problem) for r in P.route_differences(a, b).collect()) == [(2, "changed"), (3, "not replayed"), (4, "not logged")]
    assert one(spark, P.letters_changed, "ABD", "BC") == ["A", "C", "D"]


def test_rules_by_what_questions_have(spark):
    rows = [("收入是多少", ["financial_reports"], False), ("比例５％", ["insurance", "financial_reports"], True), ("无", [], False), (None, None, None)]
    d = spark.createDataFrame(rows, "text string, domains array<string>, several boolean")
    got = [r[0].split("\n") for r in d.select(prompts.rules(F.col("text"), F.col("domains"), F.col("several"))).collect()]
    reports, insurance = prompts.BY_DOMAIN["financial_reports"], prompts.BY_DOMAIN["insurance"]
    assert got == [[prompts.BASE, reports], [prompts.BASE, prompts.NUMBERS, reports, insurance, prompts.SEVERAL], [prompts.BASE], [prompts.BASE]]


def test_prompts(spark):
    d = spark.createDataFrame([("证据", "问", [("A", "甲"), ("B", "乙")], "research"), (None, None, None, "regulatory"), ("e", "q", [], None)], "block string, question string, options array<struct<key string, text string>>, domain string")
    asked = prompts.question_text(F.col("question"), F.col("options"))
    got = d.select(asked, prompts.prompt(F.col("block"), asked, F.lit("规则")), prompts.reasons(F.col("domain"))).collect()
    assert [r[0] for r in got] == ["问\nA. 甲\nB. 乙", "", "q\n"]
    assert got[0][1] == f"证据\n\n问\nA. 甲\nB. 乙\n\n规则\n\n{prompts.REPLY}"
    assert [r[2] for r in got] == [True, False, True]


def test_publishing_refuses_what_is_there(spark, tmp_path):
    d = spark.createDataFrame([("a", "x", "t"), ("b", "y", None)], "doc_id string, domain string, text string")
    files.publish(d, f"{tmp_path}/out")
    assert {(r.doc_id, r.domain, r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", "x", "t"), ("b", "y", None)}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.publish(d, f"{tmp_path}/out")
    with pytest.raises(ValueError, match="a"):
        files.publish(d.union(d.limit(1)), f"{tmp_path}/other")
    assert not (tmp_path / "other").exists()

"""Chunks, ranking, routing, evidence, facts, cards, answers and audits on small made tables."""

from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.operators import audit, cards, chunk, evidence, facts, index, route


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pages_leave_out_what_precedes_them(spark):
    d = spark.createDataFrame([("d", "cover\n[P1]\n" + "a" * 130 + "\n[P2]\n" + "b" * 10 + "\n[P2]\n" + "c" * 5), ("e", None), ("f", "  ")], "doc_id string, text string")
    got = chunk.chunks(d).orderBy("ord").collect()
    assert [(r.page, r.text) for r in got] == [(1, "a" * 130), (2, "b" * 10 + "\n" + "c" * 5)]


def test_clauses_cut_only_from_five_on(spark):
    text = "".join(f"\n第{n}条 " + n * 130 for n in "一二三四五")
    d = spark.createDataFrame([("five", text), ("four", text[: text.index("\n第五")])], "doc_id string, text string")
    got = {k: n for k, n in chunk.chunks(d).groupBy("doc_id").count().collect()}
    assert got == {"five": 5, "four": 1}


def test_long_lines_are_never_cut(spark):
    d = spark.createDataFrame([("d", "x" * 2000 + "\n" + "y" * 50)], "doc_id string, text string")
    assert [len(r.text) for r in chunk.chunks(d).collect()] == [2000, 50]


def test_bm25_prefers_the_unit_with_the_query(spark):
    units = spark.createDataFrame([("k", 1, "净利润 增长 12%"), ("k", 2, "营业收入 下降"), ("k", 3, None)], "index_key string, unit int, text string")
    queries = spark.createDataFrame([("q", "净利润上升12%")], "qid string, query string")
    assert index.top(index.scores(units, queries), 1).first().unit == 1


def test_coarse_small_domains_give_all(spark):
    docs = spark.createDataFrame([("s", i, i) for i in range(5)] + [("l", 100 + i, i) for i in range(40)], "domain string, unit int, pos int")
    questions = spark.createDataFrame([("a", "s"), ("b", "l"), ("c", "l")], "qid string, domain string")
    ranked = spark.createDataFrame([("b", "surface", None, 100 + i, i + 1) for i in range(20)] + [("b", "option", 0, 139, 1), ("b", "option", 0, 138, 3)], "qid string, part string, opt int, unit int, rank int")
    got = {}
    for r in route.coarse(docs, ranked, questions).orderBy("qid", "ord").collect():
        got.setdefault(r.qid, []).append(r.unit)
    assert got["a"] == [0, 1, 2, 3, 4] and got["b"] == [*range(100, 112), 139] and len(got["c"]) == 40


def test_quoted_titles_need_exactly_one_document_each(spark):
    q = spark.createDataFrame([("one", ["alpha"]), ("two", ["alpha", "common"]), ("none", ["zeta"])], "qid string, anchors array<string>")
    d = spark.createDataFrame([("x", "alpha common"), ("y", "beta common")], "doc_id string, surface string")
    assert rows(route.quoted(q, d)) == [("one", ["x"])]


def test_policies_shared_aliases_need_a_brand(spark):
    p = spark.createDataFrame([("a", 0, "", ["福"], ["甲"]), ("b", 1, "", ["福"], ["乙"]), ("c", 2, "", ["独"], ["丙"])], "doc_id string, pos int, product string, aliases array<string>, brands array<string>")
    q = spark.createDataFrame([("1", "t", "甲福怎样"), ("2", "t", "福怎样"), ("3", "t", "独怎样")], "qid string, text string, normal string")
    assert rows(route.by_policy(q, p)) == [("1", ["a"]), ("2", ["a", "b"]), ("3", ["c"])]


def test_ids_resolve_by_unique_suffix(spark):
    ids = spark.createDataFrame([("ann_01",), ("bob_01",), ("cat_7",), ("7",)], "id string")
    picks = spark.createDataFrame([("01",), ("t_7",), ("7",), ("zz",)], "value string")
    assert rows(route.resolve(picks, ids).fillna("-")) == [("01", "-"), ("7", "7"), ("t_7", "cat_7"), ("zz", "-")]


def test_budget_passes_over_what_does_not_fit(spark):
    h = spark.createDataFrame([("q", 1, 500, 9.0, False, False), ("q", 2, 900, 8.0, False, False), ("q", 3, 300, 7.0, False, False), ("q", 4, 2000, 1.0, True, False)], "qid string, unit long, n int, score double, forced boolean, contents boolean")
    r = evidence.pack(h, 3000).first()
    assert [k.unit for k in r.kept] == [4, 1, 3] and r.total == 2860


def test_coverage_evicts_unforced_hits_of_other_documents(spark):
    kept = spark.createDataFrame([("q", [(1, 10, 500, True), (2, 10, 400, False)])], "qid string, kept array<struct<unit:bigint,doc:bigint,n:int,forced:boolean>>")
    best = spark.createDataFrame([("q", 1, 10, 500, 0), ("q", 3, 11, 300, 1)], "qid string, unit long, doc long, n int, pos int")
    assert [k.unit for k in evidence.cover(kept, best, 1000).first().kept] == [1, 3]


def test_statements_carry_on_for_three_pages(spark):
    words = []
    for page in (1, 2, 3, 9):
        for i in range(8):
            y = 100.0 + 12 * i
            words += [("d", page, 10.0, y, 60.0, y + 8, "货币资金"), ("d", page, 150.0, y, 200.0, y + 8, f"{i}1,000"), ("d", page, 250.0, y, 300.0, y + 8, f"{i}2,000")]
    w = spark.createDataFrame(words, "doc string, page int, x0 double, y0 double, x1 double, y1 double, word string")
    heads = spark.createDataFrame([("d", 1, "合并 资产负债表 2024年"), ("d", 2, "x"), ("d", 3, "y"), ("d", 9, "z")], "doc string, page int, head string")
    got = facts.statements(w, heads)
    assert rows(got.groupBy("page", "continued").count()) == [(1, False, 16), (2, True, 16), (3, True, 16)]
    line = facts.lines(got.filter("page = 2 and row = 0")).first().line
    assert line == "[合并资产负债表2024(续)] 货币资金: 合并本期=01,000 合并上期=02,000 (P2)"


def test_cards_follow_clauses_over_pages(spark):
    text = "[P1]\n前言\n第一条 保险责任\n我们给付保险金。\n[P2]\n2\n续写赔偿。\n第二条\n等待期\n自生效起30天。\n自生效起30天。"
    got = cards.cards(spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string")).orderBy("id").collect()
    assert [(r.page, r.clause, r.clause_title, r.topic) for r in got] == [(1, "第一条", "保险责任", "coverage"), (2, "第一条", "保险责任", "coverage"), (2, "第二条", "等待期", "duration")]
    assert got[2].numbers == ["30天"] and got[0].id == "d:p1:0001"


def test_long_clauses_are_packed(spark):
    assert [len(x) for x in cards.packed(["甲" * 300 + "。" + "乙" * 700, "丙"])] == [301, 520, 182]


def test_answers(spark):
    df = spark.createDataFrame([("说明 答案: B\n答案：a", "mcq"), ("答案: A、C", "multi"), ("不选 A\nC D", "multi"), ("无", "multi")], "t string, f string")
    assert [r.a for r in df.select(A.parse_choice(F.col("t"), F.col("f")).alias("a")).collect()] == ["B", "AC", "CD", ""]
    calc = spark.createDataFrame([("答案: <数字>\n答案: 1.5",), ("无",)], "t string")
    assert [r.a for r in calc.select(A.parse_calc(F.col("t")).alias("a")).collect()] == ["1.5", ""]


def test_slots(spark):
    df = spark.createDataFrame([("73.186", "percent"), ("2024-05-06", "date"), ("a ＞ b>c", "ranking"), ("0.125", "number"), ("2.675", "number"), ("CA", "letter"), ("n/a", "number")], "v string, k string")
    assert [r.s for r in df.select(A.format_slot(F.col("v"), F.col("k")).alias("s")).collect()] == ["73.19%", "2024年5月6日", "a>b>c", "0.12", "2.67", "AC", "n/a"]
    cut = spark.createDataFrame([("1；2",), ("1,2",), ("约1元和2元",)], "t string")
    assert [r.s for r in cut.select(A.split_slots(F.col("t"), F.lit(2), F.lit(True)).alias("s")).collect()] == [["1", "2"], ["1", "2"], ["1", "2"]]
    kinds = spark.createDataFrame([(["number"], "净利润同比增长率为多少"), (["number"], "增长率为多少，不带单位"), (["number"], "哪一天"), (["number", "text"], "哪一天")], "k array<string>, q string")
    assert [r.s for r in kinds.select(A.refine_kinds(F.col("k"), F.col("q")).alias("s")).collect()] == [["percent"], ["number"], ["date"], ["number", "text"]]


def test_validity_and_equivalence(spark):
    v = spark.createDataFrame([("甲>乙；3%", ["ranking", "percent"], True), ("甲；3%", ["ranking", "percent"], False), ("1", ["number", "number"], False)], "a string, k array<string>, ok boolean")
    assert all(r.x == r.ok for r in v.select("ok", A.valid_calc(F.col("a"), F.col("k")).alias("x")).collect())
    e = spark.createDataFrame([("1,000", "1000.0", True), ("5%", "5", False), ("BA", "AB", True), ("2024-1-5", "2024年01月05日", True), ("x", "y", False)], "a string, b string, ok boolean")
    assert all(r.x == r.ok for r in e.select("ok", A.equivalent(F.col("a"), F.col("b")).alias("x")).collect())


def test_retries_ledgers_and_reasoning(spark):
    calls = spark.createDataFrame([("q", "r1", 1, False, "x"), ("q", "r1", 2, True, "x"), ("q", "r2", 2, True, "x"), ("q", "r3", 1, False, "x"), ("q", "r4", 1, False, "x"), ("q", "r4", 2, True, "y")], "qid string, tag string, attempt int, ok boolean, request string")
    assert [r[1:] for r in rows(audit.retries(calls))] == [("r2", 1, "attempts"), ("r3", 1, "not answered"), ("r4", 2, "requests differ")]
    t = spark.createDataFrame([("q", 1, "r1", "long", "A", ["c1"]), ("q", 2, "r2", "text", "B", ["c2"]), ("q", 3, "r3", "more", "A", [])], "qid string, ord int, stage string, content string, answer string, evidence_ids array<string>")
    assert audit.reasoning(spark.createDataFrame([("q", "A")], "qid string, final string"), t).first().stage == "r1"
    u = spark.createDataFrame([("q", 1, 3, 4, 7), ("q", 2, 3, 4, 8), ("q", 3, None, 4, 4)], "qid string, call_no int, prompt_tokens int, completion_tokens int, total_tokens int")
    assert [r[1] for r in rows(audit.usage_violations(u))] == [2, 3]


def test_policy_identities(spark):
    from corpusloom.operators import identity

    text = "[P1]\n甲乙人寿保险股份有限公司\n甲乙福星高照终身寿险（分红型）条款\n本公司指甲乙人寿保险股份有限公司（以下简称“甲乙人寿”）。\n险种简称：福星"
    df = spark.createDataFrame([("10", text), ("x", "没有名字的文本"), ("9", None)], "doc_id string, text string")
    found = identity.policies(df).collect()
    got = {r.doc_id: r for r in found}
    assert got["10"].company == "甲乙人寿保险股份有限公司" and got["10"].product == "甲乙福星高照终身寿险（分红型）条款"
    assert got["10"].alias[0] == "福星" and "福星高照" in got["10"].alias and "甲乙" in got["10"].brands
    assert rows(identity.failures(identity.policies(df))) == [("9", "company,product"), ("x", "company,product")]
    forms = identity.brand_forms(identity.policies(df)).filter("doc_id = '10'").first()
    assert "福星高照" in forms.aliases and forms.brands[0] == "甲乙人寿保险股份有限公司"


def test_policy_query_reads_whole_texts(spark, tmp_path):
    from corpusloom.plans import catalogue

    text = "plain line\n" * 1_000 + "险种简称：福星高照"
    spark.createDataFrame([(1, text, "src1")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.QUERIES["policy_identity"](spark, str(tmp_path)).collect()
    assert [r.doc_id for r in found] == ["1"] and "福星高照" in found[0].aliases.split("|")


def test_document_identities_and_company_routing(spark):
    from corpusloom.operators import identity

    docs = spark.createDataFrame(
        [("r_2023_1", "financial_reports", "年度报告", "山海科技股份有限公司 2023年\n股票简称：山海科技"), ("r2", "financial_reports", None, "山海科技股份有限公司 2024 年年度报告"), ("c", "financial_contracts", "", "标的公司、云帆\n指  云帆数据有限公司\n")],
        "doc_id string, domain string, title string, text string",
    )
    ids = identity.documents(docs)
    got = {r.doc_id: r for r in ids.collect()}
    assert got["r_2023_1"].year == "2023" and got["r2"].year == "2024" and "山海科技" in got["r2"].aliases
    assert "云帆数据" in got["c"].aliases and "标的公司" not in got["c"].aliases
    q = spark.createDataFrame([("a", "financial_reports", "山海科技2024年净利润", 4), ("b", "financial_reports", "别家公司", 4)], "qid string, domain string, text string, n_options int").withColumn("normal", identity.normal(F.col("text")))
    placed = ids.withColumn("pos", F.when(F.col("doc_id") == "r2", 2).otherwise(1))
    assert rows(route.by_company(q, placed)) == [("a", ["r2"])]


def test_model_flows(spark):
    from corpusloom.operators import flow

    q = spark.createDataFrame([("1", "multi"), ("2", "mcq"), ("3", "tf")], "qid string, answer_format string")
    said = [("1", "r1", "答案: AB"), ("1", "r2", "答案: AC"), ("1", "r3", "答案: AC"), ("2", "r1", "补充检索: 利率\n答案: A"), ("2", "r1b", "答案: B"), ("2", "r2", "答案: B"), ("3", "r1", "答案: A")]
    client = flow.replay(spark.createDataFrame(said, "qid string, tag string, content string"))
    evidence = lambda d: d.select("qid", F.coalesce("query", F.lit("")).alias("block"), F.array(F.concat("qid", F.lit("#c0"))).alias("evidence_ids"))
    final, traces = flow.choices(q, client, evidence)
    assert rows(final) == [("1", "AC"), ("2", "B"), ("3", "A")]
    assert rows(traces.select("qid", "stage")) == [("1", "r1"), ("1", "r2"), ("1", "r3"), ("2", "r1"), ("2", "r1b"), ("2", "r2"), ("3", "r1")]
    assert {r.qid: r.stage for r in audit.reasoning(final, traces).collect()} == {"1": "r3", "2": "r2", "3": "r1"}

    c = spark.createDataFrame([("1", ["number"], "x"), ("2", ["number"], "y"), ("3", ["number"], "z")], "qid string, kinds array<string>, question string")
    said = [("1", "primary", "答案: 5"), ("1", "verify", "答案: 6"), ("1", "arbitrate", "答案: 6"), ("2", "primary", "答案: 无"), ("2", "evidence_retry", "答案: 7"), ("2", "verify", "乱"), ("3", "primary", "补充检索: q\n答案: 8"), ("3", "evidence_retry", "失败"), ("3", "verify", "答案: 8")]
    final, _ = flow.calculations(c, flow.replay(spark.createDataFrame(said, "qid string, tag string, content string")), evidence)
    assert rows(final) == [("1", "6", "arbitrate", True), ("2", "7", "evidence_retry", True), ("3", "8", "primary", True)]


def test_files(spark, tmp_path):
    from corpusloom.sources import files

    (tmp_path / "regulatory/txt").mkdir(parents=True)
    (tmp_path / "regulatory/txt/b.txt").write_text("《管理办法细则》\n正文")
    (tmp_path / "regulatory/txt/a.txt").write_text("短\n这是一个标题行\n正文")
    found = files.discover(spark, str(tmp_path))
    assert [(r.domain, r.doc_id, r.kind, r.place) for r in found.orderBy("place").collect()] == [("regulatory", "a", "txt", 1), ("regulatory", "b", "txt", 2)]
    assert {r.doc_id: r.title for r in files.read_texts(spark, f"{tmp_path}/regulatory/txt").collect()} == {"a": "这是一个标题行", "b": "管理办法细则"}

    (tmp_path / "q.json").write_text('[{"qid":"1","type":"判断题","answer_format":"mcq","question":"x","options":{"A":"y"}},{"qid":"2","type":"判断题","options":{"A":"y"}},{"qid":"3","type":"多选题"}]')
    got = files.read_questions(spark, [f"{tmp_path}/q.json"])
    assert {r.qid: r.answer_format for r in got.collect()} == {"1": "mcq", "2": "tf", "3": "calc"}

    (tmp_path / "t.csv").write_text("qid,answer_1,answer_2\nsummary,,\na,12.5%,A\nb,,x\nc,,\n", encoding="utf-8-sig")
    slots = files.read_template(spark, f"{tmp_path}/t.csv")
    assert rows(slots.filter("qid = 'a'").select("slot_no", "kind")) == [(1, "percent"), (2, "letter")]
    assert rows(files.template_problems(slots)) == [("b", "gap"), ("c", "no slot")]

    (tmp_path / "l.jsonl").write_text('{"qid":"a","n":1}\n\nnot json\n{"qid":"b","n":2}\n')
    assert [(r.line, r.qid, r.bad) for r in files.read_lines(spark, f"{tmp_path}/l.jsonl", "qid string, n int").orderBy("line").collect()] == [(1, "a", False), (3, None, True), (4, "b", False)]

    for i, text in enumerate(('[{"qid":"a","x":1}]', '{"questions":[{"qid":"a"}]}', '{"a":{"x":1}}')):
        (tmp_path / f"e{i}.json").write_text(text)
        assert [r.qid for r in files.read_evidence(spark, f"{tmp_path}/e{i}.json").select("qid").collect()] == ["a"]

    results = spark.createDataFrame([("a", 0, ["1.50%", "A"], "line\nnext"), ("b", 1, ["2"], None)], "qid string, ord int, slots array<string>, reasoning string")
    ledger = spark.createDataFrame([("a", 3, 4), ("z", 1, 0)], "qid string, prompt_tokens int, completion_tokens int")
    files.write_submission(files.submission(results, ledger.filter("qid = 'a'"), 2), f"{tmp_path}/out")
    text = next((tmp_path / "out").glob("*.csv")).read_text(encoding="utf-8-sig").splitlines()
    assert text == ["qid,answer_1,answer_2,prompt_tokens,completion_tokens,total_tokens,reasoning", "summary,,,3,4,7,", "a,1.50%,A,3,4,7,line next", "b,2,,0,0,0,"]
    assert rows(files.submission_problems(results, ledger, slots.filter("qid = 'a'"))) == [("z", "usage of no question")]


def test_streamed_ledger(spark, tmp_path):
    from corpusloom.streaming import ledger

    (tmp_path / "calls").mkdir()
    (tmp_path / "calls/1.json").write_text('{"qid":"a","prompt_tokens":3,"completion_tokens":4}\n{"qid":"a","prompt_tokens":1,"completion_tokens":0}\n{"qid":"b","prompt_tokens":2,"completion_tokens":2}\n')
    stream = ledger.running_ledger(ledger.read_calls(spark, f"{tmp_path}/calls"))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("running_ledger").option("checkpointLocation", f"{tmp_path}/state").start()
    run.processAllAvailable()
    run.stop()
    assert rows(spark.table("running_ledger")) == [("a", 4, 4, 2), ("b", 2, 2, 1)]


def test_titles(spark):
    from corpusloom.operators import titles

    df = spark.createDataFrame([("a", "标题：某某公告", "x"), ("b", "目录", "第一条内容甲\n第二条内容乙\n第二条内容乙\n12"), ("c", None, None)], "i string, t string, x string")
    got = {r.i: r.o for r in df.select("i", titles.display_title(F.col("t"), F.col("x"), F.col("i")).alias("o")).collect()}
    assert got == {"a": "某某公告", "b": "第二条内容乙", "c": "c"}
    spans = spark.createDataFrame([("d", 0, 1, 9.0, "小号文字一行"), ("d", 0, 2, 20.1, "大号标题上"), ("d", 0, 3, 19.8, "大号标题下半"), ("d", 1, 4, 30.0, "第二页更大的")], "doc string, page int, ord int, size double, text string")
    assert rows(titles.by_font(spans)) == [("d", "大号标题上大号标题下半")]
    name = "福满终身寿险"
    t = spark.createDataFrame([("insurance", "x", "旧", None, f"{name}。{name}，{name}"), ("financial_reports", "r_2024", "某公司2023年报", None, ""), ("financial_contracts", "k", "旧", "某公司债券", "封面\n某公司募集说明书\n")], "d string, i string, t string, f string, x string")
    got = [r.o for r in t.select(titles.rewritten(F.col("d"), F.col("i"), F.col("t"), F.col("f"), F.col("x")).alias("o")).collect()]
    assert got == ["福满终身寿险条款", "某公司2024年年度报告", "某公司债券某公司募集说明书"]

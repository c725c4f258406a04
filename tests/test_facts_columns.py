"""Value columns of many pages."""

from corpusloom.operators import facts


def test_tasks_grow_with_pages(spark, monkeypatch):
    monkeypatch.setattr(facts, "TASK_PAGES", 2, raising=False)
    places = [(p, 100.0 * c + p % 3 + r % 2) for p in range(60) for c in range(1, 6 if p % 2 else 2) for r in range(4 if p % 2 else 20)]
    words = spark.createDataFrame([(0, p, x, "1.0") for p, x in places], "doc int, page int, x1 double, word string")
    pages = spark.createDataFrame([(0, p, "合并及公司利润表" if p % 4 == 1 else "合并利润表") for p in range(60)], "doc int, page int, title string")
    out = facts.columns(words, pages)
    assert out.rdd.getNumPartitions() >= 30
    want = [(p, i, 100.0 * c + p % 3 + 0.5) for p in range(60) if p % 2 for i, c in enumerate((2, 3, 4, 5) if p % 4 == 1 else (4, 5))]
    assert sorted((r.page, r.col, r.centre) for r in out.collect()) == want

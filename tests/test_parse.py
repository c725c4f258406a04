"""Parsing of raw files, with errors as rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files, html, parse


def test_undecodable_bytes_are_dropped(spark):
    raw = [b"plain", b"a\xffb\xc3", "é\ufffd中".encode() + b"\x80!", b"", None, b"\xe4\xb8x"]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(raw)], "i int, b binary")
    got = [r.t for r in df.orderBy("i").select(parse.decoded(F.col("b")).alias("t")).collect()]
    assert got == [b.decode("utf-8", errors="ignore") if b is not None else None for b in raw]


def test_metas(spark):
    page = "<head><META content='A &amp; B' name=\"ArticleTitle\"><meta name=ArticleTitle content=second><meta name='PubDate' content=' '><meta name=PubDate content=2024-01-02><meta property=x content=y></head><body>one<p>two</p></body>"
    df = spark.createDataFrame([(page,), ("<p>x",), (None,)], "h string")
    rows = [r.d for r in df.select(html.document(F.col("h"), F.lit("stem")).alias("d")).collect()]
    assert rows[0].title == "A & B" and rows[0].pub_date == "2024-01-02" and rows[0].column == ""
    assert rows[0].text == "标题：A & B\n栏目：\n发布日期：2024-01-02\n\none\ntwo"
    assert rows[1].text == "标题：stem\n栏目：\n发布日期：\n\nx" and rows[2].text == "标题：stem\n栏目：\n发布日期：\n\n"


def test_each_file_gives_a_row_or_an_error(spark, tmp_path):
    for name, content in (("regulatory/txt/a.txt", b"\xff\xe3\x80\x8arule of things\xe3\x80\x8b more"), ("regulatory/html/b.html", b"<meta name='ColumnName' content='news'><p>hello"), ("regulatory/html/a.html", b"again"), ("research/c.pdf", b"%PDF"), ("research/d.pdf", b"%PDF")):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)
    found = files.discover(spark, str(tmp_path))
    pages = found.filter("doc_id = 'c'").select("path", F.lit("[P1]\npage").alias("text"), F.lit("Title").alias("title"), F.lit(1).alias("n_pages"))
    rows = parse.parse(spark, found, pages)
    got = {(r.domain, r.path.rsplit("/", 1)[1]): (r.title, r.text, r.n_pages, r.error) for r in rows.collect()}
    assert got == {
        ("regulatory", "a.txt"): ("rule of things", "《rule of things》 more", None, None), ("regulatory", "b.html"): ("b", "标题：b\n栏目：news\n发布日期：\n\nhello", None, None), ("regulatory", "a.html"): (None, None, None, "duplicate id"),
        ("research", "c.pdf"): ("Title", "[P1]\npage", 1, None), ("research", "d.pdf"): (None, None, None, "no decoded pdf"),
    }
    to = str(tmp_path / "out")
    with pytest.raises(ValueError, match="2 files were not parsed: .*a.html: duplicate id; .*d.pdf: no decoded pdf"):
        parse.publish_parsed(rows, to)
    assert not (tmp_path / "out").exists()
    assert sorted(r.error for r in parse.publish_parsed(rows, to, strict=False).collect()) == ["duplicate id", "no decoded pdf"]
    assert sorted(r.doc_id for r in spark.read.parquet(to).collect()) == ["a", "b", "c"]

"""Tokenizers, normal forms and numbers on texts that the given tables don't have."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T

OPTIONS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_index_tokens_pair_over_punctuation(spark):
    assert sorted(one(spark, "净利，润Q3 12.5％", T.tokens)) == sorted(["净", "利", "润", "净利", "利润", "q3", "12.5%"])
    assert one(spark, None, T.tokens) == []


def test_card_tokens_pair_only_within_a_run(spark):
    assert one(spark, "净利，润Q3", T.card_tokens) == ["净", "利", "净利", "润", "q", "3"]


def test_query_tokens_add_years_quarters_and_synonyms(spark):
    got = one(spark, "2024年第三季度分红下降", T.query_tokens)
    assert {"24", "q3", "派", "派息", "减少", "回落"} <= set(got)
    assert len([t for t in got if t == "24"]) == 1 and "增长" not in got


@OPTIONS
@given(st.text(alphabet="ab1. %，中文x3", max_size=30))
def test_index_tokens_against_plain_python(spark, text):
    raw = re.findall(r"[A-Za-z]+[0-9]+|[0-9]+(?:\.[0-9]+)?%?|[A-Za-z]+|[一-鿿]", text.replace("，", ","))
    cjk = [bool(re.match("[一-鿿]", t)) for t in raw]
    expect = [t.lower() for t in raw] + [a + b for a, b, x, y in zip(raw, raw[1:], cjk, cjk[1:]) if x and y]
    assert sorted(one(spark, text, T.tokens)) == sorted(expect)


def test_numbers_with_units(spark):
    assert one(spark, "2024 年 3 月 1 日起 30个工作日内 12.5％ 三十天 12.5%", T.numbers_with_units) == ["2024年3月1日", "30个工作日", "12.5%", "三十天"]


def test_anchors_and_phrases(spark):
    assert one(spark, "“等待期、（宽限期）或保险”与\"现金价值\"", T.anchors) == ["待期", "宽限期", "现金价值"]
    df = spark.createDataFrame([("犹豫期内退保 abc", "在犹豫期内可以退保,abc")], "q string, t string")
    assert sorted(df.select(T.shared_phrases(F.col("q"), F.col("t")).alias("x")).first().x) == ["abc", "犹豫期内", "退保"]


def test_redaction_removes_keys_and_headers(spark):
    got = one(spark, 'Authorization: Bearer abc.def-123, api_key="xyz" and sk-12345678AB', T.redact)
    assert "abc.def" not in got and "xyz" not in got and "12345678AB" not in got and got.count("[REDACTED]") == 3


def test_page_cleaning_glues_lone_characters(spark):
    assert one(spark, "年\n度\n报\n告\nx  \n\n\n\n一\n二\n1\nend", T.clean_page) == "年度报告x\n\n一\n二\n1\nend"


def test_families(spark):
    df = spark.createDataFrame([("a", "raw/x/report_att2.pdf"), ("b_附件1", None), ("c", "")], "i string, s string")
    assert [r.f for r in df.select(T.source_family(F.col("i"), F.col("s")).alias("f")).collect()] == ["report", "b", "c"]

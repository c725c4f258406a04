"""Prompts of the answering calls: checking rules by what a question has, the question with its options, and the reply's form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wordings of this library's own.
BASE = "请只用所附材料作答，逐项核对，并注明页码；材料不够时写出要补充检索的词。"
NUMBERS = "有数值时先列出取数和算式，统一单位，最后一步才舍入。"
BY_DOMAIN = {"financial_reports": "读报表时先确认主体、期间和口径。", "insurance": "读条款时只用本合同的责任、条件和例外。"}
SEVERAL = "涉及几份材料时，每个对象都要有自己的出处。"
REPLY = "请先逐项分析，最后一行写：答案: <选项>"
# The domains whose calls go without the model's extended reasoning.
STABLE_DOMAINS = ("regulatory",)
#: A digit of any script, or a percent sign.
HAS_NUMBER = "\\p{Nd}|%|％"


def rules(text: Column, domains: Column, several: Column) -> Column:
    """The rules that apply to questions of the text ``text``, of the array of ``domains``, on ``several`` documents or not.

    Null counts as no text, no domain and one document.
    """
    has = lambda name: F.coalesce(F.array_contains(domains, name), F.lit(False))
    extra = [F.when(text.rlike(HAS_NUMBER), F.lit(NUMBERS)), *[F.when(has(name), F.lit(rule)) for name, rule in BY_DOMAIN.items()], F.when(several, F.lit(SEVERAL))]
    return F.concat_ws("\n", F.lit(BASE), *extra)


def question_text(question: Column, options: Column) -> Column:
    """The question and its options with their letters, from ``options`` an array of structs with ``key`` and ``text``; null ones are none."""
    lines = F.transform(options, lambda o: F.concat_ws(". ", o["key"], o["text"]))
    return F.concat_ws("\n", F.coalesce(question, F.lit("")), F.array_join(lines, "\n"))


def prompt(block: Column, asked: Column, rule: Column) -> Column:
    """Evidence, question, rules and the reply's form, in this order; parts that are null are left out."""
    return F.concat_ws("\n\n", block, asked, rule, F.lit(REPLY))


def reasons(domain: Column, stable: tuple[str, ...] = STABLE_DOMAINS) -> Column:
    """Whether a question's call uses extended reasoning; a null domain is none of the stable ones."""
    return ~F.coalesce(domain.isin(*stable), F.lit(False))

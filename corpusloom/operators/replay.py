"""Replay of routing: what each question's documents must be, from its inputs and the logged responses, held against what was logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import ids_in_prose
from corpusloom.operators.route import MOST_PICKED, finalize

#: Candidates up to which no model is asked.
FEW = 2


def code_applies(answer_format: Column, domain: Column, enabled: bool, calculations: bool, domains: tuple[str, ...] = ()) -> Column:
    """Whether routing by code is tried for a question: if enabled, for calculations only if they are and, where domains are given, in those."""
    calculation = F.coalesce(answer_format == "calc", F.lit(False))
    in_domain = F.coalesce(domain.isin(*domains), F.lit(False)) if domains else F.lit(True)
    return F.lit(enabled) & (~calculation | (F.lit(calculations) & in_domain))


def parsed_picks(responses: DataFrame, candidates: DataFrame, most: int = MOST_PICKED) -> DataFrame:
    """``qid, parsed``: the candidates that the first list in a response names, in its order, each once, the first ``most``.

    Takes ``qid, content`` and ``qid, unit``. A value names the candidate equal to it, else the only one that ends in it; other values name none.
    Of several responses to a question, each list's values count by their place in it, so a repeated response changes nothing.
    """
    values = responses.select("qid", F.posexplode(ids_in_prose(F.col("content"))).alias("pos", "value")).filter("value is not null")
    met = values.join(candidates.select("qid", F.col("unit").cast("string").alias("unit")), "qid").filter(F.endswith("unit", "value"))
    same = F.max(F.when(F.col("unit") == F.col("value"), F.col("unit")))
    # a question may have several responses, equal ones too: units are told apart, not rows
    only = F.when(F.min("unit") == F.max("unit"), F.min("unit"))
    named = met.groupBy("qid", "pos", "value").agg(F.coalesce(same, only).alias("unit")).filter("unit is not null")
    lists = named.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "unit"))).alias("p"))
    return lists.select("qid", F.slice(F.array_distinct(F.transform("p", lambda x: x["unit"])), 1, most).alias("parsed"))


def _first(rows: DataFrame, order: list[str], most: int, name: str) -> DataFrame:
    """``qid`` and an array of each question's first ``most`` units."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*order, "unit"))
    some = rows.withColumn("place", place).filter(F.col("place") <= most)
    return some.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "unit"))), lambda x: x["unit"]).alias(name))


def replay(questions: DataFrame, code: DataFrame, candidates: DataFrame, responses: DataFrame, documents: DataFrame, tops: DataFrame, named: DataFrame, most: int = MOST_PICKED) -> DataFrame:
    """``qid, selector, picked, calls``: how each question must have been routed, to which documents, and the model calls for it.

    Takes questions ``qid, doc_ids, several`` (doc_ids: given ones, or null); code's decisions ``qid, doc_ids``; candidates ``qid, unit, ord``;
    responses to routing calls ``qid, content``; documents ``unit, family``; the best documents ``qid, part, opt, unit`` of part ``surface`` or ``option``; and the
    documents that the question names ``qid, unit, pos``. Given documents come before code's decision, that before the candidates: FEW of them are taken
    without a call; else one response must have picked, and what it leaves out is filled up. A question without candidates has no
    documents. Units are strings.
    """
    text = lambda df: df.withColumn("unit", F.col("unit").cast("string"))
    candidates, documents, tops, named = map(text, (candidates, documents, tops, named))
    # the first few candidates are all that picking needs
    firsts = _first(candidates, ["ord"], FEW + 1, "firsts")
    parsed = parsed_picks(responses, candidates, most)
    started = firsts.join(parsed, "qid", "left").withColumn("start", F.when(F.size("parsed") > 0, F.col("parsed")).otherwise(F.slice("firsts", 1, 1)))
    families = started.select("qid", F.explode("start").alias("unit")).join(documents, "unit").select("qid", "family").distinct()
    members = candidates.join(documents, "unit").join(families, ["qid", "family"]).join(started.select("qid", "start"), "qid").filter(~F.array_contains("start", F.col("unit")))
    members = _first(members.select("qid", "unit", "ord"), ["ord"], most, "family")
    named = _first(named.join(candidates.select("qid", "unit"), ["qid", "unit"], "left_semi"), ["pos"], 2 * most, "named")
    surface = _first(tops.filter("part = 'surface'"), ["opt"], 1, "surface")
    options = tops.filter("part = 'option'").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("opt", "unit"))), lambda x: x["unit"]).alias("options"))
    rows = questions.join(code.select("qid", F.col("doc_ids").alias("code")), "qid", "left").join(started, "qid", "left")
    for more in (members, named, surface, options):
        rows = rows.join(more, "qid", "left")
    none = F.array().cast("array<string>")
    given = lambda c: F.coalesce(F.col(c).cast("array<string>"), none)
    runner_up = F.slice(F.array_except(given("firsts"), F.slice(given("start"), 1, 1)), 1, 1)
    filled = finalize(given("start"), given("firsts"), given("family"), given("named"), given("surface"), given("options"), F.lit(False), F.coalesce("several", F.lit(False)), runner_up, most)
    by_input, by_code, few = F.size(given("doc_ids")) > 0, F.col("code").isNotNull(), F.size(given("firsts")) <= FEW
    picked = F.when(by_input, given("doc_ids")).when(by_code, given("code")).when(few, given("firsts")).otherwise(filled)
    selector = F.when(by_input, "input").when(by_code, "code").otherwise("model")
    return rows.select("qid", selector.alias("selector"), picked.alias("picked"), F.when(by_input | by_code | few, 0).otherwise(1).alias("calls"))


def differences(expected: DataFrame, decisions: DataFrame, responses: DataFrame) -> DataFrame:
    """``qid, problem`` of every question whose log differs from replay(): decisions, selector, calls, picked; or a logged one that is unknown.

    Takes logged decisions ``qid, selector, picked``. A question needs one decision; of several each is compared.
    """
    logged = decisions.select("qid", F.col("selector").alias("logged"), F.col("picked").cast("array<string>").alias("logged_picked"))
    n = decisions.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    made = responses.groupBy("qid").agg(F.count(F.lit(1)).alias("made"))
    rows = expected.withColumn("known", F.lit(True)).join(logged, "qid", "full").join(n, "qid", "left").join(made, "qid", "left")
    checks = [
        ("unknown", F.col("known").isNull()),
        ("decisions", F.col("known") & (F.coalesce("n", F.lit(0)) != 1)),
        ("selector", F.col("known") & F.col("n").isNotNull() & ~F.col("selector").eqNullSafe(F.col("logged"))),
        ("calls", F.col("known") & (F.coalesce("made", F.lit(0)) != F.col("calls"))),
        ("picked", F.col("known") & F.col("n").isNotNull() & ~F.col("picked").eqNullSafe(F.col("logged_picked"))),
    ]
    problems = F.array(*[F.when(wrong, F.lit(name)) for name, wrong in checks])
    return rows.select("qid", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem")).distinct()

"""Quality rules by weak supervision, in DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns estimates each
rule's accuracy among good and bad documents, from the votes that it casts, and with them the posterior probability that a
document is good; an abstention says nothing. Patterns number at most 3 ** len(RULES) whatever the corpus holds, so a round of estimation is one small aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import BLANK, words
from corpusloom.session import Scratch

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20
ROUNDS = 12
KEEP_FROM = 0.5
#: Starting rates of bad and good votes among the votes on good and on bad documents, and the pseudo-counts that hold them there.
RATES_GOOD, RATES_BAD = (0.01, 0.99), (0.20, 0.80)
PRIOR_GOOD, PSEUDO = 0.8, 20.0


def _per(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")


RULES = ("symbols", "letters", "repeats", "lines", "word_length", "capitals", "stops", "variety")


def _rules() -> dict[str, Column]:
    """Votes from the measures; columns exist only once a session does, so they are made when asked for."""
    symbols, repeats, lines = _per("n_symbols", "n_words"), _per("n_repeat_words", "n_words"), _per("n_dup_lines", "n_lines")
    length, capitals, stops = _per("word_chars", "n_words"), _per("n_capitals", "word_chars"), _per("n_stops", "n_words")
    long = F.col("n_words") >= 20
    return {
        "symbols": _vote(symbols <= 0.02, symbols >= 0.2),
        "letters": _vote(_per("n_letters", "word_chars") >= 0.8, long & (_per("n_letters", "word_chars") < 0.65)),
        "repeats": _vote(repeats <= 0.02, repeats > 0.2),
        "lines": _vote((F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1), (F.col("n_dup_lines") >= 3) & (lines >= 0.5)),
        "word_length": _vote((length >= 3) & (length <= 10), (length < 2) | (length > 20)),
        "capitals": _vote(capitals <= 0.1, long & (capitals >= 0.5)),
        "stops": _vote(long & (stops >= 0.01) & (stops <= 0.35), long & ((stops > 0.7) | (stops < 0.002))),
        "variety": _vote(long & (_per("n_kinds", "n_words") >= 0.3), long & (_per("n_kinds", "n_words") < 0.05)),
    }


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the measures of their whole texts and the array ``votes``.

    Columns of ``docs`` that a measure would clash with are replaced. A null text has no words. Nothing is shuffled: a
    text's 5-word windows are hashed in place, and only where hashes repeat are its windows themselves sorted and compared.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_w", words(text)).withColumn("n_words", F.size("_w").cast("long"))
    with_word = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{BLANK}]"))
    d = d.withColumn("_lines", with_word)
    d = d.withColumns(
        {
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_letters": F.regexp_count(text, F.lit("\\p{L}")).cast("long"),
            "n_capitals": F.regexp_count(text, F.lit("\\p{Lu}")).cast("long"),
            "n_stops": F.regexp_count(text, F.lit("[.!?]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_kinds": F.size(F.array_distinct("_w")).cast("long"),
        }
    )
    starts = F.slice("_w", 1, F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0)))
    at = lambda i, k: F.get(F.col("_w"), i + k)
    d = d.withColumn("_h", F.transform(starts, lambda w, i: F.xxhash64(w, *[at(i, k) for k in range(1, WINDOW)])))
    windows = F.transform(starts, lambda w, i: F.struct(F.concat_ws(" ", w, *[at(i, k) for k in range(1, WINDOW)]).alias("s"), i.alias("i")))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(windows)))
    same = lambda x, k: x["s"] == F.get(F.col("_s"), k)["s"]
    found = F.transform("_s", lambda x, k: F.when(F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)), x["i"]))
    d = d.withColumn("_p", F.array_sort(F.filter(found, lambda i: i.isNotNull())))
    # each found window covers its words up to the next one's start
    new = F.transform("_p", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), k + 1) - i, F.lit(WINDOW))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words")))
    return d.withColumn("votes", F.array(*_rules().values())).drop("_w", "_lines", "_h", "_s", "_p")


def good_probability(model: tuple[float, list, list]) -> Column:
    """Posterior probability of a good document, from the column ``votes``."""
    prior, good, bad = model
    odds = F.lit(math.log(prior / (1 - prior)))
    for j, (g, b) in enumerate(zip(good, bad, strict=True)):
        against, for_it = (F.lit(math.log(x / y)) for x, y in zip(g, b, strict=True))
        vote = F.get(F.col("votes"), j)
        odds = odds + F.when(vote < 0, against).when(vote > 0, for_it).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def estimate(votes: DataFrame, rounds: int = ROUNDS) -> tuple[float, list, list]:
    """Prior and each rule's vote rates among good and bad documents, by expectation-maximisation.

    Takes columns ``votes`` and ``base_failed`` of a written table; what fails the base test is decided without the rules, and would teach them
    only that test. An empty table leaves the starting rates.
    """
    n = len(RULES)
    patterns = Scratch(votes.sparkSession, "votes").keep(votes.filter("not base_failed").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    model = (PRIOR_GOOD, [RATES_GOOD] * n, [RATES_BAD] * n)
    for _ in range(rounds):
        weighted = patterns.select("votes", "n", (F.col("n") * good_probability(model)).alias("g"))
        sums = [F.sum("n").alias("n"), F.sum("g").alias("g")]
        for j in range(n):
            for v in (-1, 1):
                here = F.get(F.col("votes"), j) == v
                sums += [F.sum(F.when(here, F.col("n")).otherwise(0)).alias(f"n{j}_{v}"), F.sum(F.when(here, F.col("g")).otherwise(0.0)).alias(f"g{j}_{v}")]
        r = weighted.agg(*sums).first()
        total, g = r["n"] or 0, r["g"] or 0.0
        rate = lambda x, whole, start: (x + PSEUDO * start) / (whole + PSEUDO)
        rates = lambda down, up, start: (rate(down, down + up, start[0]), rate(up, down + up, start[1]))
        model = (
            rate(g, total, PRIOR_GOOD),
            [rates(r[f"g{j}_-1"] or 0.0, r[f"g{j}_1"] or 0.0, RATES_GOOD) for j in range(n)],
            [rates((r[f"n{j}_-1"] or 0) - (r[f"g{j}_-1"] or 0.0), (r[f"n{j}_1"] or 0) - (r[f"g{j}_1"] or 0.0), RATES_BAD) for j in range(n)],
        )
    return model


def judged(rows: DataFrame, model: tuple[float, list, list]) -> DataFrame:
    """``rows`` of measured() with ``good_probability`` and ``kept``: no base failure, and good at least as likely as not."""
    out = rows.withColumn("good_probability", good_probability(model))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("good_probability") >= KEEP_FROM))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the measures, votes, ``base_failed``, ``good_probability`` and ``kept``.

    A null or empty text has no words and fails the base test. Repeated rows are judged alike. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    rows = Scratch(docs.sparkSession, "quality").keep(measured(rows, "_text").drop("_text"), "measures")
    return judged(rows, estimate(rows))


def good_documents(docs: DataFrame) -> DataFrame:
    """The kept documents, with the columns of ``docs``, of any name.

    Null and blank texts fail the base test and go. Ids don't matter: repeated rows, and rows with null or shared ids, are each judged by
    their own text. An empty table gives an empty table.

    Documents are written with their votes once, and read again to be judged: no text is measured twice or shuffled, and
    the test for ``kept`` meets plain columns, not the measures' expressions.
    """
    rows = measured(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text")), "_text")
    rows = Scratch(docs.sparkSession, "quality").keep(rows.select("_doc", "votes", "base_failed"), "documents")
    return judged(rows, estimate(rows)).filter("kept").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])

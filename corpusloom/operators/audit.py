"""Audit operators: ledgers, coverage, retries, manifests and provenance, as joins that report every violation at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger(calls: DataFrame) -> DataFrame:
    """``qid, prompt_tokens, completion_tokens, total_tokens, n_calls`` by question."""
    p, c = F.sum("prompt_tokens"), F.sum("completion_tokens")
    return calls.groupBy("qid").agg(p.alias("prompt_tokens"), c.alias("completion_tokens"), (p + c).alias("total_tokens"), F.count(F.lit(1)).alias("n_calls"))


def submission(calls: DataFrame) -> DataFrame:
    """The ledger with its grand total, whose qid is ``summary`` and place 0."""
    rolled = calls.rollup("qid").agg(F.grouping_id().alias("g"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    summary = F.col("g") == 1
    return rolled.select(F.when(summary, "summary").otherwise(F.col("qid").cast("string")).alias("qid"), F.when(summary, 0).otherwise(1).alias("place"), "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))


def valid_usage(prompt: Column, completion: Column, total: Column) -> Column:
    """Whether all three counts are there, none negative, and the total is their sum."""
    return F.coalesce((prompt >= 0) & (completion >= 0) & (total == prompt + completion), F.lit(False))


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``key, problem``: keys that are missing from ``found`` or not expected there."""
    missing = expected.select(key).distinct().join(found, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return missing.unionByName(found.select(key).distinct().join(expected, key, "left_anti").select(key, F.lit("unexpected").alias("problem")))


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with ``surplus``: how much more often ``a`` has them, negative if ``b`` does.

    Counts are taken before anything is compared, so a row that is repeated a million times is one row of the exchange.
    """
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_n")).unionByName(b.select(*cols, F.lit(-1).alias("_n")))
    return both.groupBy(*cols).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")


def reconcile(sides: dict[str, DataFrame]) -> DataFrame:
    """``qid`` and each side's total where totals of the named sides ``(qid, total)`` differ or are missing."""
    every = None
    for name, df in sides.items():
        part = df.groupBy("qid").agg(F.sum("total").alias("total")).withColumn("side", F.lit(name))
        every = part if every is None else every.unionByName(part)
    wide = every.groupBy("qid").agg(*[F.max(F.when(F.col("side") == n, F.col("total"))).alias(n) for n in sides])
    first, *others = sides
    differs = F.lit(False)
    for n in others:
        differs = differs | ~F.col(first).eqNullSafe(F.col(n))
    return wide.filter(differs)


def retries(calls: DataFrame) -> DataFrame:
    """``qid, tag, n, problem`` of call sequences that are no attempts 1 to n of one request, all failed but the last.

    Takes ``qid, tag, attempt, ok, request``. Only sums leave a group, so a long sequence is never gathered.
    """
    last = F.max(F.struct("attempt", "ok"))["ok"]
    g = calls.groupBy("qid", "tag").agg(
        F.count(F.lit(1)).alias("n"), F.max("attempt").alias("most"), F.min("attempt").alias("least"), F.countDistinct("attempt").alias("kinds"), F.count_if("ok").alias("oks"), last.alias("last_ok"), (F.min("request") != F.max("request")).alias("mixed")
    )
    problem = (
        F.when((F.col("least") != 1) | (F.col("most") != F.col("n")) | (F.col("kinds") != F.col("n")), "attempts")
        .when(~F.col("last_ok"), "not answered")
        .when(F.col("oks") > 1, "answered twice")
        .when(F.col("mixed"), "requests differ")
    )
    return g.select("qid", "tag", "n", problem.alias("problem")).filter("problem is not null")


def fingerprint(content: Column) -> tuple[Column, Column]:
    return F.length(content).cast("long"), F.sha2(content, 256)


def manifest(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, bytes, sha256`` of files."""
    size, digest = fingerprint(F.col(content).cast("binary"))
    return files.select(F.col(path).alias("path"), size.alias("bytes"), digest.alias("sha256"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, problem``: what is missing, added or changed in ``new``."""
    a = old.select("path", F.struct("bytes", "sha256").alias("a"))
    b = new.select("path", F.struct("bytes", "sha256").alias("b"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full_outer").select("path", problem.alias("problem")).filter("problem is not null")


def tree_hash(entries: DataFrame, by: str, digits: int = 2) -> DataFrame:
    """``by, n, tree_sha256``: a digest of each group's paths and file digests.

    Takes a manifest. A group's files are dealt to blocks by the first ``digits`` digits of their paths' MD5; a block's digest is that of its lines,
    80 bytes a file or so, in the order of the paths, and the group's that of its blocks' digests in their order. So no task holds a group's
    lines: two digits are right for some million files a group, each more for 16 times as many.
    """
    block = F.substring(F.md5(F.col("path").cast("binary")), 1, digits).alias("block")
    line = F.concat("path", F.lit("\u0000"), "sha256", F.lit("\n"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"]), "")
    blocks = entries.groupBy(by, block).agg(F.count(F.lit(1)).alias("n"), F.sha2(joined(F.struct("path", line.alias("line"))).cast("binary"), 256).alias("digest"))
    return blocks.groupBy(by).agg(F.sum("n").alias("n"), F.sha2(joined(F.struct("block", F.col("digest").alias("line"))).cast("binary"), 256).alias("tree_sha256"))


def assembled(answers: DataFrame, parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Answers with a list column for each named part ``(rows with qid, order column)``, in order; a question without rows gets an empty one."""
    out = answers
    for name, (rows, order) in parts.items():
        cols = [c for c in rows.columns if c != "qid"]
        row = F.struct(F.col(order).alias("_o"), F.struct(*cols).alias("r"))
        lists = rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias(name))
        kind = lists.schema[name].dataType.simpleString()
        out = out.join(lists, "qid", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def cited(traces: DataFrame, chunks: DataFrame) -> DataFrame:
    """``qid, ord, chunk_id, missing`` for each chunk that a trace cites."""
    ids = traces.select("qid", F.posexplode("evidence_ids").alias("ord", "chunk_id"))
    return ids.join(chunks.select("chunk_id", F.lit(True).alias("there")).distinct(), "chunk_id", "left").select("qid", "ord", "chunk_id", F.col("there").isNull().alias("missing"))


def reasoning(finals: DataFrame, traces: DataFrame) -> DataFrame:
    """``qid, stage, content, evidence_ids``: each question's last trace that has its final answer, content and evidence.

    Takes ``qid, final`` and ``qid, ord, stage, content, answer, evidence_ids``. A question without one is left out.
    """
    fits = traces.join(finals, "qid").filter((F.col("answer") == F.col("final")) & (F.trim("content") != "") & (F.size("evidence_ids") > 0))
    last = fits.groupBy("qid").agg(F.max_by(F.struct("stage", "content", "evidence_ids"), "ord").alias("t"))
    return last.select("qid", "t.stage", "t.content", "t.evidence_ids")


def embedded_mismatch(embedded: DataFrame, source: DataFrame) -> DataFrame:
    """``line, problem``: embedded records ``(line, record)`` that are ``changed``, ``repeated`` or ``not in the source``, and source records that are ``not embedded``."""
    there = source.select("line", F.col("record").alias("there"), F.lit(True).alias("known"))
    both = embedded.withColumn("had", F.lit(True)).join(there, "line", "full")
    problem = F.when(F.col("known").isNull(), "not in the source").when(F.col("had").isNull(), "not embedded").when(~F.col("record").eqNullSafe(F.col("there")), "changed")
    again = embedded.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("line", F.lit("repeated").alias("problem"))
    return both.select("line", problem.alias("problem")).filter("problem is not null").distinct().unionByName(again)


def card_stats(cards: DataFrame) -> DataFrame:
    """``topic, n, longest, mean_chars, with_numbers`` of cards ``topic, verbatim, numbers``."""
    n = F.length("verbatim")
    return cards.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 1).alias("mean_chars"), F.count_if(F.size("numbers") > 0).alias("with_numbers"))


def usage_violations(calls: DataFrame) -> DataFrame:
    """``qid, call_no, problem``: calls whose usage is incomplete or doesn't add up."""
    return calls.filter(~valid_usage(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("total_tokens"))).select("qid", "call_no", F.lit("usage").alias("problem"))


def unknown_tags(calls: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    return calls.filter(~F.col("tag").isin(*allowed) | F.col("tag").isNull()).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def sequence_numbers(rows: DataFrame, by: list[str], order: list[str], name: str = "seq") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

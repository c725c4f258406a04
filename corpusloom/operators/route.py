"""Routing of questions to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import ids_in_prose, wants_several_documents
from corpusloom.operators.contain import occurrences
from corpusloom.session import Scratch

MOST_BY_COMPANY, MOST_BY_POLICY, MOST_PICKED = 8, 10, 4


def first_seen(candidates: DataFrame) -> DataFrame:
    """``qid, unit, ord`` from ``qid, unit, pos``: each unit once, in the order in which it first came."""
    once = candidates.groupBy("qid", "unit").agg(F.min("pos").alias("pos"))
    return once.select("qid", "unit", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "unit")).alias("ord"))


def coarse(docs: DataFrame, ranked: DataFrame, questions: DataFrame, k: int = 12) -> DataFrame:
    """Candidates ``qid, unit, ord`` of each question.

    Takes documents ``domain, unit, pos``; ``ranked`` hits ``qid, part, opt, unit, rank`` with part ``surface``, ``question`` or
    ``option``; and questions ``qid, domain``. A domain of at most max(12, 2k) documents gives them all. Else the first k of the
    whole surface, then the question's first max(2, k // 3), then each option's first max(1, k // 6), each document once;
    a question without any gets its whole domain.
    """
    sizes = docs.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.filter(F.col("n") <= max(12, 2 * k)).select("domain")
    limit = F.when(F.col("part") == "surface", k).when(F.col("part") == "question", max(2, k // 3)).otherwise(max(1, k // 6))
    order = F.when(F.col("part") == "surface", 0).when(F.col("part") == "question", 1).otherwise(2 + F.coalesce("opt", F.lit(0)))
    large = questions.join(small, "domain", "left_anti")
    hits = ranked.filter(F.col("rank") <= limit).join(large.select("qid"), "qid", "left_semi")
    hits = hits.select("qid", "unit", F.struct(order.alias("a"), F.col("rank").cast("long").alias("b")).alias("pos"))
    whole = questions.join(small, "domain", "left_semi").unionByName(large.join(hits.select("qid").distinct(), "qid", "left_anti"))
    every = whole.join(docs, "domain").select("qid", "unit", F.struct(F.lit(0).alias("a"), F.col("pos").cast("long").alias("b")).alias("pos"))
    return first_seen(hits.unionByName(every))


def quoted(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """``qid, doc_ids`` for questions whose ``anchors`` each occur in exactly one document's ``surface``.

    A question with an anchor in no document or in several is left out.
    """
    anchors = questions.select("qid", F.posexplode("anchors").alias("pos", "anchor"))
    by_anchor = occurrences(docs, anchors, "doc_id", "surface", "anchor").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    every = anchors.join(by_anchor, "anchor", "left")
    picked = every.groupBy("qid").agg(F.bool_and(F.coalesce(F.col("n") == 1, F.lit(False))).alias("clear"), F.array_sort(F.collect_list(F.struct("pos", "doc_id"))).alias("d"))
    return picked.filter("clear").select("qid", F.array_distinct(F.transform("d", lambda x: x["doc_id"])).alias("doc_ids"))


def unique_owners(names: DataFrame, owner: str) -> DataFrame:
    """``alias, owner`` of aliases that one owner alone has."""
    return names.groupBy("alias").agg(F.countDistinct(owner).alias("n"), F.min(owner).alias("owner")).filter("n = 1").select("alias", "owner")


def named_companies(questions: DataFrame, identities: DataFrame) -> DataFrame:
    """``qid, domain, company_key, alias``: the companies that a question names, with the longest of their aliases in it, ties to the first by letters.

    Takes questions ``qid, domain, normal`` and identities ``domain, company_key, aliases``.
    """
    return _longest(_aliases_met(questions, identities), _aliases(identities))


def _aliases(identities: DataFrame) -> DataFrame:
    return identities.select("domain", "company_key", F.explode("aliases").alias("alias")).distinct()


def _aliases_met(questions: DataFrame, identities: DataFrame) -> DataFrame:
    """``qid, domain, alias``: the aliases in a question, of whichever companies."""
    met = occurrences(questions.select("qid", "normal"), _aliases(identities), "qid", "normal", "alias").distinct()
    return met.join(questions.select("qid", "domain"), "qid")


def _longest(met: DataFrame, aliases: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.length("alias")).alias("minus"), "alias"))["alias"]
    return met.join(aliases, ["domain", "alias"]).groupBy("qid", "domain", "company_key").agg(best.alias("alias"))


def _too_wide(met: DataFrame, identities: DataFrame, most: int) -> DataFrame:
    """``qid`` of questions with an alias of more than ``most`` companies that have documents of their own, and so with more documents than that.

    Whatever years are asked for, a company gives a document. Only companies none of whose documents is another's are counted, so no document is
    counted twice.
    """
    held = identities.filter("company_key is not null and domain is not null").select("domain", "company_key", "doc_id").distinct()
    several = held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("other", F.col("n") > 1)
    own = held.join(several, held["doc_id"].eqNullSafe(several["doc_id"])).groupBy("domain", "company_key").agg(F.max("other").alias("other")).filter(~F.col("other"))
    wide = _aliases(identities).join(own, ["domain", "company_key"]).groupBy("domain", "alias").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return met.join(wide, ["domain", "alias"], "left_semi").select("qid").distinct()


def _few(found: DataFrame, most: int) -> DataFrame:
    """``qid, doc_ids`` in the order of ``pos`` from ``qid, doc_id, pos``, of questions with ``most`` documents or fewer; more are counted but not gathered."""
    found = found.groupBy("qid", "doc_id").agg(F.min("pos").alias("pos"))
    few = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
    gathered = found.join(few.select("qid"), "qid").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))).alias("d"))
    return gathered.select("qid", F.transform("d", lambda x: x["doc_id"]).alias("doc_ids"))


def by_company(questions: DataFrame, identities: DataFrame, years: tuple[str, ...] = ("financial_reports",)) -> DataFrame:
    """``qid, doc_ids`` by the companies that a question names.

    Takes questions ``qid, domain, text, normal, n_options`` (normal: the normal form of the text) and identities ``doc_id, pos,
    domain, company_key, aliases, year``. A company matches if one of its aliases occurs; several need options or wording that asks
    for several sources. In the domains of ``years``, a company's documents are narrowed to the years named, if it has any of them. No
    document, more than MOST_BY_COMPANY, or one where several are asked for: no decision.
    """
    several = wants_several_documents(F.col("text"))
    scratch = Scratch(questions.sparkSession, "companies")
    met = scratch.keep(_aliases_met(questions, identities), "met")
    # no question meets all companies of a common alias: such questions have no decision, and of the others' aliases few companies are owners
    met = met.join(_too_wide(met, identities, MOST_BY_COMPANY), "qid", "left_anti")
    named = scratch.keep(_longest(met, _aliases(identities)), "named")
    groups = named.groupBy("qid").agg(F.count(F.lit(1)).alias("groups"))
    q = questions.join(groups, "qid").select("qid", several.alias("several"), F.regexp_extract_all("text", F.lit("20\\d{2}"), F.lit(0)).alias("asked"), "groups", "n_options")
    q = q.filter((F.col("n_options") > 0) | F.col("several") | (F.col("groups") == 1))
    docs = named.join(identities.select("domain", "company_key", "doc_id", "pos", "year"), ["domain", "company_key"]).join(q.select("qid", "asked"), "qid")
    docs = docs.withColumn("in_year", F.col("domain").isin(*years) & F.coalesce(F.array_contains("asked", F.col("year")), F.lit(False)))
    dated = docs.groupBy("qid", "company_key").agg(F.max("in_year").alias("dated"))
    docs = docs.join(dated, ["qid", "company_key"]).filter(F.col("in_year") | ~F.col("dated"))
    out = _few(docs.select("qid", "doc_id", "pos"), MOST_BY_COMPANY).join(q.select("qid", "several"), "qid")
    return out.filter(~(F.col("several") & (F.size("doc_ids") < 2))).select("qid", "doc_ids")


def by_policy(questions: DataFrame, policies: DataFrame) -> DataFrame:
    """``qid, doc_ids`` by the policies that a question names.

    Takes questions ``qid, text, normal`` and policies ``doc_id, pos, product, aliases, brands`` in normal form. A policy
    matches by its product; else by an alias that stands behind one of its brands; else by an alias that it alone has; else by a
    shared alias of which no owner's brand stands before it. No policy, more than MOST_BY_POLICY, or one where several are asked
    for: no decision.
    """
    alias = policies.select("doc_id", F.explode("aliases").alias("alias")).distinct()
    owners = alias.groupBy("alias").agg(F.count(F.lit(1)).alias("owners"), F.count("doc_id").alias("known"))
    branded = policies.select("doc_id", F.explode("aliases").alias("alias"), "brands").select("doc_id", "alias", F.explode("brands").alias("brand")).select("doc_id", "alias", F.concat("brand", "alias").alias("name")).distinct()
    product = policies.select("doc_id", F.col("product").alias("name"))
    names = alias.select(F.col("alias").alias("name")).unionByName(branded.select("name")).unionByName(product.select("name"))
    scratch = Scratch(questions.sparkSession, "policies")
    met = scratch.keep(occurrences(questions, names, "qid", "normal", "name").distinct(), "met")
    bare = met.withColumnRenamed("name", "alias").join(owners, "alias")
    # an alias that one of its owners' brands stands before is not bare
    claimed = met.join(branded.select("name", "alias").distinct(), "name").select("qid", "alias", F.lit(True).alias("claimed")).distinct()
    bare = bare.join(claimed, ["qid", "alias"], "left").filter((F.col("owners") == 1) | F.col("claimed").isNull())
    # names of more documents than are decided on meet none of them: their questions are left out first
    wide = branded.select("name", "doc_id").unionByName(product.select("name", "doc_id")).groupBy("name").agg(F.countDistinct("doc_id").alias("n")).filter(F.col("n") > MOST_BY_POLICY)
    over = met.join(wide, "name", "left_semi").select("qid").unionByName(bare.filter(F.col("known") > MOST_BY_POLICY).select("qid")).distinct()
    over = scratch.keep(over, "over")
    met, bare = (df.join(over, "qid", "left_anti") for df in (met, bare))
    by_brand = met.join(branded, "name")
    bare = bare.join(alias, "alias")
    found = by_brand.select("qid", "doc_id").unionByName(bare.select("qid", "doc_id")).unionByName(met.join(product, "name").select("qid", "doc_id")).distinct()
    out = _few(found.join(policies.select("doc_id", "pos"), "doc_id"), MOST_BY_POLICY)
    out = out.join(questions.select("qid", wants_several_documents(F.col("text")).alias("several")), "qid")
    return out.filter(~(F.col("several") & (F.size("doc_ids") < 2))).select("qid", "doc_ids")


def append_named(questions: DataFrame, selected: DataFrame, names: DataFrame, candidates: DataFrame | None = None, most: int = MOST_PICKED) -> DataFrame:
    """``qid, doc_id, ord`` of the documents that a question's raw text names, added behind its selected ones while there is room.

    Takes questions ``qid, domain, text``, selected ``qid, doc_id``, names ``doc_id, domain, pos, name`` and, where candidates are fewer than
    the domain, ``qid, doc_id``. A name needs two characters; documents come in the order of ``pos``; those selected already are not added again.
    """
    names = names.filter(F.length("name") >= 2)
    met = occurrences(questions, names, "qid", "text", "name").distinct().join(questions.select("qid", "domain"), "qid")
    found = met.join(names, ["domain", "name"]).groupBy("qid", "doc_id").agg(F.min("pos").alias("pos")).join(selected, ["qid", "doc_id"], "left_anti")
    if candidates is not None:
        found = found.join(candidates, ["qid", "doc_id"], "left_semi")
    taken = selected.distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("taken"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("pos", "doc_id"))
    out = found.withColumn("place", place).filter(F.col("place") <= most).join(taken, "qid", "left")
    ord_ = F.col("place") + F.coalesce("taken", F.lit(0))
    return out.filter(ord_ <= most).select("qid", "doc_id", ord_.cast("int").alias("ord"))


def resolve(picks: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ``picked``: the id equal to ``value``, else the only id that ends in it.

    Ids meet values by equality of suffixes of the values' lengths, so no id is compared with every value.
    """
    lengths = picks.select(F.length("value").alias("len")).distinct()
    ends = ids.join(F.broadcast(lengths), F.length("id") >= F.col("len")).select("id", F.expr("right(id, len)").alias("suffix"))
    ends = ends.join(picks.select(F.col("value").alias("suffix")).distinct(), "suffix", "left_semi").groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"), F.max(F.when(F.col("id") == F.col("suffix"), F.col("id"))).alias("same"))
    picked = F.coalesce("same", F.when(F.col("n") == 1, F.col("only")))
    return picks.join(ends, F.col("value") == F.col("suffix"), "left").withColumn("picked", picked).drop("suffix", "n", "only", "same")


def finalize(parsed: Column, candidates: Column, family: Column, identity: Column, surface_top: Column, option_tops: Column, single: Column, several: Column, runner_up: Column, most: int = MOST_PICKED) -> Column:
    """The picked ids of a question, from arrays in their order of precedence.

    Parsed ids come first, else the first candidate; then family members, identity matches, the surface's best document and up
    to two options' bests; then the runner-up if one document is all there is and several are asked for. Each once, the first ``most``.
    """
    none = F.array().cast("array<string>")
    start = F.when(F.size(parsed) > 0, F.slice(F.array_distinct(parsed), 1, most)).otherwise(F.slice(candidates, 1, 1))
    more = F.concat(start, family, identity, surface_top)
    added = F.slice(F.array_except(option_tops, more), 1, 2)
    picked = F.slice(F.array_distinct(F.concat(more, added)), 1, most)
    return F.when((F.size(picked) == 1) & several & ~single, F.slice(F.array_distinct(F.concat(picked, F.coalesce(runner_up, none))), 1, most)).otherwise(picked)


def expand(ranked: DataFrame, current: DataFrame) -> DataFrame:
    """``qid, unit``: the best document outside a question's own whose score is over 1.5 times the best of its own, 0 if it has none.

    Takes ``qid, unit, score`` of the follow-up query over the domain and the current ``qid, unit``.
    """
    own = current.select("qid", "unit").distinct().withColumn("own", F.lit(True))
    marked = ranked.join(own, ["qid", "unit"], "left")
    best = marked.groupBy("qid").agg(F.coalesce(F.max(F.when(F.col("own"), F.col("score"))), F.lit(0.0)).alias("mine"), F.max(F.when(F.col("own").isNull(), F.struct("score", (-F.hash("unit")).alias("_"), "unit"))).alias("other"))
    return best.filter((F.col("other.score") > 1.5 * F.col("mine")) & (F.col("other.score") > 0)).select("qid", F.col("other.unit").alias("unit"))

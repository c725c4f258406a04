"""Retrieval queries: tokens, index statistics, BM25, document routing and evidence over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunk, evidence, index, route
from corpusloom.plans.catalogue import register
from corpusloom.session import Scratch, ship, spread, table

#: DuckDB's spelling of the index tokenizer for texts without CJK characters, and of token weights.
TOKENS = "list_transform(regexp_extract_all(replace(replace(text, '％', '%'), '，', ','), '[A-Za-z]+[0-9]+|[0-9]+(?:\\.[0-9]+)?%?|[A-Za-z]+|[一-鿿]'), lambda x: lower(x))"
YEARS = "list_transform(regexp_extract_all(' ' || replace(q, ' ', '  ') || ' ', '[^0-9](20[0-9][0-9])[^0-9]', 1), lambda y: y[3:4])"
POSTINGS = f"""
tokened AS (SELECT doc_id, lang, {TOKENS} AS toks FROM documents),
tf AS (SELECT doc_id, lang, tok, count(*) AS tf FROM (SELECT doc_id, lang, unnest(toks) AS tok FROM tokened) GROUP BY ALL),
dl AS (SELECT doc_id, lang, len(toks) AS dl FROM tokened)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _units(docs: DataFrame, key=None, part: str | None = None) -> DataFrame:
    return docs.select((F.lit("all") if key is None else F.col(key)).alias("index_key"), F.col("doc_id").alias("unit"), "text", *([part] if part else []))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@register(f"WITH {POSTINGS} SELECT doc_id, dl::BIGINT AS n_tokens, len(list_distinct(toks))::BIGINT AS n_kinds FROM tokened JOIN dl USING (doc_id, lang)")
def tok_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(_documents(spark, sf_dir)).select("doc_id", T.tokens(F.col("text")).alias("toks"))
    return rows.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.size(F.array_distinct("toks")).cast("long").alias("n_kinds"))


@register(f"WITH {POSTINGS} SELECT tok, count(*)::BIGINT AS df, sum(tf)::BIGINT AS n FROM tf GROUP BY tok")
def tok_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = index.postings(_units(_documents(spark, sf_dir)))
    return p.groupBy("tok").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


@register(f"WITH {POSTINGS} SELECT lang AS index_key, count(*)::BIGINT AS n, round(coalesce(nullif(sum(dl), 0) / count(*), 1.0), 6) AS avgdl FROM dl GROUP BY lang")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.unit_stats(spread(_units(_documents(spark, sf_dir), "lang"))).select("index_key", "n", F.round("avgdl", 6).alias("avgdl"))


def bm25_sql(key: str, last: str, query: str = "text") -> str:
    return f"""
WITH {POSTINGS},
keyed AS (SELECT {key} AS index_key, doc_id AS unit, tok, tf, dl FROM tf JOIN dl USING (doc_id, lang)),
stats AS (SELECT {key} AS index_key, count(*) AS n, coalesce(nullif(sum(dl), 0) / count(*), 1.0) AS avgdl FROM dl GROUP BY 1),
q AS (SELECT item_id AS qid, {query} AS q FROM benchmark),
own AS (SELECT qid, {TOKENS.replace("(text", "(q")} AS toks, {YEARS} AS years FROM q),
terms AS (SELECT qid, tok, count(*) AS qtf FROM (SELECT qid, unnest(list_concat(toks, list_filter(list_distinct(years), lambda y: NOT list_contains(toks, y)))) AS tok FROM own) GROUP BY ALL),
df AS (SELECT index_key, tok, count(*) AS df FROM keyed GROUP BY ALL),
scored AS (
  SELECT qid, index_key, unit, round(sum(qtf * CASE WHEN regexp_matches(tok, '^[0-9]|%$') THEN 2.2 ELSE 1.0 END * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM keyed JOIN terms USING (tok) JOIN df USING (index_key, tok) JOIN stats USING (index_key) GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, index_key ORDER BY score DESC, unit) AS rank FROM scored)
{last}"""


@register(bm25_sql("'all'", "SELECT qid AS item_id, unit AS doc_id, score, rank::INT AS rank FROM ranked WHERE rank <= 5 AND score > 0"))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = index.scores(_units(_documents(spark, sf_dir)), _queries(spark, sf_dir), most=5)
    return index.top(scored, 5).select(F.col("qid").alias("item_id"), F.col("unit").alias("doc_id"), "score", "rank")


@register(bm25_sql("lang", "SELECT qid AS item_id, index_key AS lang, unit AS doc_id, score, rank::INT AS rank FROM ranked WHERE rank <= 3 AND score > 0"))
def bm25_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = index.scores(_units(_documents(spark, sf_dir), "lang"), _queries(spark, sf_dir), most=3)
    return index.top(scored, 3).select(F.col("qid").alias("item_id"), F.col("index_key").alias("lang"), F.col("unit").alias("doc_id"), "score", "rank")


@register(
    bm25_sql(
        "lang",
        """, best AS (SELECT *, round(score / max(score) OVER (PARTITION BY qid, index_key), 6) AS norm FROM ranked WHERE rank <= 3 AND score > 0)
SELECT qid AS item_id, index_key AS lang, unit AS doc_id, norm, row_number() OVER (PARTITION BY qid ORDER BY norm DESC, index_key, rank)::INT AS place FROM best""",
    )
)
def bm25_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = index.scores(_units(_documents(spark, sf_dir), "lang"), _queries(spark, sf_dir), most=3)
    return index.search_documents(scored, 3).select(F.col("qid").alias("item_id"), F.col("index_key").alias("lang"), F.col("unit").alias("doc_id"), "norm", "place")


@register(
    f"""WITH q AS (SELECT item_id, text AS q FROM benchmark), own AS (SELECT item_id, {TOKENS.replace("(text", "(q")} AS toks, {YEARS} AS years FROM q)
SELECT item_id, len(toks)::BIGINT AS n_own, len(list_filter(list_distinct(years), lambda y: NOT list_contains(toks, y)))::BIGINT AS n_added FROM own"""
)
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    n = F.size(T.tokens(F.col("text")))
    return items.select("item_id", n.cast("long").alias("n_own"), (F.size(T.query_tokens(F.col("text"))) - n).cast("long").alias("n_added"))


@register(
    """SELECT doc_id, len(runs)::BIGINT AS n_tokens, md5(array_to_string(runs, ' ')) AS tokens_md5
FROM (SELECT doc_id, list_transform(regexp_extract_all(replace(text, '％', '%'), '[0-9]+(?:\\.[0-9]+)?%?|[A-Za-z]+|[一-鿿]+'), lambda x: lower(x)) AS runs FROM documents)"""
)
def bigrams_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(_documents(spark, sf_dir)).select("doc_id", T.card_tokens(F.col("text")).alias("toks"))
    return rows.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.md5(F.array_join("toks", " ").cast("binary")).alias("tokens_md5"))


@register(
    """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)
SELECT doc_id, (greatest(len(w) - 1, 0))::BIGINT AS n_pairs, md5(array_to_string(list_transform(list_zip(w[1:len(w)-1], w[2:]), lambda p: p[1] || p[2]), ' ')) AS pairs_md5 FROM t"""
)
def bigrams_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(_documents(spark, sf_dir)).select("doc_id", T.pairs(T.all_matches(F.col("text"), "[A-Za-z]+")).alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n_pairs"), F.md5(F.array_join("p", " ").cast("binary")).alias("pairs_md5"))


CHUNK_SQL = """
packed AS (
  SELECT doc_id, CASE WHEN length(text) <= 1400 THEN [text] ELSE (
    SELECT list_filter(list_append(r.parts, r.buf), lambda p: p <> '') FROM (SELECT list_reduce(
      list_transform(string_split(text, chr(10)), lambda l: {'parts': []::VARCHAR[], 'buf': l}),
      lambda a, x: CASE WHEN length(a.buf) + length(x.buf) > 1400 AND length(a.buf) >= 120
        THEN {'parts': list_append(a.parts, a.buf), 'buf': x.buf}
        ELSE {'parts': a.parts, 'buf': CASE WHEN a.buf = '' THEN x.buf ELSE a.buf || chr(10) || x.buf END} END,
      {'parts': []::VARCHAR[], 'buf': ''}) AS r)) END AS parts
  FROM documents
),
cleaned AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: regexp_replace(p, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda p: p <> '') AS parts FROM packed),
merged AS (
  SELECT doc_id, list_reduce(list_transform(parts, lambda p: [p]),
    lambda a, x: CASE WHEN len(a) > 0 AND length(a[-1]) < 120 THEN list_append(a[1:len(a)-1], a[-1] || chr(10) || x[1]) ELSE list_append(a, x[1]) END,
    []::VARCHAR[]) AS chunks FROM cleaned
)"""


@register(f"WITH {CHUNK_SQL} SELECT doc_id, len(parts)::BIGINT AS n_parts, list_max(list_transform(parts, lambda p: length(p)))::BIGINT AS longest FROM packed")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(_documents(spark, sf_dir)).select("doc_id", chunk.split_long(F.col("text")).alias("parts"))
    return rows.select("doc_id", F.size("parts").cast("long").alias("n_parts"), F.array_max(F.transform("parts", F.length)).cast("long").alias("longest"))


@register(f"WITH {CHUNK_SQL} SELECT doc_id, (pos - 1)::INT AS ord, length(c)::BIGINT AS n_chars, md5(c) AS chunk_md5 FROM (SELECT doc_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS pos FROM merged)")
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk.chunks(spread(_documents(spark, sf_dir)))
    return rows.select("doc_id", "ord", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("chunk_md5"))


@register(
    bm25_sql(
        "'all'",
        """, firsts AS (SELECT qid, unit, min(CASE WHEN rank <= 4 THEN rank END) AS pos FROM ranked WHERE rank <= 4 AND score > 0 GROUP BY ALL),
by_lang AS (SELECT qid, unit, 100 + min(r) AS pos FROM (SELECT r.qid, r.unit, row_number() OVER (PARTITION BY r.qid, d.lang ORDER BY r.score DESC, r.unit) AS r FROM ranked r JOIN documents d ON d.doc_id = r.unit WHERE r.score > 0) WHERE r <= 1 GROUP BY ALL)
SELECT qid AS item_id, unit AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY min(pos), unit)::INT AS ord FROM (SELECT * FROM firsts UNION ALL SELECT * FROM by_lang) GROUP BY qid, unit""",
    )
)
def coarse_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = index.scores(_units(docs, part="lang"), _queries(spark, sf_dir), most=4, part="lang")
    scored = Scratch(spark, "scored").keep(scored, "scored")  # two rankings read them
    full = index.top(scored, 4).select("qid", "unit", F.col("rank").alias("pos"))
    by_lang = index.top(scored, 1, by=("qid", "lang")).select("qid", "unit", (F.col("rank") + 100).alias("pos"))
    return route.first_seen(full.unionByName(by_lang)).select(F.col("qid").alias("item_id"), F.col("unit").alias("doc_id"), "ord")


KIND = "CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END"


@register(
    bm25_sql(
        KIND,
        f""", hits AS (SELECT r.qid, r.unit, r.score, r.rank, d.source FROM ranked r JOIN documents d ON d.doc_id = r.unit WHERE r.score > 0 AND r.index_key = CASE WHEN r.qid % 2 = 0 THEN 'en' ELSE 'other' END),
parts AS (
  SELECT qid, unit, 0 AS a, rank AS b FROM hits WHERE rank <= 12
  UNION ALL SELECT qid, unit, 2 + opt, r FROM (SELECT *, row_number() OVER (PARTITION BY qid, opt ORDER BY score DESC, unit) AS r FROM (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY source NULLS LAST) AS opt FROM hits)) WHERE r <= 2),
kinds AS (SELECT {KIND} AS kind, doc_id FROM documents), small AS (SELECT kind FROM kinds GROUP BY kind HAVING count(*) <= 24),
asked AS (SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'other' END AS kind FROM benchmark),
every AS (SELECT qid, doc_id AS unit, 0 AS a, doc_id AS b FROM asked JOIN kinds USING (kind) WHERE kind IN (SELECT kind FROM small) OR qid NOT IN (SELECT qid FROM parts)),
found AS (SELECT parts.* FROM parts JOIN asked USING (qid) WHERE kind NOT IN (SELECT kind FROM small) UNION ALL SELECT * FROM every),
once AS (SELECT qid, unit, min(struct_pack(a := a::BIGINT, b := b::BIGINT)) AS pos FROM found GROUP BY qid, unit)
SELECT qid AS item_id, unit AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY pos, unit)::INT AS ord FROM once""",
    )
)
def coarse_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of items: those with even ids are asked of English documents, the others of the rest; sources stand for options."""
    kind = F.when(F.col("lang") == "en", F.lit("en")).otherwise(F.lit("other"))
    docs = _documents(spark, sf_dir).withColumn("kind", kind)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 2 == 0, F.lit("en")).otherwise(F.lit("other")).alias("domain"))
    # of each source the first ones, so every source with a hit is there
    hits = index.scores(_units(docs, "kind", "source"), _queries(spark, sf_dir), within=asked.withColumnRenamed("domain", "index_key"), most=12, part="source")
    hits = hits.filter("score > 0").withColumn("opt", F.dense_rank().over(Window.partitionBy("qid").orderBy(F.asc_nulls_last("source"))))
    hits = Scratch(spark, "coarse").keep(hits, "hits")  # two rankings read them
    full = index.top(hits, 12).select("qid", F.lit("surface").alias("part"), F.lit(0).alias("opt"), "unit", "rank")
    each = index.top(hits, 2, by=("qid", "opt")).select("qid", F.lit("option").alias("part"), "opt", "unit", "rank")
    out = route.coarse(docs.select(F.col("kind").alias("domain"), F.col("doc_id").alias("unit"), F.col("doc_id").alias("pos")), full.unionByName(each), asked)
    return out.select(F.col("qid").alias("item_id"), F.col("unit").alias("doc_id"), "ord")


@register(
    """WITH a AS (SELECT item_id, lower(text) AS anchor FROM benchmark),
hits AS (SELECT item_id, doc_id, count(*) OVER (PARTITION BY item_id) AS n FROM a JOIN documents d ON contains(lower(d.text), anchor))
SELECT item_id, doc_id FROM hits WHERE n = 1"""
)
def quoted_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array(F.lower("text")).alias("anchors"))
    docs = _documents(spark, sf_dir).select("doc_id", F.lower("text").alias("surface"))
    return route.quoted(items, docs).select(F.col("qid").alias("item_id"), F.explode("doc_ids").alias("doc_id"))


@register(
    """WITH q AS (SELECT conv_id AS qid, string_agg(lower(text), ' ' ORDER BY turn, role) AS t FROM conversations GROUP BY conv_id),
alias AS (SELECT source, lower(regexp_extract(text, '[A-Za-z]{6,}')) AS alias FROM documents WHERE regexp_matches(text, '[A-Za-z]{6,}') GROUP BY ALL),
owners AS (SELECT alias, count(*) AS n, min(source) AS source FROM alias GROUP BY alias),
w AS (SELECT DISTINCT qid, unnest(regexp_extract_all(t, '[a-z]+')) AS word FROM q)
SELECT qid AS conv_id, count(DISTINCT source)::BIGINT AS n_sources, min(source) AS first_source, max(length(alias))::BIGINT AS longest FROM w JOIN owners ON word = alias WHERE n = 1 GROUP BY qid"""
)
def alias_unique_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    words = talk.select(F.col("conv_id").alias("qid"), F.explode(F.array_distinct(T.all_matches(F.lower(F.array_join(F.transform("t", lambda x: x["text"]), " ")), "[a-z]+"))).alias("alias"))
    names = _documents(spark, sf_dir).select("source", F.lower(F.regexp_extract("text", "[A-Za-z]{6,}", 0)).alias("alias")).filter("alias <> ''").distinct()
    hit = words.join(route.unique_owners(names, "source"), "alias")
    return hit.groupBy(F.col("qid").alias("conv_id")).agg(F.countDistinct("owner").alias("n_sources"), F.min("owner").alias("first_source"), F.max(F.length("alias")).cast("long").alias("longest"))


@register(
    """WITH f AS (SELECT doc_id, source, regexp_replace(source, '[0-9]$', '') AS family FROM documents),
g AS (SELECT family, count(*)::BIGINT AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM f GROUP BY family)
SELECT doc_id, family, n, first_id, last_id FROM f JOIN g USING (family)"""
)
def family_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", F.regexp_replace("source", "[0-9]$", "").alias("family"))
    groups = docs.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return docs.join(groups, "family").select("doc_id", "family", "n", "first_id", "last_id")


@register(
    """WITH ids AS (SELECT doc_id::VARCHAR AS id FROM documents), suffixes AS (SELECT id, substr(id, i) AS suffix FROM ids, (SELECT unnest(range(1, 8)) AS i) WHERE i <= length(id)),
n AS (SELECT suffix, count(*) AS n, min(id) AS id FROM suffixes GROUP BY suffix),
q AS (SELECT item_id, (item_id * 7)::VARCHAR AS value FROM benchmark)
SELECT item_id, value, coalesce(e.id, CASE WHEN n.n = 1 THEN n.id END) AS picked FROM q LEFT JOIN ids e ON e.id = value LEFT JOIN n ON n.suffix = value"""
)
def suffix_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 7).cast("string").alias("value"))
    ids = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"))
    return route.resolve(picks, ids).select("item_id", "value", "picked")


@register(
    bm25_sql(
        "lang",
        """SELECT qid AS item_id, unit AS doc_id, max(score) AS score, count(*)::BIGINT AS n_hits FROM ranked WHERE rank <= 2 AND score > 0 GROUP BY qid, unit""",
    )
)
def evidence_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = index.top(index.scores(_units(_documents(spark, sf_dir), "lang"), _queries(spark, sf_dir), most=2), 2)
    return hits.groupBy(F.col("qid").alias("item_id"), F.col("unit").alias("doc_id")).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_hits"))


EVIDENCE_SQL = """, hit AS (SELECT r.qid, r.unit, r.score, r.rank = 1 AS forced, length(d.text) AS n FROM ranked r JOIN documents d ON d.doc_id = r.unit WHERE r.rank <= 8 AND r.score > 0),
ordered AS (SELECT qid, list(struct_pack(u := unit, n := n, f := forced) ORDER BY NOT forced, score DESC, unit) AS hits FROM hit GROUP BY qid),
folded AS (SELECT qid, list_reduce(list_transform(hits, lambda h: {'total': h.n, 'kept': [h.u], 'f': h.f}),
  lambda a, x: CASE WHEN x.f OR a.total + x.total + 20 <= 3600 THEN {'total': a.total + x.total + 20, 'kept': list_append(a.kept, x.kept[1]), 'f': a.f} ELSE a END,
  {'total': 0::BIGINT, 'kept': []::BIGINT[], 'f': false}) AS r FROM ordered)"""


@register(bm25_sql("'all'", EVIDENCE_SQL + " SELECT qid AS item_id, r.total::BIGINT AS total, len(r.kept)::BIGINT AS n_kept, array_to_string(r.kept, ',') AS kept FROM folded"))
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    hits = index.top(index.scores(_units(docs), _queries(spark, sf_dir), most=8), 8).join(docs.select(F.col("doc_id").alias("unit"), F.length("text").alias("n")), "unit")
    packed = evidence.pack(hits.select("qid", "unit", "n", "score", (F.col("rank") == 1).alias("forced"), F.lit(False).alias("contents")), 3600)
    return packed.select(F.col("qid").alias("item_id"), F.col("total").cast("long").alias("total"), F.size("kept").cast("long").alias("n_kept"), F.array_join(F.transform("kept", lambda k: k["unit"].cast("string")), ",").alias("kept"))


@register(bm25_sql("'all'", EVIDENCE_SQL + ", k AS (SELECT qid, unnest(r.kept) AS unit FROM folded) SELECT qid AS item_id, unit AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY unit::VARCHAR)::INT AS ord FROM k"))
def evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    hits = index.top(index.scores(_units(docs), _queries(spark, sf_dir), most=8), 8).join(docs.select(F.col("doc_id").alias("unit"), F.length("text").alias("n")), "unit")
    packed = evidence.pack(hits.select("qid", "unit", "n", "score", (F.col("rank") == 1).alias("forced"), F.lit(False).alias("contents")), 3600)
    kept = packed.select("qid", F.explode("kept").alias("k")).select("qid", F.col("k.unit").alias("unit"))
    order = Window.partitionBy("qid").orderBy(F.col("unit").cast("string"))
    return kept.select(F.col("qid").alias("item_id"), F.col("unit").alias("doc_id"), F.row_number().over(order).alias("ord"))


@register(
    bm25_sql(
        "'all'",
        """, a AS (SELECT qid, list(unit ORDER BY rank) AS c FROM ranked WHERE rank <= 6 AND score > 0 GROUP BY qid),
s AS (SELECT qid, CASE WHEN qid % 3 = 0 THEN c[1:1] ELSE list_concat(c[2:2], c[3:3]) END AS start, c FROM a),
m AS (SELECT qid, list_concat(start, list_concat(c[4:4], c[1:1])) AS l, c FROM s),
o AS (SELECT qid, l, list_filter(c[5:6], lambda x: NOT list_contains(l, x)) AS more FROM m),
e AS (SELECT qid, unnest(list_concat(l, more)) AS unit, generate_subscripts(list_concat(l, more), 1) AS i FROM o),
f AS (SELECT qid, unit, row_number() OVER (PARTITION BY qid ORDER BY min(i)) AS ord FROM e GROUP BY qid, unit)
SELECT qid AS item_id, string_agg(unit::VARCHAR, ',' ORDER BY ord) AS picked FROM f WHERE ord <= 4 GROUP BY qid""",
    )
)
def finalize_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks from the hits of each item: the second and third as parsed ids of two items in three, others as fallbacks."""
    hits = index.top(index.scores(_units(_documents(spark, sf_dir)), _queries(spark, sf_dir), most=6), 6)
    c = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "unit"))), lambda x: x["unit"].cast("string")).alias("c"))
    none = F.array().cast("array<string>")
    parsed = F.when(F.col("qid") % 3 == 0, none).otherwise(F.slice("c", 2, 2))
    picked = route.finalize(parsed, F.col("c"), F.slice("c", 4, 1), none, F.slice("c", 1, 1), F.slice("c", 5, 2), F.lit(False), F.lit(False), none)
    return c.select(F.col("qid").alias("item_id"), F.array_join(picked, ",").alias("picked"))

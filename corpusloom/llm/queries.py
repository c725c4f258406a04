"""The registered queries of this subpackage, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import alignment, bpe, decontaminate, language_id, licenses, lm_scoring, media, mixing, periodic, quality_rules, sharding, simhash, warc
from corpusloom.session import Scratch, ship, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)  # whatever Python the query's tasks run, they find this package
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Scratch(spark, "warc").path("archives")
    warc.write(table(spark, sf_dir, "pages"), at, uri_col="url")
    return warc.read(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# five hex digits of the digest are four base-32 ones
ORACLE["op3_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS last FROM p),
b AS (SELECT *, list_transform(range(0, 32), lambda i: ('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT // (32 ** (3 - i % 4))::BIGINT % 32) AS digits FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(digits, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + x, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE["op1_lm_scoring"] = """
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), placed AS (
  SELECT doc_id, i, w[i - 1] AS a, w[i] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts)
), one AS (SELECT b AS word, count(*) AS n FROM placed GROUP BY b
), two AS (SELECT a, b, count(*) AS n FROM placed WHERE i > 1 GROUP BY a, b HAVING count(DISTINCT doc_id) > 1
), whole AS (SELECT count(*)::DOUBLE AS n FROM placed
), scored AS (
  SELECT placed.doc_id, CASE WHEN placed.i = 1 THEN ln(y.n / whole.n) WHEN two.n IS NOT NULL THEN ln(two.n / x.n) ELSE ln(0.4) + ln(y.n / whole.n) END AS s
  FROM placed CROSS JOIN whole JOIN one y ON y.word = placed.b LEFT JOIN one x ON x.word = placed.a AND placed.i > 1 LEFT JOIN two ON two.a = placed.a AND two.b = placed.b AND placed.i > 1
), sums AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM scored GROUP BY doc_id)
SELECT texts.doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(s, 0.0), 6) AS log_score, round(s / n, 6) AS mean_log_score FROM texts LEFT JOIN sums ON sums.doc_id = texts.doc_id
"""


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _quality_sql() -> str:
    """Measures and votes as the operator's, and its rounds of expectation-maximisation one after another, over rates by rule and vote."""
    q = quality_rules
    starts = ", ".join(f"({j}, {v}, {q.RATES_GOOD[k]}::DOUBLE, {q.RATES_BAD[k]}::DOUBLE)" for j in range(1, len(q.RULES) + 1) for k, v in enumerate((-1, 1)))
    rounds = []
    for k in range(q.ROUNDS + 1):
        rounds.append(
            f"""q{k} AS MATERIALIZED (
  SELECT p.votes, p.n, p.n / (1 + exp(-(any_value(ln(prior / (1 - prior))) + coalesce(sum(ln(r.good / r.bad)), 0)))) AS g
  FROM p CROSS JOIN prior{k} LEFT JOIN cast_votes c ON c.votes = p.votes LEFT JOIN rates{k} r ON r.rule = c.rule AND r.vote = c.vote GROUP BY p.votes, p.n
), prior{k + 1} AS (SELECT (coalesce(sum(g), 0) + {q.PSEUDO * q.PRIOR_GOOD}) / (coalesce(sum(n), 0) + {q.PSEUDO}) AS prior FROM q{k}
), seen{k + 1} AS (SELECT rule, vote, sum(n) AS n, sum(g) AS g FROM q{k} JOIN cast_votes USING (votes) GROUP BY rule, vote
), rates{k + 1} AS MATERIALIZED (
  SELECT s.rule, s.vote, (coalesce(g, 0) + {q.PSEUDO} * good) / (coalesce(sum(g) OVER (PARTITION BY s.rule), 0) + {q.PSEUDO}) AS good,
    (coalesce(n - g, 0) + {q.PSEUDO} * bad) / (coalesce(sum(n - g) OVER (PARTITION BY s.rule), 0) + {q.PSEUDO}) AS bad
  FROM rates0 s LEFT JOIN seen{k + 1} e ON e.rule = s.rule AND e.vote = s.vote)"""
        )
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents
), placed AS (SELECT k, i, array_to_string(w[i:i + {q.WINDOW - 1}], ' ') AS x FROM (SELECT k, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i FROM texts)
), again AS (SELECT k, unnest(range(i, i + {q.WINDOW})) AS pos FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS n FROM placed) WHERE n > 1
), repeats AS (SELECT k, count(DISTINCT pos) AS n FROM again GROUP BY k
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(regexp_extract_all(t, '\\p{{L}}')) AS n_letters, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals,
    len(regexp_extract_all(t, '[.!?]')) AS n_stops, len(list_distinct(w)) AS n_kinds, coalesce(n, 0) AS n_repeat_words FROM texts LEFT JOIN repeats USING (k)
), per AS (
  SELECT *, n_symbols / greatest(n_words, 1) AS symbols, n_letters / greatest(word_chars, 1) AS letters, n_repeat_words / greatest(n_words, 1) AS repeats,
    n_dup_lines / greatest(n_lines, 1) AS lines, word_chars / greatest(n_words, 1) AS size, n_capitals / greatest(word_chars, 1) AS capitals,
    n_stops / greatest(n_words, 1) AS stops, n_kinds / greatest(n_words, 1) AS kinds, n_words >= 20 AS long,
    n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEAT_PERCENT} * n_words AS base_failed FROM m
), voted AS MATERIALIZED (
  SELECT *, [CASE WHEN symbols >= 0.2 THEN -1 WHEN symbols <= 0.02 THEN 1 ELSE 0 END,
    CASE WHEN long AND letters < 0.65 THEN -1 WHEN letters >= 0.8 THEN 1 ELSE 0 END,
    CASE WHEN repeats > 0.2 THEN -1 WHEN repeats <= 0.02 THEN 1 ELSE 0 END,
    CASE WHEN n_dup_lines >= 3 AND lines >= 0.5 THEN -1 WHEN n_dup_lines = 0 AND n_lines > 1 THEN 1 ELSE 0 END,
    CASE WHEN size < 2 OR size > 20 THEN -1 WHEN size BETWEEN 3 AND 10 THEN 1 ELSE 0 END,
    CASE WHEN long AND capitals >= 0.5 THEN -1 WHEN capitals <= 0.1 THEN 1 ELSE 0 END,
    CASE WHEN long AND (stops > 0.7 OR stops < 0.002) THEN -1 WHEN long AND stops BETWEEN 0.01 AND 0.35 THEN 1 ELSE 0 END,
    CASE WHEN long AND kinds < 0.05 THEN -1 WHEN long AND kinds >= 0.3 THEN 1 ELSE 0 END] AS votes FROM per
), p AS MATERIALIZED (SELECT votes, count(*) AS n FROM voted WHERE NOT base_failed GROUP BY votes
), cast_votes AS MATERIALIZED (SELECT votes, rule, votes[rule] AS vote FROM (SELECT votes, unnest(range(1, {len(q.RULES) + 1})) AS rule FROM p) WHERE votes[rule] <> 0
), prior0 AS (SELECT {q.PRIOR_GOOD}::DOUBLE AS prior
), rates0 AS (SELECT * FROM (VALUES {starts}) AS s(rule, vote, good, bad)
), {", ".join(rounds)}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(g / n >= {q.KEEP_FROM}, false) AS kept
FROM voted v LEFT JOIN q{q.ROUNDS} USING (votes)
"""


ORACLE["op2_quality_rules"] = _quality_sql()


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, stored = media.store(table(spark, sf_dir, "documents"))
    out = names.join(media.features(media.headers(stored)), "digest")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth")


@query
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of a tree: a folder for each source, in it one for each thousand ids, in it one for each hundred.

    Files whose ids end in 0 lie one folder up, those whose ids end in 00 two, and of these the ones with a notice are licence files.
    """
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    thousand, hundred = F.concat(F.lit("t"), F.floor(i / 1000).cast("string")), F.concat(F.lit("h"), F.floor(i / 100).cast("string"))
    name = F.concat(F.when(i % 10 == 0, F.lit("LICENSE.")).otherwise(F.lit("file.")), i.cast("string"))
    folder = F.when(i % 100 == 0, F.array(F.col("source"))).when(i % 10 == 0, F.array(F.col("source"), thousand)).otherwise(F.array(F.col("source"), thousand, hundred))
    files = docs.select("doc_id", "text", F.concat(F.array_join(folder, "/"), F.lit("/"), name).alias("path"))
    return licenses.scan(files, keep=("doc_id",)).select("doc_id", "path", "licence", "cosine", "origin", "from_dir")


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op10_mixing"] = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source
), whole AS (SELECT sum(source_size)::DOUBLE * 1.5 AS budget FROM per),
-- stopped sources are taken out round by round until no share is above its cap
rounds AS (
  SELECT 0 AS round, (SELECT list(struct_pack(s := source, c := (2 * source_size)::DOUBLE, w := w) ORDER BY source NULLS LAST) FROM per) AS open, (SELECT budget FROM whole) AS left_over
  UNION ALL
  SELECT round + 1,
    list_filter(open, lambda x: x.c * list_sum(list_transform(open, lambda y: y.w)) > left_over * x.w),
    left_over - list_sum(list_transform(list_filter(open, lambda x: x.c * list_sum(list_transform(open, lambda y: y.w)) <= left_over * x.w), lambda y: y.c))
  FROM rounds
  WHERE len(list_filter(open, lambda x: x.c * list_sum(list_transform(open, lambda y: y.w)) <= left_over * x.w)) > 0
), last_round AS (
  SELECT left_over / list_sum(list_transform(open, lambda y: y.w)) AS level FROM rounds ORDER BY round DESC LIMIT 1
), targets AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, coalesce(w * (SELECT level FROM last_round), (2 * source_size)::DOUBLE)) AS target FROM per
), ranked AS (
  SELECT d.*, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size) - d.size AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM ranked)
"""


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE["op11_decontamination"] = """
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, w, least(10, len(w)) AS size FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), wanted AS MATERIALIZED (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM item)
), placed AS (
  SELECT k, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM texts CROSS JOIN (SELECT DISTINCT size FROM item))
), met AS MATERIALIZED (SELECT k, i, placed.size, item FROM placed JOIN wanted ON placed.win = wanted.win AND placed.size = wanted.size
), words AS (SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS pos FROM met) GROUP BY k
), lists AS (SELECT k, list(item ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM met) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM texts LEFT JOIN words USING (k) LEFT JOIN lists USING (k)
"""


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document by its id's checksum is periodic from a place on, as the query's contract lays down."""
    h, blank = F.crc32(F.col("doc_id").cast("string")), "[\\x20\\x09-\\x0D]+"
    w = F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), blank, -1), "")
    g = F.floor(h / 10)

    def repeated(p: Column) -> Column:
        n = F.size(p["w"])
        a = (p["g"] % n).cast("int")
        period = (1 + F.floor((n - a) / (3 + p["g"] % 8))).cast("int")
        return F.array_join(F.transform(p["w"], lambda x, i: F.when(i < a, x).otherwise(F.get(p["w"], a + (i - a) % period))), " ")

    # bound as an element of an array, so that the words are made once
    made = F.get(F.transform(F.array(F.struct(w.alias("w"), g.alias("g"))), lambda p: F.when(F.size(p["w"]) > 0, repeated(p)).otherwise(F.lit(""))), F.lit(0))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.when(h % 10 == 0, made).otherwise(F.col("text")).alias("text"))
    found = periodic.periodic(texts)
    better = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])  # noqa: E731  (runs come by start, then period)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, x: F.when(better(a, x), x).otherwise(a))
    line = lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE["op12_periodic_runs"] = """
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    xor(list_reduce([ord(c) FOR c IN string_split(doc_id::VARCHAR, '')], lambda acc, c: list_reduce(range(0, 8), lambda y, j: xor(y >> 1, (y & 1) * 3988292384), xor(acc, c::BIGINT)), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM documents
), planted AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM texts)
), word AS MATERIALIZED (
  SELECT k, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS x FROM (SELECT k, w, a, p, unnest(range(0, n)) AS i FROM planted)
), grid AS (SELECT k, p, unnest(range(0, n - 2 * p + 1, 2 * p)) AS g FROM (SELECT k, n, unnest(range(1, n // 4 + 1)) AS p FROM planted)
), one AS (SELECT grid.* FROM grid JOIN word a ON a.k = grid.k AND a.i = g JOIN word b ON b.k = grid.k AND b.i = g + p WHERE a.x = b.x
), two AS (SELECT one.* FROM one JOIN word a ON a.k = one.k AND a.i = g + p // 2 JOIN word b ON b.k = one.k AND b.i = g + p // 2 + p WHERE a.x = b.x
), period AS MATERIALIZED (SELECT DISTINCT two.k, p FROM two JOIN word a ON a.k = two.k AND a.i = g + p - 1 JOIN word b ON b.k = two.k AND b.i = g + 2 * p - 1 WHERE a.x = b.x
), again AS (SELECT c.k, c.p, a.i FROM period c JOIN word a ON a.k = c.k JOIN word b ON b.k = c.k AND b.i = a.i + c.p AND b.x = a.x
), stretch AS (SELECT k, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY k, p ORDER BY i) AS part FROM again) GROUP BY k, p, part
), run AS MATERIALIZED (SELECT k, start, length, min(p) AS p FROM stretch WHERE length >= greatest(6, 4 * p) GROUP BY k, start, length
), best AS (
  SELECT k, count(*) AS n_runs, first({'start': start, 'length': length, 'p': p} ORDER BY length / p DESC, start, p) AS b,
    string_agg(start || ',' || length || ',' || p || chr(10), '' ORDER BY start, p) AS lines FROM run GROUP BY k
), gone AS (SELECT DISTINCT k, unnest(range(start + p, start + length)) AS i FROM run
), kept AS (SELECT k, string_agg(x, ' ' ORDER BY i) AS line FROM word ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.p::BIGINT AS period, (1000 * b.length // b.p)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM texts LEFT JOIN best USING (k) LEFT JOIN kept USING (k)
"""


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "align")
    rows = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = scratch.keep(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", digest, "pairs", "times"), "rows")
    return alignment.scored(rows, scratch).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

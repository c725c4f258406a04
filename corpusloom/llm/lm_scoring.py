"""Language-model scoring: stupid backoff over word bigrams.

Two count tables cover all documents: of every word, and of every bigram that two documents share or, with ``own_pairs``, of every bigram. Bigrams are dealt out by hash once:
the count table is summed from the exploded bigrams and joined back to them. Words with high counts have numbers that every
task knows, a short cut that changes no count; any other word has a 63-bit hash for a number, and its count is joined from the word table.
Bigrams that no other document has back off, unless ``own_pairs`` is set: else a document would know all of its
own. Pairs with a word that the whole corpus has once are of that kind, and need not travel; a bitmap of fixed size tells most of them.
With ``own_pairs`` their count is 1, and they travel only if the count of their first word is not known in the task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.bitmaps import bitmap, there
from corpusloom.session import Scratch, spread

#: Most words that every task knows: those with the highest counts, words of one power of two all or none.
FREQUENT = 1 << 18
BACKOFF = 0.4
#: Factor of the first of two frequent words' numbers; rows of documents' own with one first word are spread over so many keys.
_SECOND, _SPREAD = 1 << 20, 1 << 10
#: Numbers from here down are for the rows of documents' scores so far.
_LOCAL = -(1 << 62)
#: Distinct words counted in a task before their counts leave it, and rows of a batch of bigrams.
_HELD, _ROWS = 1 << 18, 1 << 18


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: ASCII case and ASCII blanks only


def _hashed(word: bytes) -> int:
    return -1 - (int.from_bytes(blake2b(word, digest_size=8).digest(), "little") >> 1)


class _Numbers(dict):
    """Numbers of the frequent words, and of any other word its hash."""

    def __missing__(self, word: bytes) -> int:
        return _hashed(word)

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, _words(text)), dtype=np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def leave() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.decode() for x in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(_words(text.as_py()))
            if len(counts) > _HELD:
                yield leave()
                counts.clear()
    yield leave()


def word_counts(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The written table ``word, n, number`` of the words that ``rows (text)`` has twice or more, each with its hash; and the number of all words."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_hashed(x.encode()) for x in batch.column(0).to_pylist()], pa.int64())], ["word", "n", "number"])

    all_words = Observation()
    counts = rows.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = counts.observe(all_words, F.sum("n").alias("n")).filter("n > 1").mapInArrow(number, "word string, n long, number long")
    return scratch.keep(counts, "words"), all_words.get["n"] or 0


class _Known:
    """What every task knows: numbers of the frequent words, the logarithms of their counts by number, the bits of the repeated hashed words."""

    def __init__(self, numbers: dict[bytes, int], logs: np.ndarray, repeated: np.ndarray, log_total: float) -> None:
        self.numbers, self.logs, self.repeated, self.log_total = numbers, logs, repeated, log_total

    def single(self, w: np.ndarray) -> np.ndarray:
        """Words that surely occur once in the corpus: no repeated word has their bit."""
        return (w < 0) & ~there(self.repeated, w)


def _explode(batches: Iterator[pa.RecordBatch], known: _Known, ids: pa.DataType, own_pairs: bool) -> Iterator[pa.RecordBatch]:
    """``pair, a, b, doc_id, own`` for the distinct bigrams of each row, and two rows for the row itself, with a negative ``pair``.

    ``pair`` is made of the numbers of the frequent words, 0 in the place of a hashed one; ``a`` and ``b`` are the hashed first and second
    word, 0 for a frequent one. ``own`` says how often the row has the bigram. The row's own two have the number of its words, with its first
    word, and its score so far: that of pairs with a word that occurs once, if it is the second or the second is frequent.
    They can't be in another document, and back off to a count that is known here. With ``own_pairs`` they are found once among
    the occurrences of their first word: if that occurs once too, or is frequent, the count is known here.
    """
    numbers, held = _Numbers(known.numbers), []
    size = serial = 0

    def batched() -> pa.RecordBatch:
        *columns, names = zip(*held, strict=True)
        columns = [pa.array(np.concatenate(c)) for c in columns]
        columns.insert(3, pa.array([x for x, n in names for _ in range(n)], ids))
        return pa.RecordBatch.from_arrays(columns, ["pair", "a", "b", "doc_id", "own"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            w = numbers.of(text.as_py())
            kinds, at = np.unique(w, return_inverse=True)
            k = max(len(kinds), 1)
            both, own = np.unique(at[:-1] * k + at[1:], return_counts=True)
            first, second = both // k, both % k
            hashed, single = kinds < 0, known.single(kinds)
            number, rare = np.where(hashed, 0, kinds), np.where(hashed, kinds, 0)
            if own_pairs:
                here = single[first] | single[second] & ~hashed[first]
                local = -known.logs[number[first[here]]].sum()
            else:
                here = single[second] | single[first] & ~hashed[second]
                local = (own[here] * (known.logs[number[second[here]]] + (math.log(BACKOFF) - known.log_total))).sum()
            first, second, own = first[~here], second[~here], own[~here]
            spread_over = serial % _SPREAD
            head = -1 - (number[at[0]] * _SPREAD + spread_over) if len(w) else -1 - spread_over
            pair = np.concatenate(([head, _LOCAL - spread_over], number[first] * _SECOND + number[second]))
            held.append((pair, np.concatenate(([rare[at[0]] if len(w) else 0, 0], rare[first])), np.concatenate(([0, 0], rare[second])), np.concatenate(([len(w), local], own)), (doc_id, len(pair))))
            serial += 1
            size += len(pair)
            if size > _ROWS:
                yield batched()
                held, size = [], 0
    if held:
        yield batched()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, own_pairs: bool = False) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score``: natural logarithms of stupid-backoff scores, summed over the words.

    A word scores count(pair) / count(previous word) if another document has its pair with the previous word too, else
    BACKOFF * count(word) / words of the corpus; a first word scores count / words of the corpus. ASCII letters are lower-cased. A null
    or blank text has 0 words, log_score 0 and a null mean. Rows that share an id, null included, count as parts of one
    document and give one row (its parts' first words each as such); documents with a null id make no pair known to others.
    With ``own_pairs`` every pair is counted and scores count(pair) / count(previous word), whichever documents have it, those with a null id
    included: plain stupid backoff, which never backs off on the texts that it was counted on.
    An empty table gives an empty table. ``frequent`` only says how the counts are held. Any
    two of n hashed words have one number, and are counted as one word, with a probability of n * n / 2 ** 64: 1 in 18 for a billion words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    counts, total = word_counts(rows, scratch)
    log_total = math.log(max(total, 1))
    least, so_far = None, 0
    levels = counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    for r in sorted(levels, key=lambda r: -r.level):
        so_far += r.words
        if so_far > frequent:
            break
        least = 2**r.level
    top = sorted(counts.filter(F.col("n") >= least).select("word", "n").collect(), key=lambda r: (-r.n, r.word)) if least else []
    others = counts.filter(F.col("n") < least) if least else counts
    logs = np.log([1, *(r.n for r in top)])
    numbers = {r.word.encode(): i + 1 for i, r in enumerate(top)}
    shared = spark.sparkContext.broadcast(_Known(numbers, logs, bitmap(others, F.col("number")), log_total))
    known = spark.createDataFrame(pa.table({"w": pa.array(range(len(logs)), pa.int64()), "log": logs}))

    kind = docs.schema[id_col].dataType.simpleString()
    ids = to_arrow_type(docs.schema[id_col].dataType)
    exploded = rows.mapInArrow(lambda batches: _explode(batches, shared.value, ids, own_pairs), f"pair long, a long, b long, doc_id {kind}, own double")
    # both the count table and the join take this exchange; rows of documents' own find no count
    key = ["pair", "a", "b"]
    exploded = exploded.filter("pair is not null and a is not null and b is not null").repartition(*key)
    if own_pairs:
        # a table of all bigrams is about as large as what meets it, so the join is left to Spark, which sorts and spills
        pairs = exploded.filter("pair >= 0").groupBy(*key).agg(F.sum("own").alias("n"))
    else:
        pairs = exploded.groupBy(*key).agg(F.sum("own").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last").select(*key, "n")
        # distinct bigrams spread evenly over the hash partitions, so no partition of the table is larger than the others
        pairs = pairs.hint("shuffle_hash")
    met = exploded.join(pairs, key, "left")
    local, document, seen, own = F.col("pair") <= _LOCAL, F.col("pair") < 0, F.col("n").isNotNull(), F.col("own")
    first = F.when(local, 0).when(document, F.floor((-1 - F.col("pair")) / _SPREAD)).otherwise(F.floor(F.col("pair") / _SECOND))
    met = met.withColumn("first", first).withColumn("second", F.when(document, 0).otherwise(F.col("pair") % _SECOND))
    met = met.join(F.broadcast(known.toDF("first", "log_a")), "first", "left").join(F.broadcast(known.toDF("second", "log_b")), "second", "left")

    # number 0 stands for hashed words, whose logarithms are 0 here and added where their counts are; of a word that occurs once it is 0
    part = F.when(local, own).when(document & (own > 0), F.col("log_a") - log_total).when(document, 0.0).when(seen, own * (F.log("n") - F.col("log_a"))).otherwise(own * (F.col("log_b") + (math.log(BACKOFF) - log_total)))
    parts = met.select("doc_id", F.when(document & ~local, own).otherwise(0.0).alias("words"), part.alias("part"))
    need, times = F.when(document | seen, F.col("a")).otherwise(F.col("b")), F.when(document, 1.0).when(seen, -own).otherwise(own)
    needed = met.select("doc_id", need.alias("number"), times.alias("times")).filter("number <> 0")
    added = needed.join(others.select("number", F.col("n").alias("of")), "number")
    added = added.select("doc_id", F.lit(0.0).alias("words"), (F.col("times") * F.log("of")).alias("part"))
    out = parts.unionByName(added).groupBy("doc_id").agg(F.sum("words").cast("long").alias("n_words"), F.sum("part").alias("log_score"))
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))

"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import spread

BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Bound on the labelled documents of a language that the model is fitted on, in expectation; chosen by a hash of the id.
TRAIN_PER_LANGUAGE = 2_000
#: Bound on the model that is broadcast.
MOST_LANGUAGES = 500
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Grams of a window; texts scored together at most; elements of a block of the product.
_WINDOW, _TOGETHER, _PRODUCT = 1 << 18, 256, 1 << 20


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that is never learned from; ids that are null don't, but aren't learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the character 2- and 3-grams of a lower-cased text between two spaces, a window at a time."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype="<u4")
    for i in range(0, max(1, len(points) - 1), _WINDOW):
        p = points[i : i + _WINDOW + 2].astype(np.uint32)
        two = p[:-1] * np.uint32(0x9E3779B1) ^ p[1:] * np.uint32(0x85EBCA77)
        two = two[:_WINDOW]
        three = p[:-2] * np.uint32(0xC2B2AE3D) ^ p[1:-1] * np.uint32(0x27D4EB2F) ^ p[2:] * np.uint32(0x165667B1)
        for x in (two, three):
            yield ((x ^ x >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            of = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for x in grams(text):
                of += np.bincount(x, minlength=BUCKETS)
    for lang, of in counts.items():
        at = np.flatnonzero(of)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(of[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities: a row of BUCKETS and, last, the log prior.

    Learns from texts with a language outside the held-out fold, from about ``most`` whole documents of each language at most.
    Without any, there is no language and everything is unknown.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    totals = {r.lang: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    langs = sorted(totals)
    if not langs:
        return [], np.zeros((0, BUCKETS + 1), dtype=np.float32)
    part = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, most / totals[k])))]), F.col("lang"))
    drawn = F.expr("pmod(xxhash64(doc_id), 1000000L)") < part * 1_000_000
    counted = spread(known.filter(drawn).select("lang", "text")).mapInArrow(_count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), BUCKETS))
    at = {k: i for i, k in enumerate(langs)}
    counts[[at[k] for k in rows["lang"].to_pylist()], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    log = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    prior = np.log(np.array([totals[k] + 1.0 for k in langs]))
    return langs, np.column_stack((log, prior - np.log(sum(totals.values()) + len(langs)))).astype(np.float32)


def _batch_scores(texts: list[str], log: np.ndarray) -> np.ndarray:
    """Log-probabilities of each text (rows) in each language (columns).

    The texts' grams are a sparse matrix, row after row: indices into the rows of ``log`` and the places where texts begin. Its
    product with ``log`` is taken a block of indices at a time; a text that goes on in the next block is added to.
    """
    total = np.tile(log[-1].astype(np.float64), (len(texts), 1))
    most = max(1, _PRODUCT // max(log.shape[1], 1))
    for first, indices, starts in _sparse(texts):
        for i in range(0, len(indices), most):
            block = log[indices[i : i + most]].astype(np.float64)
            # the texts that have indices in this block: that in which it begins, and those that begin in it
            at = max(int(np.searchsorted(starts, i, side="right")) - 1, 0)
            end = int(np.searchsorted(starts, i + len(block)))
            total[first + at : first + end] += np.add.reduceat(block, np.maximum(starts[at:end] - i, 0), axis=0)
    return total


def _sparse(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first text, indices and starts of runs of texts; each text is in one run, or alone in several if it is long."""
    held, starts, size, first = [], [], 0, 0
    for t, text in enumerate(texts):
        for x in grams(text):
            if size and size + len(x) > _WINDOW:
                yield first, np.concatenate(held), np.array(starts)
                held, starts, size = [], [], 0
            if not held:
                first = t
            if len(starts) < t - first + 1:
                starts.append(size)
            held.append(x)
            size += len(x)
    if held:
        yield first, np.concatenate(held), np.array(starts)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score``, the probability of that language given the text alone.

    Columns of ``docs`` of these two names give way to them. A text that is null or has no letter is ``und`` with score 0, as is every text
    if nothing was learned. Ties go to the first language in code-point order. Rows stay in their partitions; the text alone goes to Python.
    """
    langs = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1].T.copy())

    @F.arrow_udf("lang_pred string, score double")
    def found(text: pa.Array, letter: pa.Array) -> pa.Array:
        names, scores = np.full(len(text), UNKNOWN, dtype=object), np.zeros(len(text))
        at = np.flatnonzero(letter.to_numpy(zero_copy_only=False))
        for part in np.array_split(at, max(1, -(-len(at) // _TOGETHER))) if langs else ():
            total = _batch_scores([text[i].as_py() for i in part], shared.value)
            best = total.argmax(axis=1)
            names[part] = np.array(langs, dtype=object)[best]
            scores[part] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    text = F.col(text_col)
    rows = spread(docs.select(F.struct(*own).alias("doc"), text.alias("text"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letter")))
    rows = rows.select("doc", found("text", "letter").alias("found"))
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")], "found.lang_pred", "found.score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``. An empty table gives an empty table."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, fit(docs, id_col, text_col, lang_col)).select("doc_id", "held_out", "lang_pred", "score")


#: Documents whose language is less sure than this go.
LEAST_SCORE = 0.5


def identified_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is found, with the columns of ``docs``, of any name; unknown and unsure ones go.

    Null texts and texts without a letter are unknown. Ids serve only to draw what is learned from: rows that repeat or share one
    are each judged by their own text. Without a labelled document nothing is known and all go. An empty table gives an empty table.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    found = predict(own, fit(docs)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])

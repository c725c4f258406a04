"""SimHash near-duplicates: fingerprints, links within a few bits, and their components.

Links come from a range join in the segment-popcount embedding. A fingerprint becomes the bit counts of its 2-bit
segments; the Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints. The segments form
8 bands. Vectors within distance 4 differ in 4 bands at most, so they share the grid cell of some 4 bands: each
fingerprint enters the cells of all 70 choices. Cells are searched without pairing all their members: a member is compared with
those not yet reached, and only the links of a spanning forest leave the task. A large cell is a grid again: its members differ in the 4
other bands alone, which form 8 narrower bands, and the cells of all 70 choices of 4 of these are searched one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusloom.llm.bitmaps import bitmap, there
from corpusloom.session import Scratch, spread

BITS, MOST_BITS = 64, 4
SHINGLE, SEED = 4, 42
SEGMENT, BANDS = 2, 8
#: Members up to which a grid cell is searched at once; beyond, by the cells within it.
CELL = 4096
_VOTE_ROWS = 1 << 15


def fingerprint(text: str | None) -> int:
    """The SimHash of one text: see fingerprints()."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=">u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _VOTE_ROWS):
        votes += np.unpackbits(hashes[i : i + _VOTE_ROWS].view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


@F.arrow_udf(LongType())
def _fingerprint_column(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x.as_py()) for x in text], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, fp the fingerprint as a signed long; ids keep their type.

    A bit is 1 if set in over half the XXH64 (seed 42) of the text's 4-word shingles, repeats included; a shorter text is one
    shingle, a text without words has fingerprint 0.
    """
    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", _fingerprint_column("text").alias("fp"))


def _counts(fp: np.ndarray) -> np.ndarray:
    """The embedding: bit counts of the segments of each fingerprint."""
    bits = np.unpackbits(fp.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.reshape(len(fp), BITS // SEGMENT, SEGMENT).sum(axis=2, dtype=np.int8)


def _keys(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Grid cells by the counts of BANDS bands of equally many segments: a key for each vector, for each choice of the bands that agree."""
    per_band = counts.reshape(len(counts), BANDS, -1).astype(np.int64)
    width = (SEGMENT + 1) ** per_band.shape[2]
    band = per_band @ ((SEGMENT + 1) ** np.arange(per_band.shape[2], dtype=np.int64))
    for c, choice in enumerate(combinations(range(BANDS), BANDS - MOST_BITS)):
        key = np.full(len(counts), c, dtype=np.int64)
        for b in choice:
            key = key * width + band[:, b]
        yield key


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint with the keys of its grid cells: the counts of the segments of 4 of the 8 bands."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for key in _keys(_counts(fp)):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["cell", "fp"])


def _within(cell: int, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest over the distinct fingerprints of a cell, or of several whose union spans the same."""
    if len(fp) <= CELL:
        yield forest(fp)
        return
    segments = BITS // SEGMENT // BANDS
    agree = list(combinations(range(BANDS), BANDS - MOST_BITS))[cell // (SEGMENT + 1) ** (segments * (BANDS - MOST_BITS))]
    others = _counts(fp).reshape(len(fp), BANDS, segments)[:, [b for b in range(BANDS) if b not in agree]]
    for key in _keys(others.reshape(len(fp), -1)):
        order = np.argsort(key, kind="stable")
        for part in np.split(fp[order], np.flatnonzero(np.diff(key[order])) + 1):
            if len(part) > 1:
                yield forest(part)


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over distinct fingerprints, joined at up to MOST_BITS differing bits."""
    left, right, free, counts = [], [], fp.view(np.uint64), _counts(fp)
    while len(free) > 1:
        queue, free, counts_free, queue_counts = [free[0]], free[1:], counts[1:], [counts[0]]
        while queue and len(free):
            x, c = queue.pop(), queue_counts.pop()
            # the embedding's distance first, as the lower bound; then the exact one
            near = np.abs(counts_free - c).sum(axis=1) <= MOST_BITS
            near[near] = np.bitwise_count(free[near] ^ x) <= MOST_BITS
            if near.any():
                left.append(np.full(near.sum(), x, dtype=np.uint64))
                right.append(free[near])
                queue += list(free[near])
                queue_counts += list(counts_free[near])
                free, counts_free = free[~near], counts_free[~near]
        counts = counts_free
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *left]).view(np.int64), np.concatenate([none, *right]).view(np.int64)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from cells: rows come sorted by cell, of which one is held at a time."""
    held_cell, held = 0, []

    def link() -> Iterator[pa.RecordBatch]:
        for a, b in _within(held_cell, np.unique(np.concatenate(held))) if held else ():
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        cell, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(cell):
            continue
        cuts = np.flatnonzero(np.diff(cell)) + 1
        first, last = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(cell)]))
        # cells of one member, away from the batch's edges, need no work
        work = (last - first > 1) | (first == 0) | (last == len(cell))
        for i, j in zip(first[work].tolist(), last[work].tolist(), strict=True):
            if held_cell != cell[i]:
                yield from link()
                held_cell, held = int(cell[i]), []
            held.append(fp[i:j])
    yield from link()


def links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Links ``(a, b)`` that join the same distinct fingerprints as all pairs within MOST_BITS bits do."""
    distinct = scratch.keep(prints.select("fp").distinct(), "prints")
    cells = spread(distinct).mapInArrow(_cells, "cell long, fp long")
    return scratch.keep(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_search, "a long, b long"), "links")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``: root is the component's smallest node.

    Labels sink along links, then jump to their label's label; each round is written to the shared folder.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = scratch.keep(both, "edges")
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels0")
    k = 0
    while True:
        via = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        sunk = labels.join(via, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = sunk.join(jump, "root").select("node", "was", F.least("root", "next").alias("root"))
        k += 1
        new = scratch.keep(new, f"labels{k}")
        labels = new.select("node", "root")
        scratch.drop(f"labels{k - 1}")
        if new.filter("was <> root").isEmpty():
            return labels


def rooted(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """``(fp, root)`` for every distinct fingerprint of the written table ``prints``: root is the least one that links reach."""
    roots = components(links(prints, scratch), scratch)
    out = prints.select("fp").distinct().join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    # a table of its own: a component of very many fingerprints is then a hot key of a plain join, which is split over tasks
    return scratch.keep(out.select("fp", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Fingerprints within MOST_BITS bits are linked; component_id is the smallest id that links reach. Null and blank texts have
    fingerprint 0, linked like any other. Null ids are passed over when the smallest is taken; a component of them alone has a null
    component_id. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, id_col, text_col), "fingerprints")
    roots = rooted(prints, scratch)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    least = scratch.keep(first.join(roots, "fp").groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = scratch.keep(roots.join(least, "root").select("fp", "component_id"), "components")
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def unique_documents(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of ``docs``: that with the smallest doc_id, nulls last.

    Rows are told apart by keys of their own, not by doc_id: documents without an id, and different texts that share one,
    are kept or go by their components alone. Of rows that tie, repeated ones among them, one stays. Null and blank texts are
    one component. Columns of any name pass through; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "unique")
    rows = spread(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    rows = scratch.keep(rows.select("doc", F.monotonically_increasing_id().alias("row"), _fingerprint_column("doc.text").alias("fp")), "rows")
    prints = rows.select("row", F.col("doc.doc_id").alias("doc_id"), "fp")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    # the best of each fingerprint first: copies meet no join
    best = prints.groupBy("fp").agg(best).join(rooted(prints, scratch), "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = scratch.keep(best.select("best.row"), "kept")
    gone = scratch.keep(prints.select("row").join(kept, "row", "left_anti"), "gone")
    # a bitmap of fixed size tells nearly all rows that surely stay, so only the others' texts are dealt out
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(gone, F.xxhash64("row")))

    @F.pandas_udf("boolean")
    def doubtful(hashed: pd.Series) -> pd.Series:
        return pd.Series(there(bits.value, hashed.to_numpy()))

    columns = [F.col("doc")[c].alias(c) for c in docs.columns]
    marked = rows.withColumn("doubtful", doubtful(F.xxhash64("row")))
    return marked.filter("not doubtful").select(*columns).unionByName(marked.filter("doubtful").join(gone, "row", "left_anti").select(*columns))

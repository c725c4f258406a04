"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group and stay together where they fit. Groups that fill much of a shard are packed first, on the driver: there are few of them
whatever the corpus holds. One that fits no shard any more is cut into pieces. All others are packed in batches, each in the task that holds it: a batch has its part of what
capacity the large ones left of every shard, and each of its groups goes where the dot product with the batch's residual capacity is highest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.words import word_count
from corpusloom.session import Scratch, ship

SHARDS = 8
#: A group is packed on the driver beyond this part of a shard; a shard may be this part over full before a group is cut.
LARGE, TOLERANCE = 1 / 16, 1 / 100
#: Groups of a batch that is packed in one task.
TOGETHER = 8_192
ROWS_PER_BUCKET = 20_000
DIMS = ("size", "tokens", "n_rows")


def pack(demand: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each vector: largest first, where its dot product with the residual capacity is highest; ``residual`` is used up.

    Shards that a vector still fits are preferred; ties go to the first shard.
    """
    out = np.zeros(len(demand), dtype=np.int32)
    for i in np.argsort(-demand.max(axis=1), kind="stable"):
        score = residual @ demand[i]
        fits = (residual >= demand[i] - 1e-9).all(axis=1)
        at = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        out[i] = at
        residual[at] -= demand[i]
    return out


def pack_whole(demand: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each vector that fits one, largest first, as pack() does; -1 for those that fit none. ``residual`` is used up."""
    out = np.full(len(demand), -1, dtype=np.int32)
    for i in np.argsort(-demand.max(axis=1), kind="stable"):
        fits = (residual + TOLERANCE >= demand[i]).all(axis=1)
        if fits.any():
            out[i] = at = int(np.argmax(np.where(fits, residual @ demand[i], -np.inf)))
            residual[at] -= demand[i]
    return out


def pack_batch(vectors: np.ndarray, left: np.ndarray, turn: int) -> np.ndarray:
    """Packs a batch into its part of the capacity ``left`` of every shard.

    ``turn`` says which shard comes first in ties: else the last groups of all batches would go to the same one.
    """
    order = np.roll(np.arange(len(left)), turn)
    whole = vectors.sum(axis=0)
    share = np.maximum(left, 0)[order]
    # demands and capacities in units of an even shard of this batch
    residual = share / np.where(share.sum(axis=0) > 0, share.sum(axis=0), 1.0) * len(left)
    return order[pack(vectors / np.where(whole > 0, whole / len(left), 1.0), residual)]


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, cut: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, size, tokens, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus 1. Shards get near-equal sizes, token counts and row counts. Null texts count as
    empty, and equal ones (null and empty alike) form one group. A group is cut only where it fits no shard within TOLERANCE of it, in one of the three, when all
    larger ones are placed: its rows, told apart by keys of their own and not by their ids, then go in pieces of about ``LARGE`` of a shard. Without ``cut`` no group is ever cut.
    Slots count from 0 in each shard without gaps; rows come in no order there. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    ship(spark)
    scratch = Scratch(spark, "shards")
    rows = scratch.keep(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), word_count(text).alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("grp"), F.monotonically_increasing_id().alias("row")),
        "rows",
    )
    groups = scratch.keep(rows.groupBy("grp").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")), "groups")
    total = groups.agg(F.count(F.lit(1)).alias("groups"), *[F.sum(d).alias(d) for d in DIMS]).first()
    even = np.array([max(1.0, (total[d] or 0) / shards) for d in DIMS])
    part = F.greatest(*[F.col(d) / float(e) for d, e in zip(DIMS, even, strict=True)])
    # at most len(DIMS) * shards / LARGE groups are so large, and those that are cut have as many pieces or as many again
    large = sorted(groups.filter(part > LARGE).select("grp", *DIMS).collect(), key=lambda r: r.grp)
    left, vectors = np.ones((shards, len(DIMS))), lambda found: np.array([[r[d] for d in DIMS] for r in found], dtype=float).reshape(-1, len(DIMS)) / even
    demand = vectors(large)
    at = pack_whole(demand, left) if cut else pack(demand, left)
    pieces = [1 if s >= 0 else int(np.ceil(d.max() / LARGE)) for s, d in zip(at, demand, strict=True)]
    large = spark.createDataFrame([(r.grp, int(s), n) for r, s, n in zip(large, at, pieces, strict=True)], "grp long, shard int, pieces int")
    kept = rows.join(F.broadcast(large), "grp", "left").withColumn("piece", F.expr("pmod(xxhash64(row), pieces)").cast("int"))
    hot = kept.filter("shard < 0").drop("shard")
    found = hot.groupBy("grp", "piece").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")).collect()
    found.sort(key=lambda r: (r.grp, r.piece))
    where = spark.createDataFrame([(r.grp, r.piece, int(s)) for r, s in zip(found, pack(vectors(found), left), strict=True)], "grp long, piece int, shard int")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                grp, *vectors = (c.to_numpy(zero_copy_only=False) for c in part.columns)
                to = pack_batch(np.stack(vectors, axis=1).astype(float), left, int(grp[0]) % shards)
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(to.astype(np.int32))], ["grp", "shard"])

    small = groups.filter(part <= LARGE).select("grp", *DIMS).coalesce(max(1, (total.groups or 0) // TOGETHER))
    small = scratch.keep(small.mapInArrow(place, "grp long, shard int"), "placed")
    hot = hot.join(F.broadcast(where), ["grp", "piece"])
    columns = ["doc_id", "size", "tokens", "text_crc32", "shard", "row"]
    rows = kept.filter("pieces is null").drop("shard").join(small, "grp").select(*columns)
    rows = rows.unionByName(kept.filter("shard >= 0").select(*columns)).unionByName(hot.select(*columns))

    buckets = max(1, -(-(total.n_rows or 0) // (shards * ROWS_PER_BUCKET)))
    rows = rows.withColumn("bucket", F.expr(f"pmod(xxhash64(row), {buckets}L)"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "bucket").count().withColumn("first", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row"))
    rows = rows.withColumn("inside", inside).join(first, ["shard", "bucket"])
    return rows.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("first") + F.col("inside") - 1).cast("long").alias("slot"))

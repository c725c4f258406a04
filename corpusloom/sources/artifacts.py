"""Published tables that are rebuilt only where their sources changed.

An artifact is a folder of generations, each a complete table; the last complete one is current. A row carries its document's source hash and the
version of the rules that made it. A crash while a generation is written leaves it without Spark's success mark, and nobody reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class VersionError(ValueError):
    """A published table was made by rules of another version."""


def source_hash(text: Column, identity: Column) -> Column:
    """SHA-256 of a text and of what is known of its document, as JSON with its fields in their order; null texts and identities count as empty."""
    return F.sha2(F.concat(F.coalesce(text, F.lit("")).cast("binary"), F.lit("\0").cast("binary"), F.coalesce(F.to_json(identity), F.lit("")).cast("binary")), 256)


def _generations(spark: SparkSession, at: str) -> list[int]:
    """The numbers of the complete generations, in order."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(at)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removeprefix("generation-")) for n in names if n.startswith("generation-") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{at}/{n}/_SUCCESS")))


def published(spark: SparkSession, at: str, schema: StructType, version: str, forced: bool = False) -> DataFrame:
    """The current table: an empty one with the same columns where none was published. Raises VersionError for another version's, unless ``forced``: then it counts as none."""
    done = _generations(spark, at)
    if not done:
        return spark.createDataFrame([], schema)
    table = spark.read.schema(schema).parquet(f"{at}/generation-{done[-1]}")
    other = table.filter(~F.col("version").eqNullSafe(F.lit(version))).select("version").limit(1).collect()
    if other and not forced:
        raise VersionError(f"{at} has version {other[0].version!r}, not {version!r}")
    return table.limit(0) if other else table


def refresh(docs: DataFrame, at: str, version: str, build: Callable[[DataFrame], DataFrame], schema: str, id_col: str = "doc_id", text_col: str = "text", identity: list[str] | None = None, forced: bool = False) -> DataFrame:
    """Publishes a new generation and returns it: ``id_col``, the columns of ``schema``, ``source_hash, version, rebuilt``.

    ``build`` makes rows ``id_col`` and ``schema`` from documents with the columns of ``docs``. It is given only those whose source hash the current
    generation doesn't have; rows of the others are taken over, and rows of documents that are gone are left out. A document for which build() gives no
    row is built again each time. Documents with a null id are not published. ``forced`` rebuilds after a change of version.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    whole = StructType.fromDDL(f"`{id_col}` {kind}, {schema}, source_hash string, version string, rebuilt boolean")
    known = F.struct(*[F.col(c) for c in identity]) if identity else F.lit(None).cast("struct<none:string>")
    now = docs.filter(F.col(id_col).isNotNull()).withColumn("source_hash", source_hash(F.col(text_col), known))
    old = published(spark, at, whole, version, forced)
    kept = old.join(now.select(id_col, "source_hash").distinct(), [id_col, "source_hash"], "left_semi").withColumn("rebuilt", F.lit(False))
    stale = now.join(old.select(id_col, "source_hash").distinct(), [id_col, "source_hash"], "left_anti")
    made = build(stale.drop("source_hash")).join(stale.select(id_col, "source_hash").distinct(), id_col).withColumns({"version": F.lit(version), "rebuilt": F.lit(True)})
    to = f"{at}/generation-{max(_generations(spark, at), default=0) + 1}"
    kept.select(whole.names).unionByName(made.select(whole.names)).write.mode("overwrite").parquet(to)
    return spark.read.schema(whole).parquet(to)

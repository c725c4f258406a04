"""Which patterns occur in which texts.

Patterns are dealt into batches of bounded size, each searched for at once by an automaton that tasks make from the batch; a text is read
where it lies and only what it holds leaves it. No pattern is compared with every text, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import Scratch, ship, spread

#: Characters of a batch of patterns, and so the bound of what is sent to the tasks at once.
MOST_CHARS = 1 << 20

#: The automaton of the batch that this process searched for last.
_last: tuple[str, object] = ("", None)


def _automaton(name: str, patterns: list[str]):
    global _last
    if _last[0] != name:
        import ahocorasick

        made = ahocorasick.Automaton()
        for p in patterns:
            made.add_word(p, p)
        made.make_automaton()
        _last = name, made
    return _last[1]


def _search(shared: Broadcast, name: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _automaton(name, shared.value)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1)):
                if text.is_valid:
                    met = sorted({p for _, p in tool.iter(text.as_py())})
                    rows += [i] * len(met)
                    found += met
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["id", "pattern"])

    return find


def occurrences(texts: DataFrame, patterns: DataFrame, id_col: str, text_col: str, pattern_col: str, most_chars: int = MOST_CHARS) -> DataFrame:
    """``id_col, pattern_col``: each pattern that occurs in a row's text, once for each row of ``texts``.

    Rows are told apart by nothing but their place, so rows with equal ids give their own. Null texts hold nothing; null and empty patterns occur nowhere;
    repeated patterns are one. Texts are read once for each ``most_chars`` characters of distinct patterns.
    """
    spark = texts.sparkSession
    ship(spark)
    kept = patterns.select(F.col(pattern_col).alias("pattern")).filter("pattern <> ''").distinct()
    kept = Scratch(spark, "patterns").keep(kept, "patterns")
    batches = -(-(kept.agg(F.sum(F.length("pattern"))).first()[0] or 0) // most_chars)
    rows = spread(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    schema = f"id {texts.schema[id_col].dataType.simpleString()}, pattern string"
    parts = []
    for b in range(batches):
        batch = [r.pattern for r in kept.filter(F.pmod(F.xxhash64("pattern"), F.lit(batches)) == b).collect()]
        if not batch:
            continue
        shared = spark.sparkContext.broadcast(batch)
        parts.append(rows.mapInArrow(_search(shared, f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"), schema))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return found.toDF(id_col, pattern_col)

"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A window is ``WINDOW`` consecutive words of an item, or the whole of a shorter item. A text's windows are told by the least hash of the
GRAM-word grams within them, so a window that a document shares with an item has the same least hash in both, whatever stands around it:
no shared span of WINDOW words is lost. Neighbouring windows mostly have one least hash. A bitmap of fixed size tells nearly all hashes that no item has
where the text lies; what is left is extended to all windows it stands for, which are joined to the items' by hash and words, and the words within equal ones
are counted once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import Scratch, spread

WINDOW, GRAM = 10, 5
#: Bits of the bitmap of the items' hashes, and of each of Spark's own bitmaps, of which it is made: 256 KiB for any number of items.
BITS, _MAP = 1 << 21, 1 << 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words, in lower-cased texts; and words, in any.
BETWEEN, WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once, also where functions within ``f`` read it for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def item_words(text: Column) -> Column:
    """Words of a text in order, A-Z in lower case; none for null."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.array_remove(F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), BETWEEN, -1), "")


def _each(last: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of each number from 1 to ``last``, none if that is less."""
    return F.transform(F.slice(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), 1, F.greatest(last, F.lit(0))), f)


def _least(words: Column, length: int) -> Column:
    """The least gram hash of each window of ``length`` words."""
    gram = min(GRAM, length)
    grams = _each(F.size(words) - gram + 1, lambda i: F.xxhash64(F.slice(words, i, gram)))
    if length == gram:
        return grams
    return _let(grams, lambda g: _each(F.size(words) - length + 1, lambda i: F.array_min(F.slice(g, i, length - gram + 1))))


def _runs(words: Column, length: int) -> Column:
    """Array of (length, least, first, last): windows that follow each other with one least hash, by the places of their first words."""
    starts = lambda least: F.filter(F.transform(least, lambda x, i: F.when(F.coalesce(F.get(least, i - 1) != x, F.lit(True)), F.struct(x.alias("least"), i.alias("first")))), lambda x: x.isNotNull())
    ended = lambda least: _let(
        starts(least), lambda s: F.transform(s, lambda x, i: F.struct(F.lit(length).alias("length"), x["least"].alias("least"), x["first"].alias("first"), (F.coalesce(F.get(s, i + 1)["first"], F.size(least)) - 1).alias("last")))
    )
    return _let(_least(words, length), ended)


def _window(words: Column, first: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(words, first + 1, length), " ")


def _placed(words: Column, length: int) -> Column:
    """Array of (least, first, window) of a text's windows."""
    return F.transform(_least(words, length), lambda x, i: F.struct(x.alias("least"), i.alias("first"), _window(words, i, length).alias("window")))


def windows(items: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, list[int]]:
    """Of the items: ``length, least, window, rep``, a row for each distinct window; ``rep, item``, each item that has it; and the lengths there are.

    ``rep`` is the least (item, place) of a window. Ids are strings; null counts as the empty one.
    """
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), item_words(F.col(text_col)).alias("words"))
    words = scratch.keep(words.filter(F.size("words") > 0).withColumn("length", F.least(F.lit(WINDOW), F.size("words"))), "items")
    lengths = sorted(r.length for r in words.select("length").distinct().collect())  # WINDOW at most
    placed = None
    for n in lengths:
        each = _placed(F.col("words"), n)
        part = words.filter(F.col("length") == n).select("item", "length", F.explode(each).alias("w")).select("item", "length", "w.*")
        placed = part if placed is None else placed.unionByName(part)
    if placed is None:
        placed = words.select("item", "length", F.lit(0).cast("long").alias("least"), F.lit(0).alias("first"), F.lit("").alias("window"))
    placed = scratch.keep(placed, "places")
    of = scratch.keep(placed.groupBy("length", "least", "window").agg(F.min(F.struct("item", "first")).alias("rep")), "windows")
    owners = scratch.keep(placed.select("window", "item").distinct().join(of.select("window", "rep"), "window").select("rep", "item"), "owners")
    return of, owners, lengths


def _marks(of: DataFrame) -> Column:
    """The bitmap of the items' hashes, as a constant array of Spark's bitmaps; BITS / _MAP rows at most come to the driver."""
    at = F.pmod("least", F.lit(BITS)) + 1
    maps = of.groupBy((F.bitmap_bucket_number(at) - 1).alias("id")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = {r["id"]: bytes(r.bits) for r in maps.collect()}
    return F.array(*[F.lit(bits.get(i, b"")) for i in range(BITS // _MAP)])


def _marked(marks: Column, least: Column) -> Column:
    """Whether a hash's bit is set: false surely means that no item has it."""
    at = F.pmod(least, F.lit(BITS))
    byte = F.substring(F.get(marks, F.shiftright(at, 15).cast("int")), (F.shiftright(at, 3) % (_MAP // 8) + 1).cast("int"), F.lit(1))
    return F.call_function("shiftright", F.ascii(F.decode(byte, "ISO-8859-1")), (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def hits(docs: DataFrame, items: DataFrame, scratch: Scratch, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``digest, first, length, rep`` of each window of an item in each text of ``docs``, and ``rep, item`` of the items' windows.

    ``digest`` is the MD5 of a text, ``first`` the place of the window's first word, from 0.
    """
    of, owners, lengths = windows(items, item_col, item_text_col, scratch)
    texts = spread(docs.select(F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("digest"), F.col(text_col).alias("text")))

    marks = _marks(of)

    def candidates(words: Column) -> Column:
        runs = F.concat(*[_runs(words, n) for n in lengths]) if lengths else F.expr("cast(array() as array<struct<length:int,least:bigint,first:int,last:int>>)")
        some = F.filter(runs, lambda r: _marked(marks, r["least"]))
        return F.flatten(F.transform(some, lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda i: F.struct(r["length"].alias("length"), r["least"].alias("least"), i.alias("first"), _window(words, i, r["length"]).alias("window")))))

    found = texts.select("digest", F.explode(_let(item_words(F.col("text")), candidates)).alias("w"))
    # the items' windows are a written table, whose size says whether it is broadcast or both sides are dealt out
    return found.select("digest", "w.*").join(of, ["length", "least", "window"]).select("digest", "first", "length", "rep"), owners


def covered(spans: Column) -> Column:
    """Words within spans (first, length), each once."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["first"] + s["length"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["first"] + s["length"] - F.greatest(a["end"], s["first"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, items, contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` has the ids of the items with occurring windows, as
    strings, sorted. Items that share an id, null included (it counts as the empty string), are one item. Null and blank texts have no words and no
    hits; items without words have no windows. Repeated rows give equal rows; an empty table of either kind gives no hits. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    found, owners = hits(docs, items, scratch, text_col, item_col, item_text_col)
    met = found.groupBy("digest").agg(F.collect_set(F.struct("first", "length")).alias("spans"), F.array_sort(F.collect_set("rep")).alias("reps"))
    met = scratch.keep(met.select("digest", covered(F.col("spans")).cast("long").alias("n_hit"), "reps"), "met")
    # texts with the same windows have the same items, which are listed once for them all
    sets = met.select("reps").distinct().select("reps", F.explode("reps").alias("rep")).join(owners, "rep")
    sets = sets.groupBy("reps").agg(F.array_sort(F.collect_set("item")).alias("items"))
    met = scratch.keep(met.join(sets, "reps").select("digest", "n_hit", "items"), "contaminated")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), F.unhex(F.md5(text)).alias("digest"))
    out = rows.join(met, "digest", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))

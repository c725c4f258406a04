"""Alignment of two tokenizers' tokens over the same bytes.

Texts are tokenised whole by both. An offset before a space-marked token of each, where tokens of both have ended, is an anchor: anchors
split a document into windows of token ids, most of them a word. What ends together within a window depends on its ids alone,
so each pair of id tuples is aligned once a task and remembered. Tokens that end together are linked.

Links' pairs are counted over the corpus in two steps, in the tasks and by pair. The counts of frequent pairs, at most FREQUENT, are sent to
the tasks; documents' other pairs meet theirs in a join.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import Scratch, send_file, sent_file, spread

#: Most pairs whose counts every task holds: those of the highest counts, of one power of two all or none.
FREQUENT = 1 << 18
#: Entries of a pool of words or windows, and their size in all, from which it starts anew; characters tokenised at a time; distinct pairs counted in a task before they leave it.
CACHE, CACHE_SIZE, TOGETHER, HELD = 1 << 18, 1 << 24, 1 << 19, 1 << 18
#: A pair is one number: its first id times this, plus its second.
SECOND = 1 << 32
#: A word with the blanks before it.
SPACED = re.compile(" +[^ ]*")
#: Where the first tokenizer takes blanks together with a white-space character before them.
TOGETHER_BLANKS = re.compile(r"[^\S ] (?:\s|\Z)")
# How byte-level vocabularies show bytes as characters; those in these ranges as themselves, the others from U+0100 on in order.
SHOWN = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Rows(NamedTuple):
    """Integers of several keys in one row, and how many each has."""

    flat: np.ndarray
    counts: np.ndarray


class Pool(dict):
    """Numbers of keys, in the order in which they came, with what ``make`` gives for new ones together: Rows of one kind or several, and marks."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make
        self.renew()

    def renew(self) -> None:
        self.clear()
        self.new, self.made, self.marks, self.size = [], None, [], 0

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def numbers(self, keys: list) -> np.ndarray:
        """The keys' numbers; those given before are void if the pool had grown over its bounds."""
        if len(self) > CACHE or self.size > CACHE_SIZE:
            self.renew()
        at = np.fromiter(map(self.__getitem__, keys), dtype=np.int64, count=len(keys))
        if self.new:
            rows, marks = self.make(self.new)
            self.made = [Rows(*map(np.concatenate, zip(x, y, strict=True))) for x, y in zip(self.made, rows, strict=True)] if self.made else rows
            self.marks += marks
            self.size += sum(map(len, self.new))
            self.new = []
        return at

    def gather(self, at: np.ndarray, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The integers of the keys numbered ``at``, one after another, and how many each has."""
        if not len(at):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        flat, counts = self.made[kind]
        return _cut(flat, (np.cumsum(counts) - counts)[at], counts[at])


def _cut(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes


class ByteLevel:
    """The tokenizer of a JSON file of byte-level BPE.

    Where ids are the order of merges, tiktoken with them for ranks gives the same ids, in a fifth of the time; else the file's own library is used.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, special = whole["model"], {x["id"] for x in whole["added_tokens"]}
        shown = [b for first, last in SHOWN for b in range(first, last + 1)]
        byte = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.tokens = {i: bytes(byte[c] for c in x) for x, i in model["vocab"].items() if i not in special}
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if all(model["vocab"][m.replace(" ", "")] == 256 + i for i, m in enumerate(merged)) and len(self.tokens) == 256 + len(merged):
            import tiktoken

            self.encode = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={x: i for i, x in self.tokens.items()}, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            self.encode = lambda text: t.encode(text, add_special_tokens=False).ids


class Pieces:
    """The tokenizer of a sentencepiece model, of the text behind a given first blank."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = {i: bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces) if not self.model.is_control(i) and not self.model.is_unknown(i)}
        self.blank, self.by_words = [self.model.piece_to_id("▁")], not any(re.search("[^▁]▁", x) for x in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that start with a blank, which the model adds itself, but not to nothing."""
        return [x or self.blank for x in self.model.encode([t[1:] for t in texts], num_threads=1)]


class Both:
    """The ids of two tokenizers for texts that start with a blank. Whole texts are tokenised, in parts that both split them into at any rate.

    A part is a run of blanks and what stands up to the next. No piece of the second vocabulary has a blank behind another character (else texts
    are not split), so no merge reaches over the start of a part; the first splits there itself, but where another white-space character stands before
    a blank that more white space or the end follows: such texts are one part. Distinct parts are tokenised once.
    """

    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.by_words = b.by_words

        def tokens(parts: list[str]) -> tuple[list[Rows], list]:
            made = list(map(a.encode, parts)), b.encode(parts)
            return [Rows(np.fromiter(chain.from_iterable(x), dtype=np.int64), np.fromiter(map(len, x), dtype=np.int64)) for x in made], []

        self.pool = Pool(tokens)

    def encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        """For either tokenizer the ids of each text."""
        parts = [(SPACED.findall(x) if self.by_words and not TOGETHER_BLANKS.search(x) else [x]) if x else [] for x in texts]
        at, ends = self.pool.numbers(list(chain.from_iterable(parts))), np.cumsum([0, *map(len, parts)])
        out = []
        for kind in range(2):
            ids, sizes = self.pool.gather(at, kind)
            cuts = np.concatenate(([0], np.cumsum(sizes)))[ends]
            out.append([ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
        return out


class Tokens:
    """Byte lengths and space marks of a tokenizer's tokens, and their bytes in one row, by id."""

    def __init__(self, tokenizer: ByteLevel | Pieces) -> None:
        named = [tokenizer.tokens.get(i, b"") for i in range(max(tokenizer.tokens) + 1)]
        self.size = np.array([len(x) for x in named])
        self.spaced = np.array([x[:1] == b" " for x in named])
        self.flat, self.starts = np.frombuffer(b"".join(named), dtype=np.uint8), np.cumsum(self.size) - self.size
        if not all(tokenizer.tokens.values()):
            raise ValueError("a token without bytes ends where another does")

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return _cut(self.flat, self.starts[ids], self.size[ids])[0]


#: Set in the ids of the second tokenizer within a window's key.
_SECOND_MARK = 1 << 31


class Aligner:
    """Aligns texts of which several are taken up together: their tokens stand in one row for each tokenizer, over the same bytes."""

    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.both, self.a, self.b = Both(a, b), Tokens(a), Tokens(b)
        self.windows = Pool(self._aligned)
        ids = [f"{i},".encode() for i in range(max(len(self.a.size), len(self.b.size)))]
        self.digits, self.n_digits = np.frombuffer(b"".join(ids), dtype=np.uint8), np.array([len(x) for x in ids])
        self.digits_at = np.cumsum(self.n_digits) - self.n_digits

    def _aligned(self, keys: list[bytes]) -> tuple[list[Rows], list[str]]:
        """The pairs of windows' links, how many each has, and its groups as text with a semicolon behind each.

        A window's key has its ids as 32-bit integers, those of the second tokenizer behind the first's and marked. Both sides of a window are as
        many bytes, so offsets agree all along the windows.
        """
        row = np.frombuffer(b"".join(keys), dtype="<u4").astype(np.int64)
        window, second = np.repeat(np.arange(len(keys)), [len(k) // 4 for k in keys]), row >= _SECOND_MARK
        a, b = row[~second], row[second] - _SECOND_MARK
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        met = np.zeros(int(ends_a[-1]) + 1, dtype=np.int8)
        met[ends_a] += 1
        met[ends_b] += 1
        last_a, last_b = met[ends_a] == 2, met[ends_b] == 2
        pairs = a[last_a] * SECOND + b[last_b]
        counts = np.bincount(window[~second][last_a], minlength=len(keys))
        # the ids of each group, the first tokenizer's before the second's, each with the sign behind it
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n_a, n_b = np.bincount(group_a), np.bincount(group_b)
        ids, last = np.empty(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.uint8)
        place_a, place_b = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a], np.arange(len(b)) + np.cumsum(n_a)[group_b]
        ids[place_a], ids[place_b], last[place_a[last_a]], last[place_b[last_b]] = a, b, ord("|"), ord(";")
        text, sizes = _cut(self.digits, self.digits_at[ids], self.n_digits[ids])
        ends = np.cumsum(sizes)
        text[ends[last > 0] - 1] = last[last > 0]
        whole = text.tobytes().decode()
        stops = ends[np.cumsum(np.bincount(window)) - 1].tolist()
        return [Rows(pairs, counts)], list(map(whole.__getitem__, map(slice, [0, *stops[:-1]], stops)))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], list[np.ndarray]]:
        """Of each text: the numbers of its tokens and of its groups, its groups as text, the pairs of its links in order."""
        spaced = [" " + t if t else "" for t in texts]
        want = [x.encode() for x in spaced]
        a, b = self.both.encode(spaced)
        for i, w in enumerate(want):
            if self.a.bytes(a[i]).tobytes() != w or self.b.bytes(b[i]).tobytes() != w:
                a[i], b[i] = a[i][:0], b[i][:0]
        n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        ids, first_a = self._windows(np.concatenate(a), np.concatenate(b))
        flat, links = self.windows.gather(ids)
        # a window belongs to the text that its first token does
        cuts = np.searchsorted(first_a, np.concatenate(([0], np.cumsum(n_a))))
        in_order, strings = ids.tolist(), self.windows.marks
        groups = ["".join(map(strings.__getitem__, in_order[i:j]))[:-1] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        ends = np.concatenate(([0], np.cumsum(links)))[cuts]
        return n_a, n_b, np.diff(ends), groups, [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def _windows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of two rows of ids over the same bytes, as numbers in the pool, and the place of each one's first token.

        Both rows start with a marked token, as every text does.
        """
        if not len(a):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        starts_a, starts_b = (np.cumsum(t.size[x]) - t.size[x] for t, x in ((self.a, a), (self.b, b)))
        anchor = np.zeros(int(starts_a[-1]) + 1 + int(self.a.size[a[-1]]), dtype=np.int8)
        marked_a, marked_b = np.flatnonzero(self.a.spaced[a]), np.flatnonzero(self.b.spaced[b])
        anchor[starts_a[marked_a]] += 1
        anchor[starts_b[marked_b]] += 1
        first_a, first_b = marked_a[anchor[starts_a[marked_a]] == 2], marked_b[anchor[starts_b[marked_b]] == 2]
        # each window's ids of the first tokenizer, then those of the second, in one row of bytes
        n_a, n_b = np.diff(np.append(first_a, len(a))), np.diff(np.append(first_b, len(b)))
        row = np.empty(len(a) + len(b), dtype="<u4")
        row[np.arange(len(a)) + np.repeat(first_b, n_a)] = a
        row[np.arange(len(b)) + np.repeat(first_a + n_a, n_b)] = b + _SECOND_MARK
        ends = 4 * np.cumsum(n_a + n_b)
        whole, ends = row.tobytes(), ends.tolist()
        return self.windows.numbers(list(map(whole.__getitem__, map(slice, [0, *ends[:-1]], ends)))), first_a


def _counted_in_texts(pairs: list[np.ndarray]) -> tuple[list[bytes], list[bytes]]:
    """The distinct pairs of each text and how often it has them, packed."""
    n = np.array([len(x) for x in pairs])
    kinds, at = np.unique(np.concatenate(pairs), return_inverse=True)
    keys, times = np.unique(np.repeat(np.arange(len(pairs)), n) * max(len(kinds), 1) + at, return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(pairs) + 1) * max(len(kinds), 1)).tolist()
    names, times = kinds[keys % max(len(kinds), 1)].astype("<i8").tobytes() if len(keys) else b"", times.astype("<i4").tobytes()
    return [names[8 * i : 8 * j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], [times[4 * i : 4 * j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(ByteLevel(a_path), Pieces(b_path))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, groups, pairs, times``.

    The first tokenizer gets a blank and the text, the second the text, to which it adds the blank. ``groups`` lists the ids of each
    stretch between offsets where both end, ``a1,a2|b1;a3|b2``. ``pairs`` are the distinct pairs of linked ids, SECOND times the first plus the second, as
    little-endian 64-bit integers in a binary, and ``times`` how many links have each, as 32-bit ones. Null and empty texts, and those
    whose tokens don't give their bytes back, have no tokens. Ids stay as they are, null and shared ones too; so do repeated rows; an empty table
    gives an empty table. A text is held whole in one task with its tokens.
    """
    names = send_file(docs.sparkSession, a_path), send_file(docs.sparkSession, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _aligner(*map(sent_file, names))
        for batch in batches:
            i = 0
            for texts in _some(batch.column(1)):
                n_a, n_b, n_groups, groups, pairs = tool.texts(texts)
                kinds, times = _counted_in_texts(pairs)
                columns = [*(pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups)), pa.array(groups, pa.string()), pa.array(kinds, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), *columns], ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])
                i += len(texts)

    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups string, pairs binary, times binary")


def _some(column: pa.Array) -> Iterator[list[str | None]]:
    held, size = [], 0
    for x in column:
        x = x.as_py()
        held.append(x)
        size += len(x or "")
        if size > TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _unpacked(batch: pa.RecordBatch, pairs: str = "pairs", times: str = "times") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, pair and times of each entry of a batch."""
    p, t = batch.column(pairs).to_pylist(), batch.column(times).to_pylist()
    return np.repeat(np.arange(len(p)), [len(x) // 8 for x in p]), np.frombuffer(b"".join(p), dtype="<i8"), np.frombuffer(b"".join(t), dtype="<i4")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        n = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(n, at, np.concatenate([n for _, n in held]))
        return pairs, n

    for batch in batches:
        _, pairs, times = _unpacked(batch)
        held.append((pairs, times.astype(np.int64)))
        if sum(len(p) for p, _ in held) > 4 * HELD:
            held = [summed()]
            if len(held[0][0]) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["pair", "n"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["pair", "n"])


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, n, best`` over all rows of align(): how many links have a pair, and whether no other pair of its second id has more."""
    counts = rows.select("pairs", "times").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("b", F.col("pair") % SECOND)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of the second vocabulary
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(rows: DataFrame, scratch: Scratch, frequent: int = FREQUENT) -> DataFrame:
    """The rows of align() with ``n_links, n_best, count_sum``: a row's links, those of pairs with ``best``, and the counts of their pairs, summed.

    ``rows`` must be a written table, with a column ``row`` that no two rows share. ``frequent`` only says how counts are held.
    """
    spark = rows.sparkSession
    counts = scratch.keep(pair_counts(rows), "counts")
    least, so_far = None, 0
    levels = counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("pairs")).collect()
    for r in sorted(levels, key=lambda r: -r.level):
        so_far += r.pairs
        if so_far > frequent:
            break
        least = 2**r.level
    top = counts.filter(F.col("n") >= least).toArrow().sort_by("pair") if least else counts.limit(0).toArrow()
    shared = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n, best = shared.value
        for batch in batches:
            of, pairs, times = _unpacked(batch)
            at = np.minimum(np.searchsorted(names, pairs), max(len(names) - 1, 0))
            there = names[at] == pairs if len(names) else np.zeros(len(pairs), dtype=bool)
            links, in_best, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            np.add.at(links, of, times)
            np.add.at(in_best, of[there], times[there] * best[at[there]])
            np.add.at(total, of[there], times[there] * n[at[there]])
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, (links, in_best, total))], ["row", "n_links", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value[0]
        for batch in batches:
            of, pairs, times = _unpacked(batch)
            at = np.minimum(np.searchsorted(names, pairs), max(len(names) - 1, 0))
            rest = names[at] != pairs if len(names) else np.ones(len(pairs), dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(of[rest])), pa.array(pairs[rest]), pa.array(times[rest].astype(np.int64))], ["row", "pair", "times"])

    packed = rows.select("row", "pairs", "times")
    parts = packed.mapInArrow(known, "row long, n_links long, n_best long, count_sum long")
    rare = counts.filter(F.col("n") < least) if least else counts
    rest = packed.mapInArrow(others, "row long, pair long, times long").join(rare, "pair")
    rest = rest.select("row", F.lit(0).cast("long").alias("n_links"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = parts.unionByName(rest).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    return rows.drop("pairs", "times").join(sums, "row")

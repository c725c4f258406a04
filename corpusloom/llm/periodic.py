"""Periodic runs of words, by recompression.

Texts become sequences of word numbers. Rounds of block compression (a maximal block of one symbol becomes one symbol) and pair
compression (symbols are dealt to a left and a right side; every left symbol with a right one behind it becomes one symbol) give a run-length
grammar: equal stretches are parsed alike but at their edges. The longest common extension of two places climbs the grammar from both while they
agree, comparing one block or pair a level, and descends to the word that differs, for all queries of a batch at once.

A run of period p and four periods or more has a multiple of 2p from its text's start within, two periods before its end. On this harmonic
grid, n / 2p places for each p, places whose words recur one period on are extended both ways, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import spread

#: A run's least length, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words taken up together (a longer text alone), and candidates of the grid held at a time.
TOGETHER, HELD = 1 << 18, 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Equal keys, equal numbers from 0."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int32)


class Grammar:
    """The levels of a recompressed sequence, up to one whose symbols all differ.

    ``symbols[t]`` are the symbols of level t. ``up[t]`` says in which symbol of level t + 1 each lies, ``first[t]`` and ``last[t]`` which
    symbols of level t each of level t + 1 begins and ends with. Even levels' symbols are compressed as blocks, odd ones' as pairs.
    """

    def __init__(self, sequence: np.ndarray) -> None:
        self.symbols, self.up, self.first, self.last = [_numbered(sequence)], [], [], []
        rng = np.random.default_rng(1)
        while (kinds := int(self.symbols[-1].max()) + 1) < (n := len(s := self.symbols[-1])):
            starts = np.ones(n, dtype=bool)
            if len(self.up) % 2 == 0:
                starts[1:] = s[1:] != s[:-1]
            else:
                left = rng.random(kinds) < 0.5
                starts[1:] = ~(left[s[:-1]] & ~left[s[1:]])
            first = np.flatnonzero(starts).astype(np.int32)
            last = np.append(first[1:], n).astype(np.int32) - 1
            # in a block all symbols are one, so its length tells it; in a pair, so does the second symbol
            tail = last - first if len(self.up) % 2 == 0 else np.where(last > first, s[last] + 1, 0)
            self.up.append(np.cumsum(starts, dtype=np.int32) - 1)
            self.first.append(first)
            self.last.append(last)
            self.symbols.append(_numbered(s[first].astype(np.int64) * (int(tail.max()) + 1) + tail))

    def extensions(self, x: np.ndarray, y: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many symbols from places x on (or back, x included) equal those from y on. x and y differ, and a symbol that is nowhere else ends every match."""
        step, edge, far = (1, self.first, self.last) if forward else (-1, self.last, self.first)
        a, b = x.astype(np.int64), y.astype(np.int64)
        found = np.zeros(len(a), dtype=np.int16)  # the level at which symbols differ
        going = np.arange(len(a))
        for t, up in enumerate(self.up):
            s, p, q = self.symbols[t], a[going], b[going]
            same = s[p] == s[q]
            found[going[~same]] = t
            going, p, q = going[same], p[same], q[same]
            inside = (edge[t][up[p]] != p) | (edge[t][up[q]] != q)
            # within a symbol of the next level: past the rest of the block that is shorter, or past the second of a pair
            rest = np.minimum(np.abs(far[t][up[p]] - p), np.abs(far[t][up[q]] - q)) + 1 if t % 2 == 0 else 1
            move = np.where(inside, rest, 0) * step
            p, q = p + move, q + move
            met = (edge[t][up[p]] == p) & (edge[t][up[q]] == q)
            found[going[~met]] = t
            a[going], b[going] = np.where(met, up[p], p), np.where(met, up[q], q)
            going = going[met]
        found[going] = len(self.up)
        for t in range(len(self.up) - 1, -1, -1):
            down = np.flatnonzero(found > t)
            s, p, q = self.symbols[t], edge[t][a[down]].astype(np.int64), edge[t][b[down]].astype(np.int64)
            same = s[p] == s[q]
            move = same if t % 2 else np.where(same, np.minimum(np.abs(far[t][a[down]] - p), np.abs(far[t][b[down]] - q)) + 1, 0)
            a[down], b[down] = p + move * step, q + move * step
        return np.abs(a - x)


def _grid(sizes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the grids of texts of ``sizes`` words that begin at ``begins``, some at a time."""
    texts = np.flatnonzero(sizes >= LEAST_WORDS)
    most = sizes[texts] // LEAST_PERIODS
    of, period = np.repeat(texts, most), np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most) + 1
    count = sizes[of] // (2 * period)
    cuts = np.unique([0, *np.searchsorted(np.cumsum(count), np.arange(HELD, count.sum(), HELD)), len(count)])
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        n, p = count[i:j], period[i:j]
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(p, n)
        yield np.repeat(begins[of[i:j]], n) + turn * 2 * p, p


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of numbers (not negative) its runs, rows (start, length, period) by start, then period.

    A run is a stretch with smallest period p, of LEAST_WORDS and LEAST_PERIODS * p or more, that can't be extended with period p.
    """
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    ends = np.cumsum(sizes + 1)  # where the symbols between texts are; they have numbers of their own
    whole = np.empty(int(ends[-1]) + 1 if len(texts) else 1, dtype=np.int64)
    whole[0] = -1
    begins = ends - sizes
    for x, i, k in zip(texts, begins, range(len(texts)), strict=True):
        whole[i : i + len(x)], whole[i + len(x)] = x, -2 - k
    kept = [(np.empty(0, dtype=np.int64),) * 2]
    for at, p in _grid(sizes, begins):
        for part in range(3):  # the first, middle and last of the words that must recur
            place = at + (0, p // 2, p - 1)[part]
            same = whole[place] == whole[place + p]
            at, p = at[same], p[same]
        kept.append((at, p))
    at, p = (np.concatenate(c) for c in zip(*kept, strict=True))
    if not len(at):
        return [np.empty((0, 3), dtype=np.int64)] * len(texts)
    # only texts with candidates enter the grammar
    of = np.searchsorted(ends, at)
    some = np.unique(of)
    parts, shift, size = [whole[:1]], np.zeros(len(texts), dtype=np.int64), 1
    for k in some:
        parts.append(whole[begins[k] : ends[k] + 1])
        shift[k] = size - begins[k]
        size += len(parts[-1])
    grammar = Grammar(np.concatenate(parts))
    found = []
    for i in range(0, len(at), HELD):
        x, period, text = at[i : i + HELD] + shift[of[i : i + HELD]], p[i : i + HELD], of[i : i + HELD]
        after, before = grammar.extensions(x, x + period), grammar.extensions(x - 1, x - 1 + period, forward=False)
        length = before + period + after
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append(np.stack((text, x - before - shift[text] - begins[text], length, period), axis=1)[long])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a stretch that has a period and a multiple of it is the same stretch for both: the least one stays
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[i:j, 1:] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def collapsed(words: list[bytes], of: np.ndarray) -> bytes:
    """The words that no run of ``of`` has after its first period, joined by blanks."""
    if not len(of):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, of[:, 0] + of[:, 2], 1)
    np.add.at(edges, of[:, 0] + of[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)])


def _batches(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """Words of the texts to be taken up together."""
    held, size = [], 0
    for text in column:
        words = (text.as_py() or "").encode().split()  # bytes: blanks of ASCII only, U+0020 and U+0009 to U+000D
        if held and size + len(words) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, runs, collapsed``.

    ``runs`` is an array of (start, length, period) in words, by start, then period; ``collapsed`` the words that stay when each run keeps
    its first period, joined by one blank. Words are runs without U+0020 and U+0009 to U+000D. A null or blank text has no words, no runs and an
    empty ``collapsed``. Ids, null and shared ones included, and repeated rows stay as they are; an empty table gives an empty table. A text is read whole in one task, in memory in
    proportion to its length.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in _batches(batch.column(1)):
                numbers: dict[bytes, int] = {}
                found = runs([np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words)) for words in texts])
                flat = np.concatenate(found)
                entries = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32()), entries)
                rest = pa.array([collapsed(w, x).decode() for w, x in zip(texts, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), lists, rest], ["doc_id", "runs", "collapsed"])
                done += len(texts)

    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(read, f"doc_id {docs.schema[id_col].dataType.simpleString()}, runs {RUNS}, collapsed string")

"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer.

Texts are split without regular expressions. Code points become classes; each class is a transition function over eight states,
and function composition is associative, so blocks of a text compose their functions side by side, a scan over the blocks
gives the state each begins in, and a second pass gives the state before each character. State and class say where pieces start.
Pieces are merged by rank and cached; token end offsets are kept with the ids.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import spread

LETTER, NUMBER, OTHER, SPACE, BLANK, SHORT, LONG, END = range(8)
#: States: at a start; in a run of letters, numbers, others; after a space, another blank; one or two letters left of a contraction.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)
SENTINEL = 0x110000
#: Code points with the White_Space property.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers that Unicode 16.0, which the tokenizer library goes by, has beyond 15.1.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Characters scanned at a time, and the length of a block.
CHUNK, BLOCK = 1 << 20, 256
CACHE, LONGEST_CACHED = 1 << 17, 48


@lru_cache(1)
def classes() -> np.ndarray:
    """Class by code point; the sentinel after each text has its own."""
    major = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(SENTINEL)).encode(), dtype=np.uint8)
    out = np.full(SENTINEL + 1, OTHER, dtype=np.uint8)
    out[:-1][major == ord("L")] = LETTER
    out[:-1][major == ord("N")] = NUMBER
    for kind, added in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for first, last in added:
            out[first : last + 1] = kind
    out[WHITE] = BLANK
    out[0x20] = SPACE
    out[SENTINEL] = END
    return out


@lru_cache(1)
def transitions() -> np.ndarray:
    """The state after a character, by class and the state before it."""
    t = np.zeros((8, 8), dtype=np.uint8)
    for kind, to in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (SPACE, AFTER_SPACE), (BLANK, AFTER_BLANK), (SHORT, ONE_LEFT), (LONG, TWO_LEFT), (END, START)):
        t[kind] = to
    for kind in (SHORT, LONG):  # an apostrophe inside a run, or after a space that joins it, is like any other character
        t[kind, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
    t[LETTER, TWO_LEFT], t[LETTER, ONE_LEFT] = ONE_LEFT, START
    return t


def _states(kind: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The state before each character, and that after the last, from the state before the first."""
    step = transitions().ravel()
    n = len(kind)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, END, dtype=np.uint8)
    padded[:n] = kind
    by_column = np.ascontiguousarray(padded.reshape(rows, BLOCK).T).astype(np.intp) * 8
    function = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in by_column:
        function = step[column[:, None] + function]
    reach = 1
    while reach < rows:  # compose each block's function with those before it, twice as far in each round
        function[reach:] = np.take_along_axis(function[reach:], function[:-reach].astype(np.intp), axis=1)
        reach *= 2
    now = np.concatenate(([state], function[:-1, state])).astype(np.uint8)
    before = np.empty((BLOCK, rows), dtype=np.uint8)
    for i, column in enumerate(by_column):
        before[i] = now
        now = step[column + now]
    before = before.T.ravel()
    last = int(step[int(kind[-1]) * 8 + int(before[n - 1])])
    return before[:n], last


def piece_starts(points: np.ndarray) -> np.ndarray:
    """True where a piece starts, for code points of texts that each end with the sentinel."""
    kind = classes()[points]
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        ahead = np.append(points, [SENTINEL] * 2)
        a, b = ahead[quote + 1], ahead[quote + 2]
        pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        kind[quote[np.isin(a, [ord(x) for x in "stmd"])]] = SHORT
        kind[quote[pair]] = LONG
    blank = (kind == SPACE) | (kind == BLANK)
    # a run of blanks before a character gives its last one to that character or leaves it alone
    ends = blank & ~np.append(blank[1:] | (kind[1:] == END), True)
    starts = np.empty(len(points), dtype=bool)
    state = START
    for i in range(0, len(points), CHUNK):
        part = kind[i : i + CHUNK]
        before, state = _states(part, state)
        go_on = np.zeros((8, 8), dtype=bool)  # class, state: the character belongs to the piece before it
        go_on[LETTER, [IN_LETTERS, AFTER_SPACE, ONE_LEFT, TWO_LEFT]] = True
        go_on[NUMBER, [IN_NUMBERS, AFTER_SPACE]] = True
        for x in (OTHER, SHORT, LONG):
            go_on[x, [IN_OTHERS, AFTER_SPACE]] = True
        for x in (SPACE, BLANK):
            go_on[x, [AFTER_SPACE, AFTER_BLANK]] = True
        starts[i : i + CHUNK] = ~go_on.ravel()[part.astype(np.intp) * 8 + before]
    return starts | ends


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a piece: the adjacent pair of least rank, leftmost first, is joined until no pair has a rank."""
    if piece in ranks:
        return (ranks[piece],)
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, end = heapq.heappop(heap)
        if gone[i] or after[i] >= n or after[after[i]] != end:
            continue
        gone[after[i]] = 1
        after[i] = end
        before[end] = i
        if end < n and (r := ranks.get(piece[i : after[end]])) is not None:
            heapq.heappush(heap, (r, i, after[end]))
        if i and (r := ranks.get(piece[before[i] : end])) is not None:
            heapq.heappush(heap, (r, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(out)


class Merged(dict):
    """Ids by piece, merged on first sight; the older half goes when it is full."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        got = self.old.get(piece) or merge(piece.encode(), self.ranks)
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class Tokenizer:
    """Encoder and decoder of a rank file: a line for each token, its bytes in base64 and its rank."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(x) for x in self.tokens], dtype=np.uint32)
        self.merged = Merged(self.ranks)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        points = [np.frombuffer(x.encode("utf-32-le"), dtype="<u4") for x in texts]
        end = np.array([SENTINEL], dtype="<u4")
        whole = np.concatenate([y for x in points for y in (x, end)])
        at = np.flatnonzero(piece_starts(whole))
        out, first = [], 0
        bounds = np.cumsum([len(x) + 1 for x in points])
        ends = np.searchsorted(at, bounds - 1)
        begins = np.searchsorted(at, np.concatenate(([0], bounds[:-1])))
        for text, stop, i, j in zip(texts, bounds, begins, ends, strict=True):
            cuts = [*(at[i:j] - first).tolist(), len(text)]
            pieces = map(text.__getitem__, map(slice, cuts[:-1], cuts[1:]))
            out.append(np.fromiter(chain.from_iterable(map(self.merged.__getitem__, pieces)), dtype="<u4"))
            first = stop
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


#: Characters encoded at a time, and rows of a batch taken up at a time; a longer text is encoded alone.
TOGETHER, ROWS = 1 << 20, 512


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Position and texts of the rows to be encoded together; only these are held as Python strings."""
    at, held, size = 0, [], 0
    for i in range(0, len(column), ROWS):
        for x in column.slice(i, ROWS).to_pylist():
            x = x or ""
            if held and size + len(x) > TOGETHER:
                yield at, held
                at, held, size = at + len(held), [], 0
            held.append(x)
            size += len(x)
    if held:
        yield at, held


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids, ends`` and, if asked for, ``decoded``.

    ``ids`` and ``ends``, the byte offset at which each token ends, are little-endian unsigned 32-bit integers in a binary;
    ``decoded`` is what decode() gives for them, made where the ids are. A null text is empty and has no tokens. Rows stay in
    their partitions, and ids keep their type; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for i, texts in _groups(batch.column(1)):
                ids = t.encode(texts)
                ends = [np.cumsum(t.lengths[x], dtype="<u4") for x in ids]
                columns = [batch.column(0).slice(i, len(texts)), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in ends], pa.binary())]
                if decoded:
                    columns.append(pa.array([_decoded(t, x, y) for x, y in zip(ids, ends, strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "ends", "decoded"][: len(columns)])

    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary, ends binary" + ", decoded binary" * decoded)


def _decoded(t: Tokenizer, ids: np.ndarray, ends: np.ndarray) -> bytes:
    out = t.decode(ids)
    if len(out) != (ends[-1] if len(ends) else 0):
        raise ValueError("token offsets and decoded bytes disagree")
    return out


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encode() with ``decoded``, the bytes of the tokens, which end where the last token's offset says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids, ends = ([np.frombuffer(x, dtype="<u4") for x in part.column(c).to_pylist()] for c in (2, 3))
                yield part.append_column("decoded", pa.array([_decoded(t, x, y) for x, y in zip(ids, ends, strict=True)], pa.binary()))

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, ends binary, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of texts encoded and decoded again."""
    both = encode(docs, path, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Media columns: payloads as PNG images in content-addressed tar shards, found again by offset and length.

Each content is stored once, under its SHA-256, in the tar shards of one task in the shared folder. A payload that only one row has is
written where the row lies; payloads that several may have, as a bitmap of repeated digests tells, are first brought to one row for each
digest, copies within a task before any exchange. Rows carry digest, shard, offset and length, never the payload. A range read of an
image's first 33 bytes fills its metadata columns.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bitmaps import bitmap, there
from corpusloom.session import Scratch, spread

WIDTH = 64
SHARD_BYTES = 64 << 20
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
STORED = "digest string, shard string, offset long, length long"
#: Digests remembered in a task, so that a payload leaves it once.
_REMEMBERED = 1 << 16


def payload(raw: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of WIDTH."""
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes) -> bytes:
    """An 8-bit grey image of WIDTH samples a row, which holds the samples without loss."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # a zero before each row: no filter
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def png_header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from an image's first HEADER_BYTES bytes."""
    if start[:8] != _SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", start[16:25])


def from_png(image: bytes) -> np.ndarray:
    """Samples of an image of to_png(), one row of the array for each of its rows."""
    width, height, _ = png_header(image)
    at, packed = 8, []
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        if image[at + 4 : at + 8] == b"IDAT":
            packed.append(image[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)[:, 1:]


def tar_header(name: str, size: int) -> bytes:
    head = bytearray(512)
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"%011o\0" % 0), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(value)] = value
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


class _Shards:
    """Tar shards that one task writes, named after its attempt: a task that is run again writes shards of its own."""

    def __init__(self, root: str, part: str) -> None:
        self.fs, self.folder = open_folder(root)
        self.fs.create_dir(self.folder, recursive=True)
        task = TaskContext.get()
        self.base = f"{part}-{task.partitionId():06d}-{task.taskAttemptId()}"
        self.out, self.name, self.size, self.count = None, "", 0, 0

    def add(self, digest: str, samples: bytes) -> tuple[str, str, int, int]:
        """Digest, shard, offset and length of the image."""
        if self.out is None or self.size >= SHARD_BYTES:
            self.close()
            self.name, self.size, self.count = f"{self.base}-{self.count}.tar", 0, self.count + 1
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        image = to_png(samples)
        self.out.write(tar_header(f"{digest}.png", len(image)))
        self.out.write(image)
        self.out.write(bytes(-len(image) % 512))
        at = self.size + 512
        self.size += 512 + len(image) + -len(image) % 512
        return digest, self.name, at, len(image)

    def close(self) -> None:
        if self.out:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the payloads to shards; returns ``doc_id, n_bytes, digest`` of each row, and ``digest, shard, offset, length`` of each content.

    A null text is stored as an empty one; ids keep their type; rows that repeat share one content. Both are written tables: reading
    them writes nothing, and the second names the shards of those runs of tasks that counted.
    """
    scratch = Scratch(docs.sparkSession, "media")
    root = scratch.path("shards")
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw")))
    n = F.octet_length("raw")
    padded = F.rpad(F.col("raw"), F.greatest(F.lit(1), F.ceil(n / WIDTH)).cast("int") * WIDTH, F.lit(b"\0"))
    names = scratch.keep(rows.select("doc_id", n.cast("long").alias("n_bytes"), F.sha2(padded, 256).alias("digest")), "names")
    repeated = names.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(repeated, F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The contents of single rows go to shards; of others each payload leaves the task, once as long as it is remembered."""
        shards, remembered = _Shards(root, "single"), set()
        try:
            for batch in batches:
                done = []
                for raw in batch.column(0):
                    samples = payload(raw.as_py())
                    digest = hashlib.sha256(samples).hexdigest()
                    if not there(bits.value, np.array([int(digest[:15], 16)]))[0]:
                        done.append((*shards.add(digest, samples), None))
                    elif digest not in remembered:
                        if len(remembered) >= _REMEMBERED:
                            remembered.clear()
                        remembered.add(digest)
                        done.append((digest, None, None, None, samples))
                    if len(done) >= 256:
                        yield _batch(done)
                        done = []
                if done:
                    yield _batch(done)
        finally:
            shards.close()

    def write_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(root, "repeated")
        try:
            for batch in batches:
                done = [(*shards.add(digest.as_py(), samples.as_py()), None) for digest, samples in zip(*batch.columns, strict=True)]
                if done:
                    yield _batch(done).drop_columns(["samples"])
        finally:
            shards.close()

    first = scratch.keep(rows.select("raw").mapInArrow(write, f"{STORED}, samples binary"), "first")
    once = first.filter("samples is not null").select("digest", "samples").dropDuplicates(["digest"])
    once = scratch.keep(once.mapInArrow(write_once, STORED), "once")
    single = first.filter("samples is null").drop("samples")
    stored = single.unionByName(once).withColumn("shard", F.concat(F.lit(f"{root}/"), "shard"))
    return names, stored


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["digest", "shard", "offset", "length", "samples"])


def _ranges(batches: Iterator[pa.RecordBatch], read, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Adds the columns that read(file, offset, length) gives; one shard is open at a time."""
    shard, file = None, None
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")]
        rows = []
        for path, offset, length in zip(*cols, strict=True):
            if path != shard:
                if file:
                    file.close()
                fs, at = open_folder(path)
                shard, file = path, fs.open_input_file(at)
            rows.append(read(file, offset, length))
        for i, (name, kind) in enumerate(zip(names, types, strict=True)):
            batch = batch.append_column(name, pa.array([r[i] for r in rows], kind))
        yield batch
    if file:
        file.close()


def _declared(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def headers(index: DataFrame) -> DataFrame:
    """The index of contents with ``width, height, bit_depth``, read from the images' headers alone."""

    def read(file, offset: int, length: int) -> tuple[int, int, int]:
        return png_header(file.read_at(HEADER_BYTES, offset))

    return index.mapInArrow(lambda batches: _ranges(batches, read, ["width", "height", "bit_depth"], [pa.int64()] * 3), f"{_declared(index)}, width long, height long, bit_depth long")


def features(index: DataFrame) -> DataFrame:
    """The index of contents with digests and features of the payloads as read back from the shards.

    ``feature`` is the image's size, its mean sample, and 64 bits that say which columns are brighter than the mean.
    """

    def read(file, offset: int, length: int) -> tuple:
        image = file.read_at(length, offset)
        rows = from_png(image)
        samples = rows.tobytes()
        columns = rows.sum(axis=0, dtype=np.int64)
        bright = int("".join("1" if x else "0" for x in columns * WIDTH > columns.sum()), 2)
        feature = f"{rows.shape[1]}x{rows.shape[0]}:{columns.sum() / len(samples):.4f}:{bright:016x}"
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    more = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, types, strict=True))
    return index.mapInArrow(lambda batches: _ranges(batches, read, names, types), f"{_declared(index)}, {more}")

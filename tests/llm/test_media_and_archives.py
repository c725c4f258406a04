"""WARC archives, tar shards and sharding, by round trip and brute force."""

import base64
import collections
import hashlib
import io
import tarfile
import zlib

import numpy as np
import pytest

from corpusloom.llm import media, sharding, warc
from corpusloom.llm.queries import ORACLE, QUERIES
from corpusloom.session import Scratch
from tests.rows import compare


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def archived(spark, pages, **how):
    at = Scratch(spark, "warc-test").path("archives")
    warc.write(spark.createDataFrame(pages, "page_id long, html string, digest string"), at, **how)
    return at, warc.read(spark, at)


TRAP = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [(1, "same", ""), (2, None, ""), (3, "same", ""), (4, "", ""), (5, TRAP, ""), (6, "é😀" * 50, ""), (7, "WARC/1.1\r\n", ""), (8, "WARC/1.1\r\nWARC/1.1\r\n", ""), (9, "\r\n\r\n", ""), (10, TRAP + TRAP, "")]


def check(pages, rows, least=0):
    assert sorted(r.page_id for r in rows) == sorted(p[0] for p in pages)
    html = {p[0]: p[1] or "" for p in pages}
    largest = {}
    for i, x in html.items():
        if len(x.encode()) >= least:
            largest[x] = max(i, largest.get(x, i))
    for r in rows:
        x = html[r.page_id]
        first = largest.get(x, r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(x.encode()), digest(x)), r
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))


def test_round_trip_with_magic_inside_payloads(spark):
    check(PAGES, archived(spark, PAGES)[1].collect())
    check(PAGES, archived(spark, PAGES, least_bytes=3)[1].collect(), least=3)


def test_archives_in_many_small_splits(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 4)
    pages = [(i, TRAP * (i % 3) + "é" * (i * 7 % 50), "") for i in range(60)]
    at, _ = archived(spark, pages)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for n in ("97", "400"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", n)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            check(pages, warc.read(spark, at).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_null_and_repeated_ids(spark):
    rows = archived(spark, [(None, "a", ""), (5, "a", ""), (5, "a", ""), (None, "b", "")])[1].collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows) == [(0, "response", 0), (0, "revisit", 5), (5, "response", 0), (5, "response", 0)]


def test_headers_that_readers_need(spark):
    at = Scratch(spark, "warc-test").path("archives")
    warc.write(spark.createDataFrame([(1, "x", "http://a.b/c d"), (2, "x", None), (None, "y", None)], "page_id long, html string, url string"), at, uri_col="url")
    heads = [r.value for r in spark.read.option("lineSep", warc.MAGIC).text(at).collect() if r.value]
    assert len(heads) == 3
    for h in heads:
        for name in ("WARC-Type", "WARC-Record-ID: <urn:", "WARC-Date: 20", "WARC-Target-URI: ", "Content-Length: ", "WARC-Payload-Digest: sha1:"):
            assert h.count(name) == 1, (name, h)
    assert any("WARC-Target-URI: http://a.b/c%20d\r\n" in h for h in heads) and any("WARC-Target-URI: urn:page:2\r\n" in h for h in heads)


def test_revisits_are_held_against_their_responses(spark, tmp_path):
    at = Scratch(spark, "warc-test").path("archives")
    warc.write(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "page_id long, html string"), at)
    text = "".join(r.value for r in spark.read.text(at, wholetext=True).collect())
    broken = text.replace("<urn:page:2>\r\nWARC-Profile", "<urn:page:3>\r\nWARC-Profile")
    assert broken != text
    (tmp_path / "broken.warc").write_bytes(broken.encode())
    rows = {r.page_id: r for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert (rows[1].record_type, rows[1].payload_bytes, rows[1].payload_digest) == ("revisit", None, None) and rows[2].payload_bytes == 1


def test_no_pages(spark):
    assert archived(spark, [])[1].count() == 0


def test_pages_query(spark, sf_dir):
    pages = [(r.page_id, r.html, "") for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    check(pages, QUERIES["op3_warc"](spark, sf_dir).collect())


TEXTS = [None, "", "a", "b" * 64, "b" * 65, "é😀" * 999, "a", "\x00\xff", "x" * 300_000]


def test_media_round_trip(spark, monkeypatch):
    monkeypatch.setattr(media, "SHARD_BYTES", 2000)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, digest string")
    names, stored = media.store(docs)
    assert stored.select("digest").distinct().count() == stored.count() == len({media.payload((t or '').encode()) for t in TEXTS})
    rows = names.join(media.features(media.headers(stored)), "digest").orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(len(TEXTS)))
    for r, t in zip(rows, TEXTS, strict=True):
        raw = (t or "").encode()
        whole = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(whole), zlib.crc32(whole[-64:]))
        assert r.payload_sha256 == r.digest == hashlib.sha256(whole).hexdigest()
        assert (r.width, r.height, r.bit_depth) == (64, len(whole) // 64, 8)
        fs, at = media.open_folder(r.shard)
        tar = tarfile.open(fileobj=io.BytesIO(fs.open_input_file(at).read()))
        members = {m.name: m for m in tar.getmembers()}
        member = members[f"{r.digest}.png"]
        image = tar.extractfile(member).read()
        assert (member.offset_data, member.size) == (r.offset, r.length) and r.media_bytes == len(image)
        assert r.media_sha256 == hashlib.sha256(image).hexdigest() and media.from_png(image).tobytes() == whole
    same = {r.doc_id: r for r in rows}
    assert same[2][3:] == same[6][3:] and same[0].feature == same[1].feature
    for x in media.store(docs.limit(0)):
        assert x.count() == 0


def test_each_content_is_stored_once_over_all_tasks(spark):
    texts = [f"copy {i % 7} " * 30 for i in range(400)] + [f"single {i}" for i in range(100)]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(8)
    names, stored = media.store(docs)
    assert stored.count() == stored.select("digest").distinct().count() == 107
    rows = names.join(media.features(stored), "digest").collect()
    assert {r.doc_id: r.payload_sha256 for r in rows} == {str(i): hashlib.sha256(media.payload(t.encode())).hexdigest() for i, t in enumerate(texts)}


def test_features_by_brute_force(spark):
    texts = ["a", "zz" * 70, "é" * 500, ""]
    names, stored = media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in names.join(media.features(stored), "digest").collect():
        samples = media.payload(texts[r.doc_id].encode())
        columns = [sum(samples[c::64]) for c in range(64)]
        bright = sum(1 << (63 - c) for c in range(64) if columns[c] * 64 > sum(columns))
        assert r.feature == f"64x{len(samples) // 64}:{sum(samples) / len(samples):.4f}:{bright:016x}"


def test_media_query(spark, sf_dir):
    rows = {r.doc_id: r for r in QUERIES["op6_media_columns"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert rows[d.doc_id].payload_sha256 == hashlib.sha256(media.payload((d.text or "").encode())).hexdigest()


def packed(vectors, residual):
    """Largest first; the shard with the highest dot product among those that fit, or among all."""
    out = {}
    for i in sorted(range(len(vectors)), key=lambda i: -max(vectors[i])):
        fit = [s for s in range(len(residual)) if all(r >= v - 1e-9 for r, v in zip(residual[s], vectors[i], strict=True))]
        out[i] = max(fit or range(len(residual)), key=lambda s: (sum(r * v for r, v in zip(residual[s], vectors[i], strict=True)), -s))
        residual[out[i]] = [r - v for r, v in zip(residual[out[i]], vectors[i], strict=True)]
    return [out[i] for i in range(len(vectors))]


def test_packing_by_brute_force():
    rng = np.random.default_rng(3)
    for n, k in ((0, 8), (1, 8), (40, 3), (300, 8)):
        v = rng.integers(1, 64, size=(n, 3)) / 64  # sums of these are exact
        assert sharding.pack(v, np.full((k, 3), n / k)).tolist() == packed(v.tolist(), [[n / k] * 3 for _ in range(k)])
        at = sharding.pack_batch(v, np.ones((k, 3)), 2) if n else np.zeros(0)
        if n > 100:
            sums = np.stack([v[at == s].sum(axis=0) for s in range(k)])
            assert (abs(sums / sums.mean(axis=0) - 1) < 0.05).all()


def test_shards(spark, sf_dir):
    rows = QUERIES["op5_sharding"](spark, sf_dir).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes, slots, where = [0] * 8, [[] for _ in range(8)], {}
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert where.setdefault(docs[r.doc_id], r.shard) == r.shard
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 8 + max(len(t.encode()) for t in docs.values()) / 8


def test_hot_group_is_cut(spark):
    docs = spark.createDataFrame([(i, "hot " * 50 if i % 3 == 0 else f"text {i} " * 20, 0) for i in range(3000)] + [(None, None, 1), (None, None, 1)], "doc_id long, text string, tokens int")
    rows = sharding.shard(docs).collect()
    assert len(rows) == 3002
    for i, d in enumerate(("size", "tokens")):
        total = [sum(r[d] for r in rows if r.shard == s) for s in range(8)]
        assert max(total) <= 1.02 * sum(total) / 8, (i, total)
    counts = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(counts) - min(counts) < 40
    assert sharding.shard(docs.limit(0)).count() == 0
    whole = collections.defaultdict(set)
    for r in sharding.shard(docs, cut=None).collect():
        whole[r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in whole.values())


@pytest.mark.parametrize("n", [1, 2])
def test_few_rows(spark, n):
    assert sharding.shard(spark.createDataFrame([(i, "x") for i in range(n)], "doc_id long, text string")).count() == n


def test_warc_sql(spark, sf_dir, duck):
    compare(QUERIES["op3_warc"](spark, sf_dir), duck, ORACLE["op3_warc"])


def spread_of(spark, rows):
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    per = [(sum(r.size for r in out if r.shard == s), sum(r.shard == s for r in out)) for s in range(8)]
    return out, per


def test_a_group_that_fits_is_not_cut(spark):
    rows = [(i, f"text number {i % 760 if i >= 40 else 'same'}") for i in range(800)]
    out, per = spread_of(spark, rows)
    assert len({r.shard for r, (i, _) in zip(sorted(out, key=lambda r: r.doc_id), rows, strict=True) if i < 40}) == 1
    assert max(n for _, n in per) <= 103 and max(b for b, _ in per) <= 1.05 * sum(b for b, _ in per) / 8


def test_rows_of_one_id_are_cut_apart(spark):
    rows = [(None, "the same text for all of these rows")] * 300 + [(i, f"another text {i}") for i in range(500)]
    out, per = spread_of(spark, rows)
    assert len(out) == 800 and max(n for _, n in per) - min(n for _, n in per) <= 12
    assert max(b for b, _ in per) <= 1.1 * sum(b for b, _ in per) / 8
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(per[s][1]))


def test_groups_that_leave_no_room_for_each_other(spark):
    """Nine groups of five sixths of a shard: one of them is cut."""
    rows = [(i, f"group {i % 9}") for i in range(900)] + [(900 + i, f"single {i}") for i in range(180)]
    out, per = spread_of(spark, rows)
    assert max(n for _, n in per) <= 1.06 * 135
    held = [{r.shard for r in out if r.doc_id < 900 and r.doc_id % 9 == g} for g in range(9)]
    assert sum(len(h) == 1 for h in held) == 8

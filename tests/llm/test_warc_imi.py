import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import imi, warc


def expected(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for page, h in rows:
        if page is not None:
            first[digest(h)] = min(page, first.get(digest(h), page))
    out = Counter()
    for page, h in rows:
        again = page is not None and page > first[digest(h)]
        out[page, len((h or "").encode()), digest(h), "revisit" if again else "response", first[digest(h)] if again else None] += 1
    return out


def archived(pages):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages).collect())


def test_pages_through_archives(spark, medium):
    pages = spark.read.parquet(f"{medium}/pages.parquet")
    assert archived(pages) == expected([(r.page_id, r.html) for r in pages.collect()])


def test_odd_pages(spark):
    tricky = "WARC/1.1\r\n\r\n\n\nhttp://x 0 1 text/html 5\nabc\r\n"
    rows = [(1, "http://a b/\n", "x"), (2, None, None), (3, "u", ""), (4, "é ", "x"), (4, "v", "x"), (1, "w", "x"), (None, "n", "x"), (5, "", tricky), (6, "t", tricky), (7, "l", "long \r\n" * 200_000), (-3, "m", "\x00\U0001f600")]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, first long, digest string").repartition(4)
    assert archived(pages) == expected([(r[0], r[2]) for r in rows])
    assert warc.archived(pages.limit(0)).collect() == []


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>\n\n"), (2, "http://b/", "<p>é</p>\n\n"), (3, "http://c/", "")], "page_id long, url string, html string")
    old, new = str(tmp_path / "arc"), str(tmp_path / "warc")
    warc.write_arc(pages, old)
    warc.convert(warc.read_arc(spark, old), new)
    got = {r.page_id: r for r in warc.read_warc(spark, new).collect()}
    assert bytes(got[1].payload).decode() == "<p>é</p>\n\n" and got[2].payload is None and got[2].refers_to == 1
    assert got[1].url == "http://a/" and len({r.record_id for r in got.values()}) == 3


def test_short_members_are_unpacked_by_short_pieces(monkeypatch):
    """What is handed over beyond a member is copied, so it must not be a large piece of the file for each."""
    rng = np.random.default_rng(8)
    parts = [rng.bytes(int(k)) for k in rng.integers(0, 3 * warc.FIRST_BYTES, 600)] + [rng.bytes(3 * warc.PIECE_BYTES), b"", b"x"]
    data, handed, make = b"".join(map(warc.zlib_member, parts)), [], warc.zlib.decompressobj

    class Counting:
        def __init__(self, bits):
            self.one = make(bits)

        def __getattr__(self, name):
            return getattr(self.one, name)

        def decompress(self, part, most):
            handed.append(len(part))
            return self.one.decompress(part, most)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    file = warc._Unpacked(data)
    assert [file.take(len(p)) for p in parts] == parts and file.empty()
    assert sum(handed) < 8 * len(data)


def test_both_versions_of_the_header_line():
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    for version in (1, 2):
        about = f"{version} 0 Somebody\n".encode()
        head = b"filedesc://x 0.0.0.0 20010203040506 text/plain " + (b"" if version == 1 else b"200 - - 0 x ") + str(len(about)).encode()
        data = head + b"\n" + about + b"\n" + warc._arc_line(version, "http://a/", block, "20010203040506") + b"\n" + block + b"\n"
        (one,) = warc.arc_records(data)
        assert one["version"] == version and one["block"] == block and one["date"] == "20010203040506"
        with pytest.raises(ValueError):
            list(warc.arc_records(data[:-3]))


def test_files_are_bounded_and_a_member_a_record(spark, tmp_path, monkeypatch):
    """Small files of many records, each its own gzip member after a warcinfo record; long records in pieces."""
    import zlib as z

    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    monkeypatch.setattr(warc, "MEMBER_BYTES", 2000)
    monkeypatch.setattr(warc, "PIECE_BYTES", 100)
    records = [bytes([65 + i]) * n for i, n in enumerate((10, 0, 1500, 2000, 2001, 9000, 5))]
    files = [*warc._files(iter(records), lambda n: b"head%d" % n)]
    assert b"".join(b"".join(warc._Unpacked._pieces(f)) for f in files).replace(b"head0", b"").replace(b"head1", b"").replace(b"head2", b"").replace(b"head3", b"") == b"".join(records)
    assert len(files) > 2 and all(f[-1] == 0 for f in files)
    monkeypatch.undo()
    pages = spark.createDataFrame([(i, f"http://h/{i}", "é" * (i % 7) * 40) for i in range(50)], "page_id long, url string, html string")
    old, new = str(tmp_path / "arc"), str(tmp_path / "warc")
    warc.write_arc(pages.coalesce(1), old)
    warc.convert(warc.read_arc(spark, old), new)
    contents = [r.content for r in spark.read.format("binaryFile").load(new).collect() if r.content]
    kinds = []
    for data in contents:
        data = bytes(data)
        while data:
            one = z.decompressobj(31)
            member = one.decompress(data)
            data = one.unused_data
            ((head, _),) = warc.warc_records(member)  # a member is one whole record
            kinds.append(head["warc-type"])
    assert kinds.count("warcinfo") == len(contents) and kinds.count("response") == 7 and kinds.count("revisit") == 43


def brute(rows):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:20]
        out[int(ids[i])] = [(int(ids[j]), scores[j]) for j in order]
    return out


def test_recall_and_scores(spark, medium):
    table = spark.read.parquet(f"{medium}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    good = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    want, vectors = brute(good), dict(good)
    got = {}
    for r in sorted(imi.search(table).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
        assert r.score == pytest.approx(float(np.dot(np.array(vectors[r.query_id], float), np.array(vectors[r.vec_id], float))), abs=1e-12)
    assert set(got) == set(want)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9
    assert all(a[1] > b[1] or a[1] == b[1] and a[0] < b[0] for near in got.values() for a, b in zip(near, near[1:]))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [-1.0, 2.0]), (20, [0.5, 0.5]), (40, [3.0]), (80, [1.0]), (81, [-2.0]), (60, []), (None, [1.0, 1.0]), (-20, [2.0, 1.0])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, i int")
    got = {}
    for r in sorted(imi.search(table).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [-20, 1, 20, 7], 20: [-20, 0, 1, 7], -20: [0, 1, 20, 7], 40: [80, 81], 80: [40, 81]} and imi.search(table.limit(0)).collect() == []
    one = table.where("vec_id = 0")
    assert imi.search(one).collect() == []
    many = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    ties = imi.search(many).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in ties] == list(range(20))


def test_share_seen_of_clustered_vectors(spark):
    """Where vectors lie in groups, a query sees under a tenth of them and finds nine in ten of the nearest."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(400, 32))
    x = middles[rng.integers(0, 400, 20_000)] + 0.15 * rng.normal(size=(20_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    sample = x[rng.choice(len(x), 6000, replace=False)]
    assert imi.fit(sample, imi.centroids(len(x)))[2] < 0.1
    rows = list(zip(range(len(x)), x.tolist()))
    got = {}
    for r in imi.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8), every=400).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, len(x), 400):
        scores = x @ x[q]
        scores[q] = -9
        hits.append(len(got[q] & {*np.argsort(-scores)[:20].tolist()}) / 20)
    assert np.mean(hits) >= 0.9


def test_blocks_are_bounded_and_hold_every_row():
    sizes = np.array([5, 0, 9000, 40_000, 7, 16_000])
    blocks = imi.laid_out(np.random.default_rng(1).normal(size=(6, 4)), sizes, 16_384)
    held = {}
    for i, own in enumerate(blocks):
        assert own
        for b in own:
            held[b] = held.get(b, 0) + sizes[i] / len(own)
    assert sorted(held) == [*range(len(held))] and max(held.values()) <= 16_384 + 16_384


def test_chunks_of_neighbouring_queries_ask_for_few_blocks(spark, monkeypatch):
    """Many chunks and blocks: each chunk's queries lie in neighbouring cells, so it is sent a small part of the blocks,
    and what is found doesn't depend on the chunks."""
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(300, 16))
    x = middles[rng.integers(0, 300, 12_000)] + 0.1 * rng.normal(size=(12_000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame(list(zip(range(len(x)), x.tolist())), "vec_id long, embedding array<double>").repartition(6)
    whole = {(r.query_id, r.rank): r.vec_id for r in imi.search(table, every=10).collect()}
    monkeypatch.setattr(imi, "BLOCK_ROWS", 256)
    monkeypatch.setattr(imi, "CHUNK_ROWS", 50)
    kept = []
    real = imi.cut
    monkeypatch.setattr(imi, "cut", lambda df: (kept.append(real(df)), kept[-1])[1])
    got = {(r.query_id, r.rank): r.vec_id for r in imi.search(table, every=10).collect()}
    assert got == whole and len({q for q, _ in got}) == 1200
    wanted = next(df for df in kept if set(df.columns) == {"block", "chunk"})
    blocks, chunks = (len({r[0] for r in wanted.select(c).distinct().collect()}) for c in ("block", "chunk"))
    asks = next(df for df in kept if "limit" in df.columns)
    at_random = asks.select((F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(chunks))).alias("c"), "block").distinct().count()
    each = asks.count() / 1200
    assert chunks >= 20 and blocks >= 20 and wanted.count() < 0.8 * at_random, (wanted.count(), at_random, each, blocks, chunks)

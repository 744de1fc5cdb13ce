import collections
import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import tiff


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [False, True])
@pytest.mark.parametrize("tile", [0, 64])
def test_pages_come_back(order, compression, predictor, tile):
    rng = np.random.default_rng(compression + tile)
    pages = [rng.integers(0, 256, (70, 576)).astype(np.uint8), np.repeat(np.arange(40, dtype=np.uint8), 100).reshape(40, 100), np.zeros((1, 1), np.uint8)]
    back = list(tiff.read(tiff.write(pages, compression, predictor, order, tile)))
    assert [(w, h, b) for w, h, b, _ in back] == [(p.shape[1], p.shape[0], 8) for p in pages]
    assert [s for *_, s in back] == [p.tobytes() for p in pages]


def test_query_round_trip(spark, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = tiff.op7(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = texts[r.doc_id] + b"\xff" * ((-len(texts[r.doc_id])) % 576 if texts[r.doc_id] else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_odd_rows_and_damaged_files(spark, odd, empty):
    stored = tiff.encode_texts(odd.withColumn("media", F.lit(0)), "text")
    pages = tiff.decode_pages(stored, "media_").collect()
    assert len(pages) == odd.count() and all(p.page == 0 and p.width == 576 for p in pages)
    same = [bytes(p.samples) for p in pages if p.doc_id == 7]
    assert same[0] == same[1]
    assert tiff.decode_pages(tiff.encode_texts(empty, "text"), "media").count() == 0
    good = tiff.write([np.zeros((3, 3), np.uint8)])
    bad = spark.createDataFrame([(1, bytearray(good[:20])), (2, bytearray(b"")), (3, None), (4, bytearray(good)), (5, bytearray(b"II*\0" + b"\xff" * 40))], "id long, file binary")
    assert {r.id: r.page for r in tiff.decode_pages(bad, "file").collect()} == {1: -1, 2: -1, 3: -1, 4: 0, 5: -1}


def test_headers_that_claim_too_much(spark):
    page = np.arange(64, dtype=np.uint8).reshape(8, 8)
    good = tiff.write([page], tiff.PLAIN, False)
    bad = []
    for value in (1_000_000, 0, 2**32 - 1):
        for tag in (tiff.WIDTH, tiff.HEIGHT, tiff.ROWS):
            file = bytearray(good)
            at = struct.unpack_from("<I", good, 4)[0]
            for e in range(struct.unpack_from("<H", good, at)[0]):
                if struct.unpack_from("<H", good, at + 2 + 12 * e)[0] == tag:
                    struct.pack_into("<HII", file, at + 4 + 12 * e, 4, 1, value)
            bad.append(bytes(file))
    rows = tiff.decode_pages(spark.createDataFrame([(i, f) for i, f in enumerate([good, *bad])], "doc_id long, media binary"), "media").collect()
    assert len(rows) == 10 and [r.page for r in rows if r.doc_id == 0] == [0]
    # More rows in a strip than the page has is lawful.
    assert all(r.page == -1 for r in rows if r.doc_id not in (0, 3, 9)) and all(r.samples == page.tobytes() for r in rows if r.page == 0)


def test_query_against_plain_reading(spark):
    """Without the module's own reader: its files are of one directory, and of deflate strips whose rows hold differences."""
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    files = {r.doc_id: bytes(r.media) for r in tiff.encode_texts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "text").collect()}
    rows = tiff.op7(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        file, text = files[r.doc_id], texts[r.doc_id]
        want = text + b"\xff" * (576 - len(text) % 576 if len(text) % 576 or not text else 0)
        at = struct.unpack_from("<I", file, 4)[0]
        fields = {}
        for e in range(struct.unpack_from("<H", file, at)[0]):
            tag, kind, n, value = struct.unpack_from("<HHII", file, at + 2 + 12 * e)
            size = {3: 2, 4: 4}[kind]
            fields[tag] = list(struct.unpack_from(f"<{n}{'H' if kind == 3 else 'I'}", file, at + 10 + 12 * e if n * size <= 4 else value))
        assert fields[259] == [8] and fields[317] == [2] and fields[256] == [576]
        steps = b"".join(zlib.decompress(file[p : p + n]) for p, n in zip(fields[273], fields[279], strict=True))
        plain = bytearray(steps)
        for i in range(len(plain)):
            if i % 576:
                plain[i] = (plain[i] + plain[i - 1]) & 255
        assert bytes(plain) == want
        counts = collections.Counter(want)
        mean = sum(want) / len(want)
        deviation = (sum(n * (b - mean) ** 2 for b, n in counts.items()) / len(want)) ** 0.5
        level = sum(want[i] == want[i - 1] for i in range(len(want)) if i % 576) / (len(want) - len(want) // 576)
        entropy = -sum(n / len(want) * math.log2(n / len(want)) for n in counts.values())
        assert r.feature == f"mean={mean:.4f};std={deviation:.4f};level={level:.6f};entropy={abs(entropy):.6f}" or (len(counts) == 1 and "entropy=" in r.feature)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())

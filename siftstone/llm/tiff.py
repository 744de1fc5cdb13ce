"""Media columns: TIFF files as a binary column, read into one row per page.

Reading walks the chain of image directories in either byte order, decodes strips or tiles that are stored plainly or
with PackBits, LZW or deflate, undoes the horizontal predictor and gives the samples row by row. Samples have 8 or 16
bits. A file that breaks these rules, or claims more samples than its bytes can hold, gives one row with page -1 and the
reason, so a damaged file never ends a job.

Writing makes one page of 8-bit grey samples, in strips.

Defined cases: a null or empty file gives a row with page -1; a null text counts as empty, a text of any length is stored
whole; equal texts give equal files; repeated rows give repeated results; an empty table gives no rows; only the named
columns are read, and others that have the names of new ones make those get underscores.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, per_batch, table, with_columns

# Fixed values of the TIFF 6.0 format: tags, field types with their sizes, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 284, 317, 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

UNIT = 576
ROWS_PER_STRIP = 64
#: Bytes that one byte of a file can stand for at most; LZW, whose strings have up to 4,000 bytes for 12 bits, reaches most.
MOST_RATIO = 2800


def packbits(data: bytes) -> bytes:
    """Runs of two and more as a count and a byte, the rest as counted literals."""
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        else:
            if head > 128:
                out += data[i + 1 : i + 2] * (257 - head)
            i += 2 if head > 128 else 1
    return bytes(out)


class _Bits:
    """Codes of growing width, the highest bit first."""

    def __init__(self):
        self.out, self.held, self.n = bytearray(), 0, 0

    def put(self, code: int, width: int) -> None:
        self.held, self.n = self.held << width | code, self.n + width
        while self.n >= 8:
            self.n -= 8
            self.out.append(self.held >> self.n)
            self.held &= (1 << self.n) - 1

    def end(self) -> bytes:
        return bytes(self.out + (bytes([self.held << 8 - self.n]) if self.n else b""))


def lzw(data: bytes) -> bytes:
    bits, known, width = _Bits(), {bytes([i]): i for i in range(256)}, 9
    bits.put(256, width)
    code, held = 258, b""
    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if longer in known:
            held = longer
            continue
        bits.put(known[held], width)
        known[longer] = code
        code += 1
        width = max(9, code.bit_length())
        if code == 4095:
            bits.put(256, 12)
            known, code, width = {bytes([i]): i for i in range(256)}, 258, 9
        held = data[i : i + 1]
    if held:
        bits.put(known[held], width)
        width = max(9, (code + 1).bit_length())
    bits.put(257, min(12, width))
    return bits.end()


def unlzw(data: bytes, size: int) -> bytes:
    out, words, last = bytearray(), [], b""
    held = n = 0
    width = 9
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & (1 << n) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            words, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            last = words[code]
        else:
            word = words[code] if code < len(words) else last + last[:1]
            words.append(last + word[:1])
            last = word
        out += last
        width = min(12, max(9, (len(words) + 1).bit_length()))
    return bytes(out)


PACK = {PLAIN: lambda x: x, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1)}
UNPACK = {PLAIN: lambda x, n: x[:n], PACKBITS: unpackbits, LZW: unlzw, DEFLATE: lambda x, n: zlib.decompressobj().decompress(x, n), OLD_DEFLATE: lambda x, n: zlib.decompressobj().decompress(x, n)}


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: bool = True, order: str = "<", tile: int = 0) -> bytes:
    """A file with one directory for each two-dimensional array of 8-bit or 16-bit samples, in strips, or in square tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    for k, page in enumerate(pages):
        height, width = page.shape
        page = page.astype(page.dtype.newbyteorder(order))
        if tile:
            blocks = []
            for top in range(0, height, tile):
                for left in range(0, width, tile):
                    block = np.zeros((tile, tile), page.dtype)
                    part = page[top : top + tile, left : left + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[top : top + ROWS_PER_STRIP] for top in range(0, height, ROWS_PER_STRIP)]
        packed = []
        for block in blocks:
            if predictor:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1).astype(page.dtype)
            packed.append(PACK[compression](block.tobytes()))
        fields = {WIDTH: width, HEIGHT: height, BITS: 8 * page.itemsize, COMPRESSION: compression, PHOTOMETRIC: 1, SAMPLES: 1, PLANAR: 1, PREDICTOR: 2 if predictor else 1}
        fields |= {TILE_WIDTH: tile, TILE_HEIGHT: tile} if tile else {ROWS: ROWS_PER_STRIP}
        count, here = len(fields) + 2, len(out)
        lists = here + 2 + 12 * count + 4
        data = lists + (8 * len(packed) if len(packed) > 1 else 0)
        data += data % 2
        sizes = [len(x) for x in packed]
        places = [data + int(s) for s in np.cumsum([0, *sizes[:-1]])]
        at, by = (TILES, TILE_BYTES) if tile else (STRIPS, STRIP_BYTES)
        single = len(packed) == 1
        fields |= {at: places[0] if single else lists, by: sizes[0] if single else lists + 4 * len(packed)}
        out += struct.pack(order + "H", count)
        for tag in sorted(fields):
            out += struct.pack(order + "HHII", tag, 4, len(packed) if tag in (at, by) else 1, fields[tag])
        end = data + sum(sizes)
        end += end % 2
        out += struct.pack(order + "I", end if k + 1 < len(pages) else 0)
        if not single:
            out += struct.pack(f"{order}{2 * len(packed)}I", *places, *sizes)
        out += bytes(data - len(out)) + b"".join(packed)
        out += bytes(end - len(out)) if k + 1 < len(pages) else b""
    return bytes(out)


def read(file: bytes):
    """(width, height, bits, samples as bytes in native order) of each page."""
    order = {b"II": "<", b"MM": ">"}.get(file[:2])
    if not order or len(file) < 8 or struct.unpack_from(order + "H", file, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", file, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a circle")
        seen.add(at)
        fields = {}
        count = struct.unpack_from(order + "H", file, at)[0]
        for e in range(count):
            tag, kind, n, _ = struct.unpack_from(order + "HHII", file, at + 2 + 12 * e)
            if kind in FIELD:
                form = f"{order}{n}{FIELD[kind]}"
                place = at + 10 + 12 * e
                if struct.calcsize(form) > 4:
                    place = struct.unpack_from(order + "I", file, place)[0]
                fields[tag] = struct.unpack_from(form, file, place)
        yield _page(file, fields, order)
        at = struct.unpack_from(order + "I", file, at + 2 + 12 * count)[0]


def _page(file: bytes, fields: dict[int, tuple], order: str) -> tuple[int, int, int, bytes]:
    one = lambda tag, default=None: fields.get(tag, (default,))[0]
    width, height, bits, channels = one(WIDTH), one(HEIGHT), one(BITS, 1), one(SAMPLES, 1)
    if bits not in (8, 16) or one(PLANAR, 1) != 1 or one(COMPRESSION, 1) not in UNPACK:
        raise ValueError("samples or compression of another kind")
    kind, unpack = np.dtype(f"{order}u{bits // 8}"), UNPACK[one(COMPRESSION, 1)]
    # No compression here makes more than MOST_RATIO bytes of one, so larger pages can't be in the file.
    if min(width, height, channels) < 1 or width * height * channels * kind.itemsize > MOST_RATIO * len(file):
        raise ValueError("the header claims more samples than the file can hold")
    tiled = TILES in fields
    wide = one(TILE_WIDTH) if tiled else width
    tall = one(TILE_HEIGHT) if tiled else min(one(ROWS, height), height)
    out = np.zeros((height, width, channels), kind.newbyteorder("="))
    across = -(-width // wide)
    if len(fields[TILES if tiled else STRIPS]) != across * -(-height // tall):
        raise ValueError("the strips or tiles don't make up the page")
    for k, (place, size) in enumerate(zip(fields[TILES if tiled else STRIPS], fields[TILE_BYTES if tiled else STRIP_BYTES], strict=True)):
        top, left = k // across * tall, k % across * wide
        rows = tall if tiled else min(tall, height - top)
        if rows < 1 or rows * wide * channels * kind.itemsize > MOST_RATIO * len(file):
            raise ValueError("a strip or tile has another place or size than the page allows")
        data = unpack(file[place : place + size], rows * wide * channels * kind.itemsize)
        block = np.frombuffer(data, kind).reshape(rows, wide, channels)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        out[top : top + rows, left : left + wide] = block[: height - top, : width - left]
    return width, height, bits, out.tobytes()


PAGES = [T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("samples", T.BinaryType()), T.StructField("error", T.StringType())]


def decode_pages(df: DataFrame, media: str) -> DataFrame:
    """All columns but the media column, for one row per page, with page, width, height, bits, samples and error (names that df has get underscores)."""
    kept = [f for f in df.schema.fields if f.name != media]
    fields = [T.StructField(free_name(df, f.name), f.dataType) for f in PAGES]
    at, keep = df.columns.index(media), [i for i, f in enumerate(df.schema.fields) if f.name != media]
    names = [f.name for f in [*kept, *fields]]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def make():
        def work(batch):
            source, rows = [], []
            for i, file in enumerate(batch.column(at)):
                n = 0
                try:
                    for n, (width, height, bits, samples) in enumerate(read(file.as_py() or b""), 1):
                        rows.append((n - 1, width, height, bits, samples, None))
                        source.append(i)
                except (ValueError, KeyError, struct.error, zlib.error, IndexError, TypeError, MemoryError, OverflowError, ZeroDivisionError) as e:
                    rows.append((-1, None, None, None, None, f"after {n} pages: {e}"))
                    source.append(i)
            taken = pa.array(source, pa.int64())
            new = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(taken) for i in keep), *new], names=names)

        return work

    return per_batch(df, make, T.StructType([*kept, *fields]))


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def encode_texts(df: DataFrame, text_col: str, media: str = "media", compression: int = DEFLATE, predictor: bool = True) -> DataFrame:
    """df with each text's bytes, filled up to whole rows of UNIT samples, as a TIFF of one page."""

    def make():
        def work(texts):
            pages = (np.frombuffer(payload((x.as_py() or "").encode()), np.uint8).reshape(-1, UNIT) for x in texts)
            return [pa.array([write([p], compression, predictor) for p in pages], pa.binary())]

        return work

    return with_columns(df, text_col, [T.StructField(free_name(df, media), T.BinaryType())], make)


def describe(samples: bytes, width: int) -> str:
    """Features of a page of 8-bit samples: mean, deviation, share of steps along rows that are level, entropy in bits."""
    a = np.frombuffer(samples, np.uint8)
    counts = np.bincount(a, minlength=256)
    p = counts[counts > 0] / len(a)
    level = np.count_nonzero(np.diff(a.reshape(-1, width), axis=1) == 0) / max(1, len(a) - len(a) // width)
    return f"mean={a.mean():.4f};std={a.std():.4f};level={level:.6f};entropy={-(p * np.log2(p)).sum():.6f}"


def op7(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of all of `documents`, from their stored pages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = encode_texts(docs, "text").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "media")
    stored = stored.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    pages = decode_pages(stored, "media")
    fields = [T.StructField("tail_crc32", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("feature", T.StringType())]

    def make():
        def work(samples):
            data = [x.as_py() for x in samples]
            # A page in error has no samples.
            told = lambda f: [None if x is None else f(x) for x in data]
            return [pa.array(told(lambda x: zlib.crc32(x[-32:])), pa.int64()), pa.array(told(lambda x: hashlib.sha256(x).hexdigest()), pa.string()), pa.array(told(lambda x: describe(x, UNIT)), pa.string())]

        return work

    told = with_columns(pages, "samples", fields, make)
    return told.select("doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

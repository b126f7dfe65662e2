"""TIFF in media columns: encode bytes as images, walk image directories, one row per page.

Reading handles both byte orders, strips and tiles, chunky and planar samples of 8 or 16 bits,
no compression, PackBits, LZW and deflate, and horizontal differencing. Input that is null gives no
page; input that is malformed gives the pages before the fault, then one row with page -1 and the reason in
``error``. A page is malformed as well if its blocks hold too few bytes for the size it states, so memory
follows the file, not its header. Repeated rows give repeated pages, and extra columns are left out unless
named as keys. Texts are stored whole, in pages of bounded rows. Empty tables give no rows. Only tasks' own
rows are held, a text or file at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_batch, arrow_slices, column, ddl, table, texts_of

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Fixed values of the format: bytes of each field type.
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


# ---------------------------------------------------------------- codecs


def packbits_encode(data: bytes) -> bytes:
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


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        k = data[i]
        i += 1
        if k < 128:
            out += data[i : i + k + 1]
            i += k + 1
        elif k > 128:
            out += data[i : i + 1] * (257 - k)
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    acc = bits = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    def start() -> dict[bytes, int]:
        return {bytes((i,)): i for i in range(256)}

    codes, following, width, word = start(), 258, 9, b""
    put(256, 9)
    for b in data:
        longer = word + bytes((b,))
        if longer in codes:
            word = longer
            continue
        put(codes[word], width)
        codes[longer] = following
        following += 1
        if following >= 4095:
            put(256, width)
            codes, following, width = start(), 258, 9
        elif following >= (1 << width):
            width += 1
        word = bytes((b,))
    if word:
        put(codes[word], width)
        following += 1  # the reader adds an entry here as well
        if following >= (1 << width) and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    words: list[bytes] = [bytes((i,)) for i in range(256)] + [b"", b""]
    first = list(words)
    out, acc, bits, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            words, width, last = list(first), 9, b""
            continue
        if not last:
            word = words[code]
        else:
            word = words[code] if code < len(words) else last + last[:1]
            words.append(last + word[:1])
            if len(words) >= (1 << width) - 1 and width < 12:
                width += 1
        out += word
        last = word
        if len(out) >= size:
            break
    return bytes(out)


ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), OLD_DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits_encode}


def unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression == PACKBITS:
        return packbits_decode(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {compression}")


# ---------------------------------------------------------------- write


def write_tiff(payload: bytes, width: int = 64, page_rows: int = 8192, strip_rows: int = 1024, compression: int = DEFLATE, predictor: int = 2, tile: int = 0, order: str = "<") -> bytes:
    """Grey 8-bit pages of ``width`` samples a row; ``payload`` is whole rows. tile > 0: square tiles of that side."""
    if not payload or len(payload) % width:
        raise ValueError("whole rows are needed")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for top in range(0, len(rows), page_rows):
        page = rows[top : top + page_rows]
        if tile:
            h, w = -(-len(page) // tile) * tile, -(-width // tile) * tile
            padded = np.zeros((h, w), np.uint8)
            padded[: len(page), :width] = page
            blocks = [padded[r : r + tile, c : c + tile] for r in range(0, h, tile) for c in range(0, w, tile)]
        else:
            blocks = [page[r : r + strip_rows] for r in range(0, len(page), strip_rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
            data = ENCODERS[compression](np.ascontiguousarray(block).tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        out += b"\0" * (len(out) % 2)
        fields = {256: (4, [width]), 257: (4, [len(page)]), 258: (3, [8]), 259: (3, [compression]), 262: (3, [1]), 277: (3, [1]), 317: (3, [predictor])}
        fields |= {322: (4, [tile]), 323: (4, [tile]), 324: (4, offsets), 325: (4, counts)} if tile else {273: (4, offsets), 278: (4, [strip_rows]), 279: (4, counts)}
        packed = []
        for tag, (kind, values) in sorted(fields.items()):
            raw = struct.pack(order + ("H" if kind == 3 else "I") * len(values), *values)
            if len(raw) > 4:
                where = len(out)
                out += raw
                raw = struct.pack(order + "I", where)
            packed.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(packed)) + b"".join(packed)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# ---------------------------------------------------------------- read


def directories(data: bytes):
    """Tags of each image directory, in file order."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = FIELD_SIZES.get(kind, 0) * count
            if not size:
                continue
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            letter = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}.get(kind)
            tags[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, where)) if letter else [bytes(data[where : where + size])]
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


#: Most bytes that a byte of each compression can stand for.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 3072, DEFLATE: 1040, OLD_DEFLATE: 1040}


def read_page(data: bytes, order: str, tags: dict) -> tuple[np.ndarray, dict]:
    """Samples of one page as [rows, columns, samples] and what its directory says."""
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    width, height, samples = one(256), one(257), one(277, 1)
    bits, compression, predictor, planar = one(258, 1), one(259, 1), one(317, 1), one(284, 1)
    if not width or not height or not samples or bits not in (8, 16) or predictor not in (1, 2) or compression not in EXPANSION or planar not in (1, 2):
        raise ValueError(f"unsupported page: {width}x{height}, {samples} samples of {bits} bits, compression {compression}, predictor {predictor}")
    kind = np.dtype("u1") if bits == 8 else np.dtype(order + "u2")
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    if 324 in tags:
        bw, bh, offsets, counts = one(322), one(323), tags[324], tags.get(325, [])
    else:
        bw, bh, offsets = width, min(one(278, height), height), tags.get(273, [])
        counts = tags.get(279, [len(data)])
    if not bw or not bh:
        raise ValueError(f"blocks of {bw}x{bh}")
    blocks = planes * -(-width // bw) * -(-height // bh)
    if len(offsets) < blocks or len(counts) < blocks:
        raise ValueError(f"{len(offsets)} offsets and {len(counts)} sizes for {blocks} blocks")
    held = sum(max(0, min(c, len(data) - o)) for o, c in zip(offsets[:blocks], counts[:blocks], strict=True))
    if width * height * samples * kind.itemsize > held * EXPANSION[compression]:
        raise ValueError(f"{held} bytes are too few for {width}x{height}")
    across, down = -(-width // bw), -(-height // bh)
    page = np.zeros((down * bh, across * bw, samples), kind)
    for p in range(planes):
        for k in range(across * down):
            r, c = divmod(k, across)
            rows = min(bh, height - r * bh) if 324 not in tags else bh
            i, size = p * across * down + k, rows * bw * each * kind.itemsize
            raw = unpack(data[offsets[i] : offsets[i] + counts[i]], compression, size)
            if len(raw) != size:
                raise ValueError(f"block {i} has {len(raw)} of {size} bytes")
            block = np.frombuffer(raw, kind).reshape(rows, bw, each)
            if predictor == 2:
                block = np.cumsum(block.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
            page[r * bh : r * bh + rows, c * bw : (c + 1) * bw, p : p + each] = block
    return page[:height, :width], {"width": width, "height": height, "samples": samples, "bits": bits, "compression": compression, "predictor": predictor}


def pages(data: bytes):
    for order, tags in directories(data):
        yield read_page(data, order, tags)


# ---------------------------------------------------------------- operators


def page_rows(data: bytes) -> list[tuple]:
    """Of each page: number, width, height, samples, bits, compression, predictor, pixels, error."""
    out: list[tuple] = []
    try:
        for k, (page, about) in enumerate(pages(data)):
            out.append((k, *about.values(), page.tobytes(), None))
    except Exception as e:  # whatever a foreign file holds, it must not end the job
        out.append((-1, *[None] * 7, f"{type(e).__name__}: {e}"))
    return out


PAGE = {"page": pa.int32(), "width": pa.int32(), "height": pa.int32(), "samples": pa.int32(), "bits": pa.int32(), "compression": pa.int32(), "predictor": pa.int32(), "pixels": pa.binary(), "error": pa.string()}


def tiff_pages(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page: keys, page, width, height, samples, bits, compression, predictor, pixels, error."""
    schema = ", ".join([ddl(df, keys)] * bool(keys) + ["page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data = row[media][0].as_py()
                if data is not None:
                    got = page_rows(data)
                    again = pa.array(np.zeros(len(got), np.int64))
                    yield arrow_batch({k: row[k].take(again) for k in keys}, {n: (list(v), t) for (n, t), v in zip(PAGE.items(), zip(*got, strict=True), strict=True)})

    return df.select(*[column(c) for c in dict.fromkeys((*keys, media))]).mapInArrow(run, schema)


def varied(payload: bytes) -> dict:
    """A way to store a payload, picked by its checksum, so that equal ones are stored alike: strips or tiles, every
    compression, with and without the predictor, in both byte orders."""
    pick = zlib.crc32(payload)
    compression = (DEFLATE, LZW, PACKBITS, DEFLATE, NONE, DEFLATE, LZW, OLD_DEFLATE)[pick & 7]
    return {"compression": compression, "predictor": 1 + (pick >> 3 & 1), "tile": (0, 0, 32, 64)[pick >> 4 & 3], "order": "<>"[pick >> 6 & 1]}


def text_to_tiff(df: DataFrame, text: str = "text", key: str = "doc_id", how=varied, **fixed) -> DataFrame:
    """key, n_bytes, media: UTF-8 bytes of each text (null: empty), padded with zeros to a positive multiple of 64, as a TIFF
    file. how: gives the arguments of :func:`write_tiff` for a payload; ``fixed`` ones go first."""

    def run(batches):
        for batch in batches:
            for part in arrow_slices(batch, text):
                raw = [t.encode() for t in texts_of(part[text])]
                whole = [d + b"\0" * ((-len(d)) % 64 if d else 64) for d in raw]
                yield arrow_batch({key: part[key]}, {"n_bytes": ([len(d) for d in raw], pa.int64()), "media": ([write_tiff(d, **(how(d) | fixed)) for d in whole], pa.binary())})

    return df.select(column(key), column(text)).mapInArrow(run, ddl(df, (key,)) + ", n_bytes long, media binary")


def tiff_digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Decode each file's pages and describe them: lengths, hashes and a feature string of the samples (a file with an
    error: nulls and the reason as feature)."""

    def one(data: bytes) -> tuple:
        got = page_rows(data)
        if got[-1][-1] is not None:
            return None, None, None, len(data), hashlib.sha256(data).hexdigest(), got[-1][-1]
        payload = b"".join(p[7] for p in got)
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        share = counts[counts > 0] / len(payload)
        mean = float((counts * np.arange(256)).sum() / len(payload))
        feature = f"pages={len(got)};width={got[0][1]};rows={sum(p[2] for p in got)};compression={got[0][5]};predictor={got[0][6]};mean={mean:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};distinct={len(share)}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature

    names = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches):
        for batch in batches:
            got = [one(x.as_py()) for x in batch["media"]]
            yield arrow_batch({key: batch[key], "n_bytes": batch["n_bytes"]}, {n: ([g[i] for g in got], t) for i, (n, t) in enumerate(names.items())})

    return df.select(column(key), "n_bytes", "media").mapInArrow(run, ddl(df, (key,)) + ", n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_digest(text_to_tiff(table(spark, sf_dir, "documents")))

"""PNG rasters as arrays: bit depths 1 to 16, grey, colour, palette and alpha, all row filters; no interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type: grey, colour, palette, grey with alpha, colour with alpha.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Weights of red, green and blue in luma, in 65536ths.
LUMA = np.array([19595, 38470, 7471], np.int64)


class BadImage(ValueError):
    """What is wrong with a file."""


def chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise BadImage("not a PNG file")
    at = 8
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            break
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise BadImage(f"bad checksum of {kind.decode('latin-1')}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise BadImage("file ends early")


def unfiltered(raw: np.ndarray, bpp: int) -> np.ndarray:
    """Rows of bytes from rows led by their filter's number."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for row, (kind, line) in enumerate(zip(raw[:, 0].tolist(), raw[:, 1:], strict=True)):
        if kind == 0:
            out[row] = line
        elif kind == 1:  # running sums of every bpp-th byte, modulo 256
            for k in range(bpp):
                out[row, k::bpp] = np.cumsum(line[k::bpp], dtype=np.uint8)
        elif kind == 2:
            out[row] = line + above
        elif kind in (3, 4):
            done, up, new = bytearray(bpp) + bytearray(len(line)), bytes(bpp) + above.tobytes(), line.tobytes()
            for i, x in enumerate(new):
                a, b = done[i], up[i + bpp]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[i]
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                done[i + bpp] = (x + guess) & 255
            out[row] = np.frombuffer(done, np.uint8)[bpp:]
        else:
            raise BadImage(f"filter {kind} is not known")
        above = out[row]
    return out


def decode_png(data: bytes, most: int = 1 << 28) -> tuple[np.ndarray, int, int, np.ndarray | None]:
    """Samples (height, width, samples a pixel), colour type, bit depth and palette. Raises BadImage."""
    head, palette, packed = None, None, []
    for kind, body in chunks(data):
        if kind == b"IHDR" and len(body) == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise BadImage("no header")
    width, height, depth, colour, _, _, interlace = head
    if depth not in DEPTHS.get(colour, ()):
        raise BadImage(f"colour type {colour} of {depth} bits is not known")
    if interlace:
        raise BadImage("interlaced")
    if not width or not height or width * height > most:
        raise BadImage(f"size {width} x {height}")
    if colour == 3 and palette is None:
        raise BadImage("no palette")
    n = SAMPLES[colour]
    line = (width * n * depth + 7) // 8
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), height * (line + 1))
    except zlib.error as e:
        raise BadImage(f"pixels can't be unpacked: {e}") from None
    if len(raw) < height * (line + 1):
        raise BadImage("too few pixels")
    rows = unfiltered(np.frombuffer(raw, np.uint8).reshape(height, line + 1), max(1, n * depth // 8))
    if depth == 16:
        return rows.view(">u2").astype(np.uint16).reshape(height, width, n), colour, depth, palette
    if depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : rows.shape[1] * 8].reshape(height, -1, depth)
        rows = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, :width]
    return rows.reshape(height, width, n), colour, depth, palette


def grey(data: bytes) -> np.ndarray:
    """Grey values 0 to 255: colours by integer luma, low depths stretched, grey of 16 bits clipped at 255 and colours of 16 bits by their
    high byte; alpha has no part."""
    pixels, colour, depth, palette = decode_png(data)
    if colour == 3:
        if int(pixels.max(initial=0)) >= len(palette):
            raise BadImage("a pixel has no colour in the palette")
        pixels = palette[pixels[:, :, 0]]
    elif colour == 0:
        value = pixels[:, :, 0]
        return np.minimum(value, 255).astype(np.uint8) if depth == 16 else (value * (255 // ((1 << depth) - 1))).astype(np.uint8)
    elif depth == 16:
        pixels = (pixels >> 8).astype(np.uint8)
    if colour == 4:
        return pixels[:, :, 0]
    return ((pixels[:, :, :3].astype(np.int64) @ LUMA + 32768) >> 16).astype(np.uint8)


def first_sample(data: bytes) -> np.ndarray:
    """The first sample as stored: grey, red, or the place in the palette."""
    return decode_png(data)[0][:, :, 0]

"""PNG and baseline JPEG, reading and writing, in numpy: for files that Spark's own image reader leaves out, and for sinks."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter

import numpy as np


def encode_png(raster: np.ndarray) -> bytes:
    """An 8-bit grey (h, w) or RGB (h, w, 3) raster as PNG."""
    h, w = raster.shape[:2]
    rows = np.zeros((h, 1 + raster[0].size), np.uint8)
    rows[:, 1:] = raster.reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if raster.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray | None:
    """8-bit, non-interlaced PNG of any colour kind as (h, w) or (h, w, 3); alpha is left out."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[6] != 0:
        return None
    w, h, _, colour = head[:4]
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if n is None or len(raw) != h * (1 + w * n):
        return None
    raw = raw.reshape(h, 1 + w * n)
    out = np.zeros((h, w, n), np.uint8)
    above = np.zeros((w, n), np.int64)
    for y in range(h):
        filtered, line = raw[y, 0], raw[y, 1:].reshape(w, n).astype(np.int64)
        if filtered == 0:
            now = line
        elif filtered == 2:
            now = (line + above) & 255
        elif filtered == 1:
            now = np.cumsum(line, axis=0) & 255
        else:
            now = np.zeros((w, n), np.int64)
            left, corner = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for x in range(w):
                if filtered == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                left, corner = (line[x] + guess) & 255, above[x]
                now[x] = left
        out[y], above = now, now
    if colour == 3:
        return None if palette is None else palette[np.minimum(out[..., 0], len(palette) - 1)]
    return out[..., :3] if n >= 3 else out[..., 0]


def _zigzag() -> list[int]:
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return [8 * r + c for r, c in cells]


_ORDER = np.array(_zigzag())
_BASIS = np.array([[(0.5 if u else 0.5 / 2**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


class _Bits:
    """Bits of an entropy-coded interval, most significant first; ones follow the end."""

    def __init__(self, data: bytes):
        self.data, self.left = data + b"\xff" * 12, 8 * (len(data) + 8)
        self.total = self.left

    def peek(self, n: int) -> int:
        at = self.total - self.left
        window = int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "big")
        return (window >> (32 - (at & 7) - n)) & ((1 << n) - 1)


def _codes(body: bytes, into: dict) -> None:
    at = 0
    while at + 17 <= len(body):
        counts, k, code, table = body[at + 1 : at + 17], at + 17, 0, {}
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                table[(length, code)] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        into[body[at]] = table
        at = k


def decode_jpeg(data: bytes) -> np.ndarray | None:
    """A baseline JPEG as (h, w) or (h, w, 3); null for other kinds of JPEG and for broken ones."""
    try:
        return _decode_jpeg(data)
    except (struct.error, IndexError, KeyError, ValueError):
        return None


def _decode_jpeg(data: bytes) -> np.ndarray | None:
    if data[:2] != b"\xff\xd8":
        return None
    quant, huffman, parts, restart, at = {}, {}, [], 0, 2
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            _codes(body, huffman)
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return None
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            use = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    flat, intervals, begin, i = data, [], at, at
    while True:
        i = flat.index(b"\xff", i)
        follow = flat[i + 1]
        if follow == 0:
            i += 2
            continue
        intervals.append(flat[begin:i].replace(b"\xff\x00", b"\xff"))
        if not 0xD0 <= follow <= 0xD7:
            break
        begin = i = i + 2
    blocks = [np.zeros((down * v, across * h, 64), np.int64) for _, h, v, _ in parts]
    bits, mcu, step = None, 0, restart or across * down
    for my in range(down):
        for mx in range(across):
            if mcu % step == 0:
                bits, last = _Bits(intervals[mcu // step]), [0] * len(parts)
            for c, (name, h, v, _) in enumerate(parts):
                for b in range(h * v):
                    coefs = _block(bits, huffman[use[name] >> 4], huffman[0x10 | (use[name] & 15)])
                    last[c] += coefs[0]
                    coefs[0] = last[c]
                    blocks[c][my * v + b // h, mx * h + b % h] = coefs
            mcu += 1
    planes = []
    for (_, h, v, q), found in zip(parts, blocks, strict=True):
        square = np.zeros(found.shape, np.float64)
        square[..., _ORDER] = found * quant[q]
        pixels = np.einsum("xu,abuv,yv->abxy", _BASIS, square.reshape(*found.shape[:2], 8, 8), _BASIS) + 128
        plane = pixels.transpose(0, 2, 1, 3).reshape(found.shape[0] * 8, found.shape[1] * 8)
        planes.append(np.repeat(np.repeat(plane, vm // v, axis=0), hm // h, axis=1)[:height, :width])
    if len(planes) < 3:
        return np.clip(np.round(planes[0]), 0, 255).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.round(rgb), 0, 255).astype(np.uint8)


def _symbol(bits: _Bits, table: dict) -> int:
    code = 0
    for length in range(1, 17):
        code = bits.peek(length)
        if (length, code) in table:
            bits.left -= length
            return table[(length, code)]
    raise ValueError("bits that are no code")


def _amplitude(bits: _Bits, size: int) -> int:
    if not size:
        return 0
    value = bits.peek(size)
    bits.left -= size
    return value if value >> (size - 1) else value - (1 << size) + 1


def _block(bits: _Bits, dc: dict, ac: dict) -> list[int]:
    if bits.left < 64:
        raise ValueError("the scan is cut short")
    out = [0] * 64
    out[0] = _amplitude(bits, _symbol(bits, dc))
    k = 1
    while k < 64:
        s = _symbol(bits, ac)
        if not s & 15:
            if s >> 4 != 15:
                break
            k += 16
            continue
        k += s >> 4
        out[k] = _amplitude(bits, s & 15)
        k += 1
    return out


def decode(data: bytes) -> np.ndarray | None:
    """PNG or baseline JPEG; null for all else."""
    try:
        return decode_png(data) if data[:4] == b"\x89PNG" else decode_jpeg(data)
    except (zlib.error, ValueError):
        return None


#: The usual quantisation steps of luma and chroma at quality 50, row by row.
LUMA_STEPS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA_STEPS = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)


def _steps(base: tuple, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def code_lengths(times: dict[int, int]) -> list[tuple[int, int]]:
    """(bits, symbol) of a Huffman code of 16 bits at most, in order of codes; the code of all ones is left free."""
    while True:
        heap = [(n, s, (s,)) for s, n in times.items()] + [(0, 256, (256,))]
        heapq.heapify(heap)
        bits = dict.fromkeys([*times, 256], 0)
        while len(heap) > 1:
            (n1, s1, a), (n2, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            for s in a + b:
                bits[s] += 1
            heapq.heappush(heap, (n1 + n2, s1, a + b))
        if max(bits.values()) <= 16:
            return sorted((n, s) for s, n in bits.items())[:-1]  # 256, the rarest, has the last of the longest codes
        times = {s: n // 2 + 1 for s, n in times.items()}


def encode_jpeg(raster: np.ndarray, quality: int = 80) -> bytes:
    """An 8-bit grey (h, w) or RGB (h, w, 3) raster as baseline JPEG, chroma whole, with Huffman codes of its own."""
    h, w = raster.shape[:2]
    x = raster.astype(np.float64)
    planes = [x]
    if x.ndim == 3:
        r, g, b = x[..., 0], x[..., 1], x[..., 2]
        luma = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [luma, (b - luma) / 1.772 + 128, (r - luma) / 1.402 + 128]
    steps = [_steps(LUMA_STEPS, quality), _steps(CHROMA_STEPS, quality)]
    found = []
    for k, plane in enumerate(planes):
        whole = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
        cells = whole.reshape(whole.shape[0] // 8, 8, whole.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        flat = np.einsum("xu,nxy,yv->nuv", _BASIS, cells, _BASIS).reshape(-1, 64)
        found.append(np.round(flat / steps[min(k, 1)])[:, _ORDER].astype(int))
    symbols: list[tuple[int, int, int, int]] = []  # table, symbol, value, bits of the value
    last = [0] * len(found)
    for n in range(len(found[0])):
        for k, cells in enumerate(found):
            cell, table = cells[n], min(k, 1)
            step, last[k] = int(cell[0]) - last[k], int(cell[0])
            size = abs(step).bit_length()
            symbols.append((table, size, step if step >= 0 else step + (1 << size) - 1, size))
            at = 0
            for i in np.flatnonzero(cell[1:]).tolist():
                run, v = i - at, int(cell[1 + i])
                at = i + 1
                symbols += [(16 + table, 0xF0, 0, 0)] * (run >> 4)
                size = abs(v).bit_length()
                symbols.append((16 + table, (run & 15) << 4 | size, v if v >= 0 else v + (1 << size) - 1, size))
            if at < 63:
                symbols.append((16 + table, 0, 0, 0))
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    parts, codes = [], {}
    for table in sorted({s[0] for s in symbols}):
        lengths = code_lengths(Counter(s[1] for s in symbols if s[0] == table))
        code, now = 0, 0
        for bits, symbol in lengths:
            code <<= bits - now
            codes[table, symbol], now, code = f"{code:0{bits}b}", bits, code + 1
        parts.append(segment(0xC4, bytes([table, *(sum(n == k for n, _ in lengths) for k in range(1, 17)), *(s for _, s in lengths)])))
    stream = "".join(codes[t, s] + (f"{v:0{n}b}" if n else "") for t, s, v, n in symbols)
    stream += "1" * (-len(stream) % 8)
    body = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\x00")
    n = len(planes)
    frame = struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(n))
    scan = bytes([n]) + b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(n)) + b"\0\x3f\0"
    tables = b"".join(segment(0xDB, bytes([k]) + steps[k][_ORDER].astype(np.uint8).tobytes()) for k in range(min(n, 2)))
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    return head + tables + segment(0xC0, frame) + b"".join(parts) + segment(0xDA, scan) + body + b"\xff\xd9"

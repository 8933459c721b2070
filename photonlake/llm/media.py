"""Media columns as baseline JPEG: markers, Huffman scans, DC-only luminance thumbnails.

``Scans`` decodes the entropy-coded part of a baseline JPEG. All restart intervals of all images that share
tables and components advance together, one MCU at a time, so Python runs per MCU of an interval and numpy
runs over intervals. Only DC coefficients are kept; AC symbols are read to find their end. ``pack`` writes a
payload losslessly: a byte is the DC coefficient of one 8x8 block of a grey image (quantiser 8, so the block
is flat at that byte's value), 64 blocks a row, one restart interval for each row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

#: Blocks in a row of a packed image, and the rows that one image can have (its height is a 16-bit number).
ROW = 64
MAX_ROWS = 8191
#: A packed image's tables: twelve DC size categories of 4 bits each, one AC code, the end of block, of 1 bit.
_DC_BITS, _DC_VALUES = [0, 0, 0, 12] + [0] * 12, list(range(12))
_AC_BITS, _AC_VALUES = [1] + [0] * 15, [0]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _packed_head(rows: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, bytes([0]) + bytes([8] * 64)),
        _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * rows, 8 * ROW, 1, 1, 0x11, 0)),
        _segment(0xC4, bytes([0x00, *_DC_BITS, *_DC_VALUES])),
        _segment(0xC4, bytes([0x10, *_AC_BITS, *_AC_VALUES])),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


_SIZE_OF = np.array([0] + [int(i).bit_length() for i in range(1, 256)], np.uint64)


def _entropy_rows(samples: np.ndarray, last: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of each row of samples, stuffed and with its marker, and the length of each row.

    last: the row ends its image (EOI instead of RSTn); count: the row's number in its image.
    """
    n = len(samples)
    diff = np.diff(samples.astype(np.int64) - 128, axis=1, prepend=0)
    size = _SIZE_OF[np.abs(diff)]
    amplitude = np.where(diff < 0, diff + (np.int64(1) << size.astype(np.int64)) - 1, diff).astype(np.uint64)
    code = ((size << size) | amplitude) << np.uint64(1)
    bits = size + np.uint64(5)
    for _ in range(2):  # neighbours join: four codes are 52 bits at most
        code = (code[:, 0::2] << bits[:, 1::2]) | code[:, 1::2]
        bits = bits[:, 0::2] + bits[:, 1::2]
    ends = np.cumsum(bits, axis=1).astype(np.int64)
    total = ends[:, -1]
    used = (total + 7) // 8
    out = np.zeros((n, int(used.max()) + 10), np.uint8)
    rows = np.arange(n)
    for j in range(code.shape[1]):
        start = ends[:, j] - bits[:, j].astype(np.int64)
        word = code[:, j] << (np.uint64(64) - bits[:, j] - (start & 7).astype(np.uint64))
        at = start >> 3
        for k in range(8):
            out[rows, at + k] |= (word >> np.uint64(56 - 8 * k)).astype(np.uint8)
    pad = (8 - total % 8) % 8
    out[rows, used - 1] |= ((1 << pad) - 1).astype(np.uint8)
    keep = np.arange(out.shape[1]) < used[:, None]
    stuffed = (out == 255) & keep
    out[rows, used] = 255
    out[rows, used + 1] = np.where(last, 0xD9, 0xD0 + count % 8)
    counts = stuffed.astype(np.int64) + (np.arange(out.shape[1]) < (used + 2)[:, None])
    flat = np.repeat(out.ravel(), counts.ravel())
    flat[np.cumsum(counts.ravel())[stuffed.ravel()] - 1] = 0
    return flat, counts.sum(axis=1)


def pack(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload: one or more JPEG files, end to end. Payload lengths are multiples of 64."""
    if not payloads:
        return []
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    rows = np.array([len(p) // ROW for p in payloads])
    number = np.arange(len(samples)) - np.repeat(np.cumsum(rows) - rows, rows)
    in_image = number % MAX_ROWS
    last = np.append(in_image[1:] == 0, True)
    flat, lens = _entropy_rows(samples, last, in_image)
    ends = np.cumsum(lens)
    out, row = [], 0
    for r in rows:
        parts = []
        for at in range(0, int(r), MAX_ROWS):
            k = min(MAX_ROWS, int(r) - at)
            begin = int(ends[row - 1]) if row else 0
            parts += [_packed_head(k), flat[begin : ends[row + k - 1]].tobytes()]
            row += k
        out.append(b"".join(parts))
    return out


class BadJpeg(ValueError):
    """The bytes are no baseline JPEG that can be read."""


class Image:
    """What the markers of one JPEG say: sizes, components, tables, and where its scan begins and ends."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise BadJpeg("no SOI marker")
        at += 2
        self.quant: dict[int, int] = {}
        self.huffman: dict[int, tuple[bytes, bytes]] = {}
        self.restart, self.parts = 0, []
        self.width = self.height = 0
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) or data[at] != 0xFF:
                raise BadJpeg("a marker is missing")
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if len(body) + 2 != size:
                raise BadJpeg("a segment is cut short")
            if marker == 0xDB:
                self._tables(body)
            elif marker == 0xC4:
                self._codes(body)
            elif marker in (0xC0, 0xC1):
                self._frame(body)
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise BadJpeg("only baseline frames are read")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xDA:
                self._scan(body)
                self.begin = at
                return
            elif marker == 0xD9:
                raise BadJpeg("no scan")

    def _tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            self.quant[number] = int.from_bytes(body[at + 1 : at + 2 + bool(wide)], "big")  # of the DC coefficient
            at += 1 + 64 * (1 + bool(wide))

    def _codes(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            counts = body[at + 1 : at + 17]
            self.huffman[body[at]] = (counts, body[at + 17 : at + 17 + sum(counts)])
            at += 17 + sum(counts)

    def _frame(self, body: bytes) -> None:
        if len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5]:
            raise BadJpeg("not a frame of 8-bit samples")
        self.height, self.width = struct.unpack_from(">HH", body, 1)
        if not self.height or not self.width:
            raise BadJpeg("an empty frame")
        self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]

    def _scan(self, body: bytes) -> None:
        n = body[0] if body else 0
        if not self.parts or n != len(self.parts) or len(body) < 1 + 2 * n:
            raise BadJpeg("a scan of all components is wanted")
        use = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(n)}
        h, v = (max(p[k] for p in self.parts) for k in (1, 2))
        if n == 1:  # not interleaved: an MCU is one block
            h = v = 1
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        self.across, self.down = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        #: For each block of an MCU: component, DC table, AC table.
        self.order = []
        for k, (name, ph, pv, _) in enumerate(self.parts):
            if name not in use or use[name] >> 4 not in self.huffman or 0x10 | (use[name] & 15) not in self.huffman:
                raise BadJpeg("a Huffman table is missing")
            self.order += [(k, use[name] >> 4, 0x10 | (use[name] & 15))] * (ph * pv)
        self.mcus = self.across * self.down
        if self.parts[0][3] not in self.quant:
            raise BadJpeg("a quantisation table is missing")

    def kind(self) -> tuple:
        """Images of one kind can be decoded together."""
        return (tuple(self.order), tuple(sorted(self.huffman.items())))


def _lookup(counts: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit prefix, the length of its code (0: none) and its symbol."""
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            if k >= len(values) or code >= 1 << bits:
                raise BadJpeg("a Huffman table overflows")
            span = slice(code << (16 - bits), (code + 1) << (16 - bits))
            length[span], symbol[span] = bits, values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


def _intervals(data: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a scan: its bytes without stuffing, where each restart interval begins in them, and where the scan ends."""
    ff = np.flatnonzero(data[begin:-1] == 255) + begin
    after = data[ff + 1]
    ending = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    end = int(ending[0]) if len(ending) else len(data)
    ff, after = ff[ff < end], after[ff < end]
    drop = np.zeros(end - begin, bool)
    drop[ff[after == 0] + 1 - begin] = True
    restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop[restarts - begin] = True
    drop[restarts + 1 - begin] = True
    before = np.cumsum(drop)
    starts = np.concatenate([[0], restarts + 2 - begin])
    starts = starts - np.concatenate([[0], before[restarts + 1 - begin]])
    return data[begin:end][~drop], starts, end


def decode_dc(images: list[tuple[Image, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The DC coefficients (MCU, block of the MCU) of images of one kind, given as (image, bytes, interval starts)."""
    first = images[0][0]
    tables = {t: _lookup(*first.huffman[t]) for _, dc, ac in first.order for t in (dc, ac)}
    base, starts, counts, owners = 0, [], [], []
    for k, (image, body, begins) in enumerate(images):
        per = image.restart or image.mcus
        need = -(-image.mcus // per)
        if len(begins) < need:
            raise BadJpeg("restart intervals are missing")
        starts.append(begins[:need] + base)
        counts.append(np.minimum(per, image.mcus - per * np.arange(need)))
        owners.append(np.full(need, k))
        base += len(body) + 8
    raw = np.concatenate([np.concatenate([body, np.full(8, 255, np.uint8)]) for _, body, _ in images] + [np.full(8, 255, np.uint8)])
    # A 40-bit window from each byte: 16 bits of code and 11 of amplitude fit behind a shift of up to 7.
    window = np.zeros(len(raw) - 4, np.uint64)
    for j in range(5):
        window = (window << np.uint64(8)) | raw[j : len(raw) - 4 + j]
    bit = np.concatenate(starts).astype(np.int64) * 8
    count = np.concatenate(counts)
    limit = (len(window) - 1) * 8
    out = np.zeros((len(bit), int(count.max()), len(first.order)), np.int32)
    order = np.argsort(-count, kind="stable")  # those with most MCUs first, so the live ones are a prefix
    bit, falling = bit[order], count[order]
    previous = np.zeros((len(bit), len(first.parts)), np.int64)

    def take(at: np.ndarray, table: tuple[np.ndarray, np.ndarray]):
        if len(at) and int(at.max()) > limit:
            raise BadJpeg("the scan is cut short")
        bits = (window[at >> 3] << (at & 7).astype(np.uint64)) & np.uint64((1 << 40) - 1)
        prefix = (bits >> np.uint64(24)).astype(np.int64)
        length = table[0][prefix]
        if not length.all():
            raise BadJpeg("bits that are no code")
        return bits, length, table[1][prefix]

    for m in range(int(count.max())):
        live = int(np.searchsorted(-falling, -m, side="left"))
        at = bit[:live]
        for b, (part, dc, ac) in enumerate(first.order):
            bits, length, size = take(at, tables[dc])
            size64 = size.astype(np.uint64)
            value = ((bits << length.astype(np.uint64)) & np.uint64((1 << 40) - 1)) >> (np.uint64(40) - size64)
            value = value.astype(np.int64)
            half = np.int64(1) << np.maximum(size.astype(np.int64) - 1, 0)
            value = np.where((size > 0) & (value < half), value - 2 * half + 1, value)
            previous[:live, part] += value
            out[:live, m, b] = previous[:live, part]
            at = at + length + size
            todo, k = np.arange(live), np.ones(live, np.int64)
            while len(todo):
                _, length, symbol = take(at[todo], tables[ac])
                run, size = symbol >> 4, symbol & 15
                at[todo] += length.astype(np.int64) + size
                k[todo] += np.where(size > 0, run.astype(np.int64) + 1, np.where(run == 15, 16, 64))
                todo = todo[k[todo] < 64]
        bit[:live] = at
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    out, owner = out[back], np.concatenate(owners)
    keep = np.arange(out.shape[1]) < count[:, None]
    split = np.cumsum(np.bincount(owner, weights=count, minlength=len(images)).astype(np.int64))[:-1]
    return np.split(out[keep], split)


def _luminance(image: Image, dc: np.ndarray) -> np.ndarray:
    """The DC-only thumbnail: one 8-bit sample for each block of the first component."""
    _, h, v, table = image.parts[0]
    blocks = dc[:, : h * v].reshape(image.down, image.across, v, h).transpose(0, 2, 1, 3)
    grid = blocks.reshape(image.down * v, image.across * h)
    tall, wide = -(-image.height // 8), -(-image.width // 8)
    if len(image.parts) > 1:
        hm, vm = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
        tall, wide = -(-(-(-image.height * v // vm)) // 8), -(-(-(-image.width * h // hm)) // 8)
    grid = grid[:tall, :wide]
    return np.clip((grid.astype(np.int64) * image.quant[table] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def thumbnails(stored: list[bytes]) -> list[list[tuple[Image, np.ndarray]] | None]:
    """The images of each stored value (JPEG files end to end) with their thumbnails; None where one can't be read."""
    out: list[list | None] = [[] for _ in stored]
    kinds: dict[tuple, list] = {}
    for i, data in enumerate(stored):
        flat, at = np.frombuffer(data, np.uint8), 0
        try:
            while at < len(data) or not at:
                image = Image(data, at)
                body, begins, end = _intervals(flat, image.begin)
                out[i].append(None)
                kinds.setdefault(image.kind(), []).append((i, len(out[i]) - 1, image, body, begins))
                at = end + 2
        except (BadJpeg, struct.error, IndexError):
            out[i] = None
    for same in kinds.values():
        try:
            found = decode_dc([x[2:] for x in same])
        except BadJpeg:
            found = []
            for x in same:  # one is broken: each on its own
                try:
                    found += decode_dc([x[2:]])
                except BadJpeg:
                    found.append(None)
        for (i, k, image, _, _), dc in zip(same, found, strict=True):
            if out[i] is not None:
                if dc is None:
                    out[i] = None
                else:
                    out[i][k] = (image, _luminance(image, dc))
    return out


def average_hash(thumb: np.ndarray) -> str:
    """64 bits in hex: whether each cell of an 8x8 grid over the thumbnail is at least as bright as all of it."""
    rows = np.linspace(0, len(thumb), 9).astype(int)
    cols = np.linspace(0, thumb.shape[1], 9).astype(int)
    total = np.zeros((len(thumb) + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    top, left = np.minimum(rows[:-1], len(thumb) - 1), np.minimum(cols[:-1], thumb.shape[1] - 1)
    low, right = np.maximum(rows[1:], top + 1), np.maximum(cols[1:], left + 1)
    cell = total[low][:, right] - total[top][:, right] - total[low][:, left] + total[top][:, left]
    area = (low - top)[:, None] * (right - left)
    bits = cell * thumb.size >= total[-1, -1] * area
    return np.packbits(bits).tobytes().hex()


def describe(images: list[tuple[Image, np.ndarray]]) -> str:
    """Dimensions and thumbnail hash of each image."""
    return ";".join(f"{im.width}x{im.height}:{t.shape[1]}x{t.shape[0]}:{average_hash(t)}" for im, t in images)


def jpeg_features(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Dimensions and DC-only luminance thumbnails of a column of baseline JPEG files.

    Returns the id, ``width``, ``height`` (of the first image), ``thumbnail`` (its samples, row by row),
    ``thumb_width``, ``thumb_height``, ``thumb_hash`` and ``feature``. Where the bytes are null, empty or no
    baseline JPEG, all of these are null and the row stays. Repeated rows stay repeated; other columns aren't read.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    names = [id_col, "width", "height", "thumb_width", "thumb_height", "thumbnail", "thumb_hash", "feature"]
    schema = f"`{id_col}` {id_type}, width int, height int, thumb_width int, thumb_height int, thumbnail binary, thumb_hash string, feature string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for found in thumbnails([x or b"" for x in batch.column(1).to_pylist()]):
            if not found:
                rows.append((None,) * 7)
            else:
                im, t = found[0]
                rows.append((im.width, im.height, t.shape[1], t.shape[0], t.tobytes(), average_hash(t), describe(found)))
        types = [pa.int32()] * 4 + [pa.binary(), pa.string(), pa.string()]
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    return arrow_map(df.select(df[id_col], df[media_col]), run, schema, media_col)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Store each text as JPEG, read the stored bytes back and compute features of them.

    The payload is the UTF-8 text (null: empty) with bytes 0 up to a positive multiple of 64. Returns the id,
    ``n_bytes``, ``payload_bytes``, ``payload_sha256`` and ``tail_crc32`` (both of the payload read back),
    ``media_bytes``, ``media_sha256``, ``feature`` and, if ``keep_media``, ``media``. Equal texts have equal
    values; empty and null texts have one row of zeros. A text of over 512 kB takes several images. Repeated
    rows stay repeated; an empty table gives an empty result; other columns are not read. No shuffle.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
              "media_bytes bigint, media_sha256 string, feature string" + ", media binary" * keep_media)  # fmt: skip

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        media = pack([t.ljust(max(ROW, -(-len(t) // ROW) * ROW), b"\0") for t in texts])
        rows = []
        for text, stored, found in zip(texts, media, thumbnails(media), strict=True):
            payload = b"".join(t.tobytes() for _, t in found)
            rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                         len(stored), hashlib.sha256(stored).hexdigest(), describe(found)))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = [batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types))]
        names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        if keep_media:
            cols.append(pa.array(media, pa.binary()))
            names.append("media")
        return pa.RecordBatch.from_arrays(cols, names=names)

    return arrow_map(df.select(df[id_col], df[text_col]), run, schema, text_col)

"""EXIF of JPEG and TIFF files, read from the bytes. Whatever is broken is null; nothing raises."""

from __future__ import annotations

import struct

#: Tags by number, in the first directory, the EXIF directory and the GPS directory.
MAKE, MODEL, ORIENTATION, EXIF_AT, GPS_AT = 0x010F, 0x0110, 0x0112, 0x8769, 0x8825
EXPOSURE_TIME, F_NUMBER, ISO, DATE_ORIGINAL, FOCAL_LENGTH = 0x829A, 0x829D, 0x8827, 0x9003, 0x920A
LAT_REF, LAT, LNG_REF, LNG = 1, 2, 3, 4
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
FIELDS = ("date_time_original", "gps_lat", "gps_lng", "camera_make", "camera_model", "focal_length_mm", "aperture", "iso", "shutter_speed", "orientation")


class Seeked:
    """Slices of an open file, read where they lie, so what isn't asked for isn't read."""

    def __init__(self, file):
        self.file, self.size = file, file.seek(0, 2)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        self.file.seek(start)
        return self.file.read(max(0, stop - start))


def _container(data: bytes | Seeked) -> bytes | Seeked | None:
    """The TIFF structure of a JPEG's APP1 segment, or of the file itself."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        mark, marker, size = struct.unpack(">BBH", data[at : at + 4])
        if mark != 0xFF:
            return None
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if marker == 0xDA:
            return None
        at += 2 + size
    return None


def _directory(tiff: bytes | Seeked, order: str, at: int) -> dict:
    """Values by tag: text, or lists of numbers, rationals as (numerator, denominator)."""
    out = {}
    if at <= 0 or at + 2 > len(tiff):
        return out
    for i in range(struct.unpack(f"{order}H", tiff[at : at + 2])[0]):
        entry = at + 2 + 12 * i
        if entry + 12 > len(tiff):
            break
        tag, kind, count = struct.unpack(f"{order}HHI", tiff[entry : entry + 8])
        size = _SIZES.get(kind, 0) * count
        if not size:
            continue
        place = entry + 8 if size <= 4 else struct.unpack(f"{order}I", tiff[entry + 8 : entry + 12])[0]
        raw = tiff[place : place + size]
        if len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace")
        elif kind in (5, 10):
            out[tag] = list(struct.iter_unpack(f"{order}{'II' if kind == 5 else 'ii'}", raw))
        else:
            code = {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind]
            out[tag] = [x[0] for x in struct.iter_unpack(f"{order}{code}", raw)]
    return out


def _number(value) -> float | None:
    if not isinstance(value, list) or not value:
        return None
    first = value[0]
    if isinstance(first, tuple):
        return first[0] / first[1] if first[1] else None
    return float(first)


def gps_degrees(parts, ref: str | None) -> float | None:
    """Decimal degrees of three rationals; negative to the south and west."""
    if not isinstance(parts, list) or len(parts) < 3:
        return None
    d, m, s = (_number([p]) for p in parts[:3])
    if d is None or m is None or s is None:
        return None
    value = d + m / 60 + s / 3600
    return -value if ref and ("S" in ref or "W" in ref) else value


def _seconds_text(value) -> str | None:
    if not isinstance(value, list) or not value or not isinstance(value[0], tuple) or not value[0][1]:
        return None
    n, d = value[0]
    if n and d % n == 0 and d != n:
        return f"1/{d // n} s"
    return f"{n / d:g} s"


def _plain(text) -> str | None:
    return text.replace('"', "").strip() if isinstance(text, str) else None


def read_exif(data: bytes | Seeked) -> dict | None:
    """The fields of ``FIELDS``, of a file's bytes or of an open file; null where it has no EXIF."""
    try:
        tiff = _container(data)
        if tiff is None or len(tiff) < 8 or tiff[:2] not in (b"II", b"MM"):
            return None
        order = "<" if tiff[:2] == b"II" else ">"
        main = _directory(tiff, order, struct.unpack(f"{order}I", tiff[4:8])[0])
        pointer = lambda tag: int(main[tag][0]) if isinstance(main.get(tag), list) and main[tag] else 0
        exif, gps = _directory(tiff, order, pointer(EXIF_AT)), _directory(tiff, order, pointer(GPS_AT))
        iso, turn = _number(exif.get(ISO)), _number(main.get(ORIENTATION))
        return {
            "date_time_original": _plain(exif.get(DATE_ORIGINAL)),
            "gps_lat": gps_degrees(gps.get(LAT), gps.get(LAT_REF)), "gps_lng": gps_degrees(gps.get(LNG), gps.get(LNG_REF)),
            "camera_make": _plain(main.get(MAKE)), "camera_model": _plain(main.get(MODEL)),
            "focal_length_mm": _number(exif.get(FOCAL_LENGTH)), "aperture": _number(exif.get(F_NUMBER)),
            "iso": None if iso is None else int(iso), "shutter_speed": _seconds_text(exif.get(EXPOSURE_TIME)),
            "orientation": None if turn is None else int(turn),
        }
    except (struct.error, ValueError, IndexError, TypeError, OverflowError):
        return None


def read_orientation(data: bytes) -> int | None:
    found = read_exif(data)
    return found["orientation"] if found else None


def jpeg_dimensions(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a JPEG from its frame header, without decoding."""
    at = 2
    if data[:2] != b"\xff\xd8":
        return None
    while at + 9 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        at += 2 + size
    return None

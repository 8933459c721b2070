"""Photos made from formulas: a tree whose every file, pixel and EXIF field is known, and variants of a photo.

The tree serves the queries that compare scanning, decoding and metrics with SQL, which computes the same pixels.
"""

from __future__ import annotations

import os
import struct

import numpy as np

from .codecs import encode_jpeg, encode_png

#: Variants of a photo, by standard deviation of a Gaussian blur, and by factor of brightness.
BLURS = {"sharp": 0.0, "blur_slight": 0.5, "blur_mild": 1.0, "blur_moderate": 2.0, "blur_heavy": 4.0, "blur_extreme": 8.0}
EXPOSURES = {
    "exp_very_dark": 0.1, "exp_dark": 0.3, "exp_underexposed": 0.5, "exp_slightly_dark": 0.7, "exp_normal": 1.0,
    "exp_slightly_bright": 1.4, "exp_overexposed": 1.8, "exp_bright": 2.5, "exp_very_bright": 4.0,
}
COMBINED = ("combo_blurry_dark", 3.0, 0.4)

#: Rasters (w, h, side of a check, its two shades, and where the checkerboard is: x from and to, y from and to).
RASTERS = {
    "flat": (512, 384, 8, 128, 128, (0, 512, 0, 384)),
    "checker8": (512, 384, 8, 0, 255, (0, 512, 0, 384)),
    "bokeh_subject": (512, 384, 4, 0, 255, (208, 304, 144, 240)),
    "wide_aperture": (512, 384, 4, 0, 255, (224, 288, 160, 224)),
    "peak_low": (1024, 768, 4, 116, 140, (448, 512, 320, 384)),
    "peak_high": (1024, 768, 4, 114, 142, (448, 512, 320, 384)),
    "block30": (1024, 768, 4, 120, 136, (256, 640, 192, 512)),
}
BACKGROUND = 128
#: Where each raster's file lies; names that begin with a dot or an underscore count as well.
PLACES = {
    "flat": "flat.png", "checker8": "checker8.PNG", "bokeh_subject": "_bokeh_subject.png", "wide_aperture": "sub/wide_aperture.png",
    "peak_low": "sub/.peak_low.png", "peak_high": "sub/_deep/peak_high.png", "block30": "sub/a b é#1.png",
}
#: Grey JPEG files (w, h, shade): a flat shade comes through a lossy format as it is.
GREYS = {"grey16.jpg": (64, 48, 16), "sub/grey240.jpeg": (61, 45, 240), "turned.jpg": (80, 40, 128), "sub/south.JPG": (40, 24, 200)}
#: Files that are no photos, or can't be decoded.
OTHERS = {"notes.txt": 10, "film.gif": 20, "noend": 5, "broken.jpg": 30, "raw.Cr2": 40, "sub/phone.heic": 50}
#: EXIF of files by place: orientation, exposure time, aperture, ISO, focal length, date, latitude and its reference, longitude and its reference.
EXIF_OF = {
    "turned.jpg": (6, (1, 250), (18, 10), 400, (85, 1), "2024:01:15 14:30:00", ((40, 1), (30, 1), (0, 1)), "N", ((10, 1), (15, 1), (36, 1)), "W"),
    "sub/south.JPG": (3, (1, 30), (56, 10), 100, (200, 1), "2024-01-15 14:30:00", ((33, 1), (52, 1), (12, 1)), "S", ((151, 1), (12, 1), (36, 1)), "E"),
}
MAKE, MODEL = "Acme", "X1"
#: Modification time of the first file, in order of places; each next is a minute later.
FIRST_TIME = 1_700_000_000


def raster(name: str) -> np.ndarray:
    w, h, side, low, high, (left, right, top, bottom) = RASTERS[name]
    y, x = np.mgrid[0:h, 0:w]
    board = np.where(((x // side) ^ (y // side)) & 1 == 0, low, high)
    inside = (x >= left) & (x < right) & (y >= top) & (y < bottom)
    return np.where(inside, board, BACKGROUND).astype(np.uint8)


def exif_segment(turn, exposure, aperture, iso, focal, date, lat, lat_ref, lng, lng_ref, order: str = "<") -> bytes:
    """An APP1 segment with these fields, in either byte order."""
    heap = bytearray()
    ratio = lambda *xs: b"".join(struct.pack(f"{order}II", *x) for x in xs)
    short, text = lambda v: struct.pack(f"{order}H", v), lambda s: s.encode() + b"\0"
    main_at, sub_at, gps_at, heap_at = 8, 120, 260, 400

    def directory(entries) -> bytes:
        body = struct.pack(f"{order}H", len(entries))
        for tag, kind, count, raw in entries:
            if len(raw) > 4:
                body += struct.pack(f"{order}HHII", tag, kind, count, heap_at + len(heap))
                heap.extend(raw)
            else:
                body += struct.pack(f"{order}HHI", tag, kind, count) + raw.ljust(4, b"\0")
        return body + struct.pack(f"{order}I", 0)

    pointer = lambda at: struct.pack(f"{order}I", at)
    main = directory([(0x010F, 2, len(MAKE) + 1, text(MAKE)), (0x0110, 2, len(MODEL) + 1, text(MODEL)), (0x0112, 3, 1, short(turn)), (0x8769, 4, 1, pointer(sub_at)), (0x8825, 4, 1, pointer(gps_at))])
    sub = directory([(0x829A, 5, 1, ratio(exposure)), (0x829D, 5, 1, ratio(aperture)), (0x8827, 3, 1, short(iso)), (0x9003, 2, 20, text(date)), (0x920A, 5, 1, ratio(focal))])
    gps = directory([(1, 2, 2, text(lat_ref)), (2, 5, 3, ratio(*lat)), (3, 2, 2, text(lng_ref)), (4, 5, 3, ratio(*lng))])
    out = bytearray(heap_at)
    out[0:8] = (b"II*\0" if order == "<" else b"MM\0*") + pointer(main_at)
    for at, part in ((main_at, main), (sub_at, sub), (gps_at, gps)):
        out[at : at + len(part)] = part
    body = b"Exif\0\0" + bytes(out + heap)
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body


def write_tree(root: str) -> None:
    """Write the tree: rasters as PNG, grey JPEG files, some with EXIF, files that are no photos, and links, which don't count."""
    files = {place: encode_png(raster(name)) for name, place in PLACES.items()}
    for k, (place, (w, h, shade)) in enumerate(GREYS.items()):
        data = encode_jpeg(np.full((h, w), shade, np.uint8), 90)
        if place in EXIF_OF:
            data = data[:2] + exif_segment(*EXIF_OF[place], order="<>"[k % 2]) + data[2:]
        files[place] = data
    files |= {place: b"x" * size for place, size in OTHERS.items()}
    for k, place in enumerate(sorted(files)):
        path = os.path.join(root, place)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(files[place])
        os.utime(path, (FIRST_TIME + 60 * k,) * 2)
    os.symlink(os.path.join(root, "flat.png"), os.path.join(root, "linked.png"))
    os.symlink(os.path.join(root, "sub"), os.path.join(root, "linked"))


def places() -> list[str]:
    """All files of the tree, in order."""
    return sorted([*PLACES.values(), *GREYS, *OTHERS])


def gaussian_blur(pixels: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur out to three deviations; edge pixels go on beyond the edge."""
    if not sigma:
        return pixels
    reach = max(1, int(np.ceil(3 * sigma)))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = pixels.astype(np.float64)
    for axis in (0, 1):
        pad = [(reach, reach) if k == axis else (0, 0) for k in range(out.ndim)]
        wide = np.pad(out, pad, mode="edge")
        out = sum(w * np.take(wide, range(k, k + pixels.shape[axis]), axis=axis) for k, w in enumerate(weights))
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def brightened(pixels: np.ndarray, factor: float) -> np.ndarray:
    """Every channel times a factor, within 0 to 255, fractions cut off."""
    return np.clip(pixels.astype(np.float32) * np.float32(factor), 0, 255).astype(np.uint8)


def variants(pixels: np.ndarray) -> dict[str, np.ndarray]:
    """The sixteen variants of a photo by name: six of blur, nine of exposure, one of both."""
    out = {name: gaussian_blur(pixels, sigma) for name, sigma in BLURS.items()}
    out |= {name: brightened(pixels, factor) for name, factor in EXPOSURES.items()}
    name, sigma, factor = COMBINED
    return out | {name: brightened(gaussian_blur(pixels, sigma), factor)}


def write_variants(pixels: np.ndarray, directory: str, quality: int = 75) -> list[str]:
    """Write the variants as JPEG files; returns their paths."""
    os.makedirs(directory, exist_ok=True)
    out = []
    for name, made in variants(pixels).items():
        out.append(os.path.join(directory, f"{name}.jpg"))
        with open(out[-1], "wb") as f:
            f.write(encode_jpeg(made, quality))
    return out


__all__ = ["brightened", "exif_segment", "gaussian_blur", "places", "raster", "variants", "write_tree", "write_variants"]

"""Pixel kernels in numpy, without Spark: one image in, numbers out."""

from __future__ import annotations

import numpy as np

from ..settings import (
    FLAT_RATIO,
    FLAT_VARIANCE,
    FOCUS_FLOOR,
    FOCUS_RATIO,
    MIN_TILE_SHARE,
    OVER_MIN,
    SHARP_VARIANCE,
    STRONG_BOKEH,
    STRONG_PLAIN,
    TILE,
    UNDER_MAX,
)

#: Weights of red, green and blue in luma.
LUMA = (0.2126, 0.7152, 0.0722)


def luma(rgb: np.ndarray) -> np.ndarray:
    """8-bit luma of an (h, w, 3) raster; a grey raster is its own."""
    if rgb.ndim == 2:
        return rgb
    return np.clip(np.round(rgb[..., :3].astype(np.float32) @ np.array(LUMA, np.float32)), 0, 255).astype(np.uint8)


def orient(raster: np.ndarray, orientation: int | None) -> np.ndarray:
    """The raster as EXIF orientation 1 to 8 says it is to be seen; others leave it."""
    flips = {2: lambda r: r[:, ::-1], 3: lambda r: r[::-1, ::-1], 4: lambda r: r[::-1], 5: lambda r: r.swapaxes(0, 1),
             6: lambda r: np.rot90(r, -1), 7: lambda r: r[::-1, ::-1].swapaxes(0, 1), 8: lambda r: np.rot90(r)}
    return np.ascontiguousarray(flips.get(orientation or 1, lambda r: r)(raster))


def _triangle_taps(src: int, dst: int) -> tuple[np.ndarray, np.ndarray]:
    """(dst, taps) places and weights of a triangle filter whose support widens with the reduction."""
    scale = src / dst
    reach = max(scale, 1.0)
    centre = (np.arange(dst) + 0.5) * scale
    at = np.floor(centre - reach).astype(int)[:, None] + np.arange(int(np.ceil(2 * reach)) + 2)
    w = np.clip(1 - np.abs(at + 0.5 - centre[:, None]) / reach, 0, None)
    w[(at < 0) | (at >= src)] = 0
    return np.clip(at, 0, src - 1), w / w.sum(axis=1, keepdims=True)


def _resampled(raster: np.ndarray, size: int) -> np.ndarray:
    """The raster with another number of rows. A tap at a time, so no wide copy of the source is made."""
    if raster.shape[0] == size:
        return raster
    at, w = _triangle_taps(raster.shape[0], size)
    if size < at.shape[1]:  # few rows of many taps each
        dense = np.zeros((size, raster.shape[0]))
        np.add.at(dense, (np.arange(size)[:, None], at), w)
        return np.tensordot(dense, raster.astype(np.float64), axes=(1, 0))
    out = np.zeros((size, *raster.shape[1:]))
    for t in range(at.shape[1]):
        out += raster[at[:, t]] * w[:, t].reshape(-1, *[1] * (raster.ndim - 1))
    return out


def resize(raster: np.ndarray, width: int, height: int) -> np.ndarray:
    """Separable triangle-filter convolution to a size. Halves are rounded up, whatever the order of the sums."""
    out = _resampled(raster, height)
    out = _resampled(np.ascontiguousarray(out.swapaxes(0, 1)), width).swapaxes(0, 1)
    return np.ascontiguousarray(np.clip(np.floor(out + (0.5 + 1e-6)), 0, 255).astype(np.uint8))


def fit_within(width: int, height: int, longest: int) -> tuple[int, int]:
    """The size with its longest side at ``longest``, whole pixels downward, one at least."""
    scale = longest / max(width, height)
    return max(1, int(width * scale)), max(1, int(height * scale))


def shrink(raster: np.ndarray, longest: int) -> np.ndarray:
    """The raster with its longest side at ``longest`` at most."""
    h, w = raster.shape[:2]
    return raster if max(w, h) <= longest else resize(raster, *fit_within(w, h, longest))


def halved(raster: np.ndarray, longest: int) -> np.ndarray:
    """Means of squares of 2, 4 or 8 pixels a side, as many as leave the longest side at ``longest`` or more.

    What a scaled JPEG decode gives: the mean of a square is its block's lowest frequency.
    """
    for _ in range(3):
        if max(raster.shape[:2]) // 2 < longest or min(raster.shape[:2]) < 2:
            break
        h, w = (n // 2 * 2 for n in raster.shape[:2])
        rows = raster[:h:2].astype(np.uint16) + raster[1:h:2]
        raster = ((rows[:, :w:2] + rows[:, 1:w:2] + 2) >> 2).astype(np.uint8)
    return raster


def laplacian(gray: np.ndarray) -> np.ndarray:
    """Four neighbours minus four times the pixel, on interior pixels."""
    g = gray.astype(np.int32)
    return g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]


def largest_cluster(cells: np.ndarray) -> int:
    """Size of the largest 4-connected set of true cells, by spreading least labels."""
    if not cells.any():
        return 0
    none = cells.size
    label = np.where(cells, np.arange(cells.size).reshape(cells.shape), none)
    while True:
        near = np.pad(label, 1, constant_values=none)
        least = np.minimum.reduce([label, near[:-2, 1:-1], near[2:, 1:-1], near[1:-1, :-2], near[1:-1, 2:]])
        least = np.where(cells, least, none)
        if (least == label).all():
            return int(np.bincount(label[cells]).max())
        label = least


def compute_blur(gray: np.ndarray, bokeh: bool = False, shake: bool = False, tile: int = TILE, min_share: float = MIN_TILE_SHARE) -> dict:
    """Tiled Laplacian statistics and the default verdict."""
    h, w = gray.shape
    out = dict.fromkeys(("laplacian_variance", "mean_tile_variance", "max_tile_variance", "p95_tile_variance", "sharp_tile_fraction", "largest_sharp_cluster"), 0.0)
    out |= {"bokeh_likely": bool(bokeh), "shake_risk": bool(shake), "is_blurry": True}
    if w < 3 or h < 3:
        return out
    lap = laplacian(gray)
    rows, cols = (np.maximum(np.arange(0, size - 1, tile), 1) - 1 for size in (h, w))
    down, across = len(rows), len(cols)
    per_tile = lambda v: np.add.reduceat(np.add.reduceat(v, rows, axis=0, dtype=np.int64), cols, axis=1).ravel()
    n = np.outer(np.diff(np.append(rows, h - 2)), np.diff(np.append(cols, w - 2))).ravel()
    s, q = per_tile(lap).astype(np.float64), per_tile(lap * lap).astype(np.float64)
    total = n.sum()
    overall = q.sum() / total - (s.sum() / total) ** 2
    out["laplacian_variance"] = float(overall)
    valid = n >= int(tile * tile * min_share)
    if not valid.any():
        out |= {k: float(overall) for k in ("mean_tile_variance", "max_tile_variance", "p95_tile_variance")}
        out["is_blurry"] = bool(overall < SHARP_VARIANCE)
        return out
    var = np.zeros(len(n))
    var[valid] = q[valid] / n[valid] - (s[valid] / n[valid]) ** 2
    own = np.sort(var[valid])
    sharp = valid & (var >= SHARP_VARIANCE)
    fraction, cluster = sharp.sum() / len(own), largest_cluster(sharp.reshape(down, across)) / len(own)
    peak, f, c = STRONG_BOKEH if bokeh else STRONG_PLAIN
    top = max(0.0, float(own[-1]))
    strong = top >= peak or (fraction >= f and cluster >= c)
    out |= {"mean_tile_variance": float(own.mean()), "max_tile_variance": top, "p95_tile_variance": float(own[min(int(len(own) * 0.95), len(own) - 1)]),
            "sharp_tile_fraction": float(fraction), "largest_sharp_cluster": float(cluster), "is_blurry": bool(not strong and overall < SHARP_VARIANCE)}
    return out


def compute_exposure(gray: np.ndarray, limit: float = 0.30) -> dict:
    """Mean luminance, shares of dark and bright pixels, and the verdict; no pixel is Normal."""
    total = gray.size
    if not total:
        return {"mean_luminance": 0.0, "pct_underexposed": 0.0, "pct_overexposed": 0.0, "verdict": "Normal"}
    bins = np.bincount(gray.ravel(), minlength=256)
    under, over = bins[: UNDER_MAX + 1].sum() / total, bins[OVER_MIN:].sum() / total
    verdict = "HighContrast" if under > limit and over > limit else "Underexposed" if under > limit else "Overexposed" if over > limit else "Normal"
    return {"mean_luminance": float((bins * np.arange(256)).sum() / total / 255), "pct_underexposed": float(under), "pct_overexposed": float(over), "verdict": verdict}


def focus_verdict(subject: float, background: float, ratio: float) -> str:
    if subject >= FOCUS_FLOOR and ratio >= FOCUS_RATIO:
        return "SubjectSharp"
    if subject < FOCUS_FLOOR <= background:
        return "BackFocus"
    return "AllBlurry" if subject < FOCUS_FLOOR and background < FOCUS_FLOOR else "SubjectBlurry"


def compute_subject_focus(gray: np.ndarray, boxes: list | None, source: str | None = None) -> dict | None:
    """Laplacian variance inside and outside of normalised boxes (x, y, w, h from the bottom left); null if a side is empty."""
    h, w = gray.shape
    if not boxes or w < 3 or h < 3:
        return None
    lap = laplacian(gray).astype(np.float64)
    nx, ny = (np.arange(1, w - 1) / w)[None, :], (1 - np.arange(1, h - 1) / h)[:, None]
    inside = np.zeros(lap.shape, bool)
    for x, y, bw, bh in boxes:
        inside |= (nx >= x) & (nx <= x + bw) & (ny >= y) & (ny <= y + bh)
    if inside.all() or not inside.any():
        return None
    subject, background = (float((v * v).mean() - v.mean() ** 2) for v in (lap[inside], lap[~inside]))
    ratio = subject / background if background > FLAT_VARIANCE else FLAT_RATIO
    return {"subject_blur_variance": subject, "background_blur_variance": background, "focus_ratio": ratio, "verdict": focus_verdict(subject, background, ratio), "subject_source": source}


#: Bits of a perceptual hash of the usual side.
HASH_BITS = 144


def perceptual_hash(gray: np.ndarray, side: int = 8) -> bytes:
    """Signs of horizontal, then vertical steps of the raster at (side + 1) squared: 2 * side * (side + 1) bits."""
    small = resize(gray, side + 1, side + 1).astype(int)
    bits = np.concatenate([(small[:, :-1] < small[:, 1:]).ravel(), (small[:-1] < small[1:]).ravel()])
    return np.packbits(bits, bitorder="little").tobytes()

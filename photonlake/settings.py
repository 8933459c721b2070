"""Thresholds of the engine. Every operator takes them as parameters; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """What a reviewer can turn. The defaults."""

    blur_threshold: float = 100.0
    exposure_threshold: float = 0.3
    duplicate_threshold: int = 10
    duplicate_window_secs: int = 5
    scene_window_secs: int = 60
    person_similarity: float = 0.65


#: Fixed values of the blur rule: tile side, share of a whole tile that makes it valid, variance of a sharp tile.
TILE = 64
MIN_TILE_SHARE = 0.25
SHARP_VARIANCE = 100.0
#: Peak, sharp fraction and largest cluster of a strong region, for bokeh and for other shots.
STRONG_BOKEH = (700.0, 0.04, 0.025)
STRONG_PLAIN = (900.0, 0.12, 0.06)
#: Last shade that is under, first that is over.
UNDER_MAX, OVER_MIN = 24, 230
#: Fixed values of the focus rule: sharpness floor, least ratio, ratio where the background has no variance.
FOCUS_FLOOR, FOCUS_RATIO, FLAT_RATIO, FLAT_VARIANCE = 100.0, 0.8, 10.0, 0.001
#: Fixed value: extensions of photos, in lower case.
EXTENSIONS = ("jpg", "jpeg", "png", "tiff", "tif", "webp", "heic", "heif", "cr2", "cr3", "nef", "arw", "dng", "orf", "rw2", "raf", "pef", "srw")

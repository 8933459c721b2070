"""Scenes of photos as they arrive (an extension: the batch operators know no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import Settings


def stream_scenes(photos: DataFrame, ts: str, by: str, window_secs: int = Settings.scene_window_secs, late: str = "10 minutes") -> DataFrame:
    """(first_ts, end_ts, by, photos) of scenes of at least two photos, once the watermark has passed them.

    ``ts`` is a timestamp column; a gap of exactly ``window_secs`` goes on. ``by`` (a camera, a photographer) keeps
    sources apart and spreads the state.
    """
    keys = [F.session_window(ts, f"{window_secs} seconds").alias("w"), F.col(by)]
    found = photos.withWatermark(ts, late).groupBy(*keys).agg(F.count("*").alias("photos"))
    return found.where("photos >= 2").select(F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), by, "photos")

"""Metrics of rasters that are in a column: all kernels in one pass over Arrow batches, or tile sums as DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import raster
from ..schemas import BLUR, EXPOSURE, SUBJECT_FOCUS, struct
from ..settings import MIN_TILE_SHARE, TILE

_TYPES = {"double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _arrow(fields: str) -> pa.StructType:
    return pa.struct([(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def raster_metrics(df: DataFrame, key: str, gray: str, width: str, height: str, bokeh: str | None = None, shake: str | None = None, boxes: str | None = None,
                   tile: int = TILE, min_share: float = MIN_TILE_SHARE) -> DataFrame:
    """Blur, exposure, subject focus and perceptual hash of 8-bit grey rasters (binary, row by row).

    One pass for all kernels. A null raster, or one whose length isn't width times height, has null metrics.
    """
    flag = lambda c: (F.coalesce(F.col(c), F.lit(False)) if c else F.lit(False))
    box = F.col(boxes) if boxes else F.lit(None).cast("array<array<double>>")
    src = df.select(F.col(key).alias("k"), F.col(gray).alias("g"), F.col(width).cast("int").alias("w"), F.col(height).cast("int").alias("h"), flag(bokeh).alias("b"), flag(shake).alias("s"), box.alias("x"))
    kind = src.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            blur, exposure, focus, hashes = [], [], [], []
            for g, w, h, b, s, x in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                if g is None or w is None or h is None or len(g) != w * h:
                    blur.append(None), exposure.append(None), focus.append(None), hashes.append(None)
                    continue
                pixels = np.frombuffer(g, np.uint8).reshape(h, w)
                blur.append(raster.compute_blur(pixels, b, s, tile, min_share))
                exposure.append(raster.compute_exposure(pixels))
                focus.append(raster.compute_subject_focus(pixels, x, "given" if x else None))
                hashes.append(raster.perceptual_hash(pixels) if g else None)
            cols = [batch.column(0), pa.array(blur, _arrow(BLUR)), pa.array(exposure, _arrow(EXPOSURE)), pa.array(focus, _arrow(SUBJECT_FOCUS)), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "blur", "exposure", "subject_focus", "phash"])

    return src.mapInArrow(run, f"`{key}` {kind}, blur {struct(BLUR)}, exposure {struct(EXPOSURE)}, subject_focus {struct(SUBJECT_FOCUS)}, phash binary")


def laplacian_pixels(df: DataFrame, key: str, pixels: str, width: int, height: int) -> DataFrame:
    """(key, x, y, lap) of interior pixels of rasters held as arrays; no join, each row on its own."""
    at = lambda i: F.get(F.col("_g"), i)
    src = df.select(key, F.transform(pixels, lambda v: v.cast("bigint")).alias("_g"))
    places = F.filter(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: (F.pmod(i, F.lit(width)) > 0) & (F.pmod(i, F.lit(width)) < width - 1) & (i >= width) & (i < width * (height - 1)))
    laps = F.transform(places, lambda i: F.struct(F.pmod(i, F.lit(width)).alias("x"), F.floor(i / width).cast("int").alias("y"),
                                                  (at(i - width) + at(i + width) + at(i - 1) + at(i + 1) - 4 * at(i)).alias("lap")))
    return src.select(key, F.inline(laps))


def tile_sums(laps: DataFrame, key: str, tile: int) -> DataFrame:
    """Count, sum and sum of squares per tile."""
    ty, tx = F.floor(F.col("y") / tile).cast("bigint").alias("ty"), F.floor(F.col("x") / tile).cast("bigint").alias("tx")
    sums = laps.groupBy(key, ty, tx).agg(F.count("*").alias("n"), F.sum("lap").alias("s"), F.sum(F.col("lap") * F.col("lap")).alias("q"))
    return sums.withColumn("variance", F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2)))


def global_variance(tiles: DataFrame, key: str) -> DataFrame:
    """Tile sums rolled up to each image's population variance."""
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    return tiles.groupBy(key).agg((q / n - F.pow(s / n, F.lit(2))).alias("laplacian_variance"))


def tile_roll_up(tiles: DataFrame, key: str, min_count: int, sharp: float = 100.0) -> DataFrame:
    """Mean, greatest, nearest-rank 95th percentile and sharp share of the variances of valid tiles."""
    valid = tiles.where(F.col("n") >= min_count)
    ranked = F.array_sort(F.collect_list("variance"))
    out = valid.groupBy(key).agg(
        F.avg("variance").alias("mean_tile_variance"), F.greatest(F.max("variance"), F.lit(0.0)).alias("max_tile_variance"), ranked.alias("_v"),
        F.count_if(F.col("variance") >= sharp).cast("bigint").alias("sharp_tiles"), F.count("*").alias("valid_tiles"),
    )
    place = F.least(F.floor(F.size("_v") * F.lit(0.95)), F.size("_v") - 1).cast("int")
    out = out.withColumn("p95_tile_variance", F.get("_v", place)).drop("_v")
    return out.withColumn("sharp_tile_fraction", F.col("sharp_tiles") / F.col("valid_tiles"))


def histogram(df: DataFrame, key: str, pixels: str) -> DataFrame:
    """(key, shade, n) of rasters held as arrays."""
    return df.select(key, F.explode(F.transform(pixels, lambda v: v.cast("bigint"))).alias("shade")).groupBy(key, "shade").agg(F.count("*").alias("n"))


def exposure_of(hist: DataFrame, key: str, verdict: Column | None = None) -> DataFrame:
    """Mean luminance and shares of dark and bright pixels, from a histogram."""
    n = F.sum("n")
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / n
    return hist.groupBy(key).agg((F.sum(F.col("shade") * F.col("n")) / n / 255).alias("mean_luminance"),
                                 share(F.col("shade") <= 24).alias("pct_underexposed"), share(F.col("shade") >= 230).alias("pct_overexposed"))

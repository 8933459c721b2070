"""Logical tables bound to columns of the test tables, which hold no photos.

These bindings test what operators do, not photo quality: an event stands for a photo, a vector for a face or for
an 8x8 raster. Expressions are SQL that Spark and DuckDB read alike, so the comparison queries can share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An image view: identity, metrics (null for one in 17), groups.
VIEW = {
    "image_id": "event_id",
    "ord": "event_id",
    "ts": "ts",
    "modified_at": "CASE WHEN k % 23 = 0 THEN NULL ELSE ts END",
    "path": "'/photos/u' || CAST(user_id AS STRING) || CASE WHEN k % 2 = 0 THEN '/IMG_' ELSE '/_dsc' END || CAST(event_id AS STRING) || CASE WHEN k % 5 = 0 THEN '.JPG' WHEN k % 5 = 1 THEN '.Cr3' WHEN k % 5 = 2 THEN '.txt' WHEN k % 5 = 3 THEN '' ELSE '.gif.png' END",
    "file_size": "CASE WHEN k < 30 THEN k * 13 WHEN k < 60 THEN k * 12345 ELSE k * 1234567 END",
    "laplacian_variance": "CASE WHEN k % 17 <> 0 THEN value END",
    "mean_tile_variance": "CASE WHEN k % 17 <> 0 THEN CASE WHEN k % 10 = 3 THEN 0e0 ELSE value * (5e-1 + k / 1e2) END END",
    "max_tile_variance": "CASE WHEN k % 17 <> 0 THEN value * (1e0 + k / 2.5e1) END",
    "sharp_tile_fraction": "CASE WHEN k % 17 <> 0 THEN k / 4e2 END",
    "largest_sharp_cluster": "CASE WHEN k % 17 <> 0 THEN k / 9e2 END",
    "bokeh_likely": "event_type = 'click'",
    "shake_risk": "event_type = 'error'",
    "focus_verdict": "CASE WHEN k % 17 = 0 THEN NULL WHEN event_type = 'view' THEN 'BackFocus' WHEN event_type = 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'AllBlurry' WHEN k % 3 = 1 THEN 'SubjectBlurry' ELSE 'SubjectSharp' END END",
    "mean_luminance": "CASE WHEN k % 17 <> 0 THEN k / 9.9e1 END",
    "pct_underexposed": "CASE WHEN k % 17 <> 0 THEN k / 1.5e2 END",
    "pct_overexposed": "CASE WHEN k % 17 <> 0 THEN (99 - k) / CASE WHEN k % 4 = 0 THEN 1.5e2 ELSE 3e2 END END",
    "has_closed_eyes": "CASE WHEN k % 17 <> 0 THEN event_type = 'signup' AND k % 2 = 0 END",
    "duplicate_group_id": "CASE WHEN k % 4 = 0 THEN 'dup-' || CAST(CAST(floor(event_id / 7e0) AS BIGINT) AS STRING) END",
    "scene_group_id": "CASE WHEN k % 3 <> 0 THEN 'scene-' || CAST(CAST(floor(event_id / 3e0) AS BIGINT) AS STRING) END",
}
#: A log of marks: several for some images, some for ids that no image has.
MARK_LOG = {
    "seq": "event_id",
    "image_id": "CASE WHEN k % 11 = 0 THEN event_id + 10000000 ELSE CAST(floor(event_id / 2e0) AS BIGINT) END",
    "mark": "CASE WHEN event_type = 'click' THEN 'delete' WHEN event_type = 'view' THEN 'unmarked' WHEN event_type = 'error' THEN 'delete' ELSE 'keep' END",
}
#: Faces: three to an image; some without a person, a thumbnail or a vector.
FACES = {
    "face_id": "vec_id",
    "image_id": "CAST(floor(vec_id / 3e0) AS BIGINT)",
    "face_index": "vec_id % 3",
    "person_id": "CASE WHEN vec_id % 5 <> 0 THEN 'person-' || CAST(label AS STRING) END",
    "face_thumbnail_path": "CASE WHEN vec_id % 7 > 2 THEN '/thumbs/' || CAST(vec_id AS STRING) || '.jpg' END",
}
E_SQL = "e AS (SELECT event_id, epoch_us(ts) // 1000000 AS ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def _columns(of: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in of.items())


VIEW_SQL = f"{E_SQL}, v AS (SELECT {_columns(VIEW)} FROM e)"
MARKS_SQL = f"{E_SQL}, l AS (SELECT {_columns(MARK_LOG)} FROM e), m AS (SELECT image_id, arg_max(mark, seq) AS mark FROM l GROUP BY image_id)"
FACES_SQL = f"f AS (SELECT {_columns(FACES)}, embedding FROM embeddings)"
RASTER_SQL = (
    "r AS (SELECT vec_id AS image_id, list_transform(embedding, lambda x: CAST(least(greatest(floor(128 + "
    "(CASE WHEN vec_id % 2 = 0 THEN 10 ELSE 400 END) * CAST(x AS DOUBLE)), 0), 255) AS BIGINT)) AS px FROM embeddings), "
    "pix AS (SELECT image_id, p % 8 AS x, p // 8 AS y, px[p + 1] AS v FROM (SELECT image_id, px, unnest(range(0, 64)) AS p FROM r)), "
    "lap AS (SELECT c.image_id, c.x, c.y, t.v + b.v + l.v + g.v - 4 * c.v AS lap FROM pix c "
    "JOIN pix t ON t.image_id = c.image_id AND t.x = c.x AND t.y = c.y - 1 JOIN pix b ON b.image_id = c.image_id AND b.x = c.x AND b.y = c.y + 1 "
    "JOIN pix l ON l.image_id = c.image_id AND l.x = c.x - 1 AND l.y = c.y JOIN pix g ON g.image_id = c.image_id AND g.x = c.x + 1 AND g.y = c.y)"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whole seconds, free of the session's zone, and the number in their properties."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    return src.select("event_id", F.timestamp_diff("SECOND", epoch, F.col("ts").cast("timestamp_ntz")).alias("ts"), "user_id", "event_type", "value",
                      F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*(f"{sql} AS {name}" for name, sql in VIEW.items()))


def mark_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*(f"{sql} AS {name}" for name, sql in MARK_LOG.items()))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(*(f"{sql} AS {name}" for name, sql in FACES.items()), "embedding")


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 rasters as arrays of shades; half of them with little contrast."""
    src = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    scale = F.when(F.col("vec_id") % 2 == 0, 10).otherwise(400)
    shade = lambda x: F.least(F.greatest(F.floor(128 + scale * x.cast("double")), F.lit(0)), F.lit(255)).cast("int")
    return src.select(F.col("vec_id").alias("image_id"), F.transform("embedding", shade).alias("px"))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, image_id, ts, phash): an event's hash is the signs of a vector, null for one in 13."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = vectors.count()
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    packed = vectors.select(F.col("vec_id").alias("_v"), F.aggregate(F.transform("embedding", bit), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)).alias("h"))
    ev = events(spark, sf_dir).select("event_id", "ts", "k")
    joined = ev.join(packed, F.pmod("event_id", F.lit(n)) == F.col("_v"), "left")
    return joined.select(F.col("event_id").alias("ord"), F.col("event_id").alias("image_id"), "ts", F.when(F.col("k") % 13 != 0, F.col("h")).alias("phash"))


HASHED_SQL = f"{E_SQL}, h AS (SELECT event_id AS ord, event_id AS image_id, ts, CASE WHEN k % 13 <> 0 THEN list_transform(embedding, lambda x: x > 0) END AS bits FROM e LEFT JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings))"

"""Queries over photos that are files: a tree made from formulas, scanned and measured, beside SQL over the same formulas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import photo
from ..operators import ingest
from ..settings import EXTENSIONS
from ..sources import fixtures
from ..sources.photos import discover
from .shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return register


def tree(spark: SparkSession) -> str:
    """A new copy of the tree in the shared folder, which has to be one that can be opened by path."""
    path = shared_dir(spark).removeprefix("file:")
    if "://" in path.removeprefix("//"):
        raise ValueError("the photo tree needs a shared folder that is mounted (file:)")
    path = "/" + path.lstrip("/")
    fixtures.write_tree(path)
    return path


def _inside(root: str):
    return F.expr("substring(path, " + str(len(root) + 2) + ")")


def _values(rows: list[tuple], columns: str) -> str:
    """Rows as SQL, each column of the type that Spark gives it."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v + "'" if isinstance(v, str) else repr(v)
    kinds = {bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE", str: "VARCHAR"}
    names = columns.split(", ")
    of = [next((kinds[type(row[k])] for row in rows if row[k] is not None), "BIGINT") for k in range(len(names))]
    cast = ", ".join(f"CAST({n} AS {kind}) AS {n}" for n, kind in zip(names, of, strict=True))
    return f"SELECT {cast} FROM (VALUES " + ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows) + f") AS t({columns})"


def _is_photo(place: str) -> bool:
    return place.rpartition(".")[2].lower() in EXTENSIONS and "." in place


_TIMES = {place: fixtures.FIRST_TIME + 60 * k for k, place in enumerate(fixtures.places())}
_PHOTOS = [p for p in fixtures.places() if _is_photo(p)]


@query(_values([(p, _TIMES[p], fixtures.OTHERS.get(p)) for p in _PHOTOS], "place, modified_at, small_size"))
def photo_scan(spark, d):
    """Photos of a tree with names that file readers hide, links, and files that are no photos."""
    root = tree(spark)
    return discover(spark, root).select(_inside(root).alias("place"), "modified_at", F.when(F.col("file_size") < 60, F.col("file_size")).alias("small_size"))


@query(_values([(p, p.rpartition(".")[2].lower() if "." in p.rpartition("/")[2] else "", _is_photo(p)) for p in fixtures.places()], "place, ext, is_photo"))
def photo_scan_all(spark, d):
    """All regular files of the tree, with the extension rule beside them."""
    root = tree(spark)
    return discover(spark, root, photos_only=False).select(_inside(root).alias("place"), photo.extension(F.col("path")).alias("ext"), photo.is_photo(F.col("path")).alias("is_photo"))


def _sizes(jvm: bool) -> list[tuple]:
    size = {fixtures.PLACES[n]: r[:2] for n, r in fixtures.RASTERS.items()} | {p: g[:2] for p, g in fixtures.GREYS.items()}
    turned = lambda p: fixtures.EXIF_OF.get(p, (1,))[0] >= 5
    return [(p, *((size[p][1], size[p][0]) if turned(p) else size[p] if p in size else (None, None)), p in size) for p in _PHOTOS]


def _size_query(jvm: bool):
    def run(spark, d):
        root = tree(spark)
        seen = ingest.analyse_photos(spark, root, jvm_decoder=jvm)
        return seen.select(_inside(root).alias("place"), F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"), F.col("blur").isNotNull().alias("decoded"))

    return run


for _jvm, _name in ((False, "photo_sizes"), (True, "photo_sizes_jvm")):
    QUERIES[_name], ORACLES[_name] = _size_query(_jvm), _values(_sizes(_jvm), "place, width, height, decoded")


def _degrees(parts, ref: str) -> float:
    value = sum(a / b / 60**k for k, (a, b) in enumerate(parts))
    return round(-value if ref in "SW" else value, 6)


@query(_values([(p, "Acme", "X1", e[0], f"1/{e[1][1]} s", round(e[2][0] / e[2][1], 6), e[3], float(e[4][0]), e[5], 1705329000, _degrees(e[6], e[7]), _degrees(e[8], e[9]), e[2][0] < 28, e[4][0] / e[1][1] > 1)
                for p, e in fixtures.EXIF_OF.items()], "place, camera_make, camera_model, orientation, shutter_speed, aperture, iso, focal, date, taken_at, lat, lng, bokeh, shake"))
def photo_exif(spark, d):
    """EXIF in both byte orders: text, numbers, rationals, date, position and what the blur rule makes of them."""
    root = tree(spark)
    seen = ingest.analyse_photos(spark, root, jvm_decoder=False).where("exif is not null")
    e = lambda name: F.col(f"exif.{name}")
    return seen.select(
        _inside(root).alias("place"), e("camera_make"), e("camera_model"), e("orientation").cast("bigint").alias("orientation"), e("shutter_speed"), F.round(e("aperture"), 6).alias("aperture"),
        e("iso").cast("bigint").alias("iso"), e("focal_length_mm").alias("focal"), e("date_time_original").alias("date"), photo.taken_at(e("date_time_original"), F.col("modified_at")).alias("taken_at"),
        F.round(e("gps_lat"), 6).alias("lat"), F.round(e("gps_lng"), 6).alias("lng"), F.col("blur.bokeh_likely").alias("bokeh"), F.col("blur.shake_risk").alias("shake"),
    )


def _pixels_sql() -> str:
    """Every pixel of the rasters, by their formulas."""
    one = "SELECT '{place}' AS place, {w} AS w, {h} AS h, p % {w} AS x, p // {w} AS y FROM (SELECT unnest(range(0, {w} * {h})) AS p)"
    parts = []
    for name, (w, h, side, low, high, (left, right, top, bottom)) in fixtures.RASTERS.items():
        inner = one.format(place=fixtures.PLACES[name], w=w, h=h)
        parts.append(f"SELECT place, w, h, x, y, CASE WHEN x >= {left} AND x < {right} AND y >= {top} AND y < {bottom} THEN CASE WHEN (x // {side} + y // {side}) % 2 = 0 THEN {low} ELSE {high} END ELSE {fixtures.BACKGROUND} END AS v FROM ({inner})")
    return " UNION ALL ".join(parts)


_LAP = (
    f"WITH RECURSIVE px AS ({_pixels_sql()}), lap AS (SELECT place, x, y, w, h, lag(v) OVER r + lead(v) OVER r + lag(v) OVER c + lead(v) OVER c - 4 * v AS lap FROM px "
    "WINDOW r AS (PARTITION BY place, y ORDER BY x), c AS (PARTITION BY place, x ORDER BY y) QUALIFY x > 0 AND x < w - 1 AND y > 0 AND y < h - 1), "
    "tile AS (SELECT place, y // 64 AS ty, x // 64 AS tx, count(*) AS n, var_pop(lap) AS variance FROM lap GROUP BY ALL), "
    "s AS (SELECT place, ty, tx, ty * 16 + tx AS c FROM tile WHERE variance >= 100), "
    "reach AS (SELECT place, c, c AS root FROM s UNION SELECT r.place, b.c, r.root FROM reach r JOIN s a ON a.place = r.place AND a.c = r.c JOIN s b ON b.place = a.place AND abs(b.ty - a.ty) + abs(b.tx - a.tx) = 1), "
    "cluster AS (SELECT place, max(n) AS n FROM (SELECT place, root, count(*) AS n FROM reach GROUP BY ALL) GROUP BY place), "
    "o AS (SELECT place, variance, row_number() OVER (PARTITION BY place ORDER BY variance) AS rn, count(*) OVER (PARTITION BY place) AS n FROM tile), "
    "u AS (SELECT place, avg(variance) AS mean_v, max(variance) AS max_v, max(CASE WHEN rn = least(n * 95 // 100, n - 1) + 1 THEN variance END) AS p95, count(*) FILTER (variance >= 100) / count(*) AS fraction, count(*) AS n FROM o GROUP BY place), "
    "g AS (SELECT place, var_pop(lap) AS lv FROM lap GROUP BY place)"
)


@query(f"""{_LAP} SELECT place, round(lv, 4) AS laplacian_variance, round(mean_v, 4) AS mean_tile_variance, round(max_v, 4) AS max_tile_variance, round(p95, 4) AS p95_tile_variance,
    round(fraction, 6) AS sharp_tile_fraction, round(coalesce(cluster.n, 0) / u.n, 6) AS largest_sharp_cluster,
    NOT (max_v >= 900 OR (fraction >= 0.12 AND coalesce(cluster.n, 0) / u.n >= 0.06)) AND lv < 100 AS is_blurry FROM u JOIN g USING (place) LEFT JOIN cluster USING (place)""")
def photo_blur(spark, d):
    """Blur metrics of PNG files through the whole pass, in tiles of 64, with every branch of the rule."""
    root = tree(spark)
    seen = ingest.analyse_photos(spark, root, jvm_decoder=False).withColumn("place", _inside(root)).where(F.col("place").isin(*fixtures.PLACES.values()))
    cols = [F.round(f"blur.{c}", 4).alias(c) for c in ("laplacian_variance", "mean_tile_variance", "max_tile_variance", "p95_tile_variance")]
    return seen.select("place", *cols, *(F.round(f"blur.{c}", 6).alias(c) for c in ("sharp_tile_fraction", "largest_sharp_cluster")), "blur.is_blurry")


_SHADES = " UNION ALL ".join(f"SELECT '{p}' AS place, {shade} AS v" for p, (_, _, shade) in fixtures.GREYS.items())


@query(f"""WITH px AS ({_pixels_sql()}), a AS (SELECT place, v FROM px UNION ALL {_SHADES}),
    e AS (SELECT place, avg(v) / 255 AS m, count(*) FILTER (v <= 24) / count(*) AS u, count(*) FILTER (v >= 230) / count(*) AS o FROM a GROUP BY place)
    SELECT place, round(m, 6) AS mean_luminance, round(u, 6) AS pct_underexposed, round(o, 6) AS pct_overexposed,
    CASE WHEN u > 0.3 AND o > 0.3 THEN 'HighContrast' WHEN u > 0.3 THEN 'Underexposed' WHEN o > 0.3 THEN 'Overexposed' ELSE 'Normal' END AS verdict FROM e""")
def photo_exposure(spark, d):
    """Exposure of PNG and JPEG files through the whole pass."""
    root = tree(spark)
    seen = ingest.analyse_photos(spark, root, jvm_decoder=False).where("exposure is not null")
    return seen.select(_inside(root).alias("place"), *(F.round(f"exposure.{c}", 6).alias(c) for c in ("mean_luminance", "pct_underexposed", "pct_overexposed")), "exposure.verdict")



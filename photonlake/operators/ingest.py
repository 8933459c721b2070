"""From files to metrics: one pass per photo, and sinks for thumbnails and deletions."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Callable
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import photo, raster
from ..schemas import BLUR, CLOSED_EYES, EXIF, EXPOSURE, SUBJECT_FOCUS, struct
from ..sources import codecs, exif
from ..sources.photos import discover

#: Longest side of what is analysed, of a thumbnail and of a face thumbnail.
WORK_SIZE, THUMB_SIZE, FACE_SIZE = 1024, 300, 120
#: JPEG quality of a thumbnail and of a face thumbnail.
THUMB_QUALITY, FACE_QUALITY = 80, 75
#: What a detector says of an image: faces (box, openness of either eye, embedding) and salient boxes.
Detector = Callable[[np.ndarray], dict]


class LazyDetector:
    """A detector that each Python worker builds once, at its first image, and keeps: models load off the critical path."""

    _built: dict[str, Detector] = {}

    def __init__(self, factory: Callable[[], Detector]):
        self.factory, self.key = factory, uuid.uuid4().hex

    def __call__(self, pixels: np.ndarray) -> dict:
        if self.key not in self._built:
            self._built[self.key] = self.factory()
        return self._built[self.key](pixels)


def no_detector(pixels: np.ndarray) -> dict:
    """No vision backend: nothing is known of faces or saliency."""
    return {"faces": None, "salient": None}


def analyse_pixels(pixels: np.ndarray, meta: dict | None, detector: Detector = no_detector) -> dict:
    """Metrics of a decoded photo, in the order: blur, exposure, hash, eyes, focus, override, faces."""
    gray = raster.luma(pixels)
    meta = meta or {}
    aperture, focal = meta.get("aperture"), meta.get("focal_length_mm")
    bokeh = aperture is not None and (aperture < 2.8 or (aperture < 4.0 and focal is not None and focal >= 70))
    secs = shutter_seconds(meta.get("shutter_speed"))
    shake = secs is not None and focal is not None and focal > 0 and secs * focal > 1.0
    blur = raster.compute_blur(gray, bokeh, shake)
    seen = detector(pixels)
    faces, salient = seen.get("faces"), seen.get("salient")
    boxes, source = ([f["bounding_box"] for f in faces], "face") if faces else (salient, "saliency") if salient else (None, None)
    focus = raster.compute_subject_focus(gray, boxes, source)
    if focus and focus["verdict"] in ("AllBlurry", "SubjectBlurry"):
        blur["is_blurry"] = True
    elif focus and focus["verdict"] == "SubjectSharp":
        blur["is_blurry"] = False
    eyes = None
    if faces is not None:
        rows = [{"left_eye_openness": f["left"], "right_eye_openness": f["right"], "eyes_closed": f["left"] < 0.3 or f["right"] < 0.3, "bounding_box": list(f["bounding_box"])} for f in faces]
        eyes = {"face_count": len(rows), "faces": rows, "has_closed_eyes": any(r["eyes_closed"] for r in rows)}
    return {"blur": blur, "exposure": raster.compute_exposure(gray), "closed_eyes": eyes, "subject_focus": focus, "phash": raster.perceptual_hash(gray), "embeddings": [list(map(float, f.get("embedding") or [])) for f in faces or []]}


def shutter_seconds(text: str | None) -> float | None:
    bare = (text or "").strip().replace('"', "").rstrip("s \t")
    try:
        if "/" in bare:
            a, b = bare.split("/")
            return float(a) / float(b) if float(b) > 0 else None
        return float(bare)
    except ValueError:
        return None




_METRICS = {"exif": EXIF, "blur": BLUR, "exposure": EXPOSURE, "closed_eyes": CLOSED_EYES, "subject_focus": SUBJECT_FOCUS}
SCHEMA = ("id string, path string, file_name string, file_size bigint, modified_at bigint, width int, height int, thumbnail_path string, "
          + ", ".join(f"{n} {struct(f)}" for n, f in _METRICS.items()) + ", phash binary, embeddings array<array<float>>")
#: Formats that the JVM's image reader decodes, as a glob that looks at no case.
JVM_GLOB = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[tT][iI][fF],[tT][iI][fF][fF]}"
JVM_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff")


def _arrow_schema():
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(SCHEMA))


def _measured(out: dict, pixels: np.ndarray, meta: dict | None, detector: Detector, thumb_dir: str | None) -> None:
    """Fill a row from upright pixels of any size."""
    out["height"], out["width"] = pixels.shape[:2]
    if out["path"].lower().endswith((".jpg", ".jpeg")):
        pixels = raster.halved(pixels, WORK_SIZE)
    small = raster.shrink(pixels, WORK_SIZE)
    out |= analyse_pixels(small, meta, detector)
    if thumb_dir:
        out["thumbnail_path"] = write_thumbnail(small, thumb_dir, out["id"])


def _analyse_files(files: DataFrame, detector: Detector, thumb_dir: str | None) -> DataFrame:
    """Open, decode and measure files one at a time in Python."""
    arrow = _arrow_schema()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = dict.fromkeys(arrow.names) | row
                try:
                    with open(row["path"], "rb") as f:
                        data = f.read()
                except OSError:
                    data = b""
                out["exif"] = exif.read_exif(data)
                pixels = codecs.decode(data)
                if pixels is not None:
                    _measured(out, raster.orient(pixels, (out["exif"] or {}).get("orientation")), out["exif"], detector, thumb_dir)
                yield pa.RecordBatch.from_pylist([out], schema=arrow)

    return files.mapInArrow(run, SCHEMA)


def _analyse_decoded(spark: SparkSession, root: str, detector: Detector, thumb_dir: str | None) -> DataFrame:
    """Measure what Spark's image reader decodes below ``root``; pixels go from the JVM to the kernels and no further."""
    arrow, top = _arrow_schema(), os.path.realpath(root)
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", JVM_GLOB).option("dropInvalid", "false").load(root)

    def run(batches):
        for batch in batches:
            for origin, h, w, n, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                real = unquote(origin.as_py()).removeprefix("file:")
                real = "/" + real.lstrip("/")
                inside = os.path.relpath(real, root)
                if os.path.realpath(real) != os.path.join(top, inside):
                    continue  # reached through a link
                out = dict.fromkeys(arrow.names)
                stat = os.stat(real)
                out |= {"path": os.path.join(root, inside), "file_name": os.path.basename(real), "file_size": stat.st_size, "modified_at": max(0, int(stat.st_mtime))}
                out["id"] = hashlib.sha256(out["path"].encode() + out["modified_at"].to_bytes(8, "little")).hexdigest()
                with open(real, "rb") as f:
                    out["exif"] = exif.read_exif(exif.Seeked(f))
                h, w, n = h.as_py(), w.as_py(), n.as_py()
                if h > 0 and w > 0:
                    pixels = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, n)
                    pixels = pixels[..., 0] if n == 1 else pixels[..., 2::-1]  # blue comes first
                    _measured(out, raster.orient(pixels, (out["exif"] or {}).get("orientation")), out["exif"], detector, thumb_dir)
                yield pa.RecordBatch.from_pylist([out], schema=arrow)

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, SCHEMA)


def analyse_photos(spark: SparkSession, root: str, detector: Detector = no_detector, thumb_dir: str | None = None, tasks: int | None = None, jvm_decoder: bool = True) -> DataFrame:
    """A row per photo below ``root``: identity, EXIF and metrics. What can't be decoded keeps its row, with null metrics.

    Files are listed by the data source, dealt out evenly, and opened, decoded and measured one at a time in one pass,
    so a task holds one photo. Results are narrow: no pixels leave the pass. With ``jvm_decoder`` the JVM decodes
    the formats it reads (JPEG of any kind, PNG, TIFF), which is far faster for JPEG files; Python keeps those whose
    names Spark hides, empty files, and other formats. With ``thumb_dir``, thumbnails are written on the way, unless they are there.
    """
    found = discover(spark, root)
    files = found.select(photo.image_id(F.col("path"), F.col("modified_at")).alias("id"), "path", photo.file_name(F.col("path")).alias("file_name"), "file_size", "modified_at")
    if jvm_decoder:
        hidden = F.substring("path", len(root.rstrip("/")) + 1, 1 << 20).rlike(r"/[_.]")
        # Spark's reader leaves out empty files as well.
        files = files.where(hidden | (F.col("file_size") == 0) | ~photo.extension(F.col("path")).isin(*JVM_EXTENSIONS))
    if tasks:
        files = files.repartition(tasks)
    out = _analyse_files(files, detector, thumb_dir)
    return out.unionByName(_analyse_decoded(spark, root, detector, thumb_dir)) if jvm_decoder else out


def write_thumbnail(pixels: np.ndarray, directory: str, image_id: str) -> str:
    """A JPEG with its longest side at 300 or less, named by the id; one that is there is left."""
    path = os.path.join(directory, f"{image_id}_v2.jpg")
    if not os.path.exists(path):
        os.makedirs(directory, exist_ok=True)
        _write_whole(path, codecs.encode_jpeg(raster.shrink(pixels, THUMB_SIZE), THUMB_QUALITY))
    return path


def write_face_thumbnail(pixels: np.ndarray, box: list[float], directory: str, image_id: str, index: int) -> str:
    """A wide crop of a face at 120 pixels; one that is there is left."""
    path = os.path.join(directory, f"{image_id[:16]}_face_{index}.jpg")
    if not os.path.exists(path):
        os.makedirs(directory, exist_ok=True)
        h, w = pixels.shape[:2]
        x, y, bw, bh = box
        left, top = int(max(0.0, x - bw * 0.2) * w), int(max(0.0, 1 - y - bh - bh * 0.2) * h)
        right, low = int(min(1.0, x + bw * 1.2) * w), int(min(1.0, 1 - y + bh * 0.2) * h)
        crop = pixels[top : max(top + 1, low), left : max(left + 1, right)]
        _write_whole(path, codecs.encode_jpeg(raster.resize(crop, *raster.fit_within(crop.shape[1], crop.shape[0], FACE_SIZE)), FACE_QUALITY))
    return path


def _write_whole(path: str, data: bytes) -> None:
    """All or nothing, so a lost task leaves no half of a file."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def face_rows(photos: DataFrame) -> DataFrame:
    """(image_id, face_index, bounding_box, embedding), a row per face."""
    one = F.posexplode(F.arrays_zip(F.col("closed_eyes.faces").alias("f"), F.col("embeddings").alias("e"))).alias("face_index", "x")
    return photos.where(F.size("closed_eyes.faces") > 0).select(F.col("id").alias("image_id"), one).select("image_id", "face_index", F.col("x.f.bounding_box").alias("bounding_box"), F.col("x.e").alias("embedding"))


def delete_files(plan: DataFrame, trash: str, confirm: bool = False) -> list[dict]:
    """Move the files of a deletion plan (image_id, path) to a trash folder; without ``confirm`` only say what would go.

    A reviewer's own marks: the plan is read in pieces on the driver, whose disk holds the files. Returns image_id,
    path and error (null where it went well) of each.
    """
    out = []
    for row in plan.select("image_id", "path").toLocalIterator():
        error = None
        if confirm:
            try:
                os.makedirs(trash, exist_ok=True)
                shutil.move(row.path, os.path.join(trash, f"{row.image_id}-{os.path.basename(row.path)}"))
            except OSError as e:
                error = str(e)
        out.append({"image_id": row.image_id, "path": row.path, "error": error})
    return out

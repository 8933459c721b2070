"""A scanned folder's results, written down and read back: analysis, and duplicate, scene and person groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import photo
from ..settings import Settings
from .grouping import members, regroup_images, regroup_persons, with_position
from .ingest import Detector, analyse_photos, face_rows, no_detector


class NoResults(RuntimeError):
    """There is nothing to read: no scan has ended."""


class Library:
    """Tables ``analysis``, ``images`` and ``faces`` below a folder of any file system that Spark writes to.

    Every getter reads what the last scan, and regrouping since, have written, and raises :class:`NoResults` before.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raise NoResults("No analysis results yet")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def scan(self, root: str, detector: Detector = no_detector, thumb_dir: str | None = None, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
        """Analyse the photos below a directory, group them, and return the analysis."""
        self._write(analyse_photos(self.spark, root, detector, thumb_dir), "analysis")
        self.regroup(settings)
        return self.analysis()

    def regroup(self, settings: Settings) -> None:
        """Group anew at other thresholds, without decoding anything."""
        found = self._read("analysis")
        shot = photo.taken_at(F.col("exif.date_time_original"), F.col("modified_at"))
        inputs = with_position(found.select(F.col("id").alias("image_id"), "path", shot.alias("ts"), "phash"), F.col("path"), name="ord")
        self._write(regroup_images(inputs, settings), "images")
        self._write(regroup_persons(inputs, settings, face_rows(found)), "faces")

    def analysis(self) -> DataFrame:
        """A row per photo, with all metrics and its group ids."""
        groups = self._read("images").select(F.col("image_id").alias("_id"), "ord", "duplicate_group_id", "scene_group_id")
        return self._read("analysis").join(groups, F.col("id") == F.col("_id")).drop("_id")

    def duplicate_groups(self) -> DataFrame:
        """(duplicate_group_id, members): image ids in order of their paths."""
        return members(self._read("images"), "duplicate_group_id", "ord", "image_id")

    def scene_groups(self) -> DataFrame:
        """(scene_group_id, members): image ids in order of time."""
        return members(self._read("images").withColumn("at", F.struct("ts", "ord")), "scene_group_id", "at", "image_id")

    def person_groups(self) -> DataFrame:
        """(person_id, members): (image_id, face_index) of a person's faces, in order."""
        faces = self._read("faces").withColumn("face", F.struct("image_id", "face_index"))
        return members(faces.withColumn("at", F.col("face")), "person_id", "at", "face")

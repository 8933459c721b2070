"""Review: filters, orders, selections, marks, best of group, counters and the plan of deletions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..settings import Settings
from .grouping import group_adjacent, with_position

DEFAULTS = Settings()


def image_view(images: DataFrame, analysis: DataFrame, key: str = "image_id") -> DataFrame:
    """Images with their metrics; null where they have none."""
    return images.join(analysis, key, "left")


def by_person(images: DataFrame, faces: DataFrame, person: str, key: str = "image_id") -> DataFrame:
    """Images on which a person has a face."""
    return images.join(faces.where(F.col("person_id") == person).select(key), key, "left_semi")


#: Orders by name, for columns of an image view. Ties are broken by the input position.
ORDERS = {
    "date": lambda: [F.coalesce("modified_at", F.lit(0)).desc()],
    "name": lambda: [F.collate("file_name", "UNICODE").asc()],
    "blur": lambda: [F.col("laplacian_variance").asc_nulls_last()],
    "exposure": lambda: [F.abs(F.coalesce("mean_luminance", F.lit(0.5)) - 0.5).asc()],
}


def filtered_images(view: DataFrame, filters: Iterable[str] = (), sort_by: str | None = None, settings: Settings = DEFAULTS, position: str = "ord") -> DataFrame:
    """Rows that pass all filters, with ``pos``: their place after sorting, duplicates next to one another.

    Filters go first and reach the scan where they can. Two distributed sorts number the rows: one for the order,
    one that moves each duplicate group to its first member's place.
    """
    for name in filters:
        view = view.where(P.FILTERS[name](settings))
    order = ORDERS[sort_by]() if sort_by else []
    placed = with_position(view, *order, F.col(position).asc(), name="_pos")
    anchored = group_adjacent(placed, "_pos", "duplicate_group_id")
    return with_position(anchored, F.col("anchor").asc(), F.col("_pos").asc(), name="pos").drop("_pos", "anchor")


def grid_rows(df: DataFrame, pos: str = "pos", columns: int = 6) -> DataFrame:
    """``df`` with the row and column of each place in a grid, both from 0."""
    at = F.col(pos) - 1
    return df.withColumn("grid_row", F.floor(at / columns).cast("bigint")).withColumn("grid_col", F.pmod(at, F.lit(columns)).cast("bigint"))


def page(df: DataFrame, pos: str, first: int, count: int) -> DataFrame:
    """Rows at places first .. first + count - 1."""
    return df.where(F.col(pos).between(first, first + count - 1))


def select_range(df: DataFrame, pos: str, key: str, one: object, other: object) -> DataFrame:
    """Ids at the places between two ids, both included, whichever comes first. Nothing if either isn't there."""
    ends = df.where(F.col(key).isin(one, other)).agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.count_distinct(key).alias("n"))
    want = 1 if one == other else 2
    return df.join(F.broadcast(ends), F.col(pos).between(F.col("lo"), F.col("hi")) & (F.col("n") == want)).select(key)  # one row


def select_all(view: DataFrame, key: str = "image_id") -> DataFrame:
    return view.select(key).distinct()


def invert(view: DataFrame, selected: DataFrame, key: str = "image_id") -> DataFrame:
    """Ids in the view that aren't selected; selected ids outside of it are dropped."""
    return view.select(key).distinct().join(selected, key, "left_anti")


def toggle(selected: DataFrame, ids: DataFrame, key: str = "image_id") -> DataFrame:
    """Symmetric difference."""
    a, b = selected.select(key).distinct(), ids.select(key).distinct()
    return a.join(b, key, "left_anti").union(b.join(a, key, "left_anti"))


def union_ids(a: DataFrame, b: DataFrame, key: str = "image_id") -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def merge_last_wins(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Both tables' keys; where both have one, the new value, even a null one."""
    n = new.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    joined = old.select(key, value).join(n, F.col(key) == F.col("_k"), "full")
    return joined.select(F.coalesce(key, "_k").alias(key), F.when(F.col("_k").isNotNull(), F.col("_v")).otherwise(F.col(value)).alias(value))


def apply_marks(log: DataFrame, key: str = "image_id", mark: str = "mark", order: str = "seq") -> DataFrame:
    """The last mark of each id in a log of marks; ``unmarked`` is a mark like others."""
    last = log.groupBy(key).agg(F.max(F.struct(order, mark)).alias("_x"))
    return last.select(key, F.col(f"_x.{mark}").alias(mark))


def set_marks(marks: DataFrame, ids: DataFrame, mark: str, key: str = "image_id") -> DataFrame:
    """Marks with one mark set on all of ``ids``, known to the index or not."""
    return merge_last_wins(marks, ids.select(key).distinct().withColumn("mark", F.lit(mark)), key, "mark")


def suggest_deletes(view: DataFrame, settings: Settings = DEFAULTS, key: str = "image_id") -> DataFrame:
    """Ids of all blurry images, whatever filter is on."""
    return view.where(P.is_blurry(threshold=settings.blur_threshold)).select(key)


def best_of_group(view: DataFrame, group: str = "duplicate_group_id", position: str = "ord") -> DataFrame:
    """Group members with ``is_best``: the sharpest (no metrics count as 0), of equal ones the first.

    The best is an aggregate, so a large group isn't sorted in one task.
    """
    rows = view.where(F.col(group).isNotNull())
    sharp = F.coalesce("laplacian_variance", F.lit(0.0))
    best = rows.groupBy(F.col(group).alias("_g")).agg(F.min(F.struct((-sharp).alias("s"), F.col(position).alias("p"))).alias("_b"))
    return rows.join(best, F.col(group) == F.col("_g")).withColumn("is_best", F.col(position) == F.col("_b.p")).drop("_g", "_b")


def pick_best(view: DataFrame, group: str = "duplicate_group_id", position: str = "ord", key: str = "image_id") -> DataFrame:
    """Marks of group members: the best is kept, the others go."""
    return best_of_group(view, group, position).select(key, F.when(F.col("is_best"), "keep").otherwise("delete").alias("mark"))


def deletion_plan(marks: DataFrame, index: DataFrame, key: str = "image_id") -> DataFrame:
    """Images of the index that are marked for deletion; unknown ids are left out."""
    return index.join(marks.where("mark = 'delete'").select(key), key, "left_semi")


def after_deletes(marks: DataFrame, failed: DataFrame, key: str = "image_id") -> DataFrame:
    """Marks that stay after deletion: all but the delete marks of ids that didn't fail, known or not."""
    gone = marks.where("mark = 'delete'").select(key).join(failed, key, "left_anti")
    return marks.join(gone, key, "left_anti")


def without_deleted(images: DataFrame, deleted: DataFrame, key: str = "image_id") -> DataFrame:
    return images.join(deleted, key, "left_anti")


def issue_counters(view: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row of counts over all images that have metrics."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("bigint")
    rows = view.where(P.has_blur())
    return rows.agg(
        n(P.is_blurry(threshold=settings.blur_threshold)).alias("blurry"), n(P.exposure_issue(threshold=settings.exposure_threshold)).alias("exposure"),
        n(F.col("duplicate_group_id").isNotNull()).alias("duplicates"), n(P.closed_eyes()).alias("closed_eyes"), n(P.back_focus()).alias("back_focus"),
    )


def mark_counters(marks: DataFrame) -> DataFrame:
    return marks.agg(F.count_if(F.col("mark") == "keep").cast("bigint").alias("keep"), F.count_if(F.col("mark") == "delete").cast("bigint").alias("delete"))


def persons_by_images(faces: DataFrame, position: str) -> DataFrame:
    """(person_id, images, rank): persons by number of images, most first, then by first face."""
    found = faces.where(F.col("person_id").isNotNull()).groupBy("person_id").agg(F.count_distinct("image_id").alias("images"), F.min(position).alias("_first"))
    return with_position(found, F.col("images").desc(), F.col("_first").asc(), name="rank").drop("_first")


def person_cover(faces: DataFrame, position: str) -> DataFrame:
    """The first face of each person that has a thumbnail."""
    shown = faces.where(F.col("person_id").isNotNull() & F.col("face_thumbnail_path").isNotNull())
    first = shown.groupBy("person_id").agg(F.min(F.struct(position, "face_thumbnail_path")).alias("_f"))
    return first.select("person_id", F.col("_f.face_thumbnail_path").alias("face_thumbnail_path"))


def slowest(df: DataFrame, ms: str, tie: str, n: int = 10, fastest: bool = False) -> DataFrame:
    """The n slowest rows (or fastest): a top-k report."""
    return df.orderBy(F.col(ms).asc() if fastest else F.col(ms).desc(), F.col(tie).asc()).limit(n)


def time_histogram(df: DataFrame, ms: str, width: float = 100.0, buckets: int = 10) -> DataFrame:
    """Rows per bucket of ``width``; the last one is open."""
    at = F.least(F.floor(F.col(ms) / width), F.lit(buckets - 1)).cast("bigint")
    return df.groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))


def median_of(df: DataFrame, value: str, by: Column) -> DataFrame:
    """The element in the middle of each group's sorted values."""
    lists = df.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("_v"))
    return lists.withColumn("median", F.get("_v", F.floor(F.size("_v") / 2).cast("int"))).drop("_v")


def ranked_in_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint"))

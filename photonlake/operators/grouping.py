"""Time sessions, near-duplicate groups, scenes, block order and breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.photo import hamming, hamming_binary
from ..functions.raster import HASH_BITS
from ..plans.shared import carried, materialise
from ..settings import Settings
from .hashes import bands, linked_hashes
from .persons import cluster_faces

#: Seconds in a bucket of time, and input positions in one: what a window task sorts.
TIME_BUCKET = 86_400
ORDER_BUCKET = 1_000_000


def sessions(df: DataFrame, ts: str, gap: int, bucket: int = TIME_BUCKET) -> DataFrame:
    """``df`` with ``session_start``: the time of the first row of its session.

    A session ends where the next row comes more than ``gap`` seconds later (a gap of exactly ``gap`` goes on).
    Windows run inside buckets of time; what goes on from one bucket to the next passes through a table of one row
    a bucket. Rows with a null time have a null session.
    """
    return sessions_of(df, ts, {"session_start": gap}, bucket)


def sessions_of(df: DataFrame, ts: str, gaps: dict[str, int], bucket: int = TIME_BUCKET) -> DataFrame:
    """``df`` with a column of session starts, as in :func:`sessions`, for each named gap, in one pass."""
    inside = Window.partitionBy("_bucket").orderBy(ts)
    cut = df.withColumn("_bucket", F.floor(F.col(ts) / bucket)).withColumn("_prev", F.lag(ts).over(inside))
    edges = df.where(F.col(ts).isNotNull()).groupBy(F.floor(F.col(ts) / bucket).alias("_b")).agg(F.max(ts).alias("_max"))
    by_bucket = Window.orderBy("_b")
    edges = edges.select("_b", F.lag("_max").over(by_bucket).alias("_before"))
    cut = cut.join(edges, F.col("_bucket") == F.col("_b"), "left")
    prev = F.coalesce("_prev", "_before")
    starts, lasts, carries = ([f"_{k}{i}" for i in range(len(gaps))] for k in ("start", "last", "carry"))
    cut = cut.withColumns({s: F.when(prev.isNull() | (F.col(ts) - prev > gap), F.col(ts)) for s, gap in zip(starts, gaps.values(), strict=True)})
    last = cut.groupBy(F.col("_bucket").alias("_c")).agg(*(F.max(s).alias(x) for s, x in zip(starts, lasts, strict=True)))
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.where("_c is not null").select("_c", *(F.last(x, ignorenulls=True).over(before).alias(y) for x, y in zip(lasts, carries, strict=True)))
    cut = cut.join(carry, F.col("_bucket") == F.col("_c"), "left")
    own = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = {name: F.when(F.col(ts).isNotNull(), F.coalesce(F.last(s, ignorenulls=True).over(own), y)) for name, s, y in zip(gaps, starts, carries, strict=True)}
    return cut.withColumns(found).drop("_bucket", "_prev", "_b", "_before", "_c", *starts, *carries)


def numbered(keys: DataFrame, key: str, prefix: str, width: int) -> DataFrame:
    """Distinct keys with ``label``: the prefix and the key's number from 1 in order."""
    ranked = carried(keys.select(key).distinct(), F.col(key), width, F.lit(1), "_n")
    return ranked.select(key, F.concat(F.lit(prefix), F.col("_n").cast("string")).alias("label"))


def find_scene_groups(df: DataFrame, id_col: str, ts: str, window_secs: int = Settings.scene_window_secs) -> DataFrame:
    """(id, scene_group_id): sessions of at least two photos, numbered in order of time; single photos have none."""
    found = sessions(df.select(id_col, ts), ts, window_secs)
    sizes = found.groupBy(F.col("session_start").alias("s")).count().where("count >= 2").select("s")
    labels = numbered(sizes, "s", "scene-", TIME_BUCKET)
    return found.join(labels, F.col("session_start") == F.col("s")).select(id_col, F.col("label").alias("scene_group_id"))


def similar_pairs(df: DataFrame, group: str, order: str, hash_col: str, threshold: int, bits: int | None = None) -> DataFrame:
    """(a, b): positions of rows of a group whose hashes differ in at most ``threshold`` bits, a before b.

    Hashes are packed in 64-bit integers, or binary of any length; ``bits`` is their usual length. Where it has eight
    bits or more for each of ``threshold + 1`` bands, rows meet by an equal band, since two such hashes agree on one at
    least; else all rows of a group meet, as binary hashes of another length always do (they are compared as far as
    the shorter goes). Null hashes make no pair.
    """
    binary = df.schema[hash_col].dataType.typeName() == "binary"
    bits = bits or (HASH_BITS if binary else 64)
    distance = hamming_binary if binary else hamming
    rows = df.where(F.col(hash_col).isNotNull()).select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(hash_col).alias("h"))
    width = bits // (threshold + 1)
    keys = ["g"]
    every = rows
    if width >= 8:
        if binary:
            rows = rows.where(F.octet_length("h") * 8 == bits)
        rows = rows.select("g", "o", "h", F.posexplode(bands(F.col("h"), binary, width, threshold + 1)).alias("band", "part"))
        keys = ["g", "band", "part"]
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    near = (F.col("a.o") < F.col("b.o")) & (distance(F.col("a.h"), F.col("b.h")) <= threshold)
    for c in same:
        near = c & near
    pairs = a.join(b, near).select(F.col("a.o").alias("a"), F.col("b.o").alias("b"))
    if binary and width >= 8:
        odd, b = every.where(F.octet_length("h") * 8 != bits).alias("a"), every.alias("b")
        near = (F.col("a.g") == F.col("b.g")) & (F.col("a.o") != F.col("b.o")) & (distance(F.col("a.h"), F.col("b.h")) <= threshold)
        pairs = pairs.union(odd.join(b, near).select(F.least("a.o", "b.o").alias("a"), F.greatest("a.o", "b.o").alias("b")))
    return pairs.distinct() if width >= 8 else pairs


def duplicate_links(df: DataFrame, order: str, ts: str, hash_col: str, window_secs: int = Settings.duplicate_window_secs, threshold: int = Settings.duplicate_threshold) -> DataFrame:
    """(order, class_id, links): for each photo the first of those that similar photos of its session lead to, and how many it links with."""
    found = materialise(sessions(materialise(df.select(order, ts, hash_col)), ts, window_secs))
    return linked_hashes(found, "session_start", order, hash_col, threshold).select(order, "class_id", "links")


def find_duplicate_groups(df: DataFrame, order: str, ts: str, hash_col: str, window_secs: int = Settings.duplicate_window_secs, threshold: int = Settings.duplicate_threshold) -> DataFrame:
    """(order, duplicate_group_id): components of similar photos within a session, numbered by first input position.

    Photos without a hash bridge gaps in time but link with nothing.
    """
    nodes = materialise(duplicate_links(df, order, ts, hash_col, window_secs, threshold).where("links > 0"))
    labels = numbered(nodes.select(F.col("class_id").alias("k")), "k", "dup-", ORDER_BUCKET)
    return nodes.join(labels, F.col("class_id") == F.col("k")).select(order, F.col("label").alias("duplicate_group_id"))


def regroup(inputs: DataFrame, settings: Settings, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and faces with their ids at new thresholds; ids that no longer hold are null.

    Of inputs (ord, image_id, ts, phash), each with duplicate and scene ids; of faces (image_id, face_index,
    embedding) of these images (image_id, face_index, person_id), persons numbered by image and face in order.
    """
    return regroup_images(inputs, settings), regroup_persons(inputs, settings, faces)


def regroup_images(inputs: DataFrame, settings: Settings) -> DataFrame:
    """Inputs (ord, image_id, ts, phash) with duplicate and scene ids; null where there is none.

    Groups are those of :func:`find_duplicate_groups` and :func:`find_scene_groups`. Both kinds of sessions come from
    one pass over inputs that are written once, and rows carry them along, so no result is joined back by id.
    """
    gaps = {"_shots": settings.duplicate_window_secs, "_scene": settings.scene_window_secs}
    rows = materialise(inputs.select(F.struct(*(F.col(f"`{c}`") for c in inputs.columns)).alias("_row"), "ord", "ts", "phash"))
    found = materialise(sessions_of(rows, "ts", gaps))
    linked = materialise(linked_hashes(found, "_shots", "ord", "phash", settings.duplicate_threshold))
    linked = linked.select("_row", "_scene", F.when(F.col("links") > 0, F.col("class_id")).alias("_class"))
    duplicates = numbered(linked.where("_class is not null").select(F.col("_class").alias("_dup")), "_dup", "dup-", ORDER_BUCKET)
    sizes = linked.where("_scene is not null").groupBy(F.col("_scene").alias("_shot_at")).count().where("count >= 2")
    scenes = numbered(sizes, "_shot_at", "scene-", TIME_BUCKET)
    out = linked.join(duplicates.withColumnRenamed("label", "duplicate_group_id"), F.col("_class") == F.col("_dup"), "left")
    out = out.join(scenes.withColumnRenamed("label", "scene_group_id"), F.col("_scene") == F.col("_shot_at"), "left")
    return out.select("_row.*", "duplicate_group_id", "scene_group_id")


def regroup_persons(inputs: DataFrame, settings: Settings, faces: DataFrame) -> DataFrame:
    """(image_id, face_index, person_id) of the faces of these images; null where a face has no person."""
    known = faces.select("image_id", "face_index", "embedding").join(inputs.select("image_id", "ord"), "image_id")
    placed = with_position(materialise(known), F.col("ord"), F.col("face_index"), name="_face")
    found = cluster_faces(placed, "_face", "embedding", settings.person_similarity)
    return placed.select("image_id", "face_index", "_face").join(found, "_face", "left").select("image_id", "face_index", "person_id")


def members(df: DataFrame, group: str, order: str, member: str) -> DataFrame:
    """A group's members in order, as an array; rows without a group are left out."""
    lists = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, member))).alias("_m"))
    return lists.select(group, F.transform("_m", lambda x: x[member]).alias("members"))


def with_position(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """``df`` with the place of each row in an order, from 1. The last key must break all ties.

    A distributed sort: rows are dealt out by range and sorted there, and a table of one row a partition says how
    many come before. The sorted rows are written to the shared folder first, so a retried task can't renumber them.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place_id", F.monotonically_increasing_id())
    laid = materialise(laid)
    part = F.shiftright("_place_id", 33)
    counts = laid.groupBy(part.alias("_place_part")).agg(F.count("*").alias("_place_n"))
    before = counts.select("_place_part", F.coalesce(F.sum("_place_n").over(Window.orderBy("_place_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_place_before"))
    out = laid.join(F.broadcast(before), part == F.col("_place_part"))  # a row a partition
    return out.withColumn(name, (F.col("_place_before") + F.col("_place_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("bigint")).drop("_place_id", "_place_part", "_place_before")


def group_adjacent(df: DataFrame, pos: str, group: str) -> DataFrame:
    """``df`` with ``anchor``: the place of the first member of its group, or its own. Ordering by anchor and place puts groups together.

    First places are an aggregate that is joined back, so a large group isn't gathered in one task.
    """
    first = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_group")).agg(F.min(pos).alias("_first"))
    joined = df.join(first, F.col(group) == F.col("_group"), "left")
    return joined.withColumn("anchor", F.coalesce("_first", pos)).drop("_group", "_first")


def scene_breaks(df: DataFrame, pos: str, scene: str) -> DataFrame:
    """Places (from 1) of rows whose scene differs from that of the row before; the first row is none. Null equals null."""
    earlier = df.select((F.col(pos) + 1).alias("_at"), F.col(scene).alias("_scene"))
    return df.join(earlier, F.col(pos) == F.col("_at")).where(~F.col(scene).eqNullSafe(F.col("_scene"))).select(pos)

"""Columns of one photo: ids, EXIF text, intent, eyes, boxes, exposure and focus verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import EXTENSIONS, FOCUS_FLOOR, FOCUS_RATIO


def extension(path: Column) -> Column:
    """The lower-cased extension; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_photo(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def image_id(path: Column, modified_at: Column) -> Column:
    """SHA-256 of the path and the modification time as eight little-endian bytes, so an edited file has a new id."""
    pairs = F.regexp_extract_all(F.lpad(F.hex(modified_at.cast("bigint")), 16, "0"), F.lit("(..)"), F.lit(1))
    return F.sha2(F.concat(F.encode(path, "UTF-8"), F.unhex(F.array_join(F.reverse(pairs), ""))), 256)


def exif_seconds(text: Column) -> Column:
    """Epoch seconds of an EXIF date, read without a zone; null where it is none."""
    bare = F.trim(F.regexp_replace(text, '"', ""))
    hit = F.regexp_extract(bare, r"^(\d{4})([-:])(\d{2})\2(\d{2}) (\d{2}:\d{2}:\d{2})$", 0)
    iso = F.concat(F.substring(hit, 1, 4), F.lit("-"), F.substring(hit, 6, 2), F.lit("-"), F.substring(hit, 9, 11))
    stamp = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ss"))
    # The difference of two wall-clock times is free of the session's zone.
    return F.when(hit != "", F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), stamp.cast("timestamp_ntz")))


def taken_at(date_time_original: Column, modified_at: Column) -> Column:
    return F.coalesce(exif_seconds(date_time_original), modified_at)


def shutter_seconds(text: Column) -> Column:
    """Seconds of ``1/250``, ``0.5`` or ``1/250 s``; null where it is neither."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.trim(text), '"', "")), r"[s\s]+$", "")
    parts = F.split(bare, "/")
    num, den = F.trim(F.get(parts, F.lit(0))).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double")
    return F.when(F.size(parts) == 1, num).when((F.size(parts) == 2) & (den > 0), num / den)


def bokeh_likely(aperture: Column, focal: Column) -> Column:
    return F.coalesce((aperture < 2.8) | ((aperture < 4.0) & (focal >= 70.0)), F.lit(False))


def shake_risk(shutter: Column, focal: Column) -> Column:
    return F.coalesce((focal > 0) & (shutter_seconds(shutter) * focal > 1.0), F.lit(False))


def gps_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees; negative to the south and west; null where a part is missing."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.coalesce(ref.contains("S") | ref.contains("W"), F.lit(False)), -value).otherwise(value)


def eye_openness(points: Column) -> Column:
    """From landmark points (x, y): height over width of their box, on a scale from closed (0) to open (1)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    wide, tall = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    share = F.least(F.greatest((tall / wide - 0.05) / 0.30, F.lit(0.0)), F.lit(1.0))
    return F.when((F.coalesce(F.size(points), F.lit(0)) < 4) | (wide < 0.001), 1.0).otherwise(share)


def face_closed(left: Column, right: Column, limit: float = 0.3) -> Column:
    return (left < limit) | (right < limit)


def any_closed(faces: Column) -> Column:
    """Whether any face (left_eye_openness, right_eye_openness) has a closed eye."""
    return F.coalesce(F.exists(faces, lambda f: face_closed(f["left_eye_openness"], f["right_eye_openness"])), F.lit(False))


def subject_boxes(faces: Column, salient: Column) -> Column:
    """Faces if any, else salient regions, else null."""
    return F.when(F.size(faces) > 0, faces).when(F.size(salient) > 0, salient)


def subject_source(faces: Column, salient: Column) -> Column:
    return F.when(F.size(faces) > 0, "face").when(F.size(salient) > 0, "saliency")


def face_crop(box: Column, width: Column, height: Column, pad: float) -> Column:
    """Pixels (x, y, w, h) of a normalised box whose origin is at the bottom left, padded and clamped."""
    x, y, w, h = (F.get(box, F.lit(i)) for i in range(4))
    left, top = F.greatest(x - w * pad, F.lit(0.0)), F.greatest(1 - y - h - h * pad, F.lit(0.0))
    right, low = F.least(x + w + w * pad, F.lit(1.0)), F.least(1 - y + h * pad, F.lit(1.0))
    px, py = F.floor(left * width), F.floor(top * height)
    pw, ph = F.greatest(F.floor((right - left) * width), F.lit(1)), F.greatest(F.floor((low - top) * height), F.lit(1))
    return F.struct(px.cast("bigint").alias("x"), py.cast("bigint").alias("y"), pw.cast("bigint").alias("w"), ph.cast("bigint").alias("h"))


def exposure_verdict(under: Column, over: Column, limit: float | Column = 0.3) -> Column:
    return (
        F.when((under > limit) & (over > limit), "HighContrast").when(under > limit, "Underexposed")
        .when(over > limit, "Overexposed").otherwise("Normal")
    )


def focus_verdict(subject: Column, background: Column, ratio: Column) -> Column:
    sharp, back = subject >= FOCUS_FLOOR, background >= FOCUS_FLOOR
    return F.when(sharp & (ratio >= FOCUS_RATIO), "SubjectSharp").when(~sharp & back, "BackFocus").when(~sharp & ~back, "AllBlurry").otherwise("SubjectBlurry")


def blur_override(is_blurry: Column, verdict: Column) -> Column:
    """The focus verdict's word on blur; a back focus or no verdict leaves it."""
    return F.when(verdict.isin("AllBlurry", "SubjectBlurry"), True).when(verdict == "SubjectSharp", False).otherwise(is_blurry)


def group_number(label: Column) -> Column:
    """The number in ``dup-12``."""
    return F.regexp_replace(label, r"\D", "").try_cast("bigint")


def group_colour(label: Column, colours: int = 12) -> Column:
    return F.pmod(group_number(label) - 1, F.lit(colours))


def format_size(size: Column) -> Column:
    kb, mb = size / 1024.0, size / 1048576.0
    one = lambda x: F.regexp_replace(F.format_number(x, 1), ",", "")
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, F.concat(one(kb), F.lit(" KB"))).otherwise(F.concat(one(mb), F.lit(" MB")))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b)).cast("bigint")


def hamming_binary(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of bytes, as far as the shorter goes."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    bits = lambda h, i: F.conv(F.hex(F.substring(h, i, F.lit(1))), 16, 10).cast("bigint")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.bit_count(bits(a, i).bitwiseXOR(bits(b, i))))
    return F.when(n > 0, F.aggregate(each, F.lit(0).cast("bigint"), lambda s, x: s + x)).otherwise(F.lit(0).cast("bigint"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where a norm is 0.

    Norms are of whole vectors; of unequal lengths the product goes as far as the shorter.
    """
    n = F.least(F.size(a), F.size(b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    product = dot(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))
    return F.when(norm > 0, product / F.when(norm > 0, norm).otherwise(1.0)).otherwise(0.0)


def vector_stats(v: Column) -> Column:
    """Least, greatest, mean, L2 norm and number of non-zero entries of an embedding."""
    d = F.transform(v, lambda x: x.cast("double"))
    total = F.aggregate(d, F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)
    return F.struct(F.array_min(d).alias("min"), F.array_max(d).alias("max"), (total / F.size(d)).alias("mean"), F.sqrt(square).alias("l2"),
                    F.size(F.filter(d, lambda x: x != 0)).cast("bigint").alias("nonzero"))


def progress(current: Column, total: Column, elapsed_ms: Column) -> Column:
    """Photos a second, seconds left and rounded percent of a scan; null where nothing is done or known yet."""
    rate = F.when((elapsed_ms > 0) & (current > 0), current / elapsed_ms * 1000)
    return F.struct(rate.alias("rate"), ((total - current) / rate).alias("seconds_left"), F.when(total > 0, F.round(current / F.when(total > 0, total) * 100)).cast("bigint").alias("percent"))

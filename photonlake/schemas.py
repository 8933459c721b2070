"""Schemas of the logical tables."""

from __future__ import annotations

EXIF = (
    "date_time_original string, gps_lat double, gps_lng double, camera_make string, camera_model string, "
    "focal_length_mm double, aperture double, iso int, shutter_speed string, orientation int"
)
BLUR = (
    "laplacian_variance double, mean_tile_variance double, max_tile_variance double, p95_tile_variance double, "
    "sharp_tile_fraction double, largest_sharp_cluster double, bokeh_likely boolean, shake_risk boolean, is_blurry boolean"
)
EXPOSURE = "mean_luminance double, pct_underexposed double, pct_overexposed double, verdict string"
FACE_EYE = "left_eye_openness double, right_eye_openness double, eyes_closed boolean, bounding_box array<double>"
SUBJECT_FOCUS = "subject_blur_variance double, background_blur_variance double, focus_ratio double, verdict string, subject_source string"
DISCOVERED = "path string, file_size bigint, modified_at bigint"
MARKS = "image_id string, mark string"


def struct(fields: str) -> str:
    """``a int, b string`` as a struct type."""
    depth, out, field = 0, [], ""
    for ch in fields + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            field = ""
        else:
            field += ch
    return f"struct<{','.join(out)}>"


CLOSED_EYES = f"face_count int, faces array<{struct(FACE_EYE)}>, has_closed_eyes boolean"
#: A row of the per-image pipeline.
PHOTO = (
    "id string, path string, file_name string, file_size bigint, modified_at bigint, width int, height int, "
    f"exif {struct(EXIF)}, blur {struct(BLUR)}, exposure {struct(EXPOSURE)}, closed_eyes {struct(CLOSED_EYES)}, "
    f"subject_focus {struct(SUBJECT_FOCUS)}, phash binary, embeddings array<array<float>>"
)

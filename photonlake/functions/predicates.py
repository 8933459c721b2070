"""Review predicates as columns over the metrics of an image. Where an image has no metrics they are null-aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import STRONG_BOKEH, STRONG_PLAIN, Settings

DEFAULTS = Settings()


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def strong_sharp_region(prefix: str = "") -> Column:
    """A strong peak tile, or enough sharp area in one place; bars are lower where a soft background is meant."""
    bar = lambda i: F.when(_c(prefix, "bokeh_likely"), STRONG_BOKEH[i]).otherwise(STRONG_PLAIN[i])
    area = (_c(prefix, "sharp_tile_fraction") >= bar(1)) & (_c(prefix, "largest_sharp_cluster") >= bar(2))
    return (_c(prefix, "max_tile_variance") >= bar(0)) | area


def has_blur(prefix: str = "") -> Column:
    return _c(prefix, "laplacian_variance").isNotNull()


def is_blurry(prefix: str = "", verdict: str = "focus_verdict", threshold: float = DEFAULTS.blur_threshold) -> Column:
    """Blurry at a threshold; false without metrics. A mean of 0 or NaN gives way to the global variance."""
    mean, v = _c(prefix, "mean_tile_variance"), F.col(verdict)
    score = F.when((mean == 0) | F.isnan(mean), _c(prefix, "laplacian_variance")).otherwise(mean)
    return (
        F.when(~has_blur(prefix), False).when(v.isin("AllBlurry", "SubjectBlurry"), True).when(v == "SubjectSharp", False)
        .when(strong_sharp_region(prefix), False).otherwise(F.coalesce(score < threshold, F.lit(False)))
    )


def blur_intent(prefix: str = "", verdict: str = "focus_verdict") -> Column:
    mean, v, bokeh = _c(prefix, "mean_tile_variance"), F.col(verdict), _c(prefix, "bokeh_likely")
    soft = F.when(_c(prefix, "shake_risk"), "ShakeBlur").otherwise("OutOfFocus")
    return (
        F.when(~has_blur(prefix), "Unknown").when(v.isin("AllBlurry", "SubjectBlurry"), soft)
        .when(v == "SubjectSharp", F.when(bokeh | (mean < 100), "IntentionalBokeh").otherwise("Sharp"))
        .when(strong_sharp_region(prefix), F.when((mean >= 100) & ~bokeh, "Sharp").otherwise("IntentionalBokeh"))
        .otherwise(soft)
    )


def exposure_issue(prefix: str = "", threshold: float = DEFAULTS.exposure_threshold) -> Column:
    under, over = _c(prefix, "pct_underexposed"), _c(prefix, "pct_overexposed")
    return F.coalesce((under > threshold) | (over > threshold), F.lit(False))


def exposure_verdict_at(prefix: str = "", threshold: float = DEFAULTS.exposure_threshold) -> Column:
    from .photo import exposure_verdict

    return exposure_verdict(_c(prefix, "pct_underexposed"), _c(prefix, "pct_overexposed"), threshold)


def closed_eyes() -> Column:
    return F.coalesce(F.col("has_closed_eyes"), F.lit(False))


def back_focus(verdict: str = "focus_verdict") -> Column:
    return F.coalesce(F.col(verdict) == "BackFocus", F.lit(False))


def flagged_below_threshold(prefix: str = "", threshold: float = DEFAULTS.blur_threshold) -> Column:
    """The settings panel's own rule: global variance only."""
    return F.coalesce(_c(prefix, "laplacian_variance") < threshold, F.lit(False))


def badges(settings: Settings = DEFAULTS) -> Column:
    """Badges of a photo in order: focus or blur, exposure, eyes, duplicate number."""
    from .photo import group_number

    verdict = exposure_verdict_at(threshold=settings.exposure_threshold)
    return F.array_compact(F.array(
        F.when(back_focus(), "BACKFOCUS").when(is_blurry(threshold=settings.blur_threshold), "BLUR"),
        F.when(verdict == "Overexposed", "OVER").when(verdict == "Underexposed", "UNDER").when(verdict == "HighContrast", "HICON"),
        F.when(closed_eyes(), "EYES"),
        F.when(F.col("duplicate_group_id").isNotNull(), F.concat(F.lit("DUP "), group_number(F.col("duplicate_group_id")).cast("string"))),
    ))


#: Filters by name; a caller adds its own here.
FILTERS = {
    "blurry": lambda s: is_blurry(threshold=s.blur_threshold),
    "not_blurry": lambda s: ~is_blurry(threshold=s.blur_threshold),
    "exposure": lambda s: exposure_issue(threshold=s.exposure_threshold),
    "closed_eyes": lambda s: closed_eyes(),
    "back_focus": lambda s: back_focus(),
    "duplicates": lambda s: F.col("duplicate_group_id").isNotNull(),
}

"""How an uploaded document is handled: type, admission, strategy and cost."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark import fixed_values as fv
from tidemark.functions.classify import lookup


def mime_of(file_name: Column, declared: Column | None = None) -> Column:
    """Declared type without parameters, else by extension, else octet-stream."""
    by_name = lookup(fv.MIME_BY_EXTENSION, F.lower(F.regexp_extract(file_name, r"\.([^./]*)$", 1)),
                     F.lit(fv.DEFAULT_MIME))
    if declared is None:
        return by_name
    bare = F.trim(F.substring_index(F.coalesce(declared, F.lit("")), ";", 1))
    return F.when(bare != "", bare).otherwise(by_name)


def admission_reason(mime: Column, size: Column) -> Column:
    """Why a document is rejected; NULL when it is admitted."""
    allowed = sorted(set(fv.MIME_BY_EXTENSION.values()))
    return (F.when(size > fv.MAX_UPLOAD_BYTES, F.lit("too_large"))
            .when(~mime.isin(allowed), F.lit("unsupported_type")))


def _as_image(mime: Column, has_text: Column) -> Column:
    return mime.startswith("image/") | ((mime == fv.PDF_MIME) & ~has_text)


def strategy(mime: Column, size: Column, has_text: Column) -> Column:
    image = _as_image(mime, has_text)
    tier = (F.when(image & (size > 2 * 1024 * 1024), F.lit("premium"))
            .when(image, F.lit("standard")).otherwise(F.lit("budget")))
    return F.struct(((mime == fv.PDF_MIME) & ~has_text).alias("use_ocr"), image.alias("convert_to_image"),
                    tier.alias("cost_tier"))


def token_estimate(mime: Column, size: Column, text_chars: Column, has_text: Column, passes: Column | None = None) -> Column:
    """Tokens of a request about one document. ``passes``: how often it is read, null and less than two meaning once."""
    image = _as_image(mime, has_text)
    pages = F.when(mime.startswith("image/"), 1).otherwise(5)
    chars = F.when(text_chars == 0, size).otherwise(text_chars)
    extra = F.when(image, pages * 1000).otherwise(F.floor(chars / 4).cast("bigint"))
    once = (F.lit(1000) + extra).cast("bigint")
    return once if passes is None else once * F.greatest(F.lit(1), F.coalesce(passes, F.lit(1))).cast("bigint")


def over_limit(tokens: Column, tier: Column) -> Column:
    standard = fv.COST_TIER_LIMITS["standard"]
    return tokens > lookup(fv.COST_TIER_LIMITS, tier, F.lit(standard))


def recommendation(score: Column) -> Column:
    return (F.when(score < 0.4, F.lit("needs_more_samples"))
            .when(score < 0.7, F.lit("continue_with_more_samples"))
            .when(score < 0.9, F.lit("ready_for_review")).otherwise(F.lit("ready_for_production")))

"""Text columns: names, slugs, secrets, markup, JSON found in text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from tidemark import fixed_values as fv

TAG = r"(?is)<[^>]+>"
SCRIPT_OR_STYLE = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"


@F.pandas_udf(StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    """Character references to characters; the full reference table has no built-in function."""
    return s.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


def squeeze_spaces(text: Column) -> Column:
    """Trim, then one space for every run of white space."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")


def tidy(text: Column) -> Column:
    """One space per run of plain white space; any white space, also the non-breaking one, off the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[\t\n\f\r ]+", " "), r"(?U)^\s+|\s+$", "")


def page_text(markup: Column) -> Column:
    """Text of a whole page: every tag becomes a space."""
    plain = unescape_entities(F.regexp_replace(markup, r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def strip_fence(text: Column) -> Column:
    """Content of a ``` fenced block; other text is only trimmed."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(bare, r"^[^\n]*\n", ""), r"^\s+|\s+$", "")
    return F.when(bare.startswith("```"), F.regexp_replace(body, r"```$", "")).otherwise(bare)


def redact_secrets(text: Column) -> Column:
    out = F.regexp_replace(text, fv.SECRET_QUERY_PARAM, "$1[REDACTED]")
    out = F.regexp_replace(out, fv.SECRET_BEARER, "Bearer [REDACTED]")
    return F.regexp_replace(out, fv.SECRET_BASIC, "Basic [REDACTED]")


def slug(name: Column) -> Column:
    """Lower-case letters and digits joined by single underscores, at most 64 characters."""
    joined = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(joined, "^_|_$", ""), 1, 64)


def dash_slug(name: Column) -> Column:
    """One dash per other character, none at the ends, at most 63 characters, never empty."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]", "-"), "^-+|-+$", "")
    return F.substring(F.when(dashed == "", F.lit("my-app")).otherwise(dashed), 1, 63)


def clean_field_name(name: Column, position: Column) -> Column:
    """A valid field name: itself, else its slug, else ``field_<position>`` (position counts from 1)."""
    bare = F.trim(name)
    made = slug(bare)
    return (F.when(bare.rlike("^[a-z0-9_]+$"), bare).when(made != "", made)
            .otherwise(F.concat(F.lit("field_"), position.cast("string"))))


def name_form(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), " _-", "")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Number of equal leading characters."""
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, n))


def shares_stem(a: Column, b: Column) -> Column:
    shorter = F.least(F.length(a), F.length(b))
    needed = F.least(F.greatest(shorter - 2, F.lit(6)), shorter)
    return (shorter >= 4) & (common_prefix_length(a, b) >= needed)


def names_similar(a: Column, b: Column) -> Column:
    """Equal, equal in normal form, one inside the other, or a long shared beginning."""
    la, lb = F.lower(F.trim(a)), F.lower(F.trim(b))
    na, nb = name_form(a), name_form(b)
    return (la != "") & (lb != "") & ((la == lb) | (na == nb) | F.contains(la, lb) | F.contains(lb, la)
                                      | shares_stem(na, nb))


def safe_file_name(name: Column, url: Column, stamp: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(name, "/+$", ""), r"^.*/", "")
    base = F.when((base == "") | (base == "."), F.lit("download")).otherwise(base)
    base = F.substring(F.regexp_replace(base, "[^a-zA-Z0-9._-]+", "_"), 1, 120)
    return F.concat(stamp.cast("string"), F.lit("_"), F.substring(F.sha2(url, 256), 1, 8), F.lit("_"), base)


def lenient_json(text: Column) -> Column:
    """The JSON object in a text: the whole text, else from the first ``{`` to the last ``}``; else NULL."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.when(F.try_parse_json(text).isNotNull(), text),
                      F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def downgrade(confidence: Column) -> Column:
    return F.when(confidence == "high", F.lit("medium")).otherwise(F.lit("low"))


def member_name(member: Column) -> Column:
    """Display name of a dimension member: no prefix, no ``Member`` ending, words split at capitals."""
    local = F.regexp_replace(F.regexp_replace(member, r"^[^:]*:", ""), "Member$", "")
    return F.trim(F.regexp_replace(local, r"(?<!^)([A-Z])", " $1"))


def growth_highlight(summary: Column) -> Column:
    """Growth or decline percentage a headline states; the leftmost statement wins."""
    pos_number = F.regexp_instr(summary, F.lit(fv.GROWTH_NUMBER_FIRST))
    pos_word = F.regexp_instr(summary, F.lit(fv.GROWTH_WORD_FIRST))
    number_first = (pos_number > 0) & ((pos_word == 0) | (pos_number <= pos_word))
    word = F.when(number_first, F.regexp_extract(summary, fv.GROWTH_NUMBER_FIRST, 2)) \
            .otherwise(F.regexp_extract(summary, fv.GROWTH_WORD_FIRST, 1))
    percent = F.when(number_first, F.regexp_extract(summary, fv.GROWTH_NUMBER_FIRST, 1)) \
               .otherwise(F.regexp_extract(summary, fv.GROWTH_WORD_FIRST, 2))
    label = F.when(F.lower(word) == "decrease", F.lit("Decline")).otherwise(F.lit("Growth"))
    return F.when((pos_number > 0) | (pos_word > 0),
                  F.struct(label.alias("label"), F.concat(percent, F.lit("%")).alias("value")))

"""Money, ratios and their display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark import fixed_values as fv


def _exact_steps(x: Column, places: int) -> Column:
    """Number of 10^-places steps in ``x`` >= 0, rounding the exact binary value, ties to even.

    ``rest`` is twice the distance from ``x`` to the middle of its step, summed so that no product or
    difference loses bits; its sign alone decides whether the step rounds up.
    """
    scale = 10 ** places
    low = F.floor(x * scale)
    mid = (low * 2 + 1).cast("double")
    if places == 1:
        rest = (x * 16 - mid) + x * 4
    elif places == 2:
        rest = ((x * 128 - mid) + x * 64) + x * 8
    else:
        raise ValueError("one or two places")
    up = (rest > 0) | ((rest == 0) & (low % 2 == 1))
    return (low + up.cast("int")).cast("bigint")


def fixed_text(x: Column, places: int) -> Column:
    """Text of ``x`` >= 0 with a fixed number of decimals."""
    if places == 0:
        return F.rint(x).cast("bigint").cast("string")
    n = _exact_steps(x, places)
    scale = 10 ** places
    whole = F.floor(n / F.lit(scale)).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("."),
                    F.lpad((n - whole * scale).cast("string"), places, "0"))


def _once(x: Column, use) -> Column:
    """``use(x)`` with ``x`` computed once, however often ``use`` mentions it."""
    return F.transform(F.array(x), use)[0]


def format_value(v: Column, unit: Column) -> Column:
    """Display text of an amount: divisor, places and suffix are chosen first, then one number is rounded."""
    def shape(a: Column) -> Column:
        size, share = F.abs(a["v"]), F.coalesce(a["unit"] == fv.USD_PER_SHARE, F.lit(False))
        step = F.when(share | (size < 1e3), 1.0).when(size < 1e6, 1e3).when(size < 1e9, 1e6).otherwise(1e9)
        return F.struct((size / step).alias("x"), step.alias("step"), share.alias("share"), F.when(a["v"] < 0, F.lit("-")).otherwise(F.lit("")).alias("minus"))

    def text(m: Column) -> Column:
        digits = F.when(m["share"], fixed_text(m["x"], 2)).when(m["step"] == 1.0, fixed_text(m["x"], 0)).otherwise(fixed_text(m["x"], 1))
        suffix = F.when(m["step"] == 1e3, F.lit("K")).when(m["step"] == 1e6, F.lit("M")).when(m["step"] == 1e9, F.lit("B")).otherwise(F.lit(""))
        front = F.when(m["share"], F.concat(F.lit("$"), m["minus"])).otherwise(F.concat(m["minus"], F.lit("$")))
        return F.concat(front, digits, suffix)
    return _once(_once(F.struct(v.alias("v"), unit.alias("unit")), shape), text)


def parse_amount(cell: Column) -> Column:
    """Number in a rendered table cell; brackets mean negative, dashes mean nothing."""
    bare = F.trim(F.regexp_replace(F.trim(cell), "[$,—– ]", ""))
    inner = F.trim(F.regexp_replace(F.regexp_replace(bare, r"^\(", ""), r"\)$", ""))
    number = F.when(inner.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
                    inner.try_cast("double"))
    return F.when(bare.rlike(r"^\(.*\)$"), -number).otherwise(number)


def parse_shorthand(text: Column) -> Column:
    """Value of the first ``$1.2B`` style amount in a text."""
    pattern = r"(?i)\$([\d,.]+)\s*([BMK])?"
    digits = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(""))
    number = F.regexp_extract(digits, r"^([0-9]+\.?[0-9]*|\.[0-9]+)", 1).try_cast("double")
    letter = F.upper(F.regexp_extract(text, pattern, 2))
    return number * (F.when(letter == "B", 1e9).when(letter == "M", 1e6).when(letter == "K", 1e3).otherwise(1.0))


def signed_percent(v: Column) -> Column:
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.concat(sign, fixed_text(F.abs(v), 1), F.lit("%"))


def yoy_percent(value: Column, prior: Column) -> Column:
    """Percent change with one decimal, only against a positive base."""
    return F.when(prior > 0, F.round((F.try_divide(value, prior) - 1) * 1000) / 10)


def human_bytes(n: Column) -> Column:
    mb, gb = 1024.0 ** 2, 1024.0 ** 3
    return F.when(n >= gb, F.concat(fixed_text(n / gb, 1), F.lit(" GB"))) \
            .otherwise(F.concat(fixed_text(n / mb, 0), F.lit(" MB")))


def human_duration(seconds: Column) -> Column:
    minutes = F.floor((seconds + 30) / 60).cast("bigint")
    return F.when(seconds >= 60, F.concat(minutes.cast("string"), F.lit(" min"))) \
            .otherwise(F.concat(seconds.cast("bigint").cast("string"), F.lit("s")))


def _half_up_text(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint").cast("string")


def short_volume(n: Column) -> Column:
    v = F.coalesce(n, F.lit(0)).cast("double")
    return (F.when(v >= 1e9, F.concat(fixed_text(v / 1e9, 1), F.lit("B")))
            .when(v >= 1e6, F.concat(fixed_text(v / 1e6, 1), F.lit("M")))
            .when(v >= 1e3, F.concat(_half_up_text(v / 1e3), F.lit("K")))
            .otherwise(v.cast("bigint").cast("string")))


def short_money(n: Column) -> Column:
    v = F.coalesce(n, F.lit(0)).cast("double")
    small = F.concat(F.lit("$"), _half_up_text(v))
    return F.when(v >= 1e3, F.concat(F.lit("$"), short_volume(v))).otherwise(small)


def adjusted_or_raw(adj: Column, close: Column) -> Column:
    return F.when(adj.isNotNull() & (adj != 0), adj).otherwise(close)


def agree(a: Column, b: Column, unit: Column) -> Column:
    """Two readings of one figure match: half a cent per share, half a percent of the first for money."""
    gap = F.abs(a - b)
    base = F.when(a != 0, F.abs(a)).otherwise(F.abs(b))
    money = F.when((a == 0) & (b == 0), F.lit(True)).otherwise(F.try_divide(gap, base) <= fv.MONEY_TOLERANCE)
    return F.when(unit == fv.USD_PER_SHARE, gap <= fv.PER_SHARE_TOLERANCE).otherwise(money)


def close_to(ratio: Column, target: float) -> Column:
    return F.abs(ratio - target) / target <= fv.SCALE_TOLERANCE


def implausible_tag(decimals: Column, value: Column, unit: Column) -> Column:
    """A money fact that claims unit accuracy yet is too small for one."""
    digits = F.regexp_extract(decimals, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")
    return (unit == fv.USD) & F.coalesce(digits >= 0, F.lit(False)) & (F.abs(value) < fv.IMPLAUSIBLE_BELOW)


def eps_basis(vendor: Column, own: Column) -> Column:
    tiny = F.abs(own) < 1e-9
    gap = F.abs(vendor - own)
    same = F.when(tiny, gap < 1e-9).otherwise(F.try_divide(gap, F.abs(own)) <= fv.BASIS_TOLERANCE)
    return F.when(own.isNull() | vendor.isNull(), F.lit("unknown")) \
            .when(same, F.lit("reported")).otherwise(F.lit("street"))


def grade_by_two_sources(inst: Column, rend: Column, unit: Column, n_signals: Column) -> Column:
    """Confidence and source of a figure read from the tagged instance and the rendered statement."""
    def out(conf: str, source: str) -> Column:
        return F.struct(F.lit(conf).alias("confidence"), F.lit(source).alias("source"))
    return (F.when(n_signals > 0, out(fv.SUSPECT, fv.FROM_INSTANCE))
            .when(inst.isNotNull() & rend.isNotNull() & agree(inst, rend, unit), out(fv.VERIFIED, fv.FROM_BOTH))
            .when(inst.isNotNull() & rend.isNotNull(), out(fv.SUSPECT, fv.FROM_BOTH))
            .when(inst.isNotNull(), out(fv.SINGLE_SOURCE, fv.FROM_INSTANCE))
            .when(rend.isNotNull(), out(fv.SINGLE_SOURCE, fv.FROM_RENDERED))
            .otherwise(out(fv.SUSPECT, fv.FROM_INSTANCE)))


def grade_gap_fill(corroborators: Column, plausible: Column) -> Column:
    return (F.when(corroborators > 0, F.lit(fv.VERIFIED))
            .when(~plausible, F.lit(fv.SUSPECT)).otherwise(F.lit(fv.SINGLE_SOURCE)))


def publishable(confidence: Column) -> Column:
    return confidence.isin(fv.VERIFIED, fv.SINGLE_SOURCE)

"""Fiscal periods, date windows and time spans."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark import fixed_values as fv


def span_days(start: Column, end: Column) -> Column:
    """Days from start to end; -1 for an instant."""
    return F.coalesce(F.datediff(end, start), F.lit(-1))


def in_band(days: Column, duration: Column) -> Column:
    return (F.when(duration == "P3M", days.between(*fv.QUARTER_DAYS))
            .when(duration == "P1Y", days.between(*fv.YEAR_DAYS)).otherwise(F.lit(False)))


def _is_quarter(focus: Column) -> Column:
    return focus.rlike("^[Qq].$")


def period_of(focus: Column, fiscal_year: Column) -> Column:
    """Label and duration a filing declares through its fiscal period focus and year."""
    year = fiscal_year.cast("string")
    label = (F.when(F.upper(focus) == "FY", F.concat(F.lit("FY "), year))
             .when(_is_quarter(focus), F.concat(F.upper(focus), F.lit(" "), year))
             .otherwise(F.trim(F.concat_ws(" ", F.coalesce(focus, F.lit("")), F.coalesce(year, F.lit(""))))))
    duration = F.when(F.upper(focus) == "FY", F.lit("P1Y")).otherwise(F.lit("P3M"))
    return F.struct(label.alias("label"), duration.alias("duration"), focus.alias("focus"))


def strict_duration(focus: Column) -> Column:
    """Duration for a known focus only; anything else has none."""
    return F.when(F.upper(focus) == "FY", F.lit("P1Y")).when(_is_quarter(focus), F.lit("P3M"))


def quarter_label(q: Column) -> Column:
    return F.when(q.between(1, 4), F.concat(F.lit("Q"), q.cast("string")))


def derive_period_end(fye: Column, fiscal_year: Column, period: Column, month_end: bool = False) -> Column:
    """Period end and duration from a ``MMdd`` fiscal year end, a year and FY or Q1 to Q4.

    Earlier quarters step back three months at a time with calendar overflow (31 September is
    1 October). ``month_end=True`` clamps to the month's last day instead.
    """
    code = F.upper(F.trim(period))
    year = F.trim(fiscal_year.cast("string")).try_cast("int")
    month = F.when(fye.rlike("^[0-9]{4}$"), F.substring(fye, 1, 2).cast("int"))
    day = F.when(fye.rlike("^[0-9]{4}$"), F.substring(fye, 3, 2).cast("int"))
    back = (F.when(code.isin("FY", "Q4"), 0).when(code == "Q3", 3).when(code == "Q2", 6).when(code == "Q1", 9))
    ok = (year >= 1900) & month.between(1, 12) & day.between(1, 31) & back.isNotNull()
    # The year end itself may overflow (0231), then the quarter steps start from the real date.
    year_end = F.date_add(F.make_date(year, month, F.lit(1)), day - 1)
    anchor = F.add_months(F.trunc(year_end, "MM"), -back)
    end = F.add_months(year_end, -back) if month_end else F.date_add(anchor, F.dayofmonth(year_end) - 1)
    return F.struct(F.when(ok, F.when(back == 0, year_end).otherwise(end)).alias("period_end"),
                    F.when(ok, F.when(code == "FY", F.lit("P1Y")).otherwise(F.lit("P3M"))).alias("duration"))


def shift_years(d: Column, years: int) -> Column:
    """Same month and day in another year; 29 February overflows to 1 March."""
    first = F.make_date(F.year(d) + years, F.month(d), F.lit(1))
    return F.date_add(first, F.dayofmonth(d) - 1)


def clamp_window(want_from: Column, want_to: Column, lo: Column, hi: Column, default_years: int = 2) -> Column:
    """The window a query may read: default to the last two years, clamped to what exists.

    ``window_ok`` is false for an inverted window or one outside the data.
    """
    to = F.coalesce(want_to, hi)
    start = F.coalesce(want_from, shift_years(to, -default_years))
    cut_from, cut_to = F.greatest(start, lo), F.least(to, hi)
    ok = lo.isNotNull() & hi.isNotNull() & (start <= to) & (cut_from <= cut_to)
    return F.struct(F.when(ok, cut_from).alias("from"), F.when(ok, cut_to).alias("to"),
                    F.coalesce(ok, F.lit(False)).alias("window_ok"))


def preset_start(to: Column, years: int, lo: Column) -> Column:
    return F.greatest(shift_years(to, -years), lo)


def fiscal_year_of(label: Column, end: Column, anchor: Column) -> Column:
    in_label = F.regexp_extract(label, r"\b(20\d{2})\b", 1)
    return F.coalesce(F.when(in_label != "", in_label), F.year(end).cast("string"), F.year(anchor).cast("string"))


def is_annual(duration: Column, focus: Column) -> Column:
    return F.coalesce(duration == "P1Y", F.lit(False)) | F.coalesce(focus == "FY", F.lit(False))


def is_q4(focus: Column, label: Column) -> Column:
    return F.coalesce(focus == "Q4", F.lit(False)) | F.coalesce(label.rlike(r"(?i)^Q4\b"), F.lit(False))


def exchange_date(epoch: Column, offset: Column) -> Column:
    """Calendar date at the exchange for an epoch second and its offset from UTC."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((epoch + offset) / 86400).cast("int"))


def wall_time_text(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    m, h = F.floor(s / 60).cast("bigint"), F.floor(s / 3600).cast("bigint")
    return (F.when(seconds.isNull() | (seconds < 0), F.lit("—"))
            .when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
            .when(m < 60, F.concat(m.cast("string"), F.lit(" m "), (s - m * 60).cast("string"), F.lit(" s")))
            .otherwise(F.concat(h.cast("string"), F.lit(" h "), (m - h * 60).cast("string"), F.lit(" m"))))


def wall_time(uploaded: Column, completed: Column, status: Column, as_of: Column) -> Column:
    """Processing time of a document: to completion, or so far while it is in progress."""
    done = F.unix_micros(completed) - F.unix_micros(uploaded)
    so_far = F.unix_micros(as_of) - F.unix_micros(uploaded)
    return (F.when(uploaded.isNull(), F.lit("—"))
            .when(completed.isNotNull() & (done >= 0), wall_time_text(F.floor(done / 1e6 + 0.5)))
            .when(status.isin(fv.IN_PROGRESS_STATUSES),
                  F.concat(wall_time_text(F.floor(so_far / 1e6 + 0.5)), F.lit(" …")))
            .otherwise(F.lit("—")))

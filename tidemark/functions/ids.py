"""Identifier columns: company keys, tickers, archive addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CIK_WIDTH = 10
ARCHIVE_ROOT = "https://www.sec.gov/Archives/edgar/data"


def normalize_cik(text: Column) -> Column:
    """Ten digits with leading zeros; NULL when the text is not a company key."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?i)^cik(?=.)", ""))
    return F.when(bare.rlike(r"^[0-9]{1,10}$"), F.lpad(bare, CIK_WIDTH, "0"))


def strip_zeros(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^0+(?=.)", "")


def primary_ticker(tickers: Column) -> Column:
    return F.coalesce(F.get(tickers, F.lit(0)), F.lit(""))


def archive_url(cik: Column, accession: Column) -> Column:
    return F.concat(F.lit(ARCHIVE_ROOT + "/"), cik.cast("bigint").cast("string"), F.lit("/"),
                    F.replace(accession, F.lit("-"), F.lit("")))


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)

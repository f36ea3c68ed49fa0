"""Building the meta document of filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark import fixed_values as fv
from tidemark.functions.classify import classify_filing, filing_summary, lookup
from tidemark.sources.sinks import new_only

c = F.col


def build_meta(filings: DataFrame, existing: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Tier, category, tags and summary for filings without a meta document (all with ``force``).

    Needs form, titles, body, is_xbrl and owner.
    """
    todo = new_only(filings, existing, keys, force)
    r = todo.withColumn("_c", classify_filing(c("form"), c("titles"), c("body"), c("is_xbrl")))
    return r.select(*keys, "form", c("_c.tier").alias("tier"), lookup(fv.TIER_LABELS, c("_c.tier")).alias("tier_label"),
                    c("_c.category").alias("category"), c("_c.tags").alias("tags"),
                    filing_summary(c("form"), c("_c.category"), c("titles"), c("body"), c("owner")).alias("summary"))

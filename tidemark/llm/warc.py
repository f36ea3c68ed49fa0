"""Resolution of not-modified revisit records of web archives.

A revisit of profile server-not-modified carries no payload: the server answered 304 to a conditional request. It is resolved
to the latest earlier full response of the same canonical URL, if their validators agree, and takes that response's payload
and headers, updated with the headers of the 304 that may replace stored ones.

Records have the columns record_id long, url, captured_at long (seconds), kind ('response' or 'revisit') and headers, an
array of (name, value) in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a 304 that do not replace stored ones (they describe the connection or the absent body).
NOT_MERGED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
              "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]
#: Query parameters that only track visitors.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="
#: Seconds of one stretch of the as-of join.
STRETCH = 86_400


def canonical_url(url: Column) -> Column:
    """Scheme, fragment, default port, tracking parameters and a trailing slash removed; host lower-cased; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_extract(bare, "^[^?]*", 0)
    host = F.regexp_replace(F.lower(F.regexp_extract(place, "^[^/]*", 0)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(place, "^[^/]*", ""), "/$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def header_lines(block: Column) -> Column:
    """A header block as an array of (name, value): the status line and lines without a colon are left out, names lower-cased."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike("^[^ :]+:"))
    return F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, "^([^:]+):", 1)).alias("name"),
                                                F.trim(F.regexp_replace(x, "^[^:]+:", "")).alias("value")))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, or null."""
    return F.try_element_at(F.filter(headers, lambda h: h["name"] == name), F.lit(1))["value"]


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers whose names the update does not carry, then those of the update that may be merged."""
    allowed = F.filter(update, lambda h: ~h["name"].isin(NOT_MERGED))
    names = F.transform(allowed, lambda h: h["name"])
    return F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"])), allowed)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per revisit: record_id, canonical_url, captured_at, status, resolved_id and merged headers.

    status: 'resolved'; 'no_response' (no earlier full response, or no URL or time); 'no_validator' (the revisit has neither
    ETag nor Last-Modified); 'mismatch' (the revisit's ETag, compared weakly, or without one its Last-Modified, is not that of
    the response). resolved_id and headers are set for 'resolved' only. A response of the same second is not earlier; of
    several at one time the largest record_id counts. Null headers count as none. Repeated revisits are all answered. Other
    columns are ignored. An empty table gives an empty result.

    The join works per URL and stretch of time: each stretch looks back within itself, and one row per URL and stretch carries
    the last response on to the next, so that a URL with very many captures is spread over its stretches.
    """
    rows = records.select(
        F.col("record_id"), canonical_url(F.col("url")).alias("canonical_url"), F.col("captured_at"), (F.col("kind") == "response").alias("full"),
        F.coalesce(F.col("headers"), F.array().cast("array<struct<name:string,value:string>>")).alias("headers")).where("kind in ('response', 'revisit')")
    placed = rows.withColumn("stretch", F.floor(F.col("captured_at") / stretch))
    known = placed.where("canonical_url is not null and captured_at is not null")
    answer = F.when(F.col("full"), F.struct("record_id", "headers"))
    inside = (Window.partitionBy("canonical_url", "stretch").orderBy("captured_at", "full", "record_id")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    looked = known.withColumn("near", F.last(answer, ignorenulls=True).over(inside)).where(~F.col("full"))
    ends = (known.where("full").groupBy("canonical_url", "stretch")
            .agg(F.max_by(F.struct("record_id", "headers"), F.struct("captured_at", "record_id")).alias("end")))
    # stretches with revisits ask for the last response of the stretches before
    asked = looked.select("canonical_url", "stretch").distinct().join(ends, ["canonical_url", "stretch"], "full_outer")
    before = Window.partitionBy("canonical_url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.select("canonical_url", "stretch", F.last("end", ignorenulls=True).over(before).alias("far"))
    found = looked.join(carried, ["canonical_url", "stretch"], "left").withColumn("hit", F.coalesce("near", "far"))
    lost = placed.where("(canonical_url is null or captured_at is null) and not full").withColumn("hit", F.lit(None).cast(found.schema["hit"].dataType))
    columns = ["record_id", "canonical_url", "captured_at", "headers", "hit"]
    out = found.select(*columns).unionByName(lost.select(*columns))
    etag, stamp = header(F.col("headers"), "etag"), header(F.col("headers"), "last-modified")
    held_etag, held_stamp = header(F.col("hit.headers"), "etag"), header(F.col("hit.headers"), "last-modified")
    agree = F.when(etag.isNotNull(), F.coalesce(_weak(etag) == _weak(held_etag), F.lit(False))).otherwise(F.coalesce(stamp == held_stamp, F.lit(False)))
    status = (F.when(F.col("hit").isNull(), "no_response").when(etag.isNull() & stamp.isNull(), "no_validator")
              .when(agree, "resolved").otherwise("mismatch"))
    resolved = F.col("status") == "resolved"
    return (out.withColumn("status", status)
            .select("record_id", "canonical_url", "captured_at", "status", F.when(resolved, F.col("hit.record_id")).alias("resolved_id"),
                    F.when(resolved, merged_headers(F.col("hit.headers"), F.col("headers"))).alias("headers")))


def with_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """The revisits with the payload (columns record_id, payload) of the response that each was resolved to."""
    held = payloads.select(F.col("record_id").alias("resolved_id"), "payload")
    return resolved.join(held, "resolved_id", "left")


def header_text(headers: Column) -> Column:
    """Headers as sorted lines."""
    return F.array_join(F.array_sort(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"]))), "\n")


#: A capture stream over ``pages``, in SQL for both engines: each page is a full response at second 1000 * page_id, and a
#: revisit 30 to 90 thousand seconds later. Its validators: the ETag of the page, a weak form, none but the date, none, or another.
CAPTURES = r"""
SELECT page_id AS record_id, url, 1000 * page_id AS captured_at, 'response' AS kind,
  concat('HTTP/1.1 200 OK', chr(10), 'ETag: "', md5(html), '"', chr(10), 'Last-Modified: day ', cast(page_id % 7 AS VARCHAR(9)), chr(10),
    'Content-Type: text/html', chr(10), 'Content-Length: ', cast(length(html) AS VARCHAR(9)), chr(10), 'Cache-Control: max-age=60') AS block
FROM pages
UNION ALL
SELECT -1 - page_id, url, 1000 * page_id + 30000 + 15000 * (page_id % 5), 'revisit',
  concat('HTTP/1.1 304 Not Modified', chr(10),
    CASE page_id % 6 WHEN 0 THEN concat('ETag: W/"', md5(html), '"', chr(10)) WHEN 1 THEN concat('Last-Modified: day ', cast(page_id % 7 AS VARCHAR(9)), chr(10))
      WHEN 2 THEN '' WHEN 3 THEN concat('ETag: "other', md5(html), '"', chr(10)) ELSE concat('ETag: "', md5(html), '"', chr(10)) END,
    'Content-Length: 0', chr(10), 'Cache-Control: max-age=', cast(page_id % 90 AS VARCHAR(9)), chr(10), 'Expires: day ', cast(page_id % 9 AS VARCHAR(9)))
FROM pages
"""

REVISITS_SQL = rf"""
WITH captures AS ({CAPTURES}),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM captures),
parts AS (SELECT *, regexp_extract(b, '^[^?]*') AS place,
  list_sort(list_filter(string_split(regexp_extract(b, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))) AS q FROM bare),
named AS (SELECT record_id, captured_at, kind, block,
  concat(regexp_replace(lower(regexp_extract(place, '^[^/]*')), ':(80|443)$', ''), regexp_replace(regexp_replace(place, '^[^/]*', ''), '/$', ''),
    CASE WHEN len(q) > 0 THEN concat('?', array_to_string(q, '&')) ELSE '' END) AS canonical_url FROM parts),
heads AS (SELECT *, list_transform(list_filter(string_split(block, chr(10)), lambda x: regexp_matches(x, '^[^ :]+:')),
    lambda x: {{'name': lower(regexp_extract(x, '^([^:]+):', 1)), 'value': trim(regexp_replace(x, '^[^:]+:', ''))}}) AS h FROM named),
valid AS (SELECT record_id, captured_at, kind, canonical_url, h, list_filter(h, lambda x: x.name = 'etag')[1].value AS etag,
    list_filter(h, lambda x: x.name = 'last-modified')[1].value AS stamp FROM heads),
full_ones AS (SELECT * FROM valid WHERE kind = 'response'),
hits AS (SELECT r.record_id, r.canonical_url, r.captured_at, r.h AS rh, r.etag AS re, r.stamp AS rs, p.record_id AS pid, p.h AS ph, p.etag AS pe, p.stamp AS ps
  FROM (SELECT * FROM valid WHERE kind = 'revisit') r ASOF LEFT JOIN full_ones p ON r.canonical_url = p.canonical_url AND r.captured_at > p.captured_at),
judged AS (SELECT *, CASE WHEN pid IS NULL THEN 'no_response' WHEN re IS NULL AND rs IS NULL THEN 'no_validator'
    WHEN CASE WHEN re IS NOT NULL THEN regexp_replace(re, '^W/', '') = regexp_replace(pe, '^W/', '') ELSE rs = ps END THEN 'resolved' ELSE 'mismatch' END AS status,
    list_filter(rh, lambda x: x.name NOT IN ({", ".join(f"'{x}'" for x in NOT_MERGED)})) AS allowed FROM hits)
SELECT record_id, canonical_url, captured_at, status, CASE WHEN status = 'resolved' THEN pid END AS resolved_id,
  CASE WHEN status = 'resolved' THEN array_to_string(list_sort(list_transform(
    list_concat(list_filter(ph, lambda x: NOT list_contains(list_transform(allowed, lambda y: y.name), x.name)), allowed),
    lambda x: concat(x.name, ': ', x.value))), chr(10)) END AS merged_headers
FROM judged
"""


def revisits_of_pages(pages: DataFrame) -> DataFrame:
    """The query's form: the capture stream over pages, resolved, with headers as text."""
    spark = pages.sparkSession
    captures = spark.sql(CAPTURES.replace("FROM pages", "FROM {pages}").replace("\\", "\\\\"), pages=pages).withColumn("headers", header_lines(F.col("block")))
    return resolve(captures).select("record_id", "canonical_url", "captured_at", "status", "resolved_id", header_text(F.col("headers")).alias("merged_headers"))

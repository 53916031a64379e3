"""Not-modified revisits in web archives: as-of join to the latest earlier full response of the same URL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Fields that a not-modified answer may not change in a stored response (RFC 9111, 3.2, and hop-by-hop fields).
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization",
    "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that name a visit and not a resource.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case; without default port, fragment, tracking parameters and a slash at the end; parameters sorted.

    A text that is no URL stays as it is, in lower case.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://[^/]*):80$", "$1"), r"^(https://[^/]*):443$", "$1")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike(f"^(({TRACKING})(=.*)?)?$")))
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(head == "", F.lower(bare)).otherwise(F.concat(head, path, rest))


def lower_keys(headers: Column) -> Column:
    """Field names in lower case, of equal names the last; a null map is empty."""
    pairs = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    named = F.transform(pairs, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    later = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(later)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored fields, updated by the permitted ones of a not-modified answer."""
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(*KEPT_FIELDS))
    old = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(old, allowed)


def latest_earlier(rows: DataFrame, key: str, ts: str, value: Column, valid: Column, part_rows: int, out: str) -> DataFrame:
    """rows with the value of the row of the same key with the latest ts before theirs, among valid rows; ties to the greatest value.

    Rows are range-partitioned by key and ts into parts of about part_rows, whatever the keys and times. Within a part, a
    window finds the last valid row of a key; the last one of earlier parts comes from a table of one row per key and part. So a key
    with a third of all rows is spread over its parts; only rows of one key at the same ts stay together. Rows without key
    or ts find nothing and are left out.
    """
    at = F.unix_micros(ts)
    rows = durable(rows.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()))
    parts = max(8, math.ceil(rows.count() / part_rows))
    # Part numbers are kept before they are used twice: two shuffles could cut at other places.
    dealt = durable(rows.repartitionByRange(parts, F.col(key), at).withColumn("__part", F.spark_partition_id()))
    cut = dealt.withColumn("__own", F.when(valid, F.struct(at.alias("at"), value.alias("value"))))
    ends = cut.groupBy(key, "__part").agg(F.max("__own").alias("__end"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__carry", F.max("__end").over(before)).drop("__end")
    inside = Window.partitionBy(key, "__part").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("__local", F.max("__own").over(inside))
    joined = local.join(ends, [key, "__part"])
    return joined.withColumn(out, F.coalesce("__local", "__carry")["value"]).drop("__part", "__own", "__local", "__carry")


def resolve(records: DataFrame, *, part_rows: int = 200_000) -> DataFrame:
    """One row for each revisit among the records, with the response it stands for.

    records: record_id long, url, capture_ts timestamp, kind ('response' or 'revisit'), status int, headers map<string,string>,
    payload_digest, payload_length long. Full responses have kind 'response' and status 200.

    A revisit's candidate is the latest earlier full response with its canonical URL; of those at the same time,
    the one with the greatest record_id. Its validators are then checked: entity tags, weakly; or else
    Last-Modified; and the payload digest if the revisit has one. outcome is 'resolved', 'unverified' (no
    validator to check), 'changed' (a validator differs) or 'missing' (no earlier response, or no URL or time).
    Resolved and unverified revisits get the response's payload and its headers, updated by the permitted ones.

    Header names are compared in lower case. Null headers are empty, repeated records are rows like any other, very long
    values are compared whole, other columns are ignored, and an empty table gives no rows.
    """
    heads = F.transform(F.array_sort(F.map_entries("own")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("capture_ts").isNotNull() & F.col("canonical_url").isNotNull()
    rows = records.select(
        "record_id", "url", "capture_ts", "kind", "status", "payload_digest", "payload_length",
        canonical_url(F.col("url")).alias("canonical_url"), lower_keys(F.col("headers")).alias("own"),
    ).filter("kind IN ('response', 'revisit')")
    value = F.struct("record_id", heads.alias("heads"), "payload_digest", "payload_length")
    joined = latest_earlier(rows, "canonical_url", "capture_ts", value, F.coalesce(full, F.lit(False)), part_rows, "found")
    # Rows without URL or time find nothing and are lost to the join; they come back as missing.
    nowhere = rows.filter("canonical_url IS NULL OR capture_ts IS NULL").withColumn("found", F.lit(None).cast(joined.schema["found"].dataType))
    joined = joined.unionByName(nowhere).filter("kind = 'revisit'").withColumn("stored", F.map_from_entries("found.heads"))
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    field = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    tag, modified = field("own", "etag"), field("own", "last-modified")
    same_tag = F.coalesce(weak(tag) == weak(field("stored", "etag")), F.lit(False))
    same_time = F.coalesce(modified == field("stored", "last-modified"), F.lit(False))
    other_payload = F.coalesce(F.col("payload_digest") != F.col("found.payload_digest"), F.lit(False))
    outcome = (
        F.when(F.col("found").isNull(), "missing")
        .when(other_payload | (tag.isNotNull() & ~same_tag) | (tag.isNull() & modified.isNotNull() & ~same_time), "changed")
        .when(tag.isNull() & modified.isNull() & F.col("payload_digest").isNull(), "unverified")
        .otherwise("resolved")
    )
    good = F.col("outcome").isin("resolved", "unverified")
    return joined.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "capture_ts", "outcome",
        F.col("found.record_id").alias("response_id"),
        F.when(good, F.col("found.payload_digest")).alias("payload_digest"),
        F.when(good, F.col("found.payload_length")).alias("payload_length"),
        F.when(good, merged_headers(F.col("stored"), F.col("own"))).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Capture records made from pages: a full response of each page, and three visits that found it not modified.

    The first visit is a day later, under an equivalent URL; every fifth page has changed by then. The second, two days
    later, has Last-Modified only. The third comes an hour before the response, with nothing to check.
    """
    when = F.timestamp_seconds(1_700_000_000 + F.col("page_id") * 37)
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    modified = F.date_format(when - F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd HH:mm:ss")
    spelt = F.concat(F.upper(F.regexp_extract("url", "^([a-z]+://[^/]*)", 1)), F.regexp_extract("url", "^[a-z]+://[^/]*([^#]*)", 1), F.lit("#visit"))
    empty = F.lit(None).cast("string")

    def record(n: int, url: Column, ts: Column, kind: str, status: int, headers: Column, digest: Column, length: Column) -> Column:
        return F.struct(
            (F.col("page_id") * 4 + n).alias("record_id"), url.alias("url"), ts.alias("capture_ts"), F.lit(kind).alias("kind"), F.lit(status).alias("status"),
            headers.alias("headers"), digest.alias("payload_digest"), length.cast("long").alias("payload_length"),
        )

    full = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("ETag"), tag,
        F.lit("Last-Modified"), modified, F.lit("Cache-Control"), F.lit("max-age=60"),
    )
    own = F.when(F.col("page_id") % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    first = F.create_map(F.lit("etag"), own, F.lit("Content-Length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"))
    second = F.create_map(F.lit("Last-Modified"), modified, F.lit("Age"), F.lit("7"))
    none = F.create_map().cast("map<string,string>")
    day = F.expr("INTERVAL 1 DAY")
    return pages.select(
        F.explode(
            F.array(
                record(0, F.col("url"), when, "response", 200, full, F.md5("html"), F.octet_length("html")),
                record(1, spelt, when + day, "revisit", 304, first, empty, F.lit(0)),
                record(2, F.col("url"), when + day + day, "revisit", 304, second, F.md5("html"), F.lit(0)),
                record(3, F.col("url"), when - F.expr("INTERVAL 1 HOUR"), "revisit", 304, none, empty, F.lit(0)),
            )
        ).alias("r")
    ).select("r.*")


def digest(resolved: DataFrame) -> DataFrame:
    """resolved with headers as text: name=value, sorted, one per line."""
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return resolved.withColumn("headers", F.array_join(lines, "\n"))


ORACLE = r"""
WITH base AS (
  SELECT page_id, url, md5(html) AS digest, strlen(html)::BIGINT AS len, make_timestamp((1700000000 + page_id * 37) * 1000000) AS ts,
         '"' || substr(md5(html), 1, 12) || '"' AS tag FROM pages),
timed AS (SELECT *, strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS modified FROM base),
records AS (
  SELECT page_id * 4 AS record_id, url, ts, true AS full, tag, modified, digest, len, NULL::VARCHAR AS cache, NULL::VARCHAR AS age FROM timed
  UNION ALL SELECT page_id * 4 + 1, upper(regexp_extract(url, '^([a-z]+://[^/]*)', 1)) || regexp_extract(url, '^[a-z]+://[^/]*([^#]*)', 1) || '#visit',
    ts + INTERVAL 1 DAY, false, CASE WHEN page_id % 5 = 0 THEN '"other"' ELSE 'W/' || tag END, NULL, NULL, 0, 'max-age=600', NULL FROM timed
  UNION ALL SELECT page_id * 4 + 2, url, ts + INTERVAL 2 DAY, false, NULL, modified, digest, 0, NULL, '7' FROM timed
  UNION ALL SELECT page_id * 4 + 3, url, ts - INTERVAL 1 HOUR, false, NULL, NULL, NULL, 0, NULL, NULL FROM timed),
parts AS (
  SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM records),
split AS (
  SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS head,
    regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda p: NOT regexp_matches(p, '^((utm_[a-z]+|ref|fbclid|gclid)(=.*)?)?$'))) AS kept FROM parts),
canon AS (
  SELECT *, CASE WHEN head = '' THEN lower(bare) ELSE
    regexp_replace(regexp_replace(head, '^(http://[^/]*):80$', '\1'), '^(https://[^/]*):443$', '\1') || path ||
    CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical_url FROM split),
matched AS (
  SELECT v.*, f.record_id AS response_id, f.tag AS f_tag, f.modified AS f_modified, f.digest AS f_digest, f.len AS f_len,
         row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC, f.record_id DESC) AS place
  FROM canon v LEFT JOIN canon f ON f.full AND f.canonical_url = v.canonical_url AND f.ts < v.ts WHERE NOT v.full),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'missing'
    WHEN digest <> f_digest OR (tag IS NOT NULL AND regexp_replace(tag, '^W/', '') <> f_tag) OR (tag IS NULL AND modified IS NOT NULL AND modified <> f_modified) THEN 'changed'
    WHEN tag IS NULL AND modified IS NULL AND digest IS NULL THEN 'unverified' ELSE 'resolved' END AS outcome
  FROM matched WHERE place = 1)
SELECT record_id, canonical_url, ts AS capture_ts, outcome, response_id,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN f_digest END AS payload_digest,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN f_len END AS payload_length,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN
    concat_ws(chr(10), 'age=' || age, 'cache-control=' || coalesce(cache, 'max-age=60'), 'content-length=' || f_len, 'content-type=text/html',
              'etag=' || coalesce(tag, f_tag), 'last-modified=' || coalesce(modified, f_modified)) END AS headers
FROM judged
"""

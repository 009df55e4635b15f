"""Resolution of not-modified revisit records in web archives.

A revisit record (HTTP 304) holds no body: it refers to an earlier full response of the same canonical URL.  Each
revisit is matched as of its time with the latest earlier full response, the validators are compared, and the stored
response's headers are updated with those that a 304 is permitted to replace.

The as-of join is made of windows, not of a range join: responses and revisits are laid out by (URL, time) in range
partitions, which also splits one URL over as many partitions as it needs; each part keeps its last response, the
parts of a URL pass theirs on, and inside a part a running ``last`` finds the response.  A URL that holds a third of
all records is spread like any other.  Bodies never move: only digests, sizes and headers do.

Defined results: a revisit without an earlier response is an ``orphan``; strictly earlier counts, so a response of the
same instant does not; among responses of one instant the greatest record_id wins.  Null url is canonical '' and null
time never matches.  An ETag is compared weakly; without one, Last-Modified is; with neither the match is
``unverified``.  Null headers are empty.  Repeated revisit rows are resolved each.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stage, table

#: Header fields that a 304 response must not replace in a stored response (fixed list, lower case).
FORBIDDEN = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that do not select content.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
#: Rows up to which the table of carried responses (one row per URL and part) is broadcast.
MAX_BROADCAST_ROWS = 200_000


def canonical_url(url: Column) -> Column:
    """Without scheme, www., default port, fragment, tracking parameters and trailing slash; host in lower case."""
    u = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"#.*$", "")
    rest = F.regexp_replace(u, r"^[A-Za-z]+://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(?:80|443)$", "")
    tail = F.regexp_replace(rest, r"^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(tail, r"^[^?]*", 0), r"/+$", "")
    query = F.regexp_replace(F.regexp_extract(tail, r"\?(.*)$", 1), rf"(?:^|&){TRACKING}=[^&]*", "")
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records``.

    records: record_id, url, ts, kind ('response' or 'revisit'), etag, last_modified, digest, n_bytes,
    headers map<string,string> (lower-case names).
    """
    rows = records.select(
        canonical_url(F.col("url")).alias("key"), F.col("ts"), F.coalesce(F.col("kind") == "response", F.lit(False)).cast("int").alias("full"), F.col("record_id"),
        F.struct("record_id", "ts", "etag", "last_modified", "digest", "n_bytes", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers")).alias("r"))
    # revisits before responses of the same instant: only strictly earlier responses are seen
    order = ["ts", "full", "record_id"]
    parts = stage(rows.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()), "timeline")
    response = F.when((F.col("full") == 1) & F.col("ts").isNotNull(), F.col("r"))
    last = parts.groupBy("key", "part").agg(F.max_by(response, F.when(response.isNotNull(), F.struct(*order))).alias("last"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).where(F.col("carried").isNotNull()).select("key", "part", "carried")
    carried = small(stage(carried, "carried"), MAX_BROADCAST_ROWS)
    within = Window.partitionBy("key", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = parts.withColumn("own", F.last(response, ignorenulls=True).over(within)).where("full = 0")
    found = seen.join(carried, ["key", "part"], "left").withColumn("m", F.when(F.col("ts").isNotNull(), F.coalesce("own", "carried")))
    m, r = F.col("m"), F.col("r")
    verdict = (
        F.when(m.isNull(), "orphan")
        .when(r["etag"].isNotNull() & m["etag"].isNotNull(), F.when(_weak(r["etag"]) == _weak(m["etag"]), "validated").otherwise("mismatch"))
        .when(r["last_modified"].isNotNull() & m["last_modified"].isNotNull(), F.when(r["last_modified"] == m["last_modified"], "validated").otherwise("mismatch"))
        .otherwise("unverified")
    )
    found = found.withColumn("verdict", verdict)
    permitted = F.map_filter(r["headers"], lambda k, v: ~k.isin(*FORBIDDEN))
    kept = F.map_filter(m["headers"], lambda k, v: ~F.map_contains_key(permitted, k))
    use = F.col("verdict").isin("validated", "unverified")
    return found.select(
        "record_id", F.col("key").alias("canonical_url"), "ts", "verdict",
        F.when(use, m["record_id"]).alias("refers_to"), F.when(use, m["ts"]).alias("refers_ts"), F.when(use, m["digest"]).alias("digest"),
        F.when(use, m["n_bytes"]).alias("n_bytes"), F.when(use, F.map_concat(kept, permitted)).alias("headers"))


def headers_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of the crawl that ``pages`` stands for: five visits of each page on its own days.

    Visit 0 and 2 are full responses (2 with new validators, of every third page), 1 and 3 are revisits under
    other spellings of the URL (one in five with a stale validator), 4 is a revisit from before the first response.
    """
    day = lambda n: F.make_interval(days=n)
    k = F.col("visit")
    p = F.col("page_id")
    t0 = F.timestamp_seconds(1577836800 + F.pmod(p * 7919, F.lit(365)) * 86400 + F.pmod(p * 104729, F.lit(86400)))
    v = pages.select("page_id", "url", F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"), F.length(F.coalesce(F.col("html"), F.lit(""))).cast("bigint").alias("n_bytes")).withColumn("visit", F.explode(F.array(*map(F.lit, range(5)))))
    v = v.where((k < 2) | ((k == 2) & (p % 3 == 0)) | (k == 3) | ((k == 4) & (p % 7 == 0)))
    days = F.when(k == 1, 7).when(k == 2, 14).when(k == 3, 21).when(k == 4, -900).otherwise(0)
    ts = t0 + day(days)
    full = k.isin(0, 2)
    version = F.when(k == 2, "b").when((k == 3) & (p % 3 == 0) & (p % 5 != 0), "b").when((k == 1) & (p % 5 == 0), "x").otherwise("a")
    etag = F.when(p % 11 != 0, F.concat(F.when(full, F.lit("")).otherwise("W/"), F.lit('"'), F.substring("digest", 1, 12), version, F.lit('"')))
    modified = F.when(p % 13 != 0, F.concat(F.lit("day-"), F.pmod(p, F.lit(30)).cast("string"), version))
    url = F.when(full, F.col("url")).when(k == 1, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))).otherwise(F.regexp_replace("url", "^https?", "HTTP"))
    common = [F.lit("date"), F.date_format(ts, "yyyy-MM-dd"), F.lit("server"), F.concat(F.lit("visit-"), k.cast("string"))]
    headers = F.when(full, F.create_map(*common, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("n_bytes").cast("string"), F.lit("x-first"), F.lit("kept"))).otherwise(F.create_map(*common, F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60")))
    return v.select(F.concat(p.cast("string"), F.lit("-"), k.cast("string")).alias("record_id"), url.alias("url"), ts.alias("ts"), F.when(full, "response").otherwise("revisit").alias("kind"), etag.alias("etag"), modified.alias("last_modified"), "digest", "n_bytes", headers.alias("headers"))


def op2_revisits(spark, sf_dir):
    out = resolve(captures(table(spark, sf_dir, "pages")))
    return out.select("record_id", "canonical_url", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "verdict", "refers_to", F.date_format("refers_ts", "yyyy-MM-dd HH:mm:ss").alias("refers_at"), "digest", "n_bytes", headers_text(F.col("headers")).alias("headers"))


SQL = {
    "op2_revisits": r"""
WITH v AS (SELECT page_id AS p, url, md5(coalesce(html, '')) AS digest, length(coalesce(html, ''))::BIGINT AS n_bytes, unnest([0, 1, 2, 3, 4]) AS k,
                  make_timestamp((1577836800 + (page_id * 7919) % 365 * 86400 + (page_id * 104729) % 86400) * 1000000) AS t0 FROM pages),
w AS (SELECT *, k IN (0, 2) AS full_, t0 + CASE k WHEN 1 THEN INTERVAL 7 DAY WHEN 2 THEN INTERVAL 14 DAY WHEN 3 THEN INTERVAL 21 DAY WHEN 4 THEN INTERVAL (-900) DAY ELSE INTERVAL 0 DAY END AS ts,
             CASE WHEN k = 2 THEN 'b' WHEN k = 3 AND p % 3 = 0 AND p % 5 <> 0 THEN 'b' WHEN k = 1 AND p % 5 = 0 THEN 'x' ELSE 'a' END AS version
      FROM v WHERE k < 2 OR (k = 2 AND p % 3 = 0) OR k = 3 OR (k = 4 AND p % 7 = 0)),
c AS (SELECT p || '-' || k AS record_id, ts, full_, digest, n_bytes, k,
             CASE WHEN p % 11 <> 0 THEN '"' || substr(digest, 1, 12) || version || '"' END AS etag,
             CASE WHEN p % 13 <> 0 THEN 'day-' || (p % 30) || version END AS lm,
             regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', ''), '^[A-Za-z]+://', '') AS rest FROM w),
h AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(?:80|443)$', '') AS host,
             regexp_replace(regexp_extract(regexp_replace(rest, '^[^/?]*', ''), '^[^?]*'), '/+$', '') AS path,
             array_to_string(list_sort(list_filter(string_split(regexp_replace(regexp_extract(regexp_replace(rest, '^[^/?]*', ''), '\?(.*)$', 1), '(?:^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '&'), lambda x: x <> '')), '&') AS q FROM c),
r AS (SELECT *, CASE WHEN q = '' THEN host || path ELSE host || path || '?' || q END AS key FROM h),
m AS (SELECT a.*, b.record_id AS b_id, b.ts AS b_ts, b.etag AS b_etag, b.lm AS b_lm, b.digest AS b_digest, b.n_bytes AS b_bytes
      FROM (SELECT * FROM r WHERE NOT full_) a ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, ts ORDER BY record_id DESC) AS rn FROM r WHERE full_) WHERE rn = 1) b
      ON a.key = b.key AND a.ts > b.ts),
j AS (SELECT *, CASE WHEN b_id IS NULL THEN 'orphan' WHEN etag IS NOT NULL AND b_etag IS NOT NULL THEN CASE WHEN etag = b_etag THEN 'validated' ELSE 'mismatch' END
             WHEN lm IS NOT NULL AND b_lm IS NOT NULL THEN CASE WHEN lm = b_lm THEN 'validated' ELSE 'mismatch' END ELSE 'unverified' END AS verdict FROM m)
SELECT record_id, key AS canonical_url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, verdict,
       CASE WHEN verdict IN ('validated', 'unverified') THEN b_id END AS refers_to,
       CASE WHEN verdict IN ('validated', 'unverified') THEN strftime(b_ts, '%Y-%m-%d %H:%M:%S') END AS refers_at,
       CASE WHEN verdict IN ('validated', 'unverified') THEN b_digest END AS digest,
       CASE WHEN verdict IN ('validated', 'unverified') THEN b_bytes END AS n_bytes,
       CASE WHEN verdict IN ('validated', 'unverified') THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || b_bytes || chr(10) || 'content-type: text/html' || chr(10) ||
            'date: ' || strftime(ts, '%Y-%m-%d') || chr(10) || 'server: visit-' || k || chr(10) || 'x-first: kept' END AS headers
FROM j""",
}
QUERIES = {"op2_revisits": op2_revisits}

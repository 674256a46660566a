"""Not-modified records of a web archive, resolved by an as-of join.

A revisit (status 304) takes its content from the latest earlier full response of
the same canonical address. Its validators must agree with that response, and of
its headers only those that a not-modified answer may change replace stored ones.

The as-of join is a running maximum of (time, record). An address can hold a third
of all records, so it runs within (address, stretch of time) and the maxima of
earlier stretches, one row per stretch, are carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.shared import staged

#: Headers that a not-modified answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not tell pages apart.
TRACKING = r"(?:utm_[a-z]+|ref|sessionid|fbclid)=[^&]*"
#: Seconds per stretch of time.
STRETCH = 86_400


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., user and default port, path without end slash, query without tracking; no scheme, no fragment."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, f"(^|&){TRACKING}", ""), "^&", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolve_revisits(records: DataFrame, stretch: int = STRETCH, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """A row per revisit: (rec_id, address, ts, verdict, ref_id, ref_ts, headers).

    ``records`` has rec_id, url, ts (long, seconds), status, etag, last_modified, digest and headers, a map of lower-case
    names. verdict: ``resolved``; ``changed`` if a validator both sides have differs (etags compared weakly, then last_modified,
    then digest; the first that both have decides); ``unverified`` if they share none; ``missing`` if there is no earlier full response
    (status 200) or the url or ts is null. headers: of a resolved or unverified revisit the stored ones with permitted updates, else
    its own. Ties: of responses at one time the largest rec_id counts; a response at the revisit's own time is not earlier.
    Rows with a null rec_id are no responses; as revisits they are returned. Repeated rows: every revisit row gives one row; of full
    responses with equal rec_id, address and ts the one that sorts first by validators and headers counts. Further columns are ignored.
    """
    rows = records.select("rec_id", canonical_url(F.col("url")).alias("address"), "ts", "status", "etag", "last_modified", "digest", "headers")
    full = (F.col("status") == 200) & F.col("rec_id").isNotNull()
    known = F.col("address").isNotNull() & F.col("ts").isNotNull()
    # a revisit carries its own validators and headers along, so rows need no key to be told apart
    mine = ("etag", "last_modified", "digest", "headers")
    events = rows.where(known & (full | (F.col("status") == 304))).select(
        "rec_id", "address", "ts", F.floor(F.col("ts") / stretch).alias("part"), (F.col("status") == 304).alias("revisit"),
        F.when(full, F.struct("ts", "rec_id")).alias("r"), *[F.when(F.col("status") == 304, F.col(c)).alias(c) for c in mine])
    earlier = Window.partitionBy("address", "part").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    within = events.withColumn("near", F.max("r").over(earlier)).where("revisit")
    ends = events.where("r IS NOT NULL").groupBy("address", "part").agg(F.max("r").alias("r"))
    parts = ends.unionByName(within.select("address", "part", F.lit(None).cast(ends.schema["r"].dataType).alias("r")).distinct()) \
        .groupBy("address", "part").agg(F.max("r").alias("r"))
    before = Window.partitionBy("address").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("address", "part", F.max("r").over(before).alias("far"))
    found = within.join(carried, ["address", "part"], "left").select("rec_id", "address", "ts", F.coalesce("near", "far").alias("r"), *mine)
    lost = rows.where((F.col("status") == 304) & ~known).select("rec_id", "address", "ts", F.lit(None).cast(found.schema["r"].dataType).alias("r"), *mine)

    responses = rows.where(full & known).groupBy(F.col("rec_id").alias("ref_id"), "address", F.col("ts").alias("ref_ts"))
    entries = F.array_sort(F.map_entries("headers"))
    ref = responses.agg(F.min(F.struct("etag", "last_modified", "digest", entries.alias("entries"))).alias("full")).select(
        "ref_id", "address", "ref_ts", F.col("full.etag").alias("etag0"), F.col("full.last_modified").alias("modified0"),
        F.col("full.digest").alias("digest0"), F.map_from_entries("full.entries").alias("headers0"))
    # kept as a stage, so that the join may split a response that very many revisits name
    out = found.unionByName(lost).select("rec_id", "address", "ts", F.col("r.rec_id").alias("ref_id"), F.col("r.ts").alias("ref_ts"), *mine)
    out = out.join(staged(ref, "responses"), ["ref_id", "address", "ref_ts"], "left")

    weak = lambda c: F.regexp_replace(c, "^W/", "")
    agree = F.coalesce(weak(F.col("etag")) == weak(F.col("etag0")), F.col("last_modified") == F.col("modified0"), F.col("digest") == F.col("digest0"))
    verdict = F.when(F.col("ref_id").isNull(), "missing").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("changed")
    new, stored = F.coalesce("headers", F.create_map().cast("map<string,string>")), F.coalesce("headers0", F.create_map().cast("map<string,string>"))
    updates = F.map_filter(new, lambda k, v: k.isin(*permitted))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(updates, k)), updates)
    return out.select("rec_id", "address", "ts", verdict.alias("verdict"), "ref_id", "ref_ts",
                      F.when(verdict.isin("resolved", "unverified"), merged).otherwise(new).alias("headers"))


def archive_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records derived from the sample pages: pages of one host and language are captures of one resource.

    The page number is the time; two of three captures are not-modified answers. Validators come from the page's own
    start (which its language decides), so some agree with the earlier capture and some do not.
    """
    head, n = F.md5(F.substring("html", 1, 60)), F.col("page_id")
    etag = F.when(n % 5 == 0, None).when(n % 2 == 0, F.concat(F.lit("W/"), head)).otherwise(head)
    modified = F.when(n % 4 == 0, None).otherwise(F.concat(F.lit("day "), F.floor(n / 1000).cast("string")))
    return pages.where("page_id IS NOT NULL").select(
        n.alias("rec_id"), F.regexp_replace("url", "/[0-9]+", "").alias("url"), (n * 600).alias("ts"),
        F.when(n % 3 == 0, 200).otherwise(304).alias("status"), etag.alias("etag"), modified.alias("last_modified"), F.md5("html").alias("digest"),
        F.map_filter(F.create_map(F.lit("date"), (n * 600).cast("string"), F.lit("etag"), etag, F.lit("content-length"), F.length("html").cast("string"),
                                  F.lit("server"), F.regexp_extract("url", "^([a-z]+):", 1)), lambda k, v: v.isNotNull()).alias("headers"))


def resolved_pages(pages: DataFrame) -> DataFrame:
    """The revisits of the pages' archive, with merged headers as sorted text."""
    found = resolve_revisits(archive_of_pages(pages))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.select("rec_id", "address", "ts", "verdict", "ref_id", "ref_ts", text.alias("headers"))


RESOLVED_SQL = r"""
WITH rec AS (
  SELECT page_id AS rec_id, regexp_replace(url, '/[0-9]+', '', 'g') AS url, page_id * 600 AS ts,
         CASE WHEN page_id % 3 = 0 THEN 200 ELSE 304 END AS status,
         CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 2 = 0 THEN 'W/' || md5(substr(html, 1, 60)) ELSE md5(substr(html, 1, 60)) END AS etag,
         CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'day ' || CAST(page_id // 1000 AS VARCHAR) END AS modified,
         md5(html) AS digest, CAST(length(html) AS VARCHAR) AS bytes, regexp_extract(url, '^([a-z]+):', 1) AS server
  FROM pages WHERE page_id IS NOT NULL),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
         regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '(^|&)(?:utm_[a-z]+|ref|sessionid|fbclid)=[^&]*', '', 'g'), '^&', '') AS query
  FROM rec),
named AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS address FROM parts),
latest AS (
  SELECT r.*, max(s.ts) AS ref_ts FROM named r LEFT JOIN named s ON s.address = r.address AND s.status = 200 AND s.ts < r.ts
  WHERE r.status = 304 GROUP BY ALL),
paired AS (
  SELECT l.*, s.rec_id AS ref_id, s.etag AS etag0, s.modified AS modified0, s.digest AS digest0, s.bytes AS bytes0, s.server AS server0, s.ts AS ts0,
         coalesce(regexp_replace(l.etag, '^W/', '') = regexp_replace(s.etag, '^W/', ''), l.modified = s.modified, l.digest = s.digest) AS agree
  FROM latest l LEFT JOIN named s ON s.address = l.address AND s.status = 200 AND s.ts = l.ref_ts),
judged AS (SELECT *, CASE WHEN ref_id IS NULL THEN 'missing' WHEN agree IS NULL THEN 'unverified' WHEN agree THEN 'resolved' ELSE 'changed' END AS verdict FROM paired)
SELECT rec_id, address, ts, verdict, ref_id, ref_ts,
       CASE WHEN verdict IN ('resolved', 'unverified')
            THEN 'content-length: ' || bytes0 || chr(10) || 'date: ' || ts || CASE WHEN coalesce(etag, etag0) IS NULL THEN '' ELSE chr(10) || 'etag: ' || coalesce(etag, etag0) END || chr(10) || 'server: ' || server0
            ELSE 'content-length: ' || bytes || chr(10) || 'date: ' || ts || CASE WHEN etag IS NULL THEN '' ELSE chr(10) || 'etag: ' || etag END || chr(10) || 'server: ' || server END AS headers
FROM judged
"""

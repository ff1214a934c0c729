"""Not-modified revisits resolved to the response they stand for.

A revisit is joined as of its time to the latest earlier full response of its
canonical URL; if their validators agree, the response's headers are updated by
those that a 304 may change. Windows run over (URL, time slice), and the last
response of each slice is carried to later slices, so a URL with very many
captures is spread over tasks. Only keys and times take part in the windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICE_ROWS = 200_000
HOT_ROWS = 100_000  # revisits of one response that one task takes, about

# Header fields that a 304 does not change in a stored response
# (RFC 9111 section 3.2 and the hop-by-hop fields of RFC 9110 section 7.6.1).
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection",
    "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Lower-case host without www and default port, path without closing slash, sorted query without utm_*.

    Scheme and fragment are dropped. A null or unreadable URL gives null.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z]+://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "(:80|:443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z]+://[^/?]*([^?]*)", 1), "/+$", "")
    pairs = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    pairs = F.array_sort(F.filter(pairs, lambda p: (p != "") & ~p.startswith("utm_")))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, query))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then clash the last in order stays."""
    pairs = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda e: e["key"] == n), -1))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def merged_headers(stored: Column, update: Column) -> Column:
    """``stored`` updated by the fields of ``update`` that a 304 may change."""
    allowed = F.map_filter(_lowered(update), lambda k, v: ~k.isin(*NOT_MERGED))
    kept = F.map_filter(_lowered(stored), lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def _etag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per revisit of ``records``, with the response it resolves to.

    ``records``: record_id, url, captured_at (long), kind ("response" or
    "revisit"), status, etag, last_modified, digest, headers (map). Result:
    record_id, canonical_url, captured_at, refers_to, outcome, headers, digest.

    A full response has kind "response" and status 200. Earlier means a smaller
    captured_at; of responses at one time the largest record_id counts. The
    validators that the revisit carries are checked in the order etag (weakly),
    last_modified, digest, and the first one decides. ``outcome`` is "etag",
    "last-modified", "digest", "mismatch", "no-validator", "no-response" or
    "no-url"; ``refers_to``, headers and digest are null unless the first three.
    Records without a time are never earlier and find nothing earlier. Repeated
    revisit rows give repeated results; other columns are ignored.
    """
    known = records.withColumn("_url", canonical_url(F.col("url")))
    revisit = known.filter(F.col("kind") == "revisit").select(
        "record_id", F.col("_url").alias("canonical_url"), "captured_at", "etag", "last_modified", "digest", "headers"
    )
    full = known.filter((F.col("kind") == "response") & (F.col("status") == 200))
    reach = known.agg(F.count("*").alias("rows"), F.min("captured_at").alias("low"), F.max("captured_at").alias("high")).first()
    slices = max(1, -(-reach.rows // slice_rows))
    low = reach.low or 0
    width = max(1, -(-((reach.high or 0) - low + 1) // slices))
    part = ((F.col("captured_at") - F.lit(low)) / F.lit(width)).cast("long")
    timed = F.col("_url").isNotNull() & F.col("captured_at").isNotNull()
    marks = (
        full.filter(timed).select("_url", "captured_at", F.struct("captured_at", "record_id").alias("seen"))
        .union(known.filter((F.col("kind") == "revisit") & timed).select("_url", "captured_at", F.lit(None).alias("seen")).distinct())
        .withColumn("_part", part)
    )
    inside = Window.partitionBy("_url", "_part").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_url").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.groupBy("_url", "_part").agg(F.max("seen").alias("last")).select("_url", "_part", F.max("last").over(earlier).alias("carried"))
    found = (
        marks.withColumn("near", F.max("seen").over(inside))
        .filter(F.col("seen").isNull())
        .join(carried, ["_url", "_part"])
        .select(F.col("_url").alias("canonical_url"), "captured_at", F.coalesce("near", "carried")["record_id"].alias("at"))
    )
    stored = full.dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("at"),
        F.col("etag").alias("s_etag"),
        F.col("last_modified").alias("s_modified"),
        F.col("digest").alias("s_digest"),
        F.col("headers").alias("s_headers"),
    )
    joined = revisit.join(found, ["canonical_url", "captured_at"], "left")
    # Revisits of a popular response are dealt to several copies of it; those without a response to all tasks.
    popular = joined.groupBy("at").agg(F.ceil(F.count("*") / F.lit(hot_rows)).alias("copies")).filter(F.col("at").isNotNull() & (F.col("copies") > 1))
    copied = stored.join(popular, "at", "left").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    dealt = joined.join(popular, "at", "left").withColumn("deal", F.pmod(F.xxhash64("record_id", "captured_at"), F.when(F.col("at").isNull(), F.lit(1 << 16)).otherwise(F.coalesce("copies", F.lit(1)))))
    joined = dealt.join(copied, ["at", "deal"], "left")

    def agrees(ours: Column, theirs: Column, name: str) -> Column:
        return F.when(F.coalesce(ours == theirs, F.lit(False)), name).otherwise("mismatch")

    outcome = (
        F.when(F.col("canonical_url").isNull(), "no-url")
        .when(F.col("at").isNull(), "no-response")
        .when(F.col("etag").isNotNull(), agrees(_etag(F.col("etag")), _etag(F.col("s_etag")), "etag"))
        .when(F.col("last_modified").isNotNull(), agrees(F.col("last_modified"), F.col("s_modified"), "last-modified"))
        .when(F.col("digest").isNotNull(), agrees(F.col("digest"), F.col("s_digest"), "digest"))
        .otherwise("no-validator")
    )
    good = F.col("outcome").isin("etag", "last-modified", "digest")
    return joined.withColumn("outcome", outcome).select(
        "record_id",
        "canonical_url",
        "captured_at",
        F.when(good, F.col("at")).alias("refers_to"),
        "outcome",
        F.when(good, merged_headers(F.col("s_headers"), F.col("headers"))).alias("headers"),
        F.when(good, F.col("s_digest")).alias("digest"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A capture history for ``pages`` (page_id, url, html), which holds responses alone.

    Every page is fetched once, every third again with changed content, and each
    is revisited under another spelling of its URL; some revisits carry a wrong
    tag, only a date, or come before the first fetch.
    """
    n = F.col("page_id")
    tag = F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16)
    spelled = F.concat(F.regexp_replace("url", "^http[s]?://", "HTTPS://"), F.when(F.col("url").contains("#"), "").otherwise("#again"))

    def record(at: Column, kind: str, etag: Column, modified: Column, digest: Column, url: Column, kept: Column):
        shared = [F.lit("Date"), F.concat(F.lit("t"), at.cast("string")), F.lit("ETag"), etag, F.lit("Last-Modified"), modified]
        own = (
            [F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")]
            if kind == "response"
            else [F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-length"), F.lit("0"), F.lit("Connection"), F.lit("close"), F.lit("X-Cache"), F.lit("HIT")]
        )
        return F.when(
            kept,
            F.struct(
                at.alias("captured_at"),
                F.lit(kind).alias("kind"),
                F.lit(200 if kind == "response" else 304).alias("status"),
                etag.alias("etag"),
                modified.alias("last_modified"),
                digest.alias("digest"),
                url.alias("url"),
                F.map_filter(F.create_map(*own, *shared), lambda k, v: v.isNotNull()).alias("headers"),
            ),
        )

    first, second = F.concat(F.lit('"'), tag, F.lit('"')), F.concat(F.lit('"'), tag, F.lit('-2"'))
    modified = F.concat(F.lit("d"), (n % 28).cast("string"))
    seen = F.when(n % 3 == 0, second).otherwise(first)
    none = F.lit(None).cast("string")
    asked = F.when(n % 5 == 0, F.lit('"other"')).when(n % 7 == 0, none).otherwise(F.concat(F.lit("W/"), seen))
    rows = F.array(
        record(n * 10, "response", first, modified, tag, F.col("url"), F.lit(True)),
        record(n * 10 + 4, "response", second, modified, F.concat(tag, F.lit("-2")), F.col("url"), n % 3 == 0),
        record(n * 10 + 6, "revisit", asked, F.when(n % 2 == 0, modified), F.when(n % 3 == 0, F.concat(tag, F.lit("-2"))).otherwise(tag), spelled, F.lit(True)),
        record(n * 10 - 5, "revisit", first, modified, tag, spelled, n % 11 == 0),
    )
    each = pages.select("page_id", F.posexplode(rows).alias("k", "r")).filter(F.col("r").isNotNull())
    return each.select((n * 4 + F.col("k")).alias("record_id"), "r.*")


CAPTURES_SQL = r"""
base AS (SELECT page_id AS n, url, substr(md5(coalesce(html, '')), 1, 16) AS tag, strlen(coalesce(html, '')) AS size,
  regexp_replace(url, '^http[s]?://', 'HTTPS://') || CASE WHEN contains(url, '#') THEN '' ELSE '#again' END AS spelled,
  'd' || (page_id % 28) AS modified FROM pages),
rec AS (
  SELECT n * 4 AS record_id, n * 10 AS t, 'response' AS kind, '"' || tag || '"' AS etag, modified, tag AS digest, url, size FROM base
  UNION ALL SELECT n * 4 + 1, n * 10 + 4, 'response', '"' || tag || '-2"', modified, tag || '-2', url, size FROM base WHERE n % 3 = 0
  UNION ALL SELECT n * 4 + 2, n * 10 + 6, 'revisit',
    CASE WHEN n % 5 = 0 THEN '"other"' WHEN n % 7 = 0 THEN NULL ELSE 'W/"' || tag || CASE WHEN n % 3 = 0 THEN '-2"' ELSE '"' END END,
    CASE WHEN n % 2 = 0 THEN modified END, CASE WHEN n % 3 = 0 THEN tag || '-2' ELSE tag END, spelled, size FROM base
  UNION ALL SELECT n * 4 + 3, n * 10 - 5, 'revisit', '"' || tag || '"', modified, tag, spelled, size FROM base WHERE n % 11 = 0),
bare AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS b FROM rec),
canon AS (SELECT *,
  regexp_replace(regexp_replace(lower(regexp_extract(b, '^[A-Za-z]+://([^/?]*)', 1)), '(:80|:443)$', ''), '^www[0-9]*\.', '')
  || regexp_replace(regexp_extract(b, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS place,
  list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS q FROM bare),
keyed AS (SELECT *, place || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS u FROM canon),
latest AS (SELECT u, t, max(record_id) AS record_id FROM keyed WHERE kind = 'response' GROUP BY u, t),
found AS (SELECT r.*, s.record_id AS hit FROM (SELECT * FROM keyed WHERE kind = 'revisit') r ASOF LEFT JOIN latest s ON r.u = s.u AND r.t > s.t),
checked AS (SELECT f.*, s.etag AS s_etag, s.modified AS s_modified, s.digest AS s_digest, s.size AS s_size,
  CASE WHEN f.hit IS NULL THEN 'no-response'
       WHEN f.etag IS NOT NULL THEN CASE WHEN regexp_replace(f.etag, '^W/', '') = s.etag THEN 'etag' ELSE 'mismatch' END
       WHEN f.modified IS NOT NULL THEN CASE WHEN f.modified = s.modified THEN 'last-modified' ELSE 'mismatch' END
       WHEN f.digest = s.digest THEN 'digest' ELSE 'mismatch' END AS outcome
  FROM found f LEFT JOIN keyed s ON s.record_id = f.hit)
"""

REVISITS_SQL = f"""WITH {CAPTURES_SQL}
SELECT record_id, u AS canonical_url, t AS captured_at, CASE WHEN ok THEN hit END AS refers_to, outcome,
  CASE WHEN ok THEN 'cache-control=max-age=600; content-length=' || s_size || '; content-type=text/html; date=t' || t || '; etag=' || coalesce(etag, s_etag)
    || '; last-modified=' || coalesce(modified, s_modified) || '; x-cache=HIT' END AS headers,
  CASE WHEN ok THEN s_digest END AS digest
FROM (SELECT *, outcome IN ('etag', 'last-modified', 'digest') AS ok FROM checked)
"""

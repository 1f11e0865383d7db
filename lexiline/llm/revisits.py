"""Not-modified revisits of a web archive, resolved to the response they stand for.

A record is a capture: record_id, record_type (`response` or `revisit`), url, fetched_at (any orderable type), status,
truncated, headers (array of structs of name and value) and payload_digest. For each revisit, an as-of join on the canonical URL
finds the latest full response (type `response`, status 200, not truncated) fetched before it, and its validators
are checked:

* entity tags, compared weakly, where both records have one; else the dates of last modification, where both have one;
* payload digests, where both have one.

`resolved`: found and nothing disagrees, with at least one agreement; `unverified`: found, but there is nothing to compare;
`changed`: found, but a validator disagrees; `orphan`: there is no earlier full response. Headers of a resolved or
unverified revisit are those of the response, replaced by those that the not-modified answer may update: all but the
fields in `KEPT`, which describe the stored payload or a connection.

The as-of join sorts all records by canonical URL and time into ranges, so a URL with many captures is split over
tasks; each range hands its last full response per URL on. Bodies are not moved: `response_id` names the record that holds
the payload.

Cases: a revisit without a URL or a time is an orphan; responses without a time are never found; of responses at the
same time the largest record_id counts; a response at the very time of a revisit is not earlier; repeated records are
resolved alike and all kept; null headers count as none and the last of repeated names counts; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiline.llm.common import shuffle_partitions, stored

KEPT = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection",
    "te", "trailer", "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-md5", "content-range",
    "content-type",
)
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "sessionid", "phpsessionid", "ref")


def canonical_url(url: Column) -> Column:
    """Scheme, `www.`, default port, fragment, tracking parameters and a last slash dropped; host in lower case;
    parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    given = F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*TRACKING)))
    query = F.array_join(kept, "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def header(headers: Column, name: str) -> Column:
    """Value of the last header of that name, trimmed; null without one."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)["value"]))


def entity_tag(headers: Column) -> Column:
    """The entity tag without the mark of a weak one."""
    return F.regexp_replace(header(headers, "etag"), "^W/", "")


def merged(stored_headers: Column, fresh: Column) -> Column:
    """Headers of the stored response after an update by those of a not-modified answer."""
    allowed = F.filter(fresh, lambda h: h["name"].isNotNull() & ~F.lower(h["name"]).isin(*KEPT))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(stored_headers, lambda h: h["name"].isNotNull() & ~F.array_contains(names, F.lower(h["name"]))), allowed)


def resolve(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """(record_id, url_key, fetched_at, outcome, response_id, response_at, headers, payload_digest) of every revisit."""
    ranges = ranges or shuffle_partitions(records.sparkSession)
    none = F.array().cast(records.schema["headers"].dataType)
    headers = F.coalesce("headers", none)
    full = (F.col("record_type") == "response") & (F.col("status") == 200) & F.coalesce(F.col("truncated"), F.lit("")).isin("") & F.col("fetched_at").isNotNull()
    kept = records.select(
        "record_id",
        canonical_url(F.col("url")).alias("url_key"),
        "fetched_at",
        F.when(F.col("record_type") == "revisit", 0).when(full, 1).alias("kind"),  # a revisit stands before responses of its time
        headers.alias("headers"),
        "payload_digest",
    ).filter("kind is not null and (kind = 0 or url_key is not null)")
    rows = stored(kept.repartitionByRange(ranges, "url_key", "fetched_at", "kind", "record_id").withColumn("part", F.spark_partition_id()))
    response = F.when(F.col("kind") == 1, F.struct("record_id", "fetched_at", "headers", "payload_digest"))
    earlier = Window.partitionBy("part", "url_key").orderBy("fetched_at", "kind", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("near", F.last(response, ignorenulls=True).over(earlier))
    # One row for each URL and range; only a URL that fills several ranges has more than one.
    last = rows.filter("kind = 1").groupBy("url_key", "part").agg(F.max_by(F.struct("record_id", "fetched_at", "headers", "payload_digest"), F.struct("fetched_at", "record_id")).alias("last"))
    spans = rows.groupBy("url_key", "part").agg(F.lit(1).alias("x")).join(last, ["url_key", "part"], "left")
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("url_key", "part", F.last("last", ignorenulls=True).over(before).alias("far")).filter("far is not null")
    found = inside.filter("kind = 0").join(carried, ["url_key", "part"], "left")
    found = found.withColumn("hit", F.when(F.col("fetched_at").isNotNull(), F.coalesce("near", "far")))
    tags = (entity_tag(F.col("headers")), entity_tag(F.col("hit.headers")))
    dates = (header(F.col("headers"), "last-modified"), header(F.col("hit.headers"), "last-modified"))
    same = F.coalesce(tags[0] == tags[1], dates[0] == dates[1])
    whole = F.col("payload_digest") == F.col("hit.payload_digest")
    agreed = F.coalesce(same, F.lit(True)) & F.coalesce(whole, F.lit(True))
    outcome = (
        F.when(F.col("hit").isNull(), "orphan").when(~agreed, "changed").when(same.isNull() & whole.isNull(), "unverified").otherwise("resolved")
    )
    usable = F.col("outcome").isin("resolved", "unverified")
    return found.withColumn("outcome", outcome).select(
        "record_id",
        "url_key",
        "fetched_at",
        "outcome",
        F.col("hit.record_id").alias("response_id"),
        F.col("hit.fetched_at").alias("response_at"),
        F.when(usable, merged(F.col("hit.headers"), F.col("headers"))).alias("headers"),
        F.when(usable, F.coalesce("hit.payload_digest", "payload_digest")).alias("payload_digest"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records derived from raw pages: each page is fetched and asked for again later, as a crawler would.

    Of every page: a response, a not-modified answer one day later, one more after two days that claims another
    entity tag for each seventh page, and for each fifth page a truncated response in between. Pages under one canonical
    URL are captures of one resource.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    base = pages.select("page_id", "url", digest.alias("digest"), (F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % 1000 * 100 + F.col("page_id") % 100).alias("t"))
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 8), F.lit('"'))
    record = lambda k, kind, at, status, cut, hs, dg: F.struct(
        (F.col("page_id") * 4 + k).alias("record_id"), F.lit(kind).alias("record_type"), (F.col("t") + at).alias("fetched_at"), F.lit(status).alias("status"),
        F.lit(cut).cast("string").alias("truncated"), F.array(*hs).alias("headers"), dg.alias("payload_digest"),
    )
    other = F.when(F.col("page_id") % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    records = F.array(
        record(0, "response", 0, 200, None, [pair("Content-Type", F.lit("text/html")), pair("ETag", tag), pair("Date", F.col("t").cast("string"))], F.col("digest")),
        record(1, "revisit", 100_000, 304, None, [pair("ETag", F.concat(F.lit("W/"), tag)), pair("Date", (F.col("t") + 100_000).cast("string")), pair("Content-Length", F.lit("0"))], F.lit(None).cast("string")),
        record(2, "revisit", 200_000, 304, None, [pair("etag", other), pair("Cache-Control", F.lit("max-age=60"))], F.lit(None).cast("string")),
        record(3, "response", 150_000, 200, "length", [pair("ETag", F.lit('"cut"'))], F.lit(None).cast("string")),
    )
    wanted = F.filter(records, lambda r: r["truncated"].isNull() | (r["record_id"] % 20 == 3))
    return base.select("url", F.explode(wanted).alias("r")).select("url", "r.*")

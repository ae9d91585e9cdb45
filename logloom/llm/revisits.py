"""WARC: resolves not-modified revisits to the latest earlier full response of their canonical URL.

Captures are rows (record_id, url, ts, kind, status, headers, digest): kind is `response` or `revisit`. A
revisit is joined as of its time with the latest strictly earlier full response (kind response, status 200) of the same
canonical URL (ties in time: the larger record id). Its validators are held against the response's: the
payload digest if both have one, else the entity tag (weak comparison), else the modification date.
If they agree, the revisit takes the response's headers, replaced by its own where a not-modified
response may do so; headers that describe the stored body or one connection never are.

The as-of join is a running maximum over (URL, time bucket), seeded, in buckets that ask, by a running maximum over the
buckets' last responses: a URL with a third of all captures is spread over the buckets, whose number follows that of the captures, and what is gathered
per URL is at most two rows a bucket. Captures of one URL at one time share a bucket.

Defined cases: a revisit without an earlier response is `unmatched`; one whose validators differ is
`mismatch`, one that shares no kind of validator with the response is `unverified`; neither takes headers. Null or empty URLs match
nothing; a null time matches nothing; repeated rows are resolved as often as they come; an empty table gives no rows; extra
columns are ignored; null headers count as none, names are compared in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Captures of a time bucket, about, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 500_000, 512
#: Headers that a not-modified response never replaces.
STORED_ONLY = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that don't change what a URL shows.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without final slashes, query without tracking parameters
    in order; scheme, user and fragment are dropped. Null if there is no host."""
    bare = F.regexp_replace(F.btrim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?:]+)", 1))  # in brackets: an IPv6 address
    port = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?(?:\[[0-9A-Fa-f:.]+\]|[^/?:]+):([0-9]+)", 1)
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]+([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    out = F.concat(F.regexp_replace(host, r"^www[0-9]*\.", ""), F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), F.regexp_replace(path, r"/+$", ""), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(host != "", out)


def _lower_names(headers: Column) -> Column:
    """A later entry of a name (in order of the names as written) wins."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], r"^W/", "")


def _match(own: Column, past: Column) -> Column:
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    own_tag, past_tag = _tag(own["headers"]), _tag(past["headers"])
    own_date, past_date = own["headers"]["last-modified"], past["headers"]["last-modified"]
    same = F.when(both(own["digest"], past["digest"]), own["digest"] == past["digest"]).when(both(own_tag, past_tag), own_tag == past_tag).when(both(own_date, past_date), own_date == past_date)
    return F.when(past.isNull(), "unmatched").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")


def _bounds(captures: DataFrame, buckets: int | None) -> list[int]:
    buckets = buckets or int(min(MOST_BUCKETS, max(16, captures.count() // BUCKET_ROWS)))
    found = captures.agg(F.percentile_approx("ts", [i / buckets for i in range(1, buckets)], 10_000).alias("q")).first()
    return sorted(set(found.q or []))


def resolve_revisits(captures: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per revisit: record_id, canonical_url, ts, outcome, response_id, response_ts, status and the merged headers."""
    src = captures.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), "kind", "status", _lower_names(F.col("headers")).alias("headers"), "digest")
    cuts = _bounds(captures.select(F.col("ts").cast("long").alias("ts")), buckets)
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("ts"))) if cuts else F.lit(0)
    known = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    src = src.withColumn("bucket", bucket)
    full = F.when(known & (F.col("kind") == "response") & (F.col("status") == 200), F.struct("record_id", "ts", "status", "headers", "digest"))
    marked = src.where(known).withColumns({"full": full, "order": F.when(full.isNotNull(), F.struct("ts", "record_id"))})
    last = marked.where("full is not null").groupBy("canonical_url", "bucket").agg(F.max_by("full", "order").alias("full"), F.max("order").alias("order"))
    # what a bucket that asks starts with: the running maximum of the buckets before it
    asked = marked.where("kind = 'revisit'").groupBy("canonical_url", "bucket").agg(F.lit(True).alias("asked"))
    steps = last.withColumn("asked", F.lit(None).cast("boolean")).unionByName(asked, allowMissingColumns=True)
    before = Window.partitionBy("canonical_url").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    seeds = steps.withColumn("carried", F.max_by("full", "order").over(before)).where("asked and carried is not null").select("canonical_url", "bucket", "carried")
    inside = Window.partitionBy("canonical_url", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    here = marked.withColumn("here", F.max_by("full", "order").over(inside)).where("kind = 'revisit'")
    matched = here.join(seeds, ["canonical_url", "bucket"], "left").withColumn("past", F.coalesce("here", "carried"))
    lost = src.where(~known & (F.col("kind") == "revisit")).withColumn("past", F.lit(None).cast(matched.schema["past"].dataType))
    cols = ["record_id", "canonical_url", "ts", "headers", "digest", "past"]
    out = matched.select(*cols).unionByName(lost.select(*cols))
    outcome = _match(F.struct("headers", "digest"), F.col("past"))
    allowed = F.map_filter("headers", lambda k, v: ~k.isin(*STORED_ONLY))
    stored = F.map_filter(F.col("past")["headers"], lambda k, v: ~F.map_contains_key(allowed, k))
    out = out.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return out.select("record_id", "canonical_url", "ts", "outcome", *[F.when(good, F.col("past")[a]).alias(b) for a, b in (("record_id", "response_id"), ("ts", "response_ts"), ("status", "status"))], F.when(good, F.map_concat(stored, allowed)).alias("headers"))


def header_lines(headers: Column) -> Column:
    """"name: value" of each header in order of names, comma-joined; null stays null."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ",")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of the table of pages: page n is a full response at time 10 n, and is asked for again once 500 pages later; the
    server answers that nothing changed, with the entity tag and date of the page and fresh headers of its own."""
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    date = F.concat(F.lit("day "), F.col("page_id") % 97)
    base = lambda *more: F.create_map(*[x for k, v in (("ETag", tag), ("Last-Modified", date), *more) for x in (F.lit(k), v)])
    first = pages.select((2 * F.col("page_id")).alias("record_id"), "url", (10 * F.col("page_id")).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), base(("Content-Type", F.lit("text/html")), ("Content-Length", F.length("html").cast("string")), ("Date", F.lit("then"))).alias("headers"), F.lit(None).cast("string").alias("digest"))
    again = pages.select((2 * F.col("page_id") + 1).alias("record_id"), "url", (10 * F.col("page_id") + 5005).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), base(("Content-Length", F.lit("0")), ("Date", F.lit("now"))).alias("headers"), F.lit(None).cast("string").alias("digest"))
    return first.unionByName(again)

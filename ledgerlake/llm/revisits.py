"""WARC revisits that say "not modified": the response they stand for, and its headers now."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.llm.common import durable

DIGIT = 10  # bits of a time that one window sees
# Headers of a 304 answer that replace those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical(url: Column) -> Column:
    """A URL under which captures meet: scheme, www, default port, fragment and a last slash
    left out; the host in small letters; the query's parameters in order."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), ordered)).otherwise(F.lit("")))


def _before(moments: DataFrame, value: str) -> DataFrame:
    """For each moment (url, at) the `value` of the latest earlier moment of the url that has
    one, as `before`. Windows see at most 2^DIGIT moments, whatever the url: first those that
    share all higher bits of the time; then what each such stretch ends with is carried to the
    next stretch, by the same means."""
    def carried(rows: DataFrame, width: int) -> DataFrame:
        stretch = F.shiftright("at", DIGIT)
        keys = ["url"] if width <= DIGIT else ["url", stretch]
        earlier = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        inside = rows.select("url", "at", F.last(value, ignorenulls=True).over(earlier).alias("inside"))
        if width <= DIGIT:
            return inside.withColumnRenamed("inside", "before")
        ends = durable(
            rows.filter(F.col(value).isNotNull()).groupBy("url", stretch.alias("at"))
            .agg(F.max_by(value, "at").alias(value))
        )
        empty = rows.select("url", stretch.alias("at")).distinct().join(ends, ["url", "at"], "left")
        before = durable(carried(durable(empty), width - DIGIT)).select(
            "url", F.col("at").alias("stretch"), F.col("before").alias("outside"))
        return (
            durable(inside.withColumn("stretch", stretch)).join(before, ["url", "stretch"], "left")
            .select("url", "at", F.coalesce("inside", "outside").alias("before"))
        )

    # Times as whole seconds since the first one; 2^31 seconds are 68 years.
    return carried(moments, 31)


def _header(name: str) -> Column:
    return F.element_at("headers", name)


def resolved(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url, canonical_url, resolved_to, outcome, validator,
    headers, payload_digest.

    `records` has record_id, type ('response' or 'revisit'), url, at (timestamp), status,
    headers (map of names in small letters to values), payload_digest. A revisit is matched to the
    latest strictly earlier response with status 200 of the same canonical URL; of several at one
    time, to the largest record_id. Then the validators that both carry are compared: digest,
    etag (without a weak mark), last-modified. `outcome` is 'resolved' if they agree,
    'unverified' if they share none, 'mismatch' if one differs and 'missing' without such a
    response; `validator` names the one that decided. When resolved or unverified, headers are
    those of the response with the permitted ones of the revisit over them, and the digest is
    that of the response; else the revisit's own headers and digest.

    Revisits without URL or time are 'missing'. Repeated rows give repeated results. Other
    columns are ignored. All responses of one URL and time are one moment before anything
    is sorted, so a hot URL is many small windows; its revisits join on URL and time."""
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), "type", "url", canonical(F.col("url")).alias("canonical_url"),
        F.col("at").cast("timestamp").cast("long").alias("at"), F.col("status").cast("int").alias("status"),
        "headers", "payload_digest",
    )
    placed = rows.filter("canonical_url is not null and at is not null")
    first = placed.agg(F.min("at")).first()[0] or 0
    full = F.col("type").eqNullSafe("response") & F.col("status").eqNullSafe(200)
    moments = durable(
        placed.filter(full | (F.col("type") == "revisit"))
        .groupBy(F.col("canonical_url").alias("url"), (F.col("at") - first).alias("at"))
        .agg(F.max(F.when(full, F.col("record_id"))).alias("response"))
    )
    before = durable(
        _before(moments, "response").filter("before is not null")
        .select(F.col("url").alias("canonical_url"), (F.col("at") + first).alias("at"), F.col("before").alias("resolved_to"))
    )
    responses = durable(
        placed.filter(full).join(
            before.select(F.col("resolved_to").alias("record_id")).distinct(), "record_id", "left_semi")
        .groupBy(F.col("record_id").alias("resolved_to")).agg(
            F.min_by(F.struct("headers", "payload_digest"), F.coalesce("payload_digest", F.lit(""))).alias("response"))
    )
    revisits = durable(rows.filter("type = 'revisit'").join(before, ["canonical_url", "at"], "left"))
    found = revisits.join(responses, "resolved_to", "left")
    theirs = lambda name: F.element_at("response.headers", name)
    strong = lambda c: F.regexp_replace(c, r"^W/", "")
    checks = [
        ("digest", F.col("payload_digest") == F.col("response.payload_digest")),
        ("etag", strong(_header("etag")) == strong(theirs("etag"))),
        ("last-modified", _header("last-modified") == theirs("last-modified")),
    ]
    clash = F.coalesce(*(F.when(~ok, F.lit(name)) for name, ok in checks))
    agree = F.coalesce(*(F.when(ok, F.lit(name)) for name, ok in checks))
    outcome = (
        F.when(F.col("response").isNull(), "missing").when(clash.isNotNull(), "mismatch")
        .when(agree.isNotNull(), "resolved").otherwise("unverified")
    )
    empty = F.create_map().cast("map<string,string>")
    own, stored = F.coalesce("headers", empty), F.coalesce("response.headers", empty)
    permitted = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k)), permitted)
    out = found.withColumn("outcome", outcome)
    good = F.col("outcome").isin("resolved", "unverified")
    return out.select(
        "record_id", "url", "canonical_url", "resolved_to", "outcome", F.coalesce(clash, agree).alias("validator"),
        F.when(good, merged).otherwise(own).alias("headers"),
        F.when(good, F.col("response.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records from a table of pages. Each page is a response, a minute per page_id
    after the start of 2024; 30 seconds later its URL is asked for again and answered "not
    modified", under another scheme and with a fragment. Of the answers every fifth carries
    the etag of another version, every seventh no etag, and every eleventh comes before its page."""
    start = 1_704_067_200
    page = F.col("page_id").cast("long")
    digest = F.sha1(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary"))
    etag = lambda mark: F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit(mark), F.lit('"'))
    stamp = lambda at: F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = F.lit(start) + page * 60
    again = F.when(page % 11 == 0, at - 30).otherwise(at + 30)
    url = F.col("url").cast("string")
    headers = lambda *pairs: F.create_map(*(F.lit(x) if isinstance(x, str) else x for p in pairs for x in p))
    response = pages.select(
        (page * 2).alias("record_id"), F.lit("response").alias("type"), url.alias("url"), at.cast("timestamp").alias("at"),
        F.lit(200).alias("status"),
        headers(("content-type", "text/html"), ("date", stamp(at)), ("etag", etag(""))).alias("headers"),
        digest.alias("payload_digest"),
    )
    asked = F.concat(F.regexp_replace(url, "^https?://", "HTTP://"), F.when(url.contains("#"), F.lit("")).otherwise(F.lit("#again")))
    told = F.when(page % 7 == 0, headers(("date", stamp(again)), ("content-length", "0"))).otherwise(
        headers(("date", stamp(again)), ("content-length", "0"), ("etag", F.when(page % 5 == 0, etag("-old")).otherwise(etag("")))))
    revisit = pages.select(
        (page * 2 + 1).alias("record_id"), F.lit("revisit").alias("type"), asked.alias("url"),
        again.cast("timestamp").alias("at"), F.lit(304).alias("status"), told.alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
    return reduce(DataFrame.unionByName, [response, revisit])

"""Not-modified revisits of a web archive, resolved to the captures they stand for."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.llm.tables import settle

# Fields of a not-modified answer that replace those of the stored one; all others stay as stored.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """``host/path?query``: without scheme, ``www.``, standard ports, fragment, ``utm_`` parameters and closing slashes, the
    host in lower case. Null if the url is null or has no ``://``."""
    plain = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(plain, "^[^:/?#]+://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_extract(plain, "^[^:/?#]+://[^/?]*(.*)$", 1)
    path, query = F.regexp_extract(rest, "^([^?]*)", 1), F.regexp_extract(rest, "[?](.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)utm_[^&]*", ""), "^&|&$", "")
    out = F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.instr(url, "://") > 0, out)


def same_validators(revisit: Column, stored: Column) -> Column:
    """Whether the validators of a not-modified answer name the stored one: entity tags by weak comparison if the answer
    has one, else the dates of last change, else true (the archive said not modified and nothing contradicts it)."""
    def tag(headers):
        return F.regexp_replace(F.trim(headers["etag"]), "^W/", "")

    return F.when(revisit["etag"].isNotNull(), F.coalesce(tag(revisit) == tag(stored), F.lit(False))).when(
        revisit["last-modified"].isNotNull(),
        F.coalesce(F.trim(revisit["last-modified"]) == F.trim(stored["last-modified"]), F.lit(False))).otherwise(True)


def merged_headers(stored: Column, revisit: Column) -> Column:
    """The stored fields, those of ``PERMITTED`` that the not-modified answer has taken from it."""
    permitted = F.array(*[F.lit(n) for n in PERMITTED])
    new = F.map_filter(revisit, lambda k, v: F.array_contains(permitted, k) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(new, k)), new)


def as_of(events: DataFrame) -> DataFrame:
    """``events`` (url, date, kind, record_id, stored) with _source: the last ``stored`` before the row, of its url.

    Rows are range-sorted by url and date into parts, so a url with a third of all captures is spread over many tasks.
    Each part looks back within itself; what it inherits is the last capture of the closest part before it that has any,
    one row per part. Rows of one instant see none of each other, as revisits sort before captures.
    """
    order = ["url", "date", "kind", "record_id"]
    ranged = settle(events.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "captures")
    back = Window.partitionBy("_part", "url").orderBy("date", "kind", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn("_near", F.last("stored", ignorenulls=True).over(back))
    ends = ranged.groupBy("_part").agg(F.max_by(F.struct("url", "stored"), F.when(F.col("stored").isNotNull(), F.struct(
        *order))).alias("_end"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_end", F.when(F.col("_end.stored").isNotNull(), F.col("_end")))
    # One row per part.
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    inherited = F.when(F.col("_carried.url") == F.col("url"), F.col("_carried.stored"))
    return near.join(carried, "_part").withColumn("_source", F.coalesce("_near", inherited)).drop(
        "_part", "_near", "_carried")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per record: record_id, url (canonical), date, type, resolution, source_id, status, headers, payload_digest.

    ``records``: record_id, type (response or revisit), url, date, status, headers (map, names in any case),
    payload_digest. A response (200) with a url and a date is a full capture. A revisit takes the latest full capture of
    its canonical url before its date: resolved if the validators agree (it then has that status and digest, and the
    merged headers), mismatch if they do not (older captures are not tried), orphan if there is none. Responses are
    ``full``, all other records ``other``, with their own values.

    Null headers count as no fields; records without url or date are never sources and, as revisits, orphans. Captures of
    one instant are ordered by record_id, repeated rows count each. Payloads are not moved; ``source_id`` names the record
    that has it. An empty table gives no rows; further columns are not read.
    """
    fields = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    # Of names that differ in case only, the first in the map counts.
    lowered = F.transform(F.map_entries(fields), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(lowered, lambda e: e["key"]))
    headers = F.map_from_entries(F.transform(names, lambda n: F.get(F.filter(lowered, lambda e: e["key"] == n), F.lit(0))))
    rows = records.select("record_id", F.col("type"), canonical_url(F.col("url")).alias("url"), "date", "status",
                          headers.alias("headers"), "payload_digest")
    full = ((F.col("type") == "response") & (F.col("status") == 200) & F.col("url").isNotNull() & F.col("date").isNotNull())
    events = rows.withColumn("kind", F.when(full, 1).otherwise(0)).withColumn("stored", F.when(full, F.struct(
        F.col("record_id").alias("id"), F.col("status").alias("status"), F.col("headers").alias("headers"),
        F.col("payload_digest").alias("digest"))))
    found = as_of(events).withColumn("_source", F.when(F.col("url").isNotNull() & F.col("date").isNotNull(), F.col("_source")))
    revisit, source = F.col("type") == "revisit", F.col("_source")
    resolution = F.when(revisit & source.isNull(), "orphan").when(
        revisit & same_validators(F.col("headers"), source["headers"]), "resolved").when(revisit, "mismatch").when(
        F.col("type") == "response", "full").otherwise("other")
    judged = found.withColumn("resolution", resolution)
    done = F.col("resolution") == "resolved"
    return judged.select(
        "record_id", "url", "date", "type", "resolution",
        F.when(revisit, source["id"]).when(F.col("resolution") == "full", F.col("record_id")).alias("source_id"),
        F.when(done, source["status"]).otherwise(F.col("status")).alias("status"),
        F.when(done, merged_headers(source["headers"], F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(done, source["digest"]).otherwise(F.col("payload_digest")).alias("payload_digest"))


def with_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """``resolved`` with the payload (record_id, payload) of each record's source."""
    own = payloads.select(F.col("record_id").alias("source_id"), "payload")
    return resolved.join(own, "source_id", "left")


def captures_of(pages: DataFrame) -> DataFrame:
    """Archive records made of a table of pages: the capture of every page, a later not-modified revisit (of every
    seventh page after a change of its entity tag) and, of every fifth page, a revisit before its capture."""
    html = F.coalesce(F.col("html"), F.lit(""))
    taken = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
    tag = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 16), F.lit('"'))

    def headers(**fields):
        return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k.replace("_", "-")), v.cast("string"))])

    def record(step, kind, seconds, status, fields, digest):
        return F.struct((F.col("page_id") * 4 + step).alias("record_id"), F.lit(kind).alias("type"),
                        (taken + F.make_dt_interval(secs=F.lit(seconds))).alias("date"), F.lit(status).alias("status"),
                        fields.alias("headers"), digest.alias("payload_digest"))

    none = F.lit(None).cast("string")
    full = record(0, "response", 0, 200, headers(ETag=tag, Content_Type=F.lit("text/html"), Server=F.lit("origin"), Vary=F.lit(
        "Accept"), Content_Length=F.octet_length(html)), F.md5(html))
    changed = F.when(F.col("page_id") % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    later = record(1, "revisit", 2592000, 304, headers(etag=changed, Server=F.lit("edge"), Cache_Control=F.lit("max-age=60")), none)
    early = record(2, "revisit", -3600, 304, headers(etag=tag, Cache_Control=F.lit("no-cache")), none)
    rows = F.when(F.col("page_id") % 5 == 0, F.array(full, later, early)).otherwise(F.array(full, later))
    return pages.select("url", F.explode(rows).alias("r")).select("url", "r.*")

"""Not-modified revisits of web archives, resolved to the response they stand for.

A revisit (status 304, no body) stands for the latest earlier full response (status 200) to the same canonical URL: an
as-of join. The pair is checked by its validators, and the revisit's permitted headers update the response's.

The join is a running maximum over the records of a URL in time order. So that a URL with many captures is not sorted in
one task, time is cut into BUCKETS stretches: within a stretch the running maximum is taken over the records, and what the
stretches before hand on is taken over one row for each. Only identifiers, times and validators take part; headers and
bodies are fetched for the pairs that were found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.components import folder

BUCKETS = 1024

# What a 304 may not change (the representation's own headers and those of the connection).
NOT_MERGED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]
# Query parameters that only track visits.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical(url: Column) -> Column:
    """Scheme and a leading www. dropped, host in lower case, no default port, fragment, tracking parameter or trailing slash."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^([^/?]*)", 1)), ":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(u, "^[^/?]*", "")
    rest = F.regexp_replace(rest, rf"([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+", "$1")
    return F.concat(host, F.regexp_replace(rest, "[/?&]+$", ""))


def _header(c: str, name: str) -> Column:
    return F.col(c)[name]


def _tag(c: Column) -> Column:
    """An entity tag for the weak comparison."""
    return F.regexp_replace(F.trim(c), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for every revisit among records(record_id, url, ts, status, headers map<string,string>, body).

    Returned: record_id, canonical_url, ts, response_id, outcome, headers, body. outcome is "resolved"; or "no_earlier" (no
    earlier full response; response_id null), "no_validator" (the revisit has neither ETag nor Last-Modified) or "mismatch" (its
    ETag, or without one its Last-Modified, isn't the response's), for which headers are the revisit's and body is null.
    Earlier is strictly earlier; among responses of the same time the highest record_id counts. A null or empty URL, a null
    time, and a null status join with nothing. Header names are compared in lower case; of names that then agree the last
    in order stays. Rows that repeat are resolved as often as they occur. Other columns are ignored.
    """
    folder(records.sparkSession)
    names = F.transform(F.map_entries(F.coalesce(records["headers"], F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.filter(names, lambda e, i: (e["value"].isNotNull()) & (F.size(F.filter(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), lambda o: o["key"] == e["key"])) == 0))
    base = records.select(records["record_id"].cast("long").alias("record_id"), F.nullif(canonical(records["url"]), F.lit("")).alias("key"), records["ts"].cast("long").alias("ts"), records["status"].cast("int").alias("status"), F.map_from_entries(last).alias("headers"), records["body"].cast("string").alias("body"))
    light = base.where("status in (200, 304)").select("record_id", "key", "ts", (F.col("status") == 200).alias("full"), F.struct(_tag(_header("headers", "etag")).alias("etag"), F.trim(_header("headers", "last-modified")).alias("modified")).alias("validators")).checkpoint()
    low, high = light.agg(F.coalesce(F.min("ts"), F.lit(0)), F.coalesce(F.max("ts"), F.lit(0))).first()
    width = max(1, -(-(high - low + 1) // BUCKETS))
    usable = light.where("key is not null and ts is not null").withColumn("bucket", F.floor((F.col("ts") - low) / width))
    response = F.when(F.col("full"), F.struct("ts", "record_id", "validators"))
    rows = usable.select("key", "bucket", "ts", "full", "record_id", "validators", response.alias("response"))
    # in a stretch: records of one time see only earlier ones, so the frame ends before the time itself
    inside = Window.partitionBy("key", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max("response").over(inside)).where("not full")
    ends = rows.groupBy("key", "bucket").agg(F.max("response").alias("most"))
    handed = ends.withColumn("handed", F.max("most").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("key", "bucket", "handed")
    found = near.join(handed, ["key", "bucket"]).select("record_id", "key", "ts", "validators", F.coalesce("near", "handed").alias("r"))
    rest = light.where("not full and (key is null or ts is null)").select("record_id", "key", "ts", "validators", F.lit(None).cast(found.schema["r"].dataType).alias("r"))
    v, r = F.col("validators"), F.col("r.validators")
    same = F.when(v["etag"].isNotNull(), v["etag"].eqNullSafe(r["etag"])).otherwise(v["modified"].eqNullSafe(r["modified"]))
    outcome = F.when(F.col("r").isNull(), "no_earlier").when(v["etag"].isNull() & v["modified"].isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    found = found.unionAll(rest).select("record_id", "key", "ts", F.col("r.record_id").alias("response_id"), F.col("r.ts").alias("response_ts"), outcome.alias("outcome"))
    # headers and bodies, of equal rows once; revisits keep their number of rows
    revisit = base.where("status = 304").groupBy("record_id", "key", "ts").agg(F.max(F.map_entries("headers").cast("array<struct<key:string,value:string>>")).alias("own"))
    full = base.where("status = 200").select(F.col("record_id").alias("response_id"), F.col("key").alias("k"), F.col("ts").alias("response_ts"), F.map_entries("headers").alias("stored"), "body").dropDuplicates(["response_id", "k", "response_ts"])
    out = found.alias("f").join(revisit.alias("v"), (F.col("f.record_id").eqNullSafe(F.col("v.record_id"))) & F.col("f.key").eqNullSafe(F.col("v.key")) & F.col("f.ts").eqNullSafe(F.col("v.ts"))).select("f.*", "own")
    out = out.alias("o").join(full.alias("w"), (F.col("o.response_id") == F.col("w.response_id")) & (F.col("o.key") == F.col("k")) & (F.col("o.response_ts") == F.col("w.response_ts")) & (F.col("outcome") == "resolved"), "left").select("o.*", "stored", "body")
    new = F.filter("own", lambda e: ~e["key"].isin(NOT_MERGED))
    stays = F.filter("stored", lambda e: ~F.array_contains(F.transform(new, lambda n: n["key"]), e["key"]))
    merged = F.when(F.col("outcome") == "resolved", F.concat(stays, new)).otherwise(F.col("own"))
    return out.select("record_id", F.col("key").alias("canonical_url"), "ts", "response_id", "outcome", F.map_from_entries(F.array_sort(merged)).alias("headers"), "body")


def captures(pages: DataFrame) -> DataFrame:
    """Records for the pages table, which has neither times nor headers nor revisits of its own.

    Every page is a full response at time 10 * page_id, and there is one revisit for every page: at a time up to 5,000 before
    or 50,000 after, dealt by its URL's length and page_id. It carries the page's entity tag (or, for every third, only
    Last-Modified; for every tenth, neither), so where another capture of the URL came between, the validators differ.
    """
    etag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    modified = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    head = lambda *pairs: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), x.cast("string").alias("value")) for k, x in pairs)), lambda e: e["value"].isNotNull()))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    full = p.select(F.col("page_id").alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit(200).alias("status"), head(("ETag", etag), ("Last-Modified", modified), ("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length("html")), ("Date", F.concat(F.lit("t"), (F.col("page_id") * 10).cast("string")))).alias("headers"), F.col("html").alias("body"))
    later = F.pmod(F.col("page_id") * 7919 + F.coalesce(F.length("url"), F.lit(0)), F.lit(55_000)) - 5000
    tag = F.when((F.col("page_id") % 3 != 0) & (F.col("page_id") % 10 != 0), F.concat(F.lit("W/"), etag))
    revisit = p.select((-1 - F.col("page_id")).alias("record_id"), "url", (F.col("page_id") * 10 + later).alias("ts"), F.lit(304).alias("status"), head(("etag", tag), ("last-modified", F.when(F.col("page_id") % 10 != 0, modified)), ("Content-Length", F.lit("0")), ("Date", F.concat(F.lit("t"), (F.col("page_id") * 10 + later).cast("string")))).alias("headers"), F.lit(None).cast("string").alias("body"))
    return full.unionAll(revisit)


def report(resolved: DataFrame) -> DataFrame:
    """The digest that the query returns: headers joined by name, the body by its length and hash."""
    line = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return resolved.select("record_id", "canonical_url", "ts", "response_id", "outcome", line.alias("headers"), F.length("body").cast("long").alias("body_chars"), F.md5("body").alias("body_md5"))


ORACLE_SQL = r"""
with p as (select page_id, url, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') u from pages),
c as (select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
        || regexp_replace(regexp_replace(regexp_replace(u, '^[^/?]*', ''), '([?&])(?:(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*(?:&|$))+', '\1', 'g'), '[/?&]+$', '') k,
      '"' || md5(html) || '"' tag, 'day ' || page_id modified,
      page_id * 10 + (page_id * 7919 + coalesce(length(url), 0)) % 55000 - 5000 rts from p),
j as (select v.page_id vid, v.k, v.rts, v.modified vmod, v.page_id % 3 <> 0 and v.page_id % 10 <> 0 has_tag, v.page_id % 10 <> 0 has_mod, v.tag vtag,
        (select max((r.page_id * 10, r.page_id)) from c r where r.k = v.k and r.page_id * 10 < v.rts) hit from c v),
o as (select j.*, r.page_id rid, r.tag rtag, r.modified rmod, r.html,
        case when r.page_id is null then 'no_earlier' when not has_tag and not has_mod then 'no_validator'
             when has_tag then case when vtag = rtag then 'resolved' else 'mismatch' end
             when vmod = rmod then 'resolved' else 'mismatch' end outcome
      from j left join c r on r.page_id = j.hit[2])
select -1 - vid as record_id, k as canonical_url, rts as ts, rid as response_id, outcome,
  case when outcome = 'resolved' then 'content-length=' || octet_length(encode(html)) || ';content-type=text/html;date=t' || rts || ';etag=' || case when has_tag then 'W/' || vtag else rtag end || ';last-modified=' || vmod
       else 'content-length=0;date=t' || rts || case when has_tag then ';etag=W/' || vtag else '' end || case when has_mod then ';last-modified=' || vmod else '' end end as headers,
  case when outcome = 'resolved' then length(html) end as body_chars, case when outcome = 'resolved' then md5(html) end as body_md5
from o"""

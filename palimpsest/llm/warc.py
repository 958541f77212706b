"""WARC: records read and written, and not-modified revisits resolved.

A revisit record (profile server-not-modified) has the headers of a 304 answer and no body. It stands for the latest
earlier full response of the same canonical URL, if the validators agree: an as-of join. The response's headers are
then merged with those of the 304 answer that such an answer may change (RFC 9110, 15.4.5; RFC 9111, 3.2).

The join deals records by ranges of (URL, time), so a URL with a third of all captures is spread over tasks. Each range
is read in order, with the latest response at hand; what a range needs from those before it is one response, that of
the URL it begins in the middle of. Only heads and digests of records are sorted, bodies stay where they are.
"""

from __future__ import annotations

import datetime
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palimpsest.llm.common import checkpointed, in_small_batches

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Headers of a 304 answer that don't replace stored ones, as they belong to a connection or a body.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
HEADERS = "array<struct<name:string,value:string>>"
RECORD = f"record_id string, kind string, profile string, url string, captured timestamp, status int, headers {HEADERS}, payload binary, payload_sha256 string"
_LINE = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r?\n")
_TIME = "%Y-%m-%dT%H:%M:%S.%fZ"


def record_bytes(kind: str, record_id: str, url: str, captured: datetime.datetime, block: bytes, profile: str | None = None, content_type: str = "application/http; msgtype=response") -> bytes:
    """One WARC/1.1 record. Line ends in the URL are percent-encoded."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", captured.strftime(_TIME)), ("WARC-Target-URI", url), ("WARC-Profile", profile), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def http_bytes(status: int, reason: str, headers: list[tuple[str, str]], body: bytes = b"") -> bytes:
    return f"HTTP/1.1 {status} {reason}\r\n{''.join(f'{k}: {v}{chr(13)}{chr(10)}' for k, v in headers)}\r\n".encode() + body


def _head(data: bytes, at: int) -> tuple[list[tuple[str, str]], int]:
    """Header lines from `at` on, and where the empty line after them ends."""
    out = []
    while (m := _LINE.match(data, at)) is not None:
        out.append((m[1].decode("utf-8", "replace").strip(), m[2].decode("utf-8", "replace").strip()))
        at = m.end()
    for end in (b"\r\n", b"\n"):
        if data.startswith(end, at):
            return out, at + len(end)
    raise ValueError(f"header cut at {at}")


def parse(data: bytes):
    """(WARC headers by lower-case name, block) of each record; ValueError for a broken one."""
    at = 0
    while at < len(data):
        while data.startswith((b"\r", b"\n"), at):
            at += 1
        if at == len(data):
            return
        end = data.find(b"\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at {at}")
        head, start = _head(data, end + 1)
        named = {k.lower(): v for k, v in head}
        size = int(named.get("content-length", "-1"))
        if size < 0 or start + size > len(data):
            raise ValueError(f"record cut at {at}")
        yield named, data[start : start + size]
        at = start + size


def _record(named: dict[str, str], block: bytes) -> tuple:
    status, headers, body = None, [], block
    if "application/http" in named.get("content-type", "") and block.startswith(b"HTTP/"):
        first = block.find(b"\n")
        words = block[:first].split()
        status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
        headers, start = _head(block, first + 1)
        body = block[start:]
    try:
        text = named.get("warc-date", "")
        captured = datetime.datetime.strptime(text, _TIME if "." in text else "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=datetime.timezone.utc)
    except ValueError:
        captured = None
    return named.get("warc-record-id", "").strip("<>"), named.get("warc-type"), named.get("warc-profile"), named.get("warc-target-uri"), captured, status, headers, body, hashlib.sha256(body).hexdigest()


def read_records(archives: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The records (RECORD, and columns `keep`) in the column `warc`, which holds one or more whole records a row.

    A null or empty value has no records. Broken bytes after the last whole record give one record of kind `broken`.
    Repeated rows each have their records; ValueError if a kept column has the name of a record's. Empty table: no rows.
    """
    if clash := set(keep) & {"record_id", "kind", "profile", "url", "captured", "status", "headers", "payload", "payload_sha256"}:
        raise ValueError(f"kept columns have names of a record's: {sorted(clash)}")
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int32(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary(), pa.string()]
    names = ["record_id", "kind", "profile", "url", "captured", "status", "headers", "payload", "payload_sha256"]

    def run(batches):
        for b in batches:
            rows, of = [], []
            for i, data in enumerate(b["warc"].to_pylist()):
                try:
                    for named, block in parse(data or b""):
                        r = _record(named, block)
                        rows.append((*r[:6], [{"name": k, "value": v} for k, v in r[6]], *r[7:]))
                        of.append(i)
                except ValueError:
                    rows.append((None, "broken", None, None, None, None, None, None, None))
                    of.append(i)
            if rows:
                yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(of)) for c in keep), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], [*keep, *names])

    fields = "".join(f"`{c}` {archives.schema[c].dataType.simpleString()}, " for c in keep)
    return in_small_batches(archives).select(*keep, "warc").mapInArrow(run, fields + RECORD)


def header(headers: Column, name: str) -> Column:
    """The first header of that name, in any case; null if there is none."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def _opaque(etag: Column) -> Column:
    """An entity tag without the mark of a weak one: a 304 answer is compared weakly."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, those that the 304 answer also has replaced by its own unless KEPT_HEADERS, and its new ones."""

    def free(h: Column) -> Column:
        return ~F.lower(h["name"]).isin(*KEPT_HEADERS)

    allowed = F.filter(fresh, free)
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"]))), allowed)


def _as_of(ordered: DataFrame, carried: dict[int, tuple] | None, columns: list[str], schema: str) -> DataFrame:
    """One pass over sorted ranges. Without `carried`: each range's last URL and its latest response. With it: the
    revisits, each with the columns of the latest response before it, if there is one.

    Rows are looked at by URL and kind only; what goes on from a response is taken by Arrow, by its place.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    kinds = {c: arrow.field("row").type.field(c).type if carried is None else arrow.field(f"of_{c}").type for c in columns}

    def none():
        return pa.table({c: pa.nulls(1, kinds[c]) for c in columns})

    def run(batches):
        url, latest, part = None, none(), -1
        seen = False
        for b in batches:
            if not b.num_rows:
                continue
            if not seen:
                seen, part = True, b["part"][0].as_py()
                if carried is not None and part in carried:
                    url, row = carried[part]
                    latest = pa.table({c: pa.array([row[c] if row else None], kinds[c]) for c in columns})
            # place 0 is the response at hand, place 1 is none, row i of the batch is place i + 2
            pool = pa.concat_tables([latest, none(), pa.table({c: b[c].cast(kinds[c]) for c in columns})])
            at, last, asks, of = 0, url, [], []
            for i, (u, full) in enumerate(zip(b["canonical"].to_pylist(), b["full"].to_pylist(), strict=True)):
                if u != last:
                    last, at = u, 1
                if full:
                    at = i + 2
                else:
                    asks.append(i)
                    of.append(at)
            url, latest = last, pool.slice(at, 1)
            if carried is not None and asks:
                own, found = b.take(pa.array(asks, pa.int64())), pool.take(pa.array(of, pa.int64())).combine_chunks()
                yield from pa.table([*(own[f.name].cast(f.type) if not f.name.startswith("of_") else found[f.name[3:]] for f in arrow)], schema=arrow).to_batches()
        if carried is None and seen:
            row = {c: latest[c][0].as_py() for c in columns}
            yield pa.RecordBatch.from_pylist([{"part": part, "canonical": url, "row": row if row["record_id"] is not None else None}], schema=arrow)

    return ordered.mapInArrow(run, schema)


def resolve_revisits(records: DataFrame, canonical: Column) -> DataFrame:
    """One row for each not-modified revisit in records (RECORD, without need of payload).

    record_id, canonical, captured, of_record_id, of_payload_sha256, of_captured, headers and verdict. The response is
    the latest one with status 200 of the same canonical URL captured before the revisit (of several at one time that
    with the greatest record_id). Verdicts: `resolved` if the entity tags agree, or without two of them the
    Last-Modified dates; `unchecked` if the revisit has no validator that the response has too; `changed` if they
    differ; `missing` without an earlier response, or without a URL or time. headers are merged for resolved and
    unchecked ones, else the revisit's own. Other kinds of records, and revisits of equal payload, are not used.
    Repeated rows each have their row. Empty table: no rows.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    asks = (F.col("kind") == "revisit") & ((F.col("profile") == NOT_MODIFIED) | (F.col("status") == 304))
    slim = records.select("record_id", canonical.alias("canonical"), "captured", F.coalesce("headers", F.array().cast(HEADERS)).alias("headers"), "payload_sha256", full.alias("full"), asks.alias("asks"))
    slim = slim.where("(full or asks) and record_id is not null").drop("asks")
    known = F.col("canonical").isNotNull() & F.col("captured").isNotNull()
    order = ["canonical", "captured", "full", "record_id"]  # at one time revisits come before responses
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.where(known).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = checkpointed(dealt.withColumn("part", F.spark_partition_id()))
    columns = ["record_id", "payload_sha256", "captured", "headers"]
    types = "record_id:string,payload_sha256:string,captured:timestamp,headers:" + HEADERS
    ends = sorted(_as_of(ordered, None, columns, f"part int, canonical string, row struct<{types}>").collect(), key=lambda r: r.part)
    carried, url, latest = {}, None, None
    for r in ends:  # one row a range
        carried[r.part] = (url, latest)
        if r.canonical != url or r.row is not None:
            latest = r.row.asDict(recursive=True) if r.row is not None else None
            if latest and latest["captured"] is not None:
                latest["captured"] = latest["captured"].astimezone(datetime.timezone.utc)
        url = r.canonical
    fields = ", ".join(f"of_{x.replace(':', ' ', 1)}" for x in types.split(",headers:")[0].split(",")) + f", of_headers {HEADERS}"
    joined = _as_of(ordered, carried, columns, f"record_id string, canonical string, captured timestamp, headers {HEADERS}, {fields}")
    none = slim.where(~known & ~F.col("full")).select("record_id", "canonical", "captured", "headers", *(F.lit(None).cast(t).alias(f"of_{c}") for c, t in zip(columns, ("string", "string", "timestamp", HEADERS), strict=True)))
    both = joined.unionByName(none)
    tag, of_tag = _opaque(header(F.col("headers"), "etag")), _opaque(header(F.col("of_headers"), "etag"))
    day, of_day = F.trim(header(F.col("headers"), "last-modified")), F.trim(header(F.col("of_headers"), "last-modified"))
    same = F.coalesce(tag == of_tag, day == of_day)
    verdict = F.when(F.col("of_record_id").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    out = both.withColumn("verdict", verdict)
    use = F.col("verdict").isin("resolved", "unchecked")
    return out.select("record_id", "canonical", "captured", "of_record_id", "of_payload_sha256", "of_captured", F.when(use, merged_headers(F.col("of_headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"), "verdict")


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """The resolved revisits as full records: status 200, merged headers, and the body of the response they stand for."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("of_record_id"), "payload")
    return resolved.where("verdict in ('resolved', 'unchecked')").join(bodies, "of_record_id").select("record_id", "canonical", "captured", F.lit(200).alias("status"), "headers", "payload", "of_record_id")

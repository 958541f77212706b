"""The registered queries opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

import datetime
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import langid, mixing, neardup, negatives, ogg, packing, parsing, passages, pieces, pii, urlfilter, warc, whitening
from palimpsest.llm.common import table

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Pages of sites whose first label (after www.) is one of these make up the list of op9; half of them are listed not as
#: they are but with a last part more, so that the list has near misses.
LISTED_SITES, NEAR_MISS = ("cheap-pills", "spam-farm"), "/index"


def op1_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def pii_key(spark: SparkSession) -> str:
    """The key of pseudonyms that the session names; the test tables have one of their own."""
    return spark.conf.get("spark.palimpsest.pii.key", "the key of the test tables")


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark), report="pii")
    return made.select("doc_id", "text", F.size("pii").alias("n_replaced"), F.array_join(F.transform("pii", lambda x: x["kind"]), ",").alias("kinds"))


def op3_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, ["doc_id"], check=True)

    def each(field: str):
        return F.transform("samples", lambda x: x[field])

    return coded.select("doc_id", each("pieces").alias("n_pieces"), each("log_p").alias("log_p"), each("log_inclusion").alias("log_inclusion"), F.transform("samples", lambda x: F.sha2(x["ids"], 256)).alias("ids_sha256"), "exact")


_FIRST = datetime.datetime(2024, 1, 1)
_ASKED = "Thu, 01 Feb 2024 00:00:00 GMT"
_CHANGED = ("Sun, 31 Dec 2023 00:00:00 GMT", "Mon, 01 Jan 2024 00:00:00 GMT")


def archive(pages: DataFrame) -> DataFrame:
    """(page_id, warc): each page as a WARC file of two captures, a full answer and a not-modified one.

    The second comes a month after the first, but before it for every 7th page; its entity tag is another one for
    every 5th page and is left out for every 11th. Of these, every other one has the date of the last change, and every
    third one of all another date. A page without a number counts as 1, its records' names have none.
    """

    def run(batches):
        for b in batches:
            out = []
            for i, url, html in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html")), strict=True):
                body, n, name = (html or "").encode(), 1 if i is None else i, "" if i is None else f"{i:020d}"
                tag = f'"{hashlib.md5(body).hexdigest()[:16]}"'
                first = _FIRST + datetime.timedelta(minutes=n % 1000)
                again = first + datetime.timedelta(days=-30 if n % 7 == 0 else 30)
                full = warc.http_bytes(200, "OK", [("Content-Type", "text/html"), ("Content-Length", str(len(body))), ("ETag", tag), ("Last-Modified", _CHANGED[0]), ("Cache-Control", "max-age=60")], body)
                asked = [("Date", _ASKED), ("Content-Length", "0"), ("cache-control", "max-age=600")]
                if n % 11:
                    asked.append(("ETag", '"other"' if n % 5 == 0 else f"W/{tag}"))
                elif n % 2 == 0:
                    asked.append(("Last-Modified", _CHANGED[n % 3 == 0]))
                out.append(
                    warc.record_bytes("response", f"urn:page:{name}:200", url or "", first, full)
                    + warc.record_bytes("revisit", f"urn:page:{name}:304", url or "", again, warc.http_bytes(304, "Not Modified", asked), warc.NOT_MODIFIED)
                )
            yield pa.RecordBatch.from_arrays([b["page_id"], pa.array(out, pa.binary())], ["page_id", "warc"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, warc binary")


def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(archive(table(spark, sf_dir, "pages")))
    found = warc.resolve_revisits(records, urlfilter.canonical(F.col("url")))

    def page(record: str):
        return F.nullif(F.split(record, ":")[2], F.lit("")).cast("long")

    headers = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.select(page("record_id").alias("page_id"), "canonical", "verdict", page("of_record_id").alias("of_page_id"), F.col("of_payload_sha256").alias("payload_sha256"), headers.alias("headers"))


def op6_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken", "lack")


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.features(ogg.store(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id", "n_bytes"])


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    named = pages.select(urlfilter.canonical(F.col("url")).alias("c")).where(F.split("c", "[.]")[0].isin(*LISTED_SITES))
    listed = named.select(F.when(F.length("c") % 2 == 0, F.col("c")).otherwise(F.concat("c", F.lit(NEAR_MISS))).alias("canonical"))
    return urlfilter.filter_urls(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, *model, keep=["doc_id", "held_out"])


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whiten(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])
    return made.withColumn("deviation", F.col("deviation").cast("long"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(whitening.finite(F.col("embedding")) & F.col("label").isNotNull())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = F.transform("embedding", lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long"))
    return negatives.hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), x.alias("x")), F.col("id") % 100 == 0)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {f.__name__: f for f in (op1_shared_passages, op2_pii_pseudonyms, op3_phrase_fingerprints, op4_sampled_pieces, op5_revisit_resolution, op6_balanced_mix, op7_ogg_media, op8_minhash_near_duplicates, op9_url_filter, op10_language_id, op11_embedding_whitening, op12_hard_negatives, op13_best_fit_packing)}

_REST = "substr(url, instr(url, '://') + 3)"
CANONICAL = f"""
part AS (
  SELECT page_id, url,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract({_REST}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract({_REST}, '^[^?#]*\\?([^#]*)', 1) ELSE '' END AS query
  FROM pages),
keyed AS (
  SELECT *, regexp_replace(host, '^www\\.', '') AS bare,
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[A-Za-z_]+|ref|fbclid|gclid)='))), '&') AS kept
  FROM part),
canon AS (
  SELECT *, CASE WHEN bare <> '' THEN bare || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM keyed)"""
OP9_SQL = f"""
WITH {CANONICAL},
listed AS (SELECT DISTINCT canonical || CASE WHEN length(canonical) % 2 = 0 THEN '' ELSE '/index' END AS canonical FROM canon WHERE string_split(canonical, '.')[1] IN ('cheap-pills', 'spam-farm')),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(r.verdict, length(rhost || rpath)) AS verdict
  FROM canon, rules r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT c.page_id, c.host, c.path, b.rule, coalesce(b.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM canon c LEFT JOIN best b ON b.page_id = c.page_id LEFT JOIN listed l ON l.canonical = c.canonical
"""
OP5_SQL = f"""
WITH {CANONICAL},
captures AS (
  SELECT c.page_id, c.canonical, coalesce(p.html, '') AS html, TIMESTAMP '2024-01-01' + to_minutes(c.page_id % 1000) AS first,
    TIMESTAMP '2024-01-01' + to_minutes(c.page_id % 1000) + to_days(CASE WHEN c.page_id % 7 = 0 THEN -30 ELSE 30 END) AS again,
    CASE WHEN c.page_id % 11 = 0 THEN NULL WHEN c.page_id % 5 = 0 THEN '"other"' ELSE '"' || substr(md5(coalesce(p.html, '')), 1, 16) || '"' END AS asked,
    CASE WHEN c.page_id % 22 = 0 THEN CASE WHEN c.page_id % 3 = 0 THEN '{_CHANGED[1]}' ELSE '{_CHANGED[0]}' END END AS since
  FROM canon c JOIN pages p USING (page_id)),
pairs AS (
  SELECT r.page_id, r.canonical, r.asked, r.since, f.page_id AS of_page_id, '"' || substr(md5(f.html), 1, 16) || '"' AS tag, f.html, octet_length(encode(f.html)) AS size,
    row_number() OVER (PARTITION BY r.page_id ORDER BY f.first DESC NULLS LAST, f.page_id DESC) AS rn
  FROM captures r LEFT JOIN captures f ON f.canonical = r.canonical AND f.first < r.again),
judged AS (
  SELECT *, CASE WHEN of_page_id IS NULL THEN 'missing' WHEN asked IS NULL AND since IS NULL THEN 'unchecked' WHEN coalesce(asked = tag, since = '{_CHANGED[0]}') THEN 'resolved' ELSE 'changed' END AS verdict,
    'Content-Type: text/html' || chr(10) || 'Content-Length: ' || size AS kept, 'Date: {_ASKED}' AS date, 'cache-control: max-age=600' AS cache FROM pairs WHERE rn = 1)
SELECT page_id, canonical, verdict, of_page_id, CASE WHEN of_page_id IS NOT NULL THEN sha256(html) END AS payload_sha256,
  CASE WHEN verdict IN ('missing', 'changed') THEN date || chr(10) || 'Content-Length: 0' || chr(10) || cache || CASE WHEN asked IS NULL THEN '' WHEN page_id % 5 = 0 THEN chr(10) || 'ETag: "other"' ELSE chr(10) || 'ETag: W/' || asked END || CASE WHEN since IS NULL THEN '' ELSE chr(10) || 'Last-Modified: ' || since END
    WHEN asked IS NOT NULL THEN kept || chr(10) || 'Last-Modified: {_CHANGED[0]}' || chr(10) || date || chr(10) || cache || chr(10) || 'ETag: W/' || asked
    WHEN since IS NOT NULL THEN kept || chr(10) || 'ETag: ' || tag || chr(10) || date || chr(10) || cache || chr(10) || 'Last-Modified: ' || since
    ELSE kept || chr(10) || 'ETag: ' || tag || chr(10) || 'Last-Modified: {_CHANGED[0]}' || chr(10) || date || chr(10) || cache
  END AS headers
FROM judged
"""
OP12_SQL = """
WITH known AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256.0 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
met AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM known a JOIN known b ON a.id % 100 = 0 AND b.id <> a.id),
near AS (SELECT anchor, id AS positive, score AS positive_score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
hard AS (
  SELECT n.*, m.id, m.score, row_number() OVER (PARTITION BY n.anchor, n.positive ORDER BY m.score DESC, m.id) AS rank
  FROM near n JOIN met m ON m.anchor = n.anchor AND NOT m.same AND 30 * n.positive_score <= 100 * m.score AND 100 * m.score <= 90 * n.positive_score)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score FROM hard WHERE rank <= 10
"""
SQL = {"op12_hard_negatives": OP12_SQL, "op5_revisit_resolution": OP5_SQL, "op9_url_filter": OP9_SQL}

"""URL filters: a blocked Bloom filter lets possible hits through to an exact hash join.

Everything is DataFrame expressions. The filter is a table of 512-bit blocks (eight 64-bit lanes); a listed
canonical URL picks its block by one hash and sets one bit in each lane by another. A page's URL is looked up in
its one block; only URLs whose eight bits are all set go on to the join with the list, which removes the false
positives. Both small sides are broadcast only when their counted size allows it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, checkpointed

LANES = 8
KEYS_PER_BLOCK = 32
#: Listed URLs, and blocks of the filter (72 bytes each), that may be broadcast.
BROADCAST_ROWS, BROADCAST_BLOCKS = 200_000, 500_000
#: So many rules become one expression; more of them are joined.
EXPRESSED_RULES = 256
TRACKING = "^(utm_[A-Za-z_]+|ref|fbclid|gclid)="


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def canonical(url: Column) -> Column:
    """Host without www., path without / at its end, and the query's sorted parameters without tracking ones; null without a host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    bare = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(bare != "", F.concat(bare, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, lane: int) -> Column:
    """The one bit of the key in a lane: six bits of a second hash say which."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit("lane"), key), 6 * lane).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the filter over the column `key`; blocks that no key chose have no row."""
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*(F.bit_or(_bit(F.col("key"), i)).alias(f"w{i}") for i in range(LANES)))


def _ruled(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rows (host, path) with rule and says: those of the longest rule that fits, else null."""
    if len(rules) <= EXPRESSED_RULES:
        rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
        for word, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0])):  # the last that fits counts
            fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
            rule, says = F.when(fits, host + path).otherwise(rule), F.when(fits, word).otherwise(says)
        return rows.withColumns({"rule": rule, "says": says})
    # a host and all of its ends meet the rules of that host
    table = rows.sparkSession.createDataFrame(rules, "_word string, _host string, _path string")
    numbered = checkpointed(rows.withColumn("_row", F.monotonically_increasing_id()))
    labels = F.split("host", "[.]")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = numbered.where("host != ''").select("_row", "path", F.explode(ends).alias("_host")).join(table, "_host").where(F.startswith("path", "_path"))
    rank = F.struct(F.length(F.concat("_host", "_path")), F.length("_host"), F.col("_word"))
    best = met.groupBy("_row").agg(F.max_by(F.struct(F.concat("_host", "_path").alias("rule"), F.col("_word").alias("says")), rank).alias("_best"))
    return numbered.join(best, "_row", "left").select(*rows.columns, "_best.rule", "_best.says")


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = ()) -> DataFrame:
    """pages (page_id, url, ...) with host, path, rule, verdict, listed and maybe_listed.

    listed has a column `canonical` (nulls and repeats are ignored). rules are (verdict, host, path): a rule fits
    its host and all subdomains where the path starts with the rule's; the longest host + path wins, then the
    longer host. Without a fitting rule a listed URL is blocked and any other allowed. A null url, or one without
    a host, has empty host and path and is allowed. Repeated rows are judged alike and all returned; an empty
    table gives an empty result; columns of pages other than page_id and url are not used.

    Only what the filter lets through meets the list; the rest is not dealt out for that join.
    """
    keys = checkpointed(listed.select(F.col("canonical").alias("_key")).where("_key is not null").distinct())
    rows = keys.count()
    blocks = max(1, math.ceil(rows / KEYS_PER_BLOCK))
    url = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("_key"))
    # rows without a key choose blocks by their id, so that they don't meet in one task
    url = url.withColumn("block", _block(F.coalesce("_key", F.col("page_id").cast("string"), F.lit("")), blocks))
    filter_ = bloom_blocks(keys.withColumnRenamed("_key", "key"), blocks)
    seen = url.join(F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_.hint("shuffle_hash"), "block", "left")
    hit = F.col("_key").isNotNull()
    for i in range(LANES):
        bit = _bit(F.col("_key"), i)
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(bit) == bit)
    seen = seen.select("page_id", "url", "host", "path", "_key", F.coalesce(hit, F.lit(False)).alias("maybe_listed"))
    exact = keys.withColumn("_hit", F.lit(True))
    if rows <= BROADCAST_ROWS:
        joined = seen.withColumn("_asked", F.when(F.col("maybe_listed"), F.col("_key"))).join(F.broadcast(exact.withColumnRenamed("_key", "_asked")), "_asked", "left")
    else:
        joined = seen.where("maybe_listed").join(exact.hint("shuffle_hash"), "_key", "left").unionByName(seen.where("not maybe_listed").withColumn("_hit", F.lit(None).cast("boolean")))
    judged = _ruled(joined.select("page_id", "url", "host", "path", F.coalesce("_hit", F.lit(False)).alias("listed"), "maybe_listed"), list(rules))
    verdict = F.coalesce("says", F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), "listed", "maybe_listed")

"""Chunks of texts for a vector index."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.normalise import for_chunks, strip
from palimpsest.tables import in_small_batches

TARGET, MOST, LEAST = 280, 420, 110


def structural(x: Column) -> Column:
    """Parts at blank lines, bars between spaces and bullets."""
    return F.filter(F.transform(F.split(for_chunks(x), r"\n\s*\n+|\s\|\s|[•·]"), strip), lambda p: p != "")


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"(?<=[.!?:;])\s+"), strip), lambda s: s != "")


def _pieces(text: str, most: int) -> list[str]:
    """A sentence that is too long, cut after commas, brackets or hyphens, else between words."""
    if len(text) <= most:
        return [text]
    parts = [p.strip() for p in re.split(r"(?<=[,)\-])\s+", text) if p.strip()]
    if len(parts) < 2:
        parts = text.split()
    out, held = [], ""
    for p in parts:
        longer = f"{held} {p}".strip()
        if len(longer) <= most:
            held = longer
            continue
        if held:
            out.append(held)
        held = ""
        if len(p) > most and " " in p:
            out += _pieces(p, most)
        else:
            held = p
    return out + [held] if held else out


def pack(parts: list[list[str]], target: int = TARGET, most: int = MOST, least: int = LEAST) -> list[str]:
    """Chunks of the sentences of structural parts: up to target, single sentences up to most; short ones join the one before."""
    out: list[str] = []
    for part in parts:
        whole = " ".join(part)
        if len(whole) <= most:
            out.append(whole)
            continue
        held = ""
        for s in part:
            if len(s) > most:
                out += [held] if held else []
                held = ""
                out += _pieces(s, most)
            elif held and len(held) + 1 + len(s) > target:
                out.append(held)
                held = s
            else:
                held = f"{held} {s}".strip()
        out += [held] if held else []
    merged: list[str] = []
    for c in out:
        if merged and len(c) < least and len(merged[-1]) + 1 + len(c) <= most:
            merged[-1] += f" {c}"
        else:
            merged.append(c)
    return merged


#: The same cuts as structural() and sentences(), for one text.
_PARTS, _ENDS = re.compile(r"\n\s*\n+|\s\|\s|[•·]"), re.compile(r"(?<=[.!?:;])\s+")


def chunks_of(text: str, target: int = TARGET, most: int = MOST, least: int = LEAST) -> list[str]:
    """The chunks of a text in the form of for_chunks; one that fits is one chunk, an empty one has none."""
    if len(text) <= most:
        return [text] if text else []
    parts = [[t for s in _ENDS.split(p) if (t := s.strip())] for p in _PARTS.split(text)]
    return pack([p for p in parts if p], target, most, least)


def _packed(target: int, most: int, least: int):
    @F.pandas_udf("array<string>")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else chunks_of(t, target, most, least) for t in texts])

    return packed


def chunked(rows: DataFrame, key: str, text: str = "text", target: int = TARGET, most: int = MOST, least: int = LEAST) -> DataFrame:
    """key, chunk_index (from 1), chunk_total, chunk of each non-empty text; one that fits is one chunk."""
    made = in_small_batches(rows).select(key, _packed(target, most, least)(for_chunks(F.col(text))).alias("chunks"))
    return made.select(key, F.size("chunks").alias("chunk_total"), F.posexplode("chunks").alias("at", "chunk")).select(key, (F.col("at") + 1).alias("chunk_index"), "chunk_total", "chunk")


#: Metadata that an embedded text begins with, in this order.
EMBEDDED = ["title", "theme", "area", "author", "number"]


def rechunked(rows: DataFrame, label: str, target: int = TARGET, most: int = MOST, least: int = LEAST) -> DataFrame:
    """row, text, text_plain, metadata, embedding_text of the chunks of rows (row, text, text_plain, metadata: map).

    A row of one chunk keeps its text with marks and its metadata; the others' say source_row, chunk_index and
    chunk_total. Rows without a text go.
    """
    plain = F.coalesce(F.nullif(strip(F.col("text_plain")), F.lit("")), strip(F.col("text")))
    empty = F.create_map().cast("map<string,string>")
    own = in_small_batches(rows).select("row", strip(F.col("text")).alias("_text"), plain.alias("_plain"), F.coalesce("metadata", empty).alias("_meta")).where("_plain != ''")
    cut = own.withColumn("_chunks", _packed(target, most, least)(for_chunks(F.col("_plain")))).select("row", "_text", "_plain", "_meta", F.size("_chunks").alias("_n"), F.posexplode("_chunks").alias("_at", "_chunk"))
    one = F.col("_n") == 1
    said = F.create_map(*(x for n, c in (("source_row", F.col("row")), ("chunk_index", F.col("_at") + 1), ("chunk_total", F.col("_n"))) for x in (F.lit(n), c.cast("string"))))
    kept = F.map_filter("_meta", lambda k, v: ~k.isin("source_row", "chunk_index", "chunk_total"))
    made = cut.select("row", F.when(one, F.coalesce(F.nullif("_text", F.lit("")), "_plain")).otherwise(F.col("_chunk")).alias("text"), F.when(one, F.col("_plain")).otherwise(F.col("_chunk")).alias("text_plain"), F.when(one, F.col("_meta")).otherwise(F.map_concat(kept, said)).alias("metadata"))
    return made.withColumn("embedding_text", embedding_text(F.lit(label), F.col("text_plain"), *(F.trim(F.col("metadata")[m]) for m in EMBEDDED)))


def embedding_text(label: Column, text: Column, *fields: Column) -> Column:
    """label, fields and text that are not empty, with bars between."""
    parts = F.filter(F.array(label, *fields, text), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.regexp_replace(F.array_join(parts, " | "), r"^[ |]+|[ |]+$", "")

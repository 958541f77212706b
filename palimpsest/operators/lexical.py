"""Boolean search over a corpus of books, by book and over all of them, and search by fields."""

from __future__ import annotations

import functools
import operator
import re
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.normalise import fold, for_match, match_text, only_words, sanitise, strip, without_markdown
from palimpsest.plans import boolean
from palimpsest.tables import in_small_batches

#: Matches counted in a book at most; rows shown by default and at most.
MOST_COUNTED, SHOWN, MOST_SHOWN = 200, 50, 200


def limit_of(value: int | None, default: int, low: int, high: int) -> int:
    """A caller's limit: none or 0 is the default, others are held within bounds."""
    return max(low, min(high, value or default))


def segments(cells: Column) -> Column:
    """Non-empty parts of an array of cells, split at bars, without asterisks."""
    parts = F.flatten(F.transform(F.filter(cells, lambda c: c.isNotNull()), lambda c: F.split(without_markdown(c), "[|]")))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def indexed(corpus: DataFrame, cells: Column) -> DataFrame:
    """The corpus with hay (normalised text of all segments) and segs (each normalised): what a search reads.

    Written once as a table, searches don't normalise again.
    """
    # each segment is normalised once; the whole is what is left of them, with spaces between, as if normalised as one
    own = corpus.withColumn("_segs", segments(cells)).withColumn("_plain", F.transform("_segs", lambda s: F.lower(fold(sanitise(s)))))
    there = F.filter(F.arrays_zip("_segs", "_plain"), lambda x: (x["_plain"] != "") | (sanitise(x["_segs"]) != ""))
    whole = F.array_join(F.transform(there, lambda x: x["_plain"]), " ")
    return own.withColumns({"hay": only_words(F.trim(whole)), "segs": F.transform("_plain", lambda s: only_words(F.trim(s)))}).drop("_segs", "_plain")


#: Bits of a file's signature, as long as those of bitmap_or_agg().
BITS = 4096 * 8


def _bits(text: str) -> np.ndarray:
    """The bit of each run of three letters."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = (code[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[1:-1] * np.uint64(0xBF58476D1CE4E5B9)) ^ (code[2:] * np.uint64(0x94D049BB133111EB))
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)


def signatures(index: DataFrame) -> DataFrame:
    """(path, bits) of each file of a stored index: a bitmap of hashes of all runs of three letters in its texts and segments.

    Each batch of rows gives one bitmap a file, and these are all that is shuffled.
    """

    def run(batches):
        for b in batches:
            on: dict[str, np.ndarray] = {}
            for path, text in zip(b["path"].to_pylist(), b["text"].to_pylist(), strict=True):
                own = on.setdefault(path, np.zeros(BITS, bool))  # a file without any run of three has a signature too
                own[_bits(text)] = True
            made = [np.packbits(x, bitorder="little").tobytes() for x in on.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(on), pa.string()), pa.array(made, pa.binary())], ["path", "bits"])

    every = F.concat_ws("\n", "hay", F.array_join("segs", "\n"))
    rows = in_small_batches(index).select(F.col("_metadata.file_path").alias("path"), every.alias("text"))
    return rows.mapInArrow(run, "path string, bits binary").groupBy("path").agg(F.bitmap_or_agg("bits").alias("bits"))


def _holds(literal: str) -> Column:
    """Whether the bitmap has the bits of all runs of three letters of a literal. Shorter ones can be anywhere."""

    def bit(at: int) -> Column:
        byte = F.conv(F.hex(F.substring("bits", at // 8 + 1, 1)), 16, 10).cast("int")
        return F.getbit(byte, F.lit(at % 8)) == 1

    return functools.reduce(operator.and_, (bit(at) for at in sorted(set(_bits(literal).tolist()))), F.lit(True))


def files_for(signed: DataFrame, query: str) -> list[str]:
    """Paths of the files that may have a match: one pass over their signatures, names alone come to the driver."""
    return [unquote(r.path) for r in signed.where(boolean.possible(query, _holds)).select("path").collect()]


def within(index: DataFrame, signed: DataFrame, query: str) -> DataFrame:
    """The stored index without the files that can have no match; signed is signatures() of it."""
    paths, spark = files_for(signed, query), index.sparkSession
    if not paths:
        return spark.createDataFrame([], index.schema)
    # folders such as book=x hold columns that the files don't
    root = re.split(r"/[^/]+=[^/]*/", paths[0])[0]
    reader = spark.read.schema(index.schema)
    return (reader.option("basePath", root) if root != paths[0] else reader).parquet(*paths)


def shown_text(query: str, text: Column) -> Column:
    """A text of two bars or more is shown as its head and the parts that satisfy the query; null if none does."""
    parts = F.split(text, "[|]")
    hits = F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), strip), lambda s: (s != "") & boolean.predicate(query, for_match(s)))
    joined = F.concat_ws(" ", strip(parts[0]), F.array_join(hits, " "))
    clean = F.regexp_replace(joined, r"[\\\n]", "")
    return F.when(F.size(parts) < 3, text).when(F.size(hits) > 0, clean)


def search(index: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows of the index that match, with `shown`."""
    found = index.where(boolean.row_matches(query, F.col("hay"), F.col("segs")))
    return found.withColumn("shown", shown_text(query, F.col(text))).where("shown is not null")


def top_rows(found: DataFrame, book: str, row: str, limit: int | None = None) -> DataFrame:
    """The first rows of each book in its own order, with rank."""
    n = limit_of(limit, SHOWN, 1, MOST_SHOWN)
    order = Window.partitionBy(book).orderBy(row)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def overview(found: DataFrame, book: str, limit: int | None = None) -> DataFrame:
    """book, total (MOST_COUNTED at most) and shown_count of books with matches."""
    n = limit_of(limit, SHOWN, 1, MOST_SHOWN)
    total = F.least(F.count("*"), F.lit(MOST_COUNTED))
    return found.groupBy(book).agg(total.alias("total"), F.least(F.count("*"), F.lit(n)).alias("shown_count"))


def grouped(found: DataFrame, book: str, row: str, labels: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One row for each book: total, shown_count, label and matches (array of row and shown text), by book.

    labels (book, label) is optional; a book without one has its code as label.
    """
    rows = top_rows(found, book, row, limit).groupBy(book).agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col(row), F.col("shown")))).alias("matches"))
    out = overview(found, book, limit).join(rows, book)
    if labels is None:
        return out.withColumn("label", F.col(book))
    return out.join(labels, book, "left").withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.col(book)))


def by_fields(table: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows in which each given field has the wanted text as a substring; blank wishes don't count.

    A wish of nothing but signs matches no row. Without any wish: ValueError.
    """
    asked = {c: v for c, v in wanted.items() if v and v.strip()}
    if not asked:
        raise ValueError("no field to search in")
    tests = [F.contains(F.coalesce(for_match(F.col(c)), F.lit("")), F.lit(match_text(v))) if match_text(v) else F.lit(False) for c, v in asked.items()]
    return table.where(functools.reduce(operator.and_, tests))


def books(corpus: DataFrame, book: str, known: DataFrame | None = None) -> DataFrame:
    """Books that have rows, those that are known if a table (book, label) is given, with place in order of upper-cased code."""
    there = corpus.select(book).where(F.col(book).isNotNull()).distinct()
    if known is not None:
        there = known.join(there, book, "left_semi")
    return there.withColumn("place", F.row_number().over(Window.orderBy(F.upper(book), book)))


def book_identity(there: DataFrame, known: DataFrame) -> DataFrame:
    """(code, stem, label, place) of the files that are there (stem), in order of upper-cased stem.

    known (code, stem, label, legacy: array of older stems) names them. A file that no code has is its own code and
    label; a code without a label has its stem's name.
    """
    names = known.select("code", "label", F.explode(F.concat(F.array("stem"), F.coalesce("legacy", F.array().cast("array<string>")))).alias("stem")).dropDuplicates(["stem"])
    rows = there.select("stem").distinct().join(F.broadcast(names), "stem", "left")
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.nullif(F.trim("stem"), F.lit("")), "code")
    return rows.select(F.coalesce("code", "stem").alias("code"), "stem", label.alias("label"), F.row_number().over(Window.orderBy(F.upper("stem"), "stem")).alias("place"))


def totals(overview_: DataFrame) -> DataFrame:
    """One row: books with matches and the sum of their totals."""
    return overview_.agg(F.count("*").alias("books"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


def sample_row(corpus: DataFrame, row: str, seed: int) -> DataFrame:
    """One row with text and title, drawn by the seed, with its place in order of `row` and the number of such rows.

    The draw is the smallest hash of seed and row, so no order over all rows is needed.
    """
    able = corpus.where("trim(text) != '' and trim(title) != ''")
    drawn = able.agg(F.min(F.struct(F.md5(F.concat(F.lit(f"{seed}-"), F.col(row).cast("string"))).alias("hash"), F.col(row).alias("row"))).alias("x")).select(F.col("x.row").alias("_row"))
    places = able.crossJoin(F.broadcast(drawn)).agg(F.count_if(F.col(row) <= F.col("_row")).alias("place"), F.count("*").alias("total"), F.min("_row").alias("_row"))
    return able.join(F.broadcast(places), F.col(row) == F.col("_row")).drop("_row")

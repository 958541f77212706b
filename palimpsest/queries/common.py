"""What the registered queries share: the corpus made of `documents`, and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import lexical
from palimpsest.tables import kept


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, book, text, title (first line), area, pagina."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("book"), "text", F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("lang").alias("area"), (F.floor(F.col("doc_id") / 10) + 1).alias("pagina"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with its normalised texts and segments, a table that the session's first search writes."""
    made = lambda: lexical.indexed(corpus(spark, sf_dir), F.array("text", "title", "area", F.col("doc_id").cast("string")))
    return kept("corpus", table(spark, sf_dir, "documents"), made)


def index_for(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """The files of the index that may have a match; their signatures are a table too."""
    whole = index(spark, sf_dir)
    signed = kept("corpus_signatures", table(spark, sf_dir, "documents"), lambda: lexical.signatures(whole))
    return lexical.within(whole, signed, query)


def n1(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '\s+', ' ', 'g'))"


def n3(x: str) -> str:
    return rf"regexp_replace(trim(lower(strip_accents({n1(x)}))), '[^\p{{L}}\p{{N}}_\s*]', '', 'g')"


def n6(x: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower({x})), '\s+', ' ', 'g'))"


def n7(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


CORPUS = """corpus AS (SELECT doc_id, source AS book, text, string_split(text, chr(10))[1] AS title, lang AS area, doc_id // 10 + 1 AS pagina FROM documents)"""
_SEGS = r"list_filter(list_transform(string_split(replace(concat_ws('|', text, title, area, doc_id::VARCHAR), '*', ''), '|'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
INDEX = f"""{CORPUS},
parts AS (SELECT *, {_SEGS} AS raw FROM corpus),
idx AS (SELECT * EXCLUDE (raw), {n3("array_to_string(raw, ' ')")} AS hay, list_transform(raw, lambda s: {n3("s")}) AS segs FROM parts)"""


def either(condition) -> str:
    """SQL for: the whole text or one of its segments satisfies the condition, given as a function of an expression."""
    return f"(({condition('hay')}) OR len(list_filter(segs, lambda s: {condition('s')})) > 0)"


def shown(condition) -> str:
    """SQL for the shown text: the head and those parts that satisfy the condition, of a text of two bars or more."""
    parts = r"list_transform(string_split(text, '|')[2:], lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g'))"
    hits = f"list_filter({parts}, lambda p: p <> '' AND ({condition(n3('p'))}))"
    head = r"regexp_replace(string_split(text, '|')[1], '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN len(string_split(text, '|')) < 3 THEN text WHEN len({hits}) > 0 THEN regexp_replace({head} || ' ' || array_to_string({hits}, ' '), '[\\\\\\n]', '', 'g') END"

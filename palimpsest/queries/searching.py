"""Boolean search."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import lexical
from palimpsest.queries.common import CORPUS, INDEX, Registry, corpus, either, index_for, n3, shown

R = Registry()
QUERIES, SQL = R.queries, R.sql
GAP, END = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _has(t: str):
    return lambda x: f"contains({x}, '{t}')"


def _matched(query: str, pre, pred) -> None:
    """Registers the ids found by a query, with the shown text's length."""
    name, query, pre_sql, pred_sql = query[0], query[1], pre, pred

    def run(spark, sf_dir):
        return lexical.search(index_for(spark, sf_dir, query), query).select("doc_id", "book", F.length("shown").alias("shown_length"))

    run.__name__ = name
    where = either(pred_sql) if pre_sql is None else f"{either(pre_sql)} AND {either(pred_sql)}"
    R.add(f"WITH {INDEX} SELECT doc_id, book, length({shown(pred_sql)}) AS shown_length FROM idx WHERE {where} AND ({shown(pred_sql)}) IS NOT NULL")(run)


def _both(*terms):
    return lambda x: " AND ".join(f"contains({x}, '{t}')" for t in terms)


_PLAIN = f"WITH {INDEX}, found AS (SELECT doc_id, book FROM idx WHERE {either(_has('eaux'))} AND ({shown(_has('eaux'))}) IS NOT NULL)"


@R.add(f"{_PLAIN} SELECT book, least(count(*), 200) AS total, least(count(*), 50) AS shown_count FROM found GROUP BY book")
def lex_overview_term(spark, sf_dir):
    return lexical.overview(lexical.search(index_for(spark, sf_dir, "eaux"), "eaux"), "book")


@R.add(f"{_PLAIN}, o AS (SELECT book, least(count(*), 200) AS total FROM found GROUP BY book) SELECT count(*) AS books, coalesce(sum(total), 0)::BIGINT AS total FROM o")
def lex_overview_total(spark, sf_dir):
    return lexical.totals(lexical.overview(lexical.search(index_for(spark, sf_dir, "eaux"), "eaux"), "book"))


@R.add(f"{_PLAIN}, r AS (SELECT book, doc_id, row_number() OVER (PARTITION BY book ORDER BY doc_id) AS rank, count(*) OVER (PARTITION BY book) AS n FROM found) SELECT book, least(max(n), 200) AS total, least(max(n), 3) AS shown_count, CASE WHEN book = 'src1' THEN 'One' ELSE book END AS label, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 3) AS doc_ids FROM r GROUP BY book")
def lex_groups(spark, sf_dir):
    """Books with their first rows and labels."""
    labels = spark.createDataFrame([("src1", "One"), ("src2", "")], "book string, label string")
    made = lexical.grouped(lexical.search(index_for(spark, sf_dir, "eaux"), "eaux"), "book", "doc_id", labels, 3)
    return made.select("book", "total", "shown_count", "label", F.array_join(F.transform("matches", lambda m: m["doc_id"].cast("string")), ",").alias("doc_ids"))


@R.add(f"{_PLAIN} SELECT book, doc_id, row_number() OVER (PARTITION BY book ORDER BY doc_id) AS rank FROM found QUALIFY rank <= 3")
def lex_top_rows(spark, sf_dir):
    return lexical.top_rows(lexical.search(index_for(spark, sf_dir, "eaux"), "eaux"), "book", "doc_id", 3).select("book", "doc_id", "rank")


_matched(("lex_and", "êaux mentre"), _both("eaux", "mentre"), _both("eaux", "mentre"))
_matched(("lex_or", "heitzu | ciondos"), None, lambda x: f"contains({x}, 'heitzu') OR contains({x}, 'ciondos')")
_matched(("lex_not_leak", "eaux !mentre"), lambda x: f"contains({x}, 'eaux') AND NOT contains({x}, 'mentre')", lambda x: f"contains({x}, 'eaux') AND NOT contains({x}, 'mentre')")
_matched(("lex_group", "(thea | theor) & ation"), None, lambda x: f"(contains({x}, 'thea') OR contains({x}, 'theor')) AND contains({x}, 'ation')")
_matched(("lex_phrase", '"of the"'), _has("of the"), lambda x: rf"regexp_matches({x}, '{GAP}of\s+the{END}')")
_matched(("lex_wildcard", "th*ationst"), lambda x: "true", lambda x: f"regexp_matches({x}, '{GAP}th.*ationst{END}')")
_matched(("lex_negated_group_prefilter", "!(thea ation)"), lambda x: f"NOT contains({x}, 'thea') AND contains({x}, 'ation')", lambda x: f"NOT (contains({x}, 'thea') AND contains({x}, 'ation'))")
_matched(("lex_unbalanced", "(eaux"), _has("eaux"), _has("eaux"))
_matched(("lex_underflow", "eaux &"), _has("eaux"), lambda x: "false")


@R.add(f"WITH {INDEX} SELECT doc_id, {shown(_has('erst'))} AS shown FROM idx WHERE len(string_split(text, '|')) >= 3 AND {either(_has('erst'))} AND ({shown(_has('erst'))}) IS NOT NULL")
def lex_pipe_postprocess(spark, sf_dir):
    found = lexical.search(index_for(spark, sf_dir, "erst"), "erst")
    return found.where("size(split(text, '[|]')) >= 3").select("doc_id", "shown")


@R.add(f"WITH {CORPUS} SELECT doc_id, book FROM corpus WHERE contains({n3('title')}, 'ent') AND contains({n3('area')}, 'fr') AND contains({n3('text')}, 'eaux')")
def lex_fields(spark, sf_dir):
    return lexical.by_fields(corpus(spark, sf_dir), title="ENT", area="fr", text="êaux", book=" ").select("doc_id", "book")


@R.add("SELECT source AS book, row_number() OVER (ORDER BY upper(source), source) AS place FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def books_list(spark, sf_dir):
    return lexical.books(corpus(spark, sf_dir), "book").select("book", "place")


@R.add("SELECT CASE WHEN source IN ('src1', 'src3') THEN 'C1' WHEN source = 'src2' THEN 'C2' ELSE source END AS code, source AS stem, CASE WHEN source IN ('src1', 'src3') THEN 'First' ELSE source END AS label, row_number() OVER (ORDER BY upper(source), source) AS place FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def books_named(spark, sf_dir):
    """Files of the corpus under their codes, older names too."""
    known = spark.createDataFrame([("C1", "src1", "First", ["src3"]), ("C2", "src2", "", None), ("C9", "nowhere", "x", None)], "code string, stem string, label string, legacy array<string>")
    return lexical.book_identity(corpus(spark, sf_dir).select(F.col("book").alias("stem")).where("stem is not null"), known)


@R.add(f"WITH {CORPUS}, able AS (SELECT * FROM corpus WHERE trim(text) <> '' AND trim(title) <> ''), drawn AS (SELECT doc_id FROM able ORDER BY md5('7-' || doc_id), doc_id LIMIT 1) SELECT (SELECT doc_id FROM drawn) AS doc_id, count(*) FILTER (doc_id <= (SELECT doc_id FROM drawn)) AS place, count(*) AS total FROM able")
def sample_row(spark, sf_dir):
    return lexical.sample_row(corpus(spark, sf_dir), "doc_id", 7).select("doc_id", "place", "total")

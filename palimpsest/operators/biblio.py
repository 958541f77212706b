"""Fuzzy matching of bibliographic references, grouping of references, and merging of external records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.fuzzy import best_word, grams_of, partial_words, piece_of, python_round, ratio, token_recall, word_overlap, words_of, year_score
from palimpsest.functions.normalise import biblio_text, for_biblio, for_books, for_external, for_title_score
from palimpsest.tables import stored

WEIGHTS = {"author": 0.55, "title": 0.30, "year": 0.12, "extra": 0.03}
BOOK_BOOST, CUT = 0.08, 0.03
#: Words that don't count in titles, of references and of external records.
TITLE_STOPWORDS = ["a", "as", "o", "os", "de", "do", "da", "dos", "das", "e", "em", "no", "na", "nos", "nas", "um", "uma"]
EXTERNAL_STOPWORDS = ["a", "o", "as", "os", "de", "da", "do", "das", "dos", "e", "em", "na", "no", "nas", "nos", "the", "of", "el", "la", "los", "las", "un", "una", "y", "en"]
#: Signs of an article.
ARTICLE_CUES = ["doi", "issn", "journal", "revista", "article", "volume", "vol.", "n.", "issue"]
NEW_FROM = "2023-12-06"


def field_score(query: Column, other: Column) -> Column:
    """The best of three blends of ratio, words and partial words."""
    s, w, p = ratio(query, other), word_overlap(query, other), partial_words(query, other)
    return F.greatest(s, 0.70 * w + 0.30 * s, 0.55 * w + 0.25 * s + 0.20 * p)


def title_score(query: Column, other: Column) -> Column:
    """Field score, recall of words, and the part of the query's words, but stopwords, that the other has."""
    told = F.filter(words_of(query), lambda w: ~w.isin(*TITLE_STOPWORDS))
    exact = F.when(F.size(told) > 0, F.size(F.filter(told, lambda w: F.array_contains(words_of(other), w))) / F.size(told)).otherwise(0.0)
    return 0.55 * field_score(query, other) + 0.35 * token_recall(query, other, F.lit(0.80)) + 0.10 * exact


def surname_score(query: Column, other: Column) -> Column:
    """1 if the query's last word is a word of the other, else its best ratio with one, from 0.85 on."""
    last = F.try_element_at(words_of(query), F.lit(-1))
    near = best_word(last, other)
    return F.when(last.isNull(), 0.0).when(F.array_contains(words_of(other), last), 1.0).when(near >= 0.85, near).otherwise(0.0)


def author_score(query: Column, other: Column) -> Column:
    return 0.50 * field_score(query, other) + 0.30 * token_recall(query, other, F.lit(0.84)) + 0.20 * surname_score(query, other)


def author_penalty(total: Column, title: Column, author: Column) -> Column:
    """A good title of a wrong author loses."""
    return F.when((title >= 0.70) & (author <= 0.30), F.greatest(F.lit(0.0), total - (1 - author) * 0.25)).otherwise(total)


def year_penalty(total: Column, year: Column, author: Column, title: Column) -> Column:
    return F.when(year == 0, F.greatest(F.lit(0.0), total - 0.15 * (1 + 0.5 * F.greatest(author, title)))).otherwise(total)


def match(refs: DataFrame, key: str, author: str = "", title: str = "", year: int | None = None, extra: str = "", k: int = 20) -> DataFrame:
    """The k best rows of refs (autor, titulo, tipo, extra, ano) for the given fields, with score and rank.

    Weights are shared among the fields that are given; books gain BOOK_BOOST on the rounded score.
    """
    given = {n: v for n, v in {"author": author, "title": title, "extra": extra}.items() if v}
    if not given and year is None:
        raise ValueError("nothing to match")
    text = {n: F.lit(biblio_text(v)) for n, v in given.items()}
    made, rows = {"author": (author_score, "autor"), "title": (title_score, "titulo"), "extra": (field_score, "extra")}, refs
    for n, (score, c) in made.items():
        if n not in given:
            rows = rows.withColumn(f"_s_{n}", F.lit(0.0))
            continue
        # likenesses are costly, so each value is compared once, however many rows have it
        value = F.coalesce(F.col(c), F.lit(""))
        scored = rows.select(value.alias(f"_{n}")).distinct().withColumn(f"_s_{n}", score(text[n], for_biblio(F.col(f"_{n}"))))
        rows = rows.withColumn("_value", value).join(scored, F.col("_value") == F.col(f"_{n}")).drop("_value", f"_{n}")
    rows = rows.withColumn("_s_year", year_score(F.lit(year), F.col("ano")) if year is not None else F.lit(0.0))
    names = [*given, *["year"] * (year is not None)]
    total = sum((WEIGHTS[n] * F.col(f"_s_{n}") for n in names), F.lit(0.0)) / sum(WEIGHTS[n] for n in names)
    rows = rows.withColumn("_total", total)
    if "author" in given and "title" in given:
        rows = rows.withColumn("_total", author_penalty(F.col("_total"), F.col("_s_title"), F.col("_s_author")))
    if year is not None:
        rows = rows.withColumn("_total", year_penalty(F.col("_total"), F.col("_s_year"), F.col("_s_author"), F.col("_s_title")))
    kept = rows.where(F.col("_total") > CUT)
    book = F.when(for_biblio(F.col("tipo")) == "livro", BOOK_BOOST).otherwise(0.0)
    kept = kept.withColumn("score", python_round("_total", F.lit(4)) + book)
    best = kept.orderBy(F.desc("score"), key).limit(max(1, min(20, k)))
    order = Window.orderBy(F.desc("score"), key)  # of k rows
    return best.withColumn("rank", F.row_number().over(order)).select(*refs.columns, "score", "rank")


def title_lookup(titles: DataFrame, table: DataFrame, title: str, other: str, place: str) -> DataFrame:
    """(title, place): for each title the row of table with the same normalised title, else the first of which either contains the other.

    Rows without a normalised title meet nothing. Exact matches are a hash join; the rest meets by a piece that what is
    contained has and what contains it too.
    """
    # each title is normalised once, however many rows have it
    asked = stored(titles.select(title).distinct().select(title, F.trim(for_books(F.col(title))).alias("_q")).where("_q != ''"), "asked")
    firsts = table.groupBy(F.col(other).alias("_raw")).agg(F.min(place).alias(place))
    names = stored(firsts.select(F.trim(for_books(F.col("_raw"))).alias("_t"), place).where("_t != ''").groupBy("_t").agg(F.min(place).alias(place)), "names")
    exact = asked.join(names, asked["_q"] == names["_t"]).select(title, place)
    rest = asked.join(exact.select(title), title, "left_anti")
    inside = rest.withColumn("_g", piece_of(F.col("_q"))).join(names.withColumn("_g", F.explode(grams_of(F.col("_t")))), "_g").where(F.contains("_t", "_q"))
    around = rest.withColumn("_g", F.explode(grams_of(F.col("_q")))).join(names.withColumn("_g", piece_of(F.col("_t"))), "_g").where(F.contains("_q", "_t"))
    loose = inside.select(title, place).unionByName(around.select(title, place)).groupBy(title).agg(F.min(place).alias(place))
    return exact.withColumn("method", F.lit("exact")).unionByName(loose.withColumn("method", F.lit("contains")))


def editions(found: DataFrame, asked: str, year: str, pos: str) -> DataFrame:
    """Partial matches of a book in order: `1a ed` in the question puts the oldest first, `2a ed` the newest, else as they stand."""
    low, at = biblio_text(asked), F.coalesce(F.trim(F.col(year).cast("string")).try_cast("int"), F.lit(0))
    keys = [at.asc()] if "1a ed" in low else [at.desc()] if "2a ed" in low else []
    return found.withColumn("place", F.row_number().over(Window.orderBy(*keys, pos)))


def book_code(asked: Column, codes: dict[str, str], cues: list[tuple[list[str], str]], unknown: str) -> Column:
    """The title of a book by its code, else that of the first cue all of whose words stand in the question, else `unknown`.

    codes are titles by code; cues are (words, code) in order of precedence, compared in the form of for_books.
    """
    text = for_books(asked)
    code = F.replace(F.upper(text), F.lit(" "), F.lit(""))
    out = F.lit(unknown)
    for words, c in reversed(cues):
        hit = F.lit(True)
        for w in words:
            hit = hit & F.contains(text, F.lit(w))
        out = F.when(hit, codes[c]).otherwise(out)
    for c, name in codes.items():
        out = F.when(code == c, name).otherwise(out)
    return out


def reference_parts(list_: Column, biblio_: Column, number: Column) -> Column:
    """(number, author, title, day) of an entry: its number, else n. N in a text; **Author**, Name; ***Title*** (n. N ...); a date."""
    n = F.regexp_extract(F.concat_ws("\n", list_, biblio_), r"(?i)\bn\.\s*(\d+)\b", 1)
    own = F.when(F.trim(number).rlike("^[0-9]+$"), F.trim(number)).otherwise(F.nullif(n, F.lit("")))
    author = F.nullif(F.trim(F.regexp_extract(biblio_, r"^\s*(\*\*[^*]+\*\*,\s*[^;]+);\s*", 1)), F.lit(""))
    title = F.nullif(F.trim(F.regexp_extract(biblio_, r"(?is)(\*\*\*.*?\*\*\*\s*\(n\.\s*\d+.*?\))", 1)), F.lit(""))
    return F.struct(own.try_cast("long").alias("number"), author.alias("author"), title.alias("title"), brazilian_date(biblio_).alias("day"))


#: What stands in the place of an entry, or of a text of it, that isn't there.
MISSING, WITHOUT = "verbete nao encontrado.", "sem conteudo em"


def asked_entries(asked: DataFrame, by: str, title: str, pos: str, table: DataFrame, place: str) -> DataFrame:
    """(by, pos, input, found, number, author, title, day, ref_list, ref_biblio) of the entries that lists of titles ask for.

    asked has titles (title) with their place (pos) in a list (by), any number of lists at once. A title asked for again
    in other words of the same form counts once, by its first; one without letters or digits not at all. table has
    titulo, numero, ref_list, ref_biblio and their order (place). A title that is in none has a line that says so, with
    found false; an empty text of an entry has one too.
    """
    form = F.trim(for_books(F.col(title)))
    told = asked.groupBy(by, title).agg(F.min(pos).alias(pos))  # normalised once in a list
    firsts = told.withColumn("_form", form).where("_form != ''").groupBy(by, "_form").agg(F.min_by(F.struct(F.col(pos).alias("pos"), F.col(title).alias("input")), pos).alias("x")).select(by, "x.*", "_form")
    firsts = stored(firsts, "firsts")
    # of rows with one normalised title the first counts
    found = title_lookup(firsts.select("_form").distinct(), table, "_form", "titulo", place)
    told = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("ref_list", "ref_biblio")}
    rows = table.select(place, F.coalesce("numero", F.lit("")).alias("numero"), *(v.alias(c) for c, v in told.items()))
    met = firsts.join(found.select("_form", place), "_form", "left").join(rows, place, "left").withColumn("found", F.col(place).isNotNull())
    parts = met.withColumn("_p", reference_parts(F.col("ref_list"), F.col("ref_biblio"), F.col("numero")))

    def line(c: str) -> Column:
        name = F.concat(F.lit("**"), F.col("input"), F.lit("**: "))
        return F.when(~F.col("found"), F.concat(name, F.lit(MISSING))).when(F.col(c) == "", F.concat(name, F.lit(f"{WITHOUT} `{c}`."))).otherwise(F.col(c)).alias(c)

    return parts.select(by, "pos", "input", "found", "_p.number", "_p.author", "_p.title", "_p.day", line("ref_list"), line("ref_biblio"))


def entries_text(entries: DataFrame, by: str) -> DataFrame:
    """(by, ref_list): the texts of a list's entries (asked_entries()) by number, those without one last, with blank lines between."""
    order = F.struct(F.col("number").isNull().alias("a"), "number", "pos", F.col("ref_list").alias("t"))
    return entries.groupBy(by).agg(F.array_sort(F.collect_list(order)).alias("_all")).select(by, F.array_join(F.transform("_all", lambda x: x["t"]), "\n\n").alias("ref_list"))


def grouped_references(rows: DataFrame, author: str, title: str, number: str, date: str, new_from: str = NEW_FROM, line: str | None = None) -> DataFrame:
    """part (0 regular, 1 new), author, titles, entries, first_number: titles of an author together, for the entries of a list.

    Rows are in order of number, nulls last. What is dated after `new_from` is new and comes after all regular ones. A
    row without author or title stands by itself with its `line`, if that is named. A list is what a user asked for;
    titles of an author become one line.
    """
    dated = rows.withColumn("part", F.when(F.col(date) > F.lit(new_from).cast("date"), 1).otherwise(0))
    whole = F.col(author).isNotNull() & F.col(title).isNotNull()
    at = F.struct(F.col(number).isNull().alias("last"), F.col(number).alias("n"), F.col(title).alias("t"))
    made = dated.where(whole).withColumn("_at", at).groupBy("part", author).agg(F.min("_at").alias("_first"), F.count("*").alias("entries"), F.array_sort(F.collect_list("_at")).alias("_all"))
    made = made.withColumn("titles", F.array_join(F.transform("_all", lambda x: x["t"]), "; "))
    made = made.withColumn("titles", F.concat("titles", F.when(F.col("entries") > 1, "; verbetes.").otherwise("; verbete.")))
    made = made.withColumn("first_number", F.col("_first.n")).select("part", author, "titles", "entries", "first_number")
    if line is None:
        return made
    alone = dated.where(~whole).select("part", F.lit(None).cast("string").alias(author), F.col(line).alias("titles"), F.lit(1).cast("long").alias("entries"), F.col(number).alias("first_number"))
    return made.unionByName(alone)


def richness(publisher: Column, place: Column, pages: Column, journal: Column, year: Column, authors: Column) -> Column:
    """How much is known of a record."""
    def has(c: Column) -> Column:
        return c.isNotNull() & (F.trim(c) != "")

    return sum((F.when(t, w).otherwise(0.0) for t, w in ((has(publisher), 2.0), (has(place), 1.2), (has(pages), 1.5), (has(journal), 1.0), (year.between(1500, 2100), 0.5), (has(authors), 0.5))), F.lit(0.0))


def work_key(surname: Column, title: Column) -> Column:
    return F.concat_ws("::", for_external(surname), for_external(title))


def year_of(x: Column) -> Column:
    """A year between 1500 and 2100 from the first four characters; else null."""
    y = F.substring(F.trim(x), 1, 4).try_cast("int")
    return F.when(y.between(1500, 2100), y)


def latest_works(works: DataFrame, key: Column, rich: str, year: str, pos: str) -> DataFrame:
    """The richest record of each work, of equal ones the newest, with the place of the work's first record.

    The winner is found by a partial aggregate, so a work of very many records is no group in one task.
    """
    best = F.max(F.struct(F.col(rich).alias("r"), F.coalesce(F.col(year), F.lit(-1)).alias("y"), (-F.col(pos)).alias("p"))).alias("best")
    found = works.withColumn("_key", key).groupBy("_key").agg(best, F.min(pos).alias("place"), F.count("*").alias("records"))
    return found.select((-F.col("best.p")).alias(pos), "place", "records").join(works, pos)


def natures(works: DataFrame, by: str, nature: str) -> DataFrame:
    """Drops summaries, adaptations and studies of a query that has an original."""
    has = works.groupBy(by).agg(F.max(F.when(F.col(nature) == "original", 1).otherwise(0)).alias("_original"))
    return works.join(has, by).where((F.col("_original") == 0) | ~F.col(nature).isin("resumo", "adaptacao", "estudo")).drop("_original")


def filled(works: DataFrame, more: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """works with empty fields taken from more (unique key)."""
    other = more.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    joined = works.join(other, key, "left")
    return joined.select(*(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in works.columns))


#: Weights of what two records say of a work, and what a median of their agreement is called.
AGREEMENT = {"titulo": 4.0, "ano": 3.0, "editora": 2.0, "sobrenome": 3.0}
BANDS = [(90, "Alta confiabilidade"), (75, "Confiabilidade moderada"), (60, "Confiabilidade baixa"), (0, "Confiabilidade critica")]
ONE_SOURCE = "Fonte unica"


def agreement(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How far two records agree, 0 to 100, by the fields that both have; null if they have none in common."""
    total, most = F.lit(0.0), F.lit(0.0)
    for name, weight in AGREEMENT.items():
        both = (F.coalesce(a[name], F.lit("")) != "") & (F.coalesce(b[name], F.lit("")) != "")
        total = total + F.when(both, ratio(a[name], b[name]) * weight).otherwise(0.0)
        most = most + F.when(both, weight).otherwise(0.0)
    return F.when(most > 0, total / most * 100)


def confidence(works: DataFrame, by: str, rank: str, top: int = 5) -> DataFrame:
    """(by, pairs, median, band) of each query: how far its best `top` records (titulo, ano, editora, sobrenome) agree in pairs.

    A single record is sure and its own band; without a field in common the median is 0.
    """
    best = works.where(F.col(rank) <= top)
    year = year_of(F.col("ano").cast("string")).cast("string")
    told = best.select(by, rank, for_title_score(F.col("titulo")).alias("titulo"), year.alias("ano"), *(for_external(F.col(c)).alias(c) for c in ("editora", "sobrenome")))
    a, b = told.alias("a"), told.alias("b")
    same = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col(f"a.{rank}") < F.col(f"b.{rank}")))
    score = agreement({c: F.col(f"a.{c}") for c in AGREEMENT}, {c: F.col(f"b.{c}") for c in AGREEMENT})
    per = same.select(F.col(f"a.{by}").alias(by), score.alias("score")).groupBy(by).agg(F.count("score").alias("pairs"), python_round(F.percentile("score", F.lit(0.5)), F.lit(2)).alias("median"))
    out = best.groupBy(by).agg(F.count("*").alias("_n")).join(per, by, "left")
    median = F.when(F.col("_n") < 2, 100.0).otherwise(F.coalesce("median", F.lit(0.0)))
    return out.select(by, F.coalesce("pairs", F.lit(0)).alias("pairs"), median.alias("median"), F.when(F.col("_n") < 2, ONE_SOURCE).otherwise(band(median)).alias("band"))


def band(score: Column) -> Column:
    out = F.lit(BANDS[-1][1])
    for least, name in BANDS[-2::-1]:
        out = F.when(score >= least, name).otherwise(out)
    return out


def kind_of(text: Column) -> Column:
    """`artigo` if a cue of an article stands in the text, else `livro`."""
    low, out = F.lower(text), F.lit(False)
    for cue in ARTICLE_CUES:
        out = out | F.contains(low, F.lit(cue))
    return F.when(out, "artigo").otherwise("livro")


def title_tokens(x: Column) -> Column:
    return F.filter(F.split(for_external(x), " "), lambda w: (F.length(w) > 1) & ~w.isin(*EXTERNAL_STOPWORDS))


def reference_text(authors: Column, title: Column, pages: Column, journal: Column, publisher: Column, place: Column, year: Column) -> Column:
    """One line of what is known: **Surname**, Name for each author; ***Title***; pages; journal; publisher; place; year with a full stop."""
    def part(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    names = F.transform(authors, lambda a: F.concat(F.lit("**"), a["sobrenome"], F.lit("**, "), a["nome"]))
    what = F.concat(F.lit("***"), part(title), F.lit("***"))
    return F.concat_ws("; ", names, what, part(pages), part(journal), part(publisher), part(place), F.concat(part(year.cast("string")), F.lit(".")))


def brazilian_date(x: Column) -> Column:
    """The first dd.mm.yyyy or dd/mm/yyyy in the text."""
    found = F.regexp_extract(x, r"(\d{2})[./](\d{2})[./](\d{4})", 0)
    return F.try_to_date(F.regexp_replace(found, "/", "."), "dd.MM.yyyy")

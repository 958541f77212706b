"""External bibliography: records of several services united, ranked, filtered strictly, told apart and filled.

Records are rows (source, pos, titulo, ano, editora, local, paginas_totais, revista, tipo, autores), autores an array of
(sobrenome, nome); pos is their order. Criteria are what a user filled in: author, title, year, journal, publisher,
identifier and extra. Candidates of all questions are one table with the question as a key, and each step is a plan over
it. The order of a question's records is a column (`order`), which each ranking puts its score before, so no step numbers
rows: what needs a question's first ones takes those, what asks whether any record fits is an aggregate.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.fuzzy import best_pair, ratio
from palimpsest.functions.normalise import for_external
from palimpsest.operators import biblio
from palimpsest.tables import stored

FIELDS = ["author", "title", "year", "journal", "publisher", "identifier", "extra"]
#: Words in a title that cost rank, and words that bar it where author or title is asked for.
PENALISED = ["resumo", "summary", "baseado", "based on", "adaptação", "adaptação gráfica", "hq", "graphic", "mangá", "manga", "study", "analysis", "crítica", "critica", "leitura", "comentado", "comentários", "guia", "workbook", "livro de atividades"]
BARRED = ["trivia", "summary", "resumo", "workbook", "guide", "guia", "analysis", "study", "comentado", "comentarios", "adaptação", "adaptacao"]
#: The services of each kind of work in the order they are asked, and what each needs to be asked.
SERVICES = {"livro": ["google_title", "open_library_title", "google_isbn", "google", "open_library"], "artigo": ["crossref_doi", "crossref"]}
NEEDS = {"google_title": "title", "open_library_title": "title", "google_isbn": "identifier", "crossref_doi": "identifier"}
FALLBACK = "google_any_language"
MOST_BEFORE_ENRICHING = 12


def asked(criteria: dict[str, str], query: str = "") -> str:
    """The question as one string: the query, else the filled fields with bars between; ValueError without any."""
    text = query.strip() or " | ".join(v.strip() for n in FIELDS if (v := criteria.get(n) or "").strip())
    if not text:
        raise ValueError("no field to search for")
    return text


def kind_asked(criteria: dict[str, str], text: str) -> str:
    """`artigo` or `livro`: by the identifier, then the journal, then cues in the text."""
    identifier = (criteria.get("identifier") or "").strip().lower()
    for kind, cues in (("artigo", ("10.", "doi", "issn")), ("livro", ("isbn",))):
        if any(c in identifier for c in cues):
            return kind
    if (criteria.get("journal") or "").strip():
        return "artigo"
    return "artigo" if any(c in text.lower() for c in biblio.ARTICLE_CUES) else "livro"


def _asked_columns() -> dict[str, Column]:
    return {n: F.col(f"_q_{n}") for n in FIELDS}


def _one(records: DataFrame, criteria: dict[str, str], query: str = "", kind: str | None = None) -> DataFrame:
    """records as those of one question, number 0."""
    fields = {f"_q_{n}": F.lit((criteria.get(n) or "").strip()) for n in FIELDS}
    return records.withColumns({"question": F.lit(0)} | fields | {"_q_text": F.lit(query), "_q_kind": F.lit(kind).cast("string")})


def _alone(df: DataFrame) -> DataFrame:
    return df.drop("question", "order", *(c for c in df.columns if c.startswith("_q_")))


def told(questions: DataFrame) -> DataFrame:
    """question, _q_<field>, _q_text and _q_kind of questions (question, query and FIELDS, as far as they are columns).

    The text is the query, else the filled fields with bars between; a question without any is none. The kind is told
    by the identifier, then the journal, then cues in the text.
    """
    there = {c.lower() for c in questions.columns}
    field = {n: F.trim(F.coalesce(F.col(n), F.lit(""))) if n in there else F.lit("") for n in FIELDS}
    filled = F.array_join(F.filter(F.array(*field.values()), lambda v: v != ""), " | ")
    query = F.nullif(F.trim("query"), F.lit("")) if "query" in there else F.lit(None).cast("string")
    identifier = F.lower(field["identifier"])
    kind = F.when(functools.reduce(operator.or_, (F.contains(identifier, F.lit(c)) for c in ("10.", "doi", "issn"))), "artigo").when(F.contains(identifier, F.lit("isbn")), "livro").when(field["journal"] != "", "artigo").otherwise(biblio.kind_of(F.coalesce(query, filled)))
    made = questions.select("question", *(v.alias(f"_q_{n}") for n, v in field.items()), F.coalesce(query, filled).alias("_q_text"), kind.alias("_q_kind"))
    return made.where("_q_text != ''")


def _united(rows: DataFrame) -> DataFrame:
    """Records of the services that are asked for a question's kind, with `order`; for books without any, the fallback's."""
    c, kind, none = _asked_columns(), F.col("_q_kind"), F.lit(None).cast("string")

    def names(k: str) -> Column:
        return F.array(*(F.when(c[NEEDS[s]] != "", s).otherwise(none) if s in NEEDS else F.lit(s) for s in SERVICES[k]))

    used = F.array_compact(F.when(kind == "livro", names("livro")).otherwise(names("artigo")))
    at = F.when((kind == "livro") & (F.col("source") == FALLBACK), F.size(used) + 1).otherwise(F.array_position(used, F.col("source")))
    first = rows.withColumns({"_at": at, "_regular": at <= F.size(used)}).where("_at > 0")
    some = first.groupBy("question").agg(F.bool_or("_regular").alias("_some"))
    kept = first.join(some, "question").where(F.col("_regular") | ~F.col("_some"))
    return kept.withColumn("order", F.struct("_at", "pos")).drop("_at", "_regular", "_some")


def united(records: DataFrame, kind: str, criteria: dict[str, str]) -> DataFrame:
    """The records of the services that are asked for one question of this kind; for books without any, the fallback's."""
    return _alone(_united(_one(records, criteria, kind=kind)))


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _surname() -> Column:
    return F.lower(F.coalesce(F.get("autores", F.lit(0))["sobrenome"], F.lit("")))


def _year(c: Column) -> Column:
    return F.coalesce(biblio.year_of(c), F.lit(0))


def _rich() -> Column:
    authors = F.when(F.size("autores") > 0, "x")
    return biblio.richness(F.col("editora"), F.col("local"), F.col("paginas_totais"), F.col("revista"), biblio.year_of(F.col("ano")), authors)


def _rank_score() -> Column:
    """How well a record answers its question; higher is better. Wishes that weren't made add nothing."""
    c = {n: F.lower(x) for n, x in _asked_columns().items()}
    low, title, surname, year = F.lower("_q_text"), _low("titulo"), _surname(), _year(F.col("ano"))
    people = F.lower(F.array_join(F.transform("autores", lambda a: F.trim(F.concat_ws(" ", a["nome"], a["sobrenome"]))), " "))

    def filled(x: str) -> Column:
        return F.coalesce(F.col(x), F.lit("")) != ""

    def wish(n: str, value: Column) -> Column:
        return F.when(c[n] != "", value)

    by_title, by_author = ratio(title, c["title"]), ratio(people, c["author"])
    wanted = F.when(c["year"].rlike(r"^\d{4}"), F.substring(c["year"], 1, 4).try_cast("int"))
    apart = F.abs(year - wanted)
    parts = [6.0 * ratio(title, low), 5.0 * ratio(surname, low), F.when(filled("editora"), 0.5), F.when(filled("paginas_totais"), 0.3), year / 10000.0]
    parts += [F.when(F.contains(title, F.lit(p)), -2.5) for p in PENALISED]
    parts += [F.when((F.col("tipo") == "artigo") & filled("revista"), 0.6), 1.1 * _rich()]
    parts += [wish("title", 8.0 * by_title), wish("author", 7.0 * by_author), wish("author", 3.0 * ratio(surname, c["author"]))]
    both = (c["title"] != "") & (c["author"] != "")
    parts += [F.when(both, 10.0 * (0.6 * by_title + 0.4 * by_author)), F.when(both & ((by_title < 0.45) | (by_author < 0.35)), -4.0)]
    parts.append(F.when(wanted.between(1500, 2100) & (year > 0), F.when(apart == 0, 3.0).otherwise(F.greatest(F.lit(0.0), 1.5 - 0.3 * apart))))
    parts += [wish("journal", 6.0 * ratio(_low("revista"), c["journal"])), wish("publisher", 4.0 * ratio(_low("editora"), c["publisher"]))]
    parts.append(wish("identifier", F.when(F.contains(F.concat_ws(" ", title, _low("revista"), _low("editora")), c["identifier"]), 10.0)))
    parts.append(F.when(F.col("_q_kind").isNotNull(), F.when(F.col("tipo") == F.col("_q_kind"), 2.0).otherwise(-1.5)))
    return functools.reduce(operator.add, (F.coalesce(p, F.lit(0.0)) for p in parts))


def ranked(rows: DataFrame) -> DataFrame:
    """rows with score, in the order of falling scores (equal ones keep their order)."""
    return rows.withColumn("score", _rank_score()).withColumn("order", F.struct((-F.col("score")).alias("s"), F.col("order").alias("o")))


def scored(records: DataFrame, criteria: dict[str, str], query: str, kind: str | None = None) -> DataFrame:
    """The records of one question with their score."""
    return _alone(_one(records, criteria, query, kind).withColumn("score", _rank_score()))


def _strict(rows: DataFrame) -> DataFrame:
    c = _asked_columns()
    words = biblio.title_tokens(c["author"])
    long = F.filter(words, lambda w: F.length(w) >= 3)
    surnames = F.filter(F.transform("autores", lambda a: for_external(a["sobrenome"])), lambda s: F.coalesce(s, F.lit("")) != "")
    by_author = (F.size(words) == 0) | (best_pair(F.when(F.size(long) > 0, long).otherwise(F.slice(words, -1, 1)), surnames) >= 0.86)
    t, own, asked_ = for_external(F.coalesce("titulo", F.lit(""))), biblio.title_tokens(F.col("titulo")), biblio.title_tokens(c["title"])
    barred = functools.reduce(operator.or_, (F.contains(t, F.lit(b)) for b in BARRED))
    covered = F.size(F.filter(asked_, lambda w: F.array_contains(own, w))) / F.greatest(F.lit(1), F.size(F.array_distinct(asked_)))
    fits = (F.size(own) > 0) & ((covered >= 0.6) | (ratio(t, for_external(c["title"])) >= 0.62))
    by_title = (t != "") & ~barred & ((F.size(asked_) == 0) | fits)
    # stored, as each step after it looks at the records twice: for a question as a whole and one by one
    made = stored(rows.withColumns({"_both": by_author & by_title, "_author": by_author}), "judged")
    some = made.groupBy("question").agg(F.bool_or("_both").alias("_any"))
    free = (c["author"] == "") & (c["title"] == "")
    loose = (c["title"] == "") & F.col("_author")
    return made.join(some, "question").where(free | F.when(F.col("_any"), F.col("_both")).otherwise(loose)).drop("_both", "_author", "_any")


def strict(records: DataFrame, criteria: dict[str, str]) -> DataFrame:
    """What has an author and title as asked for. If nothing has, and only the author was asked for, what has the author.

    An author fits if a relevant word of the question (three letters or more, else the last one) is a surname or 0.86
    like one. A title fits without barred words, with 0.6 of the asked words or 0.62 likeness.
    """
    return _alone(_strict(_one(records, criteria)))


def _first(rows: DataFrame, n: int, order: str = "order") -> DataFrame:
    """The first n of each question, with `rank`. Tasks pass on n rows a question at most."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(order))).where(F.col("rank") <= n)


def titles_once(rows: DataFrame, most: int) -> DataFrame:
    """The first record of each title, max(3 most, 12) of them a question; records without a title go."""
    keyed = rows.withColumn("_key", for_external(F.col("titulo"))).where("_key != ''")
    first = _first(keyed.groupBy("question", "_key").agg(F.min("order").alias("order")), max(3 * most, MOST_BEFORE_ENRICHING))
    return keyed.join(first.select("question", "_key", F.col("order").alias("_least")), ["question", "_key"]).where(F.col("order") == F.col("_least")).select(*rows.columns)


def works_once(rows: DataFrame) -> DataFrame:
    """The richest record of each work (surname and title) of a question, of equal ones the newest, in the place of the work's first record."""
    key = biblio.work_key(F.coalesce(F.get("autores", F.lit(0))["sobrenome"], F.lit("")), F.coalesce("titulo", F.lit("")))
    # the place in a question is a number here, so that of equal ones the first wins
    first = Window.partitionBy("question").orderBy("order")
    keyed = rows.withColumns({"_key": key, "_rich": _rich(), "_year": _year(F.col("ano")), "_at": F.row_number().over(first)}).where(F.trim(F.translate("_key", ":", "")) != "")
    best = keyed.groupBy("question", "_key").agg(F.max(F.struct("_rich", "_year", (-F.col("_at")).alias("a"))).alias("_best"), F.min("order").alias("_order"))
    won = keyed.join(best, ["question", "_key"]).where(F.col("_at") == -F.col("_best.a"))
    return won.withColumn("order", F.col("_order")).select(*rows.columns)


def _filled_from(rows: DataFrame, offers: DataFrame, most: int) -> DataFrame:
    o = offers.withColumns({"_rich": _rich(), "_y": biblio.year_of(F.col("ano"))})
    lacks = (F.coalesce("editora", F.lit("")) == "") | (F.coalesce("paginas_totais", F.lit("")) == "") | biblio.year_of(F.col("ano")).isNull()
    needy = _first(rows, most).where((F.col("tipo") == "livro") & lacks & (F.coalesce("titulo", F.lit("")) != "")).select("question", F.col("pos").alias("for_pos"), for_external(F.col("titulo")).alias("_t"))
    met = o.join(needy, ["question", "for_pos"])
    by = F.struct((ratio(for_external(F.col("titulo")), F.col("_t")) + F.col("_rich")).alias("s"), (-F.col("pos")).alias("p"))
    best = met.select("question", F.col("for_pos").alias("pos"), by.alias("_by"), F.struct("editora", "paginas_totais", "ano", "_y").alias("_best")).groupBy("question", "pos").agg(F.max_by("_best", "_by").alias("_best"))
    joined = rows.join(best, ["question", "pos"], "left")

    def taken(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.col(f"_best.{c}"), F.lit("")), F.col(c))

    year = F.when(biblio.year_of(F.col("ano")).isNull() & F.col("_best._y").isNotNull(), F.col("_best.ano")).otherwise(F.col("ano"))
    return joined.withColumns({"editora": taken("editora"), "paginas_totais": taken("paginas_totais"), "ano": year}).select(*rows.columns)


def filled_from(records: DataFrame, offers: DataFrame, most: int = 5) -> DataFrame:
    """The first `most` books of one question with missing publisher, pages and year taken from the best offer for them.

    offers are records with `for_pos`, the pos of the record they were found for. The best one has the highest sum of
    the titles' likeness and its own richness, of equal ones the first.
    """
    return _alone(_filled_from(_one(records, {}).withColumn("order", F.struct("pos")), offers.withColumn("question", F.lit(0)), most))


def search_many(records: DataFrame, questions: DataFrame, most: int = 5, natures: DataFrame | None = None, offers: DataFrame | None = None) -> DataFrame:
    """question and the best records for it with rank, score and reference: united, ranked, filtered, once each, filled and ranked again.

    records have the `question` that a service gave them for, and a pos of their own in it and their source; questions
    are told(). natures (titulo key `work`, `nature`, and fields to fill) and offers (with question and for_pos) are
    optional tables. A question without an answer has no row.
    """
    rows = _strict(ranked(_united(records.join(told(questions), "question"))))
    rows = titles_once(rows, most)
    if natures is not None:
        key = biblio.work_key(F.coalesce(F.get("autores", F.lit(0))["sobrenome"], F.lit("")), F.coalesce("titulo", F.lit("")))
        fields = [c for c in ("editora", "local", "paginas_totais", "revista") if c in natures.columns]
        known = natures.select(F.col("work").alias("_work"), F.col("nature").alias("_nature"), *(F.col(f).alias(f"_{f}") for f in fields))
        rows = rows.withColumn("_work", key).join(known, "_work", "left")
        may = {f: (F.col("tipo") == "artigo") if f == "revista" else F.lit(True) for f in fields}
        rows = rows.withColumns({f: F.when(may[f], F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_{f}"))).otherwise(F.col(f)) for f in fields})
        rows = biblio.natures(rows, "question", "_nature").drop("_work", "_nature", *(f"_{f}" for f in fields))
        rows = _strict(ranked(rows))
    rows = works_once(rows)
    if offers is not None:
        rows = _filled_from(rows, offers, max(most, 5))
    best = _first(_strict(ranked(rows)), most)
    line = biblio.reference_text(F.col("autores"), F.col("titulo"), F.col("paginas_totais"), F.col("revista"), F.col("editora"), F.col("local"), F.col("ano"))
    return best.withColumn("reference", line).drop("order", *(c for c in best.columns if c.startswith("_q_")))


def search(records: DataFrame, criteria: dict[str, str], query: str = "", most: int = 5, natures: DataFrame | None = None, offers: DataFrame | None = None) -> DataFrame:
    """search_many() for one question; ValueError if it asks for nothing. An empty answer is an empty table."""
    text = asked(criteria, query)
    one = records.sparkSession.createDataFrame([(0, text, *((criteria.get(n) or "").strip() for n in FIELDS))], ", ".join(["question int", "query string", *(f"{n} string" for n in FIELDS)]))
    numbered = offers.withColumn("question", F.lit(0)) if offers is not None else None
    return search_many(records.withColumn("question", F.lit(0)), one, most, natures, numbered).drop("question")

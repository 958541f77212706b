"""Scores of references, external records and their confidence against plain Python."""

import difflib
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import biblio, external
from palimpsest.sources import records

STOP = set("a as o os de do da dos das e em no na nos nas um uma".split())


def like(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def plain_score(author, title, year, row):
    """The whole score of one row, word by word."""
    norm = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()

    def field(q, c):
        w, cw = q.split(), set(c.split())
        whole, part, seq = sum(x in cw for x in w) / len(w), sum(x in c for x in w) / len(w), like(q, c)
        return max(seq, 0.7 * whole + 0.3 * seq, 0.55 * whole + 0.25 * seq + 0.2 * part)

    def recall(q, c, least):
        best = [max((like(x, y) for y in c.split()), default=0) for x in q.split()]
        return sum(1 if b >= least else b / 2 for b in best) / len(best) if c.split() else 0.0

    q, c = norm(title), norm(row[2])
    told = [x for x in q.split() if x not in STOP]
    t = 0.55 * field(q, c) + 0.35 * recall(q, c, 0.8) + 0.1 * (sum(x in c.split() for x in told) / len(told) if told else 0)
    q, c = norm(author), norm(row[1])
    last = q.split()[-1]
    near = max((like(last, y) for y in c.split()), default=0)
    a = 0.5 * field(q, c) + 0.3 * recall(q, c, 0.84) + 0.2 * (1 if last in c.split() else near if near >= 0.85 else 0)
    d = abs(row[5] - year)
    y = 1 if d == 0 else 0.6 if d == 1 else 0.3 if d <= 3 else 0
    total = (0.55 * a + 0.3 * t + 0.12 * y) / 0.97
    if t >= 0.7 and a <= 0.3:
        total = max(0, total - (1 - a) * 0.25)
    if y == 0:
        total = max(0, total - 0.15 * (1 + 0.5 * max(a, t)))
    return round(total, 4) + (0.08 if norm(row[3]) == "livro" else 0) if total > 0.03 else None


def test_match_like_plain_python(spark):
    rng = random.Random(6)
    names, words = ["Silva", "Souza", "Sousa", "Lima", "Ana", "Rui", "Eva"], "energia vital da vida um estudo geral sobre outro tema a e".split()
    rows = [(i, f"{rng.choice(names)}, {rng.choice(names)}", " ".join(rng.choices(words, k=4)), rng.choice(["Livro", "Artigo", "Livro de bolso"]), "", float(rng.randrange(1998, 2006))) for i in range(60)]
    refs = spark.createDataFrame(rows, "id int, autor string, titulo string, tipo string, extra string, ano double")
    got = biblio.match(refs, "id", author="Ana Souza", title="A energia da vida", year=2001).collect()
    expected = sorted(((s, -r[0]) for r in rows if (s := plain_score("Ana Souza", "A energia da vida", 2001, r)) is not None), reverse=True)[:20]
    assert [(round(r.score, 9), -r.id) for r in got] == [(round(s, 9), i) for s, i in expected]


def test_confidence(spark):
    rows = [
        ("a", 1, "O livro: parte", "2001", "Ed", "Silva"), ("a", 2, "Livro", "2001-05", "", "silva"), ("a", 3, "Outra", None, "ed", "Souza"),
        ("b", 1, "So um", "1999", "x", "y"), ("c", 1, "", None, "", ""), ("c", 2, "x", "2000", "p", "q"),
    ]
    got = {r.q: (r.pairs, r.median, r.band) for r in biblio.confidence(spark.createDataFrame(rows, "q string, n int, titulo string, ano string, editora string, sobrenome string"), "q", "n").collect()}
    one = (4 * like("livro parte", "livro") + 3 + 3) / 10
    two = (4 * like("livro parte", "outra") + 2 + 3 * like("silva", "souza")) / 9
    three = (4 * like("livro", "outra") + 3 * like("silva", "souza")) / 7
    assert got["a"] == (3, round(statistics.median([100 * x for x in (one, two, three)]), 2), "Confiabilidade critica")
    assert got["b"] == (0, 100.0, "Fonte unica") and got["c"] == (0, 0.0, "Confiabilidade critica")


def record(source, pos, title, year="", publisher=None, pages=None, people=(("Silva", "Ana"),), kind="livro"):
    return (source, pos, title, year, publisher, None, pages, None, kind, [tuple(p) for p in people])


SCHEMA = "source string, pos int, titulo string, ano string, editora string, `local` string, paginas_totais string, revista string, tipo string, autores array<struct<sobrenome:string,nome:string>>"


def test_external_search(spark):
    rows = [
        record("open_library", 1, "Energia vital", "2001"), record("google", 1, "Energia vital", "1999", "Editora", "90 p."), record("google", 2, "Resumo de energia vital", "2003"),
        record("google", 3, "Outro livro", "2003"), record("google_isbn", 1, "Nao pedido", "2000"), record("google_any_language", 1, "Energia vital", "2010"), record("crossref", 1, "Energia vital", "2002", kind="artigo"),
        record("google", 4, "Energia vital", "2005", people=[("Souza", "Rui")]), record("google", 5, "A energia vital hoje", "2004", None, "10 p."),
    ]
    found = spark.createDataFrame(rows, SCHEMA)
    got = external.search(found, {"author": "Ana Silva", "title": "energia vital"}).collect()
    assert [r.titulo for r in got] == ["Energia vital", "A energia vital hoje"] and got[0].ano == "1999" and [r.rank for r in got] == [1, 2]
    assert got[0].reference == "**Silva**, Ana; ***Energia vital***; 90 p.; Editora; 1999."
    only = external.united(found.where("source = 'google_any_language'"), "livro", {})
    assert only.count() == 1 and external.united(found, "artigo", {}).select("titulo").collect()[0].titulo == "Energia vital"
    assert external.search(found, {"title": "nada disso"}).count() == 0
    assert {r.titulo for r in external.strict(found.where("source = 'google'"), {"author": "Silvo"}).collect()} == set()
    assert external.strict(found, {}).count() == len(rows) and external.strict(found, {"author": "Souza"}).count() == 1
    with pytest.raises(ValueError):
        external.search(found, {})
    assert external.kind_asked({"identifier": "ISBN 1"}, "doi") == "livro" and external.kind_asked({"journal": "x"}, "") == "artigo" and external.kind_asked({}, "a n. 5") == "artigo"
    natures = spark.createDataFrame([("silva::energia vital", "original", None), ("silva::a energia vital hoje", "estudo", "X")], "work string, nature string, editora string")
    assert [r.titulo for r in external.search(found, {"author": "Ana Silva", "title": "energia vital"}, natures=natures).collect()] == ["Energia vital"]


def test_external_search_of_many_questions(spark):
    """Each question has the answer that it has alone; no window is without a key, no numbering over all rows."""
    rng = random.Random(7)
    titles, people = ["Energia vital", "A energia vital hoje", "Resumo de energia", "Outro livro", "Vida plena", "Estudo da vida"], [("Silva", "Ana"), ("Souza", "Rui"), ("Silvo", "Eva")]
    asks = [{"title": "energia vital"}, {"author": "Ana Silva"}, {"author": "Ana Silva", "title": "vida plena"}, {"author": "Zz", "year": "2001"}, {"journal": "Revista", "title": "vida"}, {"identifier": "isbn 5", "publisher": "Ed"}, {}]
    rows, schema = [], "question int, " + SCHEMA
    for q in range(len(asks)):
        for i in range(25):
            source = rng.choice(["google", "open_library", "google_title", "google_isbn", "crossref", "google_any_language"])
            rows.append((q, *record(source, i, rng.choice(titles), rng.choice(["1999", "2001", "", "x"]), rng.choice([None, "", "Ed"]), rng.choice([None, "9 p."]), [rng.choice(people)], rng.choice(["livro", "artigo"]))))
    records_ = spark.createDataFrame(rows, schema)
    questions = spark.createDataFrame([(q, *(a.get(f) for f in external.FIELDS)) for q, a in enumerate(asks)], ", ".join(["question int", *(f"{f} string" for f in external.FIELDS)]))
    offers = spark.createDataFrame([(q, p, *record("x", 1, "Energia vital", "1990", "P", "7 p.")) for q in range(len(asks)) for p in range(25)], "question int, for_pos int, " + SCHEMA)
    natures = spark.createDataFrame([("silva::energia vital", "original", None), ("souza::vida plena", "estudo", "X")], "work string, nature string, editora string")
    many = external.search_many(records_, questions, 3, natures, offers)
    got = sorted((r.question, r.rank, r.titulo, r.ano, round(r.score, 9), r.reference) for r in many.collect())
    alone = []
    for q, a in enumerate(asks[:-1]):
        alone += [(q, r.rank, r.titulo, r.ano, round(r.score, 9), r.reference) for r in external.search(records_.where(F.col("question") == q).drop("question"), a, "", 3, natures, offers.where(F.col("question") == q).drop("question")).collect()]
    assert got == sorted(alone) and len({g[0] for g in got}) >= 3
    assert "SinglePartition" not in many._jdf.queryExecution().executedPlan().toString()


def test_rank_score_like_plain_python(spark):
    row = record("google", 1, "Um Resumo da vida", "2001", "Ed", None)
    c = {"author": "Ana Silva", "title": "da vida", "year": "2003", "publisher": "ed", "identifier": "vida"}
    got = external.scored(spark.createDataFrame([row], SCHEMA), c, "da vida | Ana", "artigo").first().score
    t, people, rich = "um resumo da vida", "ana silva", 2.0 + 0.5 + 0.5
    s = 6 * like(t, "da vida | ana") + 5 * like("silva", "da vida | ana") + 0.5 + 0.2001 - 2.5 + 1.1 * rich + 8 * like(t, "da vida") + 7 * like(people, "ana silva") + 3 * like("silva", "ana silva")
    s += 10 * (0.6 * like(t, "da vida") + 0.4) + max(0, 1.5 - 0.6) + 4 * 1.0 + 10 - 1.5
    assert got == pytest.approx(s)


def test_filled_from_offers(spark):
    rows = spark.createDataFrame([record("google", 1, "Um", ""), record("google", 2, "Dois", "2000", "E", "5 p."), record("x", 3, "Tres", "", kind="artigo")], SCHEMA)
    offers = spark.createDataFrame([(1, *record("google", 1, "Um", "1999")), (1, *record("google", 2, "Um", "1998", "P", "7 p.")), (2, *record("google", 1, "Dois", "1990", "Z"))], "for_pos int, " + SCHEMA)
    got = {r.pos: (r.editora, r.paginas_totais, r.ano) for r in external.filled_from(rows, offers).collect()}
    assert got == {1: ("P", "7 p.", "1998"), 2: ("E", "5 p.", "2000"), 3: (None, None, "")}


def test_references_of_entries(spark):
    rows = [("1", None, "**Lima**, Eva; ***Tema*** (n. 12; x); 06.12.2023", "a"), ("2", "7", "**Lima**, Eva; ***Outro*** (n. 3; y); 07.12.2023", "b"), ("3", None, "**Lima**, Eva; ***Mais*** (N. 4)", "c"), ("4", None, "sem forma", "d")]
    df = spark.createDataFrame(rows, "k string, numero string, ref string, line string").withColumn("x", biblio.reference_parts(F.lit(""), F.col("ref"), F.col("numero"))).select("k", "ref", "x.*")
    got = sorted((r.part, r.author, r.titles, r.entries) for r in biblio.grouped_references(df, "author", "title", "number", "day", line="ref").collect() if r.author) + [r.titles for r in biblio.grouped_references(df, "author", "title", "number", "day", line="ref").collect() if not r.author]
    assert got == [(0, "**Lima**, Eva", "***Mais*** (N. 4); ***Tema*** (n. 12; x); verbetes.", 2), (1, "**Lima**, Eva", "***Outro*** (n. 3; y); verbete.", 1), "sem forma"]
    books = spark.createDataFrame([(1, "1999"), (2, "x"), (3, "2005")], "pos int, ano string")
    assert [r.pos for r in biblio.editions(books, "Livro 2a. ed 2a ed", "ano", "pos").orderBy("place").collect()] == [3, 1, 2]


def test_services(spark):
    google = '{"items": [{"volumeInfo": {"title": "T", "authors": ["Ana da Silva", " "], "publishedDate": "2001-05", "pageCount": 12}}, {"volumeInfo": {}}]}'
    library = '{"docs": [{"title": "U", "author_name": ["Rui"], "first_publish_year": 1999}]}'
    crossref = '{"message": {"items": [{"title": ["V"], "author": [{"given": "Eva", "family": "Lima"}], "container-title": ["R"], "issued": {"date-parts": [[2003, 1]]}, "publisher": "P"}]}}'
    df = spark.createDataFrame([(1, google, library, crossref)], "k int, g string, l string, c string")
    g, l, c = records.google_books(df, "k", "g").collect(), records.open_library(df, "k", "l").first(), records.crossref(df, "k", "c").first()
    assert (g[0].titulo, g[0].ano, g[0].paginas_totais, [tuple(a) for a in g[0].autores]) == ("T", "2001", "12 p.", [("Silva", "Ana da")]) and g[1].titulo == "" and g[1].autores == []
    assert (l.titulo, l.ano, [tuple(a) for a in l.autores], l.editora) == ("U", "1999", [("Rui", "")], None)
    assert (c.titulo, c.ano, c.revista, c.editora, c.tipo, [tuple(a) for a in c.autores]) == ("V", "2003", "R", "P", "artigo", [("Lima", "Eva")])


def test_asked_entries(spark):
    table = spark.createDataFrame([(1, "Tenepes", "12", "lista", "**Lima**, Eva; ***Tenepes*** (n. 12; x); 06.12.2023"), (2, "tenepes", "99", "outra", ""), (3, "Abertismo (n)", None, None, "sem forma n. 7"), (4, "Vazio", None, "", None)], "place int, titulo string, numero string, ref_list string, ref_biblio string")
    asked = spark.createDataFrame([("a", 1, "nada disso"), ("a", 2, "TENEPES"), ("a", 3, "tenepes "), ("a", 4, "Abertismo"), ("a", 5, " -- "), ("a", 6, "!?"), ("b", 1, "vazio"), ("b", 2, None)], "l string, n int, t string")
    got = {(r.l, r.pos): r for r in biblio.asked_entries(asked, "l", "t", "n", table, "place").collect()}
    assert set(got) - {("a", 5)} == {("a", 1), ("a", 2), ("a", 4), ("b", 1)}
    none, one, part, empty = (got[k] for k in [("a", 1), ("a", 2), ("a", 4), ("b", 1)])
    assert not none.found and none.number is None and none.ref_list == none.ref_biblio == "**nada disso**: verbete nao encontrado."
    assert one.found and (one.number, one.author, one.ref_list) == (12, "**Lima**, Eva", "lista") and part.number == 7 and part.ref_list == "**Abertismo**: sem conteudo em `ref_list`."
    assert empty.found and empty.ref_biblio == "**vazio**: sem conteudo em `ref_biblio`."
    text = {r.l: r.ref_list for r in biblio.entries_text(biblio.asked_entries(asked, "l", "t", "n", table, "place").where("pos <> 5"), "l").collect()}
    assert text["a"] == "**Abertismo**: sem conteudo em `ref_list`.\n\nlista\n\n**nada disso**: verbete nao encontrado."
    assert biblio.asked_entries(asked.limit(0), "l", "t", "n", table, "place").count() == 0 and biblio.asked_entries(asked, "l", "t", "n", table.limit(0), "place").where("found").count() == 0


def test_titles_are_normalised_once(spark):
    """Joins of a lookup read distinct normalised titles, not the rows of the table again."""
    table = spark.range(1000).select(F.col("id").alias("place"), F.concat(F.lit("Title "), F.col("id") % 3).alias("titulo"))
    titles = table.select(F.upper("titulo").alias("title")).unionByName(spark.createDataFrame([("tle 2",)], "title string"))
    found = biblio.title_lookup(titles, table, "title", "titulo", "place")
    assert "Range (" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("TITLE 0", 0, "exact"), ("TITLE 1", 1, "exact"), ("TITLE 2", 2, "exact"), ("tle 2", 2, "contains")]


def test_values_are_scored_once(spark):
    """Equal authors and titles of many rows are one comparison; rows without them still have a score."""
    refs = spark.range(60).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("Ann "), F.col("id") % 3)).alias("autor"), F.lit("a small widget").alias("titulo"), F.lit("x").alias("tipo"), F.lit("").alias("extra"), F.lit(2010).alias("ano"))
    found = biblio.match(refs, "id", author="Ann 1", title="small widget", year=2010)
    assert "HashAggregate" in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert [r.id for r in got] == list(range(1, 60, 3)) and len({r.score for r in got}) == 1
    # without an author
    alone = biblio.match(refs.where("autor is null"), "id", title="small widget").collect()
    assert [r.id for r in alone] == list(range(0, 60, 3)) and alone[0].score > 0

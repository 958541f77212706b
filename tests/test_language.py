"""The boolean language, normalisers, string likeness, chunks and other rules, by worked examples."""

import difflib
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import fuzzy, normalise
from palimpsest.operators import biblio, chunks, citations, lexical, semantic, texts, usage
from palimpsest.plans import boolean

CASES = [
    ("energia consciencia", ["energia da consciência"], True), ("conscien", ["consciencia"], True), ("conscien*", ["autoconsciencia"], False), ("proj*logia", ["projeto de biologia"], True),
    ("a !b", ["a", "b"], True), ("a !b", ["a b"], False), ("!(a b)", ["a"], False), ("!(a b)", ["b"], True), ("!(a b) | c", ["a"], True), ("!!a", ["x"], False), ("a &", ["a"], False),
    ("a -", ["a"], False), ("!a", ["a", "7"], True), ("( a", ["a"], False), ('"a b" | zz', ["a - b"], True), ('"a b"', ["a - b"], False), ("(a", ["xa"], True),
]


@pytest.mark.parametrize("query,cells,expected", CASES)
def test_boolean_language(spark, query, cells, expected):
    index = lexical.indexed(spark.createDataFrame([(cells,)], "cells array<string>"), F.col("cells"))
    assert (index.where(boolean.row_matches(query, F.col("hay"), F.col("segs"))).count() == 1) is expected


def test_query_without_content():
    for query in ("", '""', "  ", "-"):
        with pytest.raises(ValueError):
            boolean.check(query)


def test_fold_like_unicode(spark):
    sample = "".join(chr(i) for i in range(0x20, 0x600) if unicodedata.category(chr(i)) not in ("Cn", "Cc"))
    expected = "".join(c for c in unicodedata.normalize("NFD", sample) if unicodedata.category(c) != "Mn")
    assert spark.createDataFrame([(sample,)], "x string").select(normalise.fold(F.col("x"))).first()[0] == expected


def test_driver_and_column_agree(spark):
    rows = ["A  -  b\t*c* Ação!", "​x​", "Straße nº 5", ""]
    made = spark.createDataFrame([(r,) for r in rows], "x string").select(normalise.for_match(F.col("x"))).collect()
    assert [r[0] for r in made] == [normalise.match_text(r) for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=9), st.text("abc ", max_size=14))
def test_partial_like_brute_force(a, b):
    def lcs(x, y):
        rows = [[0] * (len(y) + 1)]
        for c in x:
            row = [0]
            for j, d in enumerate(y):
                row.append(rows[-1][j] + 1 if c == d else max(rows[-1][j + 1], row[j]))
            rows.append(row)
        return rows[-1][-1]

    def one(short, long):
        n = len(short)
        return max((200 * lcs(short, w) / (n + len(w)) for s in range(1 - n, len(long)) if (w := long[max(0, s) : s + n])), default=0.0)

    expected = 0.0
    if a and b:
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        expected = max(one(short, long), one(long, short) if len(a) == len(b) else 0.0)
    assert fuzzy.partial(a, b) == pytest.approx(expected)


def test_ratio(spark):
    a, b = "qabxcd", "abycdf"
    assert spark.range(1).select(fuzzy.ratio(F.lit(a), F.lit(b))).first()[0] == difflib.SequenceMatcher(None, a, b).ratio()


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "Primeira linha\nsegunda linha\n\nTerceira linha\n\n\nQuarta"), (2, "   "), (3, None)], "doc_id long, text string")
    assert [r.paragraph for r in citations.paragraphs(df).orderBy("ordinal").collect()] == ["Primeira linha segunda linha", "Terceira linha", "Quarta"]


def test_lookup_falls_back(spark):
    corpus = spark.createDataFrame([("b", i, t) for i, t in enumerate(["um texto sobre energia vital", "outra coisa diferente aqui", "passagem procurada pelos leitores assiduos"])], "file string, at int, text string")
    entries = citations.entries(corpus, "file", "at", "text")
    asked = citations.asked(spark.createDataFrame([(1, "passagem procurada por leitores assiduos"), (2, "Um texto sobre"), (3, "zzzz yyyy")], "q int, text string"), "q", "text")
    got = {r.q: (r.entry_id.ordem if r.entry_id else None, r.method) for r in citations.lookup(asked, entries, citations.postings(entries), "q").collect()}
    assert got == {1: (2, "fuzzy_refinado"), 2: (0, "inicio"), 3: (None, "sem_match")}


def test_chunks(spark):
    rng = random.Random(1)
    long = " ".join(" ".join(rng.choice(["alfa", "beta", "gama,"]) for _ in range(9)) + "." for _ in range(40))
    made = chunks.pack([[s + "." for s in long.split(". ")]], 120, 160, 50)
    assert len(made) > 1 and all(len(c) <= 160 for c in made)
    df = spark.createDataFrame([(1, long), (2, "curto"), (3, ""), (4, None)], "id int, text string")
    rows = chunks.chunked(df, "id").collect()
    assert {r.id for r in rows} == {1, 2} and all(len(r.chunk) <= chunks.MOST for r in rows)
    assert [r.chunk_index for r in rows if r.id == 1] == list(range(1, max(r.chunk_total for r in rows) + 1))


def test_recommendation(spark):
    assert spark.range(1).select(semantic.recommend(F.lit(0.4968))).first()[0] == 0.52
    sizes = [spark.range(1).select(semantic.pool_size(k, F.lit(1000))).first()[0] for k in (1, 5, 10, 50)]
    assert sizes == [4, 20, 40, 50]


def test_reranking(spark):
    rows = [("i", 1, 1, "trecho generico sobre assistencia e convivencia", {"a": ""}, [0.91, 0.0]), ("i", 2, 2, "maturidade assistencial aplicada no cotidiano", {"title": "Maturidade assistencial"}, [0.89, 0.0])]
    index = spark.createDataFrame(rows, "index_id string, pos int, row int, text string, metadata map<string,string>, embedding array<double>")
    best = semantic.search(index, semantic.vector([1.0, 0.0]), "maturidade assistencial", 1).collect()
    assert [r.row for r in best] == [2] and best[0].score > best[0].semantic and best[0].total == 2


def test_variants():
    assert "dupla evolutiva" in semantic.query_variants("duplismo")[2][0] and "duplismo" in semantic.query_variants("a dupla evolutiva")[1][0]
    context = semantic.contextual_variants("recin", "reciclagem na vida", ["a", " ", "b"], [("t", "m"), ("u", "")])
    assert [w for _, w in context] == [1.0, 0.84, 0.72, 0.90, 0.72, 0.64] and context[4][0] == "a, b" and context[5][0] == "t: m"
    assert semantic.query_variants("maturidade assistencial") == [("maturidade assistencial", 1.0)]
    assert "reciclagem intraconsciencial" in semantic.query_variants("recin na invexis")[1][0]


def test_cost(spark):
    row = spark.range(1).select(usage.cost_brl(F.lit("gpt-5.4-mini"), F.lit(1000), F.lit(200), F.lit(500)).alias("brl")).first()
    assert row.brl == pytest.approx(0.0157575) and row.brl / usage.BRL_A_USD == pytest.approx(0.002865)


def test_hyphens(spark):
    rows = spark.createDataFrame([("uma pala-vra e auto-estima, bem-vindo, a-b",)], "x string").select(texts.joined_hyphens(F.col("x"))).first()
    assert rows[0] == "uma palavra e auto-estima, bem-vindo, a-b"


def test_biblio_match(spark):
    refs = spark.createDataFrame([(1, "Silva, Ana", "Energia vital", "Livro", "", 2001.0), (2, "Souza, Rui", "Outro tema", "Artigo", "", 1990.0)], "id int, autor string, titulo string, tipo string, extra string, ano double")
    best = biblio.match(refs, "id", author="Ana Silva", title="energia vital", year=2001).collect()
    assert best[0].id == 1 and best[0].rank == 1
    with pytest.raises(ValueError):
        biblio.match(refs, "id")


def test_fields_and_limits(spark):
    df = spark.createDataFrame([("Ação", "x"), (None, "y")], "a string, b string")
    assert lexical.by_fields(df, a="acao").count() == 1 and lexical.by_fields(df, a="--").count() == 0
    with pytest.raises(ValueError):
        lexical.by_fields(df, a=" ")
    assert [lexical.limit_of(x, 50, 1, 200) for x in (None, 0, -3, 7, 999)] == [50, 50, 1, 7, 200]


def test_cards(spark):
    from palimpsest.operators import cards

    df = spark.createDataFrame([({"title": "T", "area": "x", "raw_title": "R"}, {"title": "U", "area": "x", "page": "3", "z": " "}), ({"title": "T"}, {"title": "T"})], "base map<string,string>, raw map<string,string>")
    made = [r.m for r in df.select(cards.merged_metadata(F.col("base"), F.col("raw")).alias("m")).collect()]
    assert made == [{"title": "T", "area": "x", "raw_title": "R", "raw_title_2": "U", "page": "3"}, {"title": "T"}]
    meta = {"tema": "Tema", "autor": "E.Q.", "author": "e.q.", "title": "tema ", "number": "12", "pagina": "4", "numero": "12", "Area": "A", "book": "LO", "sourcebook": "L"}
    shown = spark.createDataFrame([(meta,)], "m map<string,string>").select(cards.metadata_entries(F.col("m"))).first()[0]
    assert shown == ["L", "tema", "Area: A", "author: e.q.", "p. 4", "numero: 12", "book: LO"]
    rows = spark.createDataFrame([("p|q", "m", "b", "t", "4", 97.32, "inicio"), (None, None, None, None, None, None, None)], "a string, b string, c string, d string, e string, f double, g string")
    lines = [r.line for r in cards.citation_rows(rows, "a", "b", "c", "d", "e", "f", "g").collect()]
    assert lines == ["| p\\|q | m | b | t | 4 | 97.32 | inicio |", "| N/D | N/D | N/D | N/D | N/D | 0.00 | sem_match |"]
    assert cards.highlight_terms('abc* & "de fgh" !zz') == ["de fgh", "abc"]
    one = spark.createDataFrame([('"Pergunta" | **W:** w: Resposta', "**b** *i* __c__ _d_ a_b_c ***e*** <x> [l](http://a)", "<b>b</b> <i>i</i>&lt;<br>x", "Termo: abc* \"de fgh\" !zz abc | Total: 3")], "q string, m string, h string, s string")
    got = one.select(cards.answer_text(F.col("q")), cards.inline_html(F.col("m")), cards.inline_markdown(F.col("h")), cards.numbered(F.lit(3), F.lit(12)), cards.dictionary_card(F.lit("t"), F.array(F.lit("d")), F.array(F.lit("s")), F.array().cast("array<string>")), cards.summary_terms(F.col("s"))).first()
    link = '<a href="http://a" target="_blank" rel="noopener noreferrer">l</a>'
    assert tuple(got) == ('**"Pergunta"** | **W:** Resposta', f"<strong>b</strong> <em>i</em> <strong>c</strong> <em>d</em> a_b_c <strong><em>e</em></strong> &lt;x&gt; {link}", "**b** *i*<\nx", "03", "**t**\n- d\nSinonimos: s", ["de fgh", "abc", "zz"])
    entry = spark.range(1).select(cards.entry_card(F.lit("T"), F.lit(" "), F.lit("A"), F.lit(None).cast("int"), F.lit("2001"), F.lit("corpo"), F.lit("HTTP://x/y.pdf")), cards.entry_card(*(F.lit(None).cast("string"),) * 6, F.lit("ftp://x"))).first()
    assert entry[0] == "**T** (*s/area*) ● *A* ● # ? ● 2001\ncorpo\n[PDF](HTTP://x/y.pdf)" and entry[1] == "**s/titulo** (*s/area*) ● *s/autor* ● # ? ● s/data"
    found = spark.createDataFrame([("g", 2, "b", "(**B**)", {"x": "1"}), ("g", 1, "a | c", "(**A**)", {"row": "5"}), ("g", 3, " ", "(**C**)", None)], "k string, n int, t string, s string, m map<string,string>")
    made = cards.search_cards(found, ["k"], "n", "t", "s", "m").withColumns({"shown": F.lit(2), "total": F.lit(3), "label": F.lit("L")})
    assert cards.overview_cards(made, "k", "label", "shown", "total", "cards").first().markdown == "## L (2/3)\n\na \n c\n(**A**)\n\nb\n(**B**)\nx: 1"


def test_markdown_blocks(spark):
    from palimpsest.operators import cards

    text = "# T\n\n| a | b |\n| :--- | ---: |\n| 1 | **2** |\n| x\\|y | z |\n| only |\nend | here\n### S"
    got = {r.k: r.html for r in cards.blocks_html(spark.createDataFrame([(1, text), (2, " "), (3, "a|b")], "k int, t string"), "k", "t").collect()}
    cell = lambda tag, at, x: f'<{tag} style="text-align:{at}">{x}</{tag}>'
    head, one, two = (f"{cell(t, 'left', x)}{cell(t, 'right', y)}" for t, x, y in (("th", "a", "b"), ("td", "1", "<strong>2</strong>"), ("td", "x|y", "z")))
    assert got == {1: f"<h1>T</h1><br/><table><thead><tr>{head}</tr></thead><tbody><tr>{one}</tr><tr>{two}</tr></tbody></table><p>| only |</p><p>end | here</p><h3>S</h3>", 3: "<p>a|b</p>"}


def test_definitions(spark):
    from palimpsest.functions import definitions

    made = definitions.normalised(["1. MORADIA; habitação", "2. Moradia", "SINÔNIMOS: LAR"])
    assert "Habitação" in made and any("Sinonimo" in d for d in made) and not any(d.startswith("Sinonimo") for d in made)
    assert definitions.normalised(["lugar onde se vive", "LAR"]) == ["Lugar onde se vive. Sinonimo: lar."]
    assert definitions.normalised(["s.f.", "adj", "s.m. casa &amp; lar  [nota]"]) == ["S.m. casa & lar"]
    assert definitions.clean_definition("12. 3. ca. casa LAR MORADA: onde se vive ") == "Casa Sinonimos: lar, morada. onde se vive"
    assert definitions.split_senses("1. um 2. dois; tres") == ["1. um", "2. dois; tres"] and definitions.split_senses("um ; dois;tres") == ["um", "dois;tres"]
    assert definitions.once(["Um", " um ", "", "dois <b>x</b>"]) == ["Um", "dois x"]
    df = spark.createDataFrame([(["um", "dois", "Um"],), (None,)], "d array<string>")
    assert [r[0] for r in df.select(definitions.definitions("d")).collect()] == [["Um", "Dois"], None]


def test_nested_metadata(spark):
    from palimpsest.operators import semantic

    texts = ['{"a": "Um", "b": {"z": "dois", "c": ["tres", {"x": "fundo"}], "y": 4}, "d": ["cinco", null, {"k": "fundo"}, true], "e": null, "f": " ", "g": "*seis*"}', '{"' + '", "'.join(f'k{i}": "v{i}' for i in range(30)) + '"}', "[1]", "no", None, "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.x for r in df.select("i", semantic.nested_metadata_text(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == ["um dois 4 cinco true seis", " ".join(f"v{i}" for i in range(16)), "", "", "", ""]


def test_entry_segments(spark):
    from palimpsest.functions.normalise import nfkc
    from palimpsest.operators import dictionary

    texts = ["<b>a</b> ( editar ) b , c ;d ( e ) [ f ]", "xx[F.: y] -", "ﬁm ½ e\u0301", " - a\n\tb . ", "a [b a[1 [[c", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.x for r in df.select("i", dictionary.segment(nfkc(F.col("t"))).alias("x")).orderBy("i").collect()]
    assert got == ["a b, c;d (e) [f]", "xx [F.: y]", "fim 1⁄2 é", "a b.", "a [b a[1 [ [c", ""]

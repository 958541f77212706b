"""Dictionary pages of five sources, entries, related words, and what is merged of them."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import dictionary

PAGES = {
    "Aulete": '<p>1. primeira coisa: "um exemplo bem longo"</p><p>nada</p><p>sf. outra coisa</p><p>Do lat. res</p>',
    "Priberam": "<p>1. antes</p><p>nome feminino</p><p>1. primeira</p><p>uma frase longa que vem depois do numero</p><p>Etimologia: latim</p><p>ex.: mostra</p><p>2. segunda</p>",
    "Dicio": '<p class="significado">coisa que ha</p><p class="adicional sinonimos">Sinonimos: algo, objeto ,</p><q>Uma citacao</q><div><em>outra</em><span>Etimologia (origem)</span></div>',
    "Wiktionary": '<ol><li>fora do conteudo que nao conta</li></ol><div id="mw-content-text"><h2>Etimologia</h2><p>Do latim</p><p>res</p><p>rei</p><h2>Nome</h2><ol><li>curta</li><li>definicao bem longa aqui <ul><li>um exemplo</li></ul></li></ol></div>',
    "Michaelis": '<div class="verbete"><acn>1</acn> coisa <b>boa</b> . <abt>exemplo um</abt><acn>2</acn> outra</div><div class="col-md-4">Veja tambem objeto, ser e algo</div>',
}


def test_five_sources(spark):
    rows = [("coisa", s, h) for s, h in PAGES.items()] + [("coisa", "Outro", "<p>1. x</p>"), ("nada", "Aulete", None), ("nada", "Dicio", "")]
    got = {(r.term, r.source): r for r in dictionary.extracted(spark.createDataFrame(rows, "term string, source string, html string"), "term").collect()}
    a, p, d, w, m = (got["coisa", s] for s in ("Aulete", "Priberam", "Dicio", "Wiktionary", "Michaelis"))
    assert a.ok and a.definitions == ['Primeira coisa: "um exemplo bem longo"', "Sf. outra coisa"] and a.etymology == "Do lat. res" and a.examples == ["um exemplo bem longo"]
    assert p.definitions == ["Primeira", "Segunda"] and p.etymology == "Etimologia: latim" and p.examples == ["ex.: mostra"]
    assert d.definitions == ["Coisa que ha"] and d.synonyms == ["algo", "objeto"] and d.examples == ["Uma citacao", "outra"] and d.etymology == "Etimologia (origem)"
    assert w.definitions == ["Definicao bem longa aqui um exemplo"] and w.examples == ["um exemplo"] and w.etymology == "Do latim res"
    assert m.definitions == ["Coisa boa. exemplo um", "Outra"] and m.examples == ["exemplo um"] and m.synonyms == ["objeto", "ser", "algo"]
    assert not got["coisa", "Outro"].ok and got["nada", "Aulete"].error == dictionary.NO_DEFINITION and got["nada", "Dicio"].definitions == []
    assert a.quality == pytest.approx(100 + 2 * 2.2 + 3)


def test_ranking_and_merging(spark):
    rows = [("t", "Dicio", True, ["Um", "dois"], ["x"], ["e"], None), ("t", "Aulete", True, ["um", "tres"], ["y", "X"], [], "lat."), ("t", "Wiktionary", False, [], [], [], "no"), ("u", "Dicio", False, [], [], [], None)]
    stages = dictionary.stages(spark.createDataFrame([(*r, None) for r in rows], "term string, source string, ok boolean, definitions array<string>, synonyms array<string>, examples array<string>, etymology string, error string"))
    got = {r.term: r for r in dictionary.merged(stages, "term").collect()}
    assert got["t"].definitions == ["Um", "Tres", "Dois"] and got["t"].synonyms == ["y", "X"] and got["t"].etymology == "lat."
    assert got["t"].sources_ok == ["Aulete", "Dicio"] and got["t"].sources_failed == ["Wiktionary"] and got["u"].definitions == [] and got["u"].sources_ok == []
    many = spark.createDataFrame([("t", "Priberam", True, [f"d{i}" for i in range(20)], [f"s{i}" for i in range(20)], [f"e{i}" for i in range(9)], None, 90.0)], "term string, source string, ok boolean, definitions array<string>, synonyms array<string>, examples array<string>, etymology string, quality double")
    row = dictionary.merged(many, "term", "precedence").first()
    assert (len(row.definitions), len(row.synonyms), len(row.examples)) == (12, 14, 6)


def test_updated_entry(spark):
    texts = ["(coi.sa) s.f. 1. aquilo que ha ( editar ) , tudo 2. outra [F.: nao] mais [F.: Do lat. causa ]", "so um texto", "", None, "(x) adj. 12. doze [f.: aberto"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(dictionary.updated_entry(F.col("t")).alias("e")).select("e.*").collect()
    first = rows[0]
    assert first.pronunciation == "coi.sa" and first.grammar == "s.f." and first.etymology == "Do lat. causa"
    assert [tuple(d) for d in first.definitions] == [(1, "aquilo que ha, tudo"), (2, "outra [F.: nao] mais")]
    assert [tuple(d) for d in rows[1].definitions] == [(1, "so um texto")] and rows[2].definitions == []
    assert rows[4].etymology is None and [d["index"] for d in rows[4].definitions] == [12]


def test_analogic(spark):
    word = '<span class="word">{}</span>'.format
    group = lambda *w: f'<span class="analog_group">{"".join(map(word, w))}</span>'
    page = f"""<div class="keyword"><h2>fora</h2>{group("z")}</div><div id="analogico_aulete"><div id="hidden_content">
      <div class="keyword"><h2>Ordem</h2>{group("a", "A", "b")}<h3>Subst.</h3>{group("c")}{group("C", "d")}<h3>Vazia</h3><h3>Verbo</h3>{group("e")}</div>
      <div class="keyword"><h2>Nada</h2><h3>x</h3></div><div class="keyword">{group("f")}</div></div></div>"""
    rows = dictionary.analogic(spark.createDataFrame([(1, page), (2, "<p>x</p>"), (3, None)], "id int, html string"), "id").collect()
    assert [(r.id, r.title, r.term_count) for r in rows] == [(1, "Ordem", 5)]
    assert [(c.label, c.group_count, c.term_count, c.groups, c.terms) for c in rows[0].classes] == [
        ("Sem classe", 1, 2, [["a", "b"]], ["a", "b"]), ("Subst.", 2, 2, [["c"], ["C", "d"]], ["c", "d"]), ("Verbo", 1, 1, [["e"]], ["e"]),
    ]


def test_senses_and_examples(spark):
    df = spark.createDataFrame([('x 1) um 2) dois; 123. tres',), ("a;b; c",), ('"curta" “um texto “bem longo” fim',)], "t string")
    got = df.select(dictionary.senses(F.col("t")).alias("s"), dictionary.examples(F.col("t")).alias("e")).collect()
    assert got[0].s == ["x 1) um 2) dois;", "123. tres"] and got[1].s == ["a;b", "c"] and got[2].e == [" “um texto “bem longo"]
    with pytest.raises(ValueError):
        dictionary.check_term(" ")
    with pytest.raises(ValueError):
        dictionary.check_term("x" * 81)
    assert dictionary.check_term(" a ") == "a"

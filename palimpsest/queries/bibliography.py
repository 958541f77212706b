"""Bibliography: parts as reference rows with suppliers as authors, orders as references of customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import fuzzy
from palimpsest.operators import biblio, external
from palimpsest.queries.common import Registry, n7, table

R = Registry()
QUERIES, SQL = R.queries, R.sql
REFS = "refs AS (SELECT p_partkey, s_name AS autor, p_name AS titulo, p_type AS tipo, p_brand AS extra, 1990 + p_size AS ano FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) + (SELECT min(s_suppkey) FROM supplier))"
WANTED = "green part 12"


def _refs(spark, sf_dir):
    """Each part with one supplier, by number."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    n = s.agg(F.count("*").alias("n"), F.min("s_suppkey").alias("low"))
    joined = p.crossJoin(F.broadcast(n)).withColumn("s_suppkey", F.col("p_partkey") % F.col("n") + F.col("low")).join(s, "s_suppkey")
    return joined.select("p_partkey", F.col("s_name").alias("autor"), F.col("p_name").alias("titulo"), F.col("p_type").alias("tipo"), F.col("p_brand").alias("extra"), (1990 + F.col("p_size")).alias("ano"))


_WORDS = "regexp_extract_all({x}, '[a-z0-9]+')"


@R.add(f"WITH {REFS} SELECT p_partkey, len(list_filter({_WORDS.format(x=repr(WANTED))}, lambda w: list_contains({_WORDS.format(x=n7('titulo'))}, w))) / 3.0::DOUBLE AS score FROM refs")
def bib_overlap(spark, sf_dir):
    return _refs(spark, sf_dir).select("p_partkey", fuzzy.word_overlap(F.lit(WANTED), biblio.for_biblio(F.col("titulo"))).alias("score"))


@R.add(f"WITH {REFS} SELECT p_partkey, len(list_filter({_WORDS.format(x=repr(WANTED))}, lambda w: contains({n7('titulo')}, w))) / 3.0::DOUBLE AS score FROM refs")
def bib_partial(spark, sf_dir):
    return _refs(spark, sf_dir).select("p_partkey", fuzzy.partial_words(F.lit(WANTED), biblio.for_biblio(F.col("titulo"))).alias("score"))


@R.add(f"WITH {REFS} SELECT p_partkey, CASE abs(ano - 2010) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.3::DOUBLE WHEN 3 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS score FROM refs")
def bib_year(spark, sf_dir):
    return _refs(spark, sf_dir).select("p_partkey", fuzzy.year_score(F.lit(2010), F.col("ano")).alias("score"))


@R.add("""WITH p AS (SELECT p_partkey, (p_size % 10) / 10.0::DOUBLE AS t, (p_partkey % 7) / 10.0::DOUBLE AS a FROM part),
q AS (SELECT *, CASE WHEN t >= 0.7::DOUBLE AND a <= 0.3::DOUBLE THEN greatest(0.0::DOUBLE, 0.5::DOUBLE - (1 - a) * 0.25::DOUBLE) ELSE 0.5::DOUBLE END AS total FROM p)
SELECT p_partkey, total AS after_author, CASE WHEN p_partkey % 2 = 0 THEN greatest(0.0::DOUBLE, total - 0.15::DOUBLE * (1 + 0.5::DOUBLE * greatest(a, t))) ELSE total END AS after_year FROM q""")
def bib_penalties(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") % 10) / 10.0).alias("t"), ((F.col("p_partkey") % 7) / 10.0).alias("a"))
    total = biblio.author_penalty(F.lit(0.5), F.col("t"), F.col("a"))
    return p.select("p_partkey", total.alias("after_author"), biblio.year_penalty(total, F.col("p_partkey") % 2, F.col("a"), F.col("t")).alias("after_year"))


@R.add(None)
def bib_match(spark, sf_dir):
    return biblio.match(_refs(spark, sf_dir), "p_partkey", author="Supplier 3", title="small widget", year=2010)


_WORKS = f"{REFS}, works AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE extra END AS editora, lower(split_part(titulo, ' ', 1)) || '::' || lower(extra) AS key, CASE p_partkey % 4 WHEN 0 THEN 'original' WHEN 1 THEN 'resumo' WHEN 2 THEN 'estudo' ELSE 'outro' END AS nature FROM refs)"


def _works(spark, sf_dir):
    nature = F.get(F.array(*map(F.lit, ["original", "resumo", "estudo", "outro"])), (F.col("p_partkey") % 4).cast("int"))
    first = F.element_at(F.split("titulo", " "), 1)
    return _refs(spark, sf_dir).withColumns({"editora": F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("extra")), "key": F.concat(F.lower(first), F.lit("::"), F.lower("extra")), "nature": nature})


@R.add(f"WITH {_WORKS} SELECT p_partkey, (CASE WHEN editora <> '' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) + 1.2::DOUBLE + (CASE WHEN ano BETWEEN 1500 AND 2100 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) + 0.5::DOUBLE AS score FROM works")
def ext_richness(spark, sf_dir):
    return _works(spark, sf_dir).select("p_partkey", biblio.richness(F.col("editora"), F.col("tipo"), F.lit(""), F.lit(None).cast("string"), F.col("ano"), F.col("autor")).alias("score"))


@R.add(f"WITH {_WORKS} SELECT key, min(p_partkey) AS place, arg_max(p_partkey, (CASE WHEN editora <> '' THEN 1 ELSE 0 END, ano, -p_partkey)) AS p_partkey, count(*) AS records FROM works GROUP BY key")
def ext_dedup_latest(spark, sf_dir):
    w = _works(spark, sf_dir).withColumn("rich", F.when(F.col("editora") != "", 1).otherwise(0))
    return biblio.latest_works(w, F.col("key"), "rich", "ano", "p_partkey").select("key", "place", "p_partkey", "records")


@R.add(f"WITH {_WORKS}, known AS (SELECT *, bool_or(nature = 'original') OVER (PARTITION BY key) AS original FROM works) SELECT p_partkey, nature FROM known WHERE NOT original OR nature NOT IN ('resumo', 'estudo', 'adaptacao')")
def ext_nature_filter(spark, sf_dir):
    return biblio.natures(_works(spark, sf_dir), "key", "nature").select("p_partkey", "nature")


@R.add(f"WITH {_WORKS}, more AS (SELECT key, max(nullif(editora, '')) AS editora FROM works GROUP BY key) SELECT p_partkey, coalesce(nullif(w.editora, ''), m.editora) AS editora FROM works w LEFT JOIN more m USING (key)")
def ext_enrich(spark, sf_dir):
    w = _works(spark, sf_dir)
    more = w.groupBy("key").agg(F.max(F.nullif("editora", F.lit(""))).alias("editora"))
    return biblio.filled(w, more, "key", ["editora"]).select("p_partkey", "editora")


@R.add("SELECT p_partkey, CASE WHEN p_size * 2 >= 90 THEN 'Alta confiabilidade' WHEN p_size * 2 >= 75 THEN 'Confiabilidade moderada' WHEN p_size * 2 >= 60 THEN 'Confiabilidade baixa' ELSE 'Confiabilidade critica' END AS band FROM part")
def ext_confidence_bands(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", biblio.band(F.col("p_size") * 2).alias("band"))


@R.add(None)
def ext_confidence(spark, sf_dir):
    from pyspark.sql import Window

    w = _works(spark, sf_dir).withColumn("sobrenome", F.element_at(F.split("autor", "#"), -1)).withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("p_partkey")))
    return biblio.confidence(w, "key", "rank")


@R.add(f"WITH {_WORKS} SELECT p_partkey, concat_ws('; ', '**' || split_part(autor, '#', 1) || '**, ' || split_part(autor, '#', 2), '***' || titulo || '***', (ano - 1900) || ' p.', nullif(editora, ''), tipo, ano::VARCHAR || '.') AS line FROM works")
def ext_reference_text(spark, sf_dir):
    a = F.split("autor", "#")
    people, pages = F.array(F.struct(a[0].alias("sobrenome"), a[1].alias("nome"))), F.concat((F.col("ano") - 1900).cast("string"), F.lit(" p."))
    return _works(spark, sf_dir).select("p_partkey", biblio.reference_text(people, F.col("titulo"), pages, F.lit(None).cast("string"), F.col("editora"), F.col("tipo"), F.col("ano")).alias("line"))


@R.add(None)
def ext_search(spark, sf_dir):
    """Parts, forty a question, as records of two services; each question asks for the title and author of its first part."""
    w = _works(spark, sf_dir).withColumn("question", F.floor(F.col("p_partkey") / 40))
    source = F.when(F.col("p_partkey") % 2 == 0, "google").otherwise("open_library")
    a = F.split("autor", "#")
    records = w.select("question", source.alias("source"), F.col("p_partkey").alias("pos"), "titulo", F.col("ano").cast("string").alias("ano"), "editora", F.lit(None).cast("string").alias("local"), F.when(F.col("p_partkey") % 4 != 0, "12 p.").alias("paginas_totais"), F.lit(None).cast("string").alias("revista"), F.lit("livro").alias("tipo"), F.array(F.struct(a[0].alias("sobrenome"), a[1].alias("nome"))).alias("autores"))
    questions = w.groupBy("question").agg(F.min_by("titulo", "p_partkey").alias("title"), F.min_by(F.element_at(a, 1), "p_partkey").alias("author"))
    return external.search_many(records, questions).select("question", "rank", "titulo", "ano", F.round("score", 6).alias("score"), "reference")


_GROUPED = """rows AS (SELECT CASE WHEN o_orderdate > DATE '1996-06-30' THEN 1 ELSE 0 END AS part, c_name AS author, o_orderkey AS number, o_orderpriority || ' ' || o_orderkey AS title FROM orders JOIN customer ON o_custkey = c_custkey)"""


@R.add(f"WITH {_GROUPED} SELECT part, author, string_agg(title, '; ' ORDER BY number, title) || CASE WHEN count(*) > 1 THEN '; verbetes.' ELSE '; verbete.' END AS titles, count(*) AS entries, min(number) AS first_number FROM rows GROUP BY part, author")
def refs_grouped(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumn("title", F.concat_ws(" ", "o_orderpriority", "o_orderkey"))
    return biblio.grouped_references(o, "c_name", "title", "o_orderkey", "o_orderdate", "1996-06-30").withColumnRenamed("c_name", "author")


#: Titles that are asked for: types of parts, their first word with the second, and all of them with a word more.
_ASKED = "SELECT DISTINCT unnest([lower(p_type), substr(p_type, 1, length(p_type) - 2), p_type || ' extra', substr(p_type, 3)]) AS q FROM part"


@R.add(f"""WITH t AS ({_ASKED}), r AS (SELECT p_partkey, {n7('p_type')} AS t FROM part), n AS (SELECT q, {n7('q')} AS k FROM t),
e AS (SELECT q, min(p_partkey) AS p FROM n JOIN r ON k = t GROUP BY q),
l AS (SELECT q, min(p_partkey) AS p FROM n JOIN r ON contains(t, k) OR contains(k, t) WHERE q NOT IN (SELECT q FROM e) GROUP BY q)
SELECT q AS title, p AS p_partkey, 'exact' AS method FROM e UNION ALL SELECT q, p, 'contains' FROM l""")
def refs_title_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = F.col("p_type")
    wanted = F.array(F.lower(t), F.substring(t, F.lit(1), F.length(t) - 2), F.concat(t, F.lit(" extra")), F.substring(t, F.lit(3), F.length(t)))
    return biblio.title_lookup(p.select(F.explode(wanted).alias("title")).distinct(), p, "title", "p_type", "p_partkey")


_WISH = "CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN p_type || ' extra' WHEN 2 THEN 'zzz ' || p_partkey ELSE substr(p_type, 3) END"


@R.add(f"""WITH a AS (SELECT p_size AS list, p_partkey AS pos, {_WISH} AS input, {n7(_WISH)} AS k FROM part),
firsts AS (SELECT list, k, min(pos) AS pos, arg_min(input, pos) AS input FROM a WHERE k <> '' GROUP BY list, k),
r AS (SELECT p_partkey, {n7('p_type')} AS t FROM part), names AS (SELECT t, min(p_partkey) AS p FROM r GROUP BY t), ks AS (SELECT DISTINCT k FROM firsts),
e AS (SELECT k, p FROM ks JOIN names ON k = t), l AS (SELECT k, min(p) AS p FROM ks JOIN names ON contains(t, k) OR contains(k, t) WHERE k NOT IN (SELECT k FROM e) GROUP BY k),
met AS (SELECT f.*, m.p FROM firsts f LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM l) m USING (k))
SELECT list, pos, input, p IS NOT NULL AS found, p AS number, CASE WHEN p % 5 <> 0 THEN '**C' || p || '**, Ann' END AS author,
  CASE WHEN p IS NULL THEN '**' || input || '**: verbete nao encontrado.' WHEN p % 4 = 0 THEN '**' || input || '**: sem conteudo em `ref_list`.' ELSE 'L' || p || ' (n. ' || p || ')' END AS ref_list,
  CASE WHEN p IS NULL THEN '**' || input || '**: verbete nao encontrado.' WHEN p % 5 = 0 THEN '**' || input || '**: sem conteudo em `ref_biblio`.' ELSE '**C' || p || '**, Ann; ***T*** (n. ' || p || '; a)' END AS ref_biblio FROM met""")
def refs_asked_entries(spark, sf_dir):
    """Titles of parts, changed and made up, as lists that are asked for by size; every third entry has its number as a field."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    entries = part.select(
        F.col("p_partkey").alias("place"), F.col("p_type").alias("titulo"), F.when((F.col("p_partkey") % 3 == 0) | (F.col("p_partkey") % 20 == 0), key).alias("numero"),
        F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("L"), key, F.lit(" (n. "), key, F.lit(")"))).alias("ref_list"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("**C"), key, F.lit("**, Ann; ***T*** (n. "), key, F.lit("; a)"))).alias("ref_biblio"),
    )
    asked = part.select(F.col("p_size").alias("list"), "p_partkey", F.expr(_WISH).alias("wish"))
    return biblio.asked_entries(asked, "list", "wish", "p_partkey", entries, "place").select("list", "pos", "input", "found", "number", "author", "ref_list", "ref_biblio")


_BOOK = "CASE WHEN p_size <= 9 THEN 'c' || p_size ELSE p_type END"


@R.add(f"""SELECT p_partkey, CASE {_BOOK} WHEN 'c1' THEN 'One' WHEN 'c2' THEN 'Two' WHEN 'c3' THEN 'Three' ELSE
  CASE WHEN contains(lower({_BOOK}), 'prom') AND contains(lower({_BOOK}), 'o') THEN 'One' WHEN contains(lower({_BOOK}), 'st') THEN 'Two' WHEN contains(lower({_BOOK}), 'e') THEN 'Three' ELSE 'none' END END AS title FROM part""")
def refs_book_code(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    asked = F.when(F.col("p_size") <= 9, F.concat(F.lit("c"), F.col("p_size").cast("string"))).otherwise(F.col("p_type"))
    codes, cues = {"C1": "One", "C2": "Two", "C3": "Three"}, [(["prom", "o"], "C1"), (["st"], "C2"), (["e"], "C3")]
    return p.select("p_partkey", biblio.book_code(asked, codes, cues, "none").alias("title"))


@R.add("""SELECT o_orderkey, o_orderkey AS number, '**C' || o_custkey || '**, Ann' AS author, '***T' || o_orderkey || '*** (n. ' || o_orderkey || '; a)' AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END AS day FROM orders""")
def refs_parts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.lit("99.99.2000"))
    text = F.concat(F.lit("**C"), F.col("o_custkey").cast("string"), F.lit("**, Ann; ***T"), key, F.lit("*** (n. "), key, F.lit("; a); "), day)
    return o.select("o_orderkey", biblio.reference_parts(F.lit(""), text, F.when(F.col("o_orderkey") % 3 == 0, key)).alias("x")).select("o_orderkey", "x.*")


@R.add("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def refs_br_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("text", F.concat(F.lit("n. 12; "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(".")))
    return o.select("o_orderkey", biblio.brazilian_date(F.col("text")).alias("day"))

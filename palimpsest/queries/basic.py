"""Normalisers, text statistics, chunks, dictionary pages, usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import normalise
from palimpsest.operators import chunks, dictionary, texts, usage
from palimpsest.queries.common import Registry, n3, n6, n7, table

R = Registry()
QUERIES, SQL = R.queries, R.sql
_PARAGRAPH = r"trim(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_BODY = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g')"
#: A paragraph ends at </p>, at the next <p> or with the page: marks are put there, as SQL's patterns don't look ahead.
_CUT = rf"regexp_extract_all(regexp_replace({_BODY}, '(?i)(</p>|<p[\s>])', chr(1) || '\1', 'g') || chr(1), '(?is)<p(?:\s[^>]*)?>([^' || chr(1) || ']*)' || chr(1), 1)"
PARAGRAPHS = f"paragraphs AS (SELECT page_id, place, {_PARAGRAPH} AS paragraph FROM (SELECT page_id, unnest({_CUT}) AS p, generate_subscripts({_CUT}, 1) AS place FROM pages) WHERE {_PARAGRAPH} <> '')"
_SOURCE = "CASE page_id % 6 WHEN 0 THEN 'Aulete' WHEN 1 THEN 'Michaelis' WHEN 2 THEN 'Priberam' WHEN 3 THEN 'Wiktionary' WHEN 4 THEN 'Dicio' ELSE 'Outro' END"
STAGES = f"""stages AS (SELECT page_id, page_id // 6 AS term, {_SOURCE} AS source, page_id % 4 <> 3 AS ok, page_id % 5 = 0 AS retried, count(p.paragraph) AS definitions, count(p.paragraph) FILTER (length(p.paragraph) < 40) AS synonyms
  FROM pages LEFT JOIN paragraphs p USING (page_id) GROUP BY page_id),
scored AS (SELECT *, CASE source WHEN 'Aulete' THEN 1.0::DOUBLE WHEN 'Michaelis' THEN 0.96::DOUBLE WHEN 'Priberam' THEN 0.92::DOUBLE WHEN 'Wiktionary' THEN 0.76::DOUBLE WHEN 'Dicio' THEN 0.66::DOUBLE ELSE 0.5::DOUBLE END * 100 + least(definitions, 10) * 2.2::DOUBLE + least(synonyms, 8) * 0.8::DOUBLE + CASE WHEN retried THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS exact, round(exact, 2) AS quality FROM stages)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@R.add(f"SELECT doc_id, {n3('text')} AS norm FROM documents")
def norm_match(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", normalise.for_match(F.col("text")).alias("norm"))


@R.add(f"SELECT doc_id, {n6('text')} AS norm FROM documents")
def norm_citation(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", normalise.for_citation(F.col("text")).alias("norm"))


@R.add(f"SELECT doc_id, md5({n7('text')}) AS digest FROM documents")
def norm_biblio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(normalise.for_biblio(F.col("text"))).alias("digest"))


@R.add(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))) AS digest FROM documents""")
def norm_chunks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(normalise.for_chunks(F.col("text"))).alias("digest"))


@R.add(r"""SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS words, length(text) AS chars, length(regexp_replace(text, '\s', '', 'g')) AS chars_without_spaces,
  len(list_filter(string_split_regex(text, '\n+'), lambda p: trim(p) <> '')) AS paragraphs, greatest(1, ceil(length(text) / 3000.0))::INT AS pages,
  greatest(1, ceil((CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END) / 200.0))::INT AS minutes FROM documents""")
def txt_stats(spark, sf_dir):
    return texts.stats(_docs(spark, sf_dir), "doc_id")


@R.add(r"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, coalesce(list_sum(list_transform(ws, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouáéíóúâêôãõàü]+'))))), 0)::INT AS syllables,
  len(list_filter(ws, lambda x: length(regexp_replace(x, '[^\p{L}]', '', 'g')) > 10)) AS long_words, len(list_filter(ws, lambda x: ends_with(regexp_replace(x, '[^\p{L}]', '', 'g'), 'logia'))) AS logia_words FROM w""")
def txt_syllables(spark, sf_dir):
    return texts.word_shapes(_docs(spark, sf_dir), "doc_id")


@R.add(None)
def txt_hyphen(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"(\p{L}{4}) (?=\p{Ll}{4})", "$1-"))
    return d.select("doc_id", texts.hyphens(F.col("text")).alias("n_joined"), F.md5(texts.joined_hyphens(F.col("text"))).alias("digest"))


@R.add(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)
SELECT doc_id, place, line FROM l WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '^[\s\-_=~.·•]{8,}$')""")
def txt_rule_lines(spark, sf_dir):
    return texts.without_rules(texts.lines(_docs(spark, sf_dir), "doc_id"))


@R.add(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
n AS (SELECT *, trim(regexp_replace(lower(strip_accents(line)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM l WHERE trim(line) <> '')
SELECT doc_id, place, line FROM n WHERE NOT regexp_matches(regexp_replace(replace(line, chr(160), ' '), '[\s\-–—.,;:()\[\]{}/\\|]+', '', 'g'), '^[0-9]{1,4}$') AND NOT (contains(norm, 'that') AND contains(norm, 'it') AND len(string_split(norm, ' ')) <= 5)""")
def txt_headers(spark, sf_dir):
    return texts.without_headers(texts.lines(_docs(spark, sf_dir), "doc_id"), ["that", "it"])


@R.add("SELECT doc_id, md5(regexp_replace(text, '(?i)eaux', '<mark>\\0</mark>', 'g')) AS digest FROM documents")
def txt_highlight(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(texts.highlighted(F.col("text"), "eaux")).alias("digest"))


@R.add("SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '(?i)eaux')) AS n FROM pages")
def txt_occurrences(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", texts.occurrences(F.col("html"), "eaux").alias("n"))


@R.add(r"""WITH p AS (SELECT doc_id, string_split_regex(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)), '\n\s*\n+|\s\|\s|[•·]') AS parts FROM documents),
q AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM p)
SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM q""")
def chunk_structural(spark, sf_dir):
    parts = _docs(spark, sf_dir).select("doc_id", F.posexplode(chunks.structural(F.col("text"))).alias("at", "part"))
    return parts.select("doc_id", "part", (F.col("at") + 1).alias("place"))


@R.add(r"""WITH s AS (SELECT item_id, string_split(regexp_replace(text, '([.!?:;])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM benchmark),
q AS (SELECT item_id, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM s)
SELECT item_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS place FROM q""")
def chunk_sentences(spark, sf_dir):
    parts = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(chunks.sentences(F.col("text"))).alias("at", "sentence"))
    return parts.select("item_id", "sentence", (F.col("at") + 1).alias("place"))


@R.add(r"SELECT doc_id, md5(regexp_replace(concat_ws(' | ', nullif(trim(source), ''), nullif(trim(lang), ''), text), '^[ |]+|[ |]+$', '', 'g')) AS digest FROM documents WHERE trim(text) <> ''")
def chunk_embed_text(spark, sf_dir):
    return _docs(spark, sf_dir).where("trim(text) != ''").select("doc_id", F.md5(chunks.embedding_text(F.col("source"), F.col("text"), F.col("lang"))).alias("digest"))


@R.add(None)
def chunk_pack(spark, sf_dir):
    return chunks.chunked(_docs(spark, sf_dir), "doc_id")


@R.add(f"WITH {PARAGRAPHS} SELECT page_id, place, paragraph FROM paragraphs")
def dict_paragraphs(spark, sf_dir):
    return dictionary.html_paragraphs(table(spark, sf_dir, "pages"), "page_id")


#: Passages with numbers before every other sentence, or with semicolons instead of full stops.
_SENSES = r"CASE WHEN item_id % 2 = 0 THEN '1. ' || regexp_replace(text, '\. ', '. 2. ', 'g') ELSE replace(text, '. ', '; ') END"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({x}, '\[[^\]]+\]|(?i:\(\s*editar\s*\))', ' ', 'g'), '\s+', ' ', 'g'), '^[ \-]+|[ \-]+$', '', 'g')"


@R.add(f"""WITH t AS (SELECT item_id, {_CLEAN.format(x=_SENSES)} AS t FROM benchmark),
p AS (SELECT item_id, string_split(regexp_replace(t, '(^|\\s)(\\d+\\.)', chr(1) || '\\1\\2', 'g'), chr(1)) AS n, string_split_regex(t, '\\s*;\\s+') AS o FROM t),
c AS (SELECT item_id, list_filter(list_transform(n, lambda x: {_CLEAN.format(x='x')}), lambda x: x <> '') AS n, list_filter(list_transform(o, lambda x: {_CLEAN.format(x='x')}), lambda x: x <> '') AS o FROM p),
s AS (SELECT item_id, CASE WHEN len(n) > 1 THEN n ELSE o END AS s FROM c)
SELECT item_id, unnest(s) AS sense, generate_subscripts(s, 1) AS place FROM s""".replace("\\\\", "\\"))
def dict_senses(spark, sf_dir):
    made = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("1. "), F.replace("text", F.lit(". "), F.lit(". 2. ")))).otherwise(F.replace("text", F.lit(". "), F.lit("; ")))
    parts = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(dictionary.senses(made)).alias("at", "sense"))
    return parts.select("item_id", "sense", (F.col("at") + 1).alias("place"))


def _stages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    n = dictionary.html_paragraphs(pages, "page_id").groupBy("page_id").agg(F.count("*").alias("definitions"), F.count_if(F.length("paragraph") < 40).alias("synonyms"))
    names = F.array(*map(F.lit, ["Aulete", "Michaelis", "Priberam", "Wiktionary", "Dicio", "Outro"]))
    made = pages.select("page_id", F.floor(F.col("page_id") / 6).alias("term"), F.get(names, (F.col("page_id") % 6).cast("int")).alias("source"), (F.col("page_id") % 4 != 3).alias("ok"), (F.col("page_id") % 5 == 0).alias("retried"))
    made = made.join(n, "page_id", "left").fillna(0, ["definitions", "synonyms"])
    return made.withColumn("quality", dictionary.quality(F.col("source"), F.col("definitions"), F.col("synonyms"), F.col("retried")))


@R.add(f"WITH {PARAGRAPHS}, {STAGES} SELECT term, source, quality, row_number() OVER (PARTITION BY term ORDER BY ok DESC, quality DESC, definitions DESC, source) AS rank FROM scored")
def dict_score_rank(spark, sf_dir):
    return dictionary.ranked(_stages(spark, sf_dir), "term").select("term", "source", "quality", "rank")


@R.add(f"SELECT page_id, coalesce(list_position(['Aulete', 'Priberam', 'Michaelis', 'Wiktionary', 'Dicio'], {_SOURCE}), 6) AS place FROM pages")
def dict_precedence(spark, sf_dir):
    return _stages(spark, sf_dir).select("page_id", dictionary.precedence(F.col("source")).alias("place"))


@R.add("""WITH w AS (SELECT conv_id, turn, i, trim(w) AS w FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations) WHERE trim(w) <> ''),
f AS (SELECT conv_id, turn, i, w, row_number() OVER (PARTITION BY conv_id, lower(w) ORDER BY turn, i, w) AS n FROM w)
SELECT conv_id, w AS word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i, w) AS place FROM f WHERE n = 1 QUALIFY place <= 14""")
def dict_dedupe(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "word"))
    return dictionary.distinct_values(w, "conv_id", "word", ["turn", "i"], 14)


@R.add(f"WITH {PARAGRAPHS}, {STAGES} SELECT term, count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (retried) AS retried, arg_max(source, (ok::INT, quality, source)) AS best FROM scored GROUP BY term")
def dict_merge(spark, sf_dir):
    return dictionary.summary(_stages(spark, sf_dir), "term")


_MERGED = f"""lists AS (SELECT s.*, coalesce(list(p.paragraph ORDER BY p.place) FILTER (p.paragraph IS NOT NULL), []) AS d, coalesce(list(p.paragraph ORDER BY p.place) FILTER (length(p.paragraph) < 40), []) AS y,
    max(CASE WHEN p.place = 1 AND s.page_id % 3 = 0 THEN p.paragraph END) AS e
  FROM scored s LEFT JOIN paragraphs p USING (page_id) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ok DESC, quality DESC, definitions DESC, source) AS by_quality, coalesce(list_position(['Aulete', 'Priberam', 'Michaelis', 'Wiktionary', 'Dicio'], source), 6) AS by_precedence FROM lists)"""


def _merged_sql(at: str, most: str) -> str:
    def once(x: str, n: int) -> str:
        flat = f"flatten(coalesce(list({x} ORDER BY {at}, source) FILTER (ok), []))"
        return f"md5(array_to_string(list_filter({flat}, lambda v, i: list_position(list_transform({flat}, lambda z: lower(z)), lower(v)) = i)" + (f"[:{n}]" if most else "") + ", '|'))"

    return f"""WITH {PARAGRAPHS}, {STAGES}, {_MERGED}
SELECT term, {once('d', 12)} AS definitions, {once('y', 14)} AS synonyms, (list(e ORDER BY {at}, source) FILTER (ok AND e IS NOT NULL))[1] AS etymology,
  array_to_string(coalesce(list(source ORDER BY {at}, source) FILTER (ok), []), ',') AS sources_ok, array_to_string(coalesce(list(source ORDER BY {at}, source) FILTER (NOT ok), []), ',') AS sources_failed
FROM placed GROUP BY term"""


def _merged(spark, sf_dir, by: str):
    pages = table(spark, sf_dir, "pages")
    p = dictionary.html_paragraphs(pages, "page_id").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", "paragraph"))).alias("_p"))
    told = F.coalesce(F.transform("_p", lambda x: x["paragraph"]), F.array().cast("array<string>"))
    lists = _stages(spark, sf_dir).select("page_id", "term", "source", "ok", "quality").join(p, "page_id", "left").select("term", "source", "ok", "quality", told.alias("definitions"), F.filter(told, lambda x: F.length(x) < 40).alias("synonyms"), F.array().cast("array<string>").alias("examples"), F.when(F.col("page_id") % 3 == 0, F.get(told, F.lit(0))).alias("etymology"))
    out = dictionary.merged(lists, "term", by)
    joined = {c: F.md5(F.array_join(c, "|")) for c in ("definitions", "synonyms")} | {c: F.array_join(c, ",") for c in ("sources_ok", "sources_failed")}
    return out.withColumns(joined).drop("examples")


@R.add(_merged_sql("by_quality", ""))
def dict_summary(spark, sf_dir):
    """What all sources of a term say, by quality; a term is six pages."""
    return _merged(spark, sf_dir, "quality")


@R.add(_merged_sql("by_precedence", "cut"))
def dict_summary_by_precedence(spark, sf_dir):
    return _merged(spark, sf_dir, "precedence")


@R.add(None)
def dict_extracted(spark, sf_dir):
    """Each page by the rule of one of five sources."""
    names = F.array(*map(F.lit, dictionary.RULES))
    pages = table(spark, sf_dir, "pages").withColumn("source", F.get(names, (F.col("page_id") % 5).cast("int")))
    made = dictionary.extracted(pages, "page_id")
    return made.select(F.col("term").alias("page_id"), "source", "ok", "quality", F.size("definitions").alias("definitions"), F.size("synonyms").alias("synonyms"), F.size("examples").alias("examples"), F.md5(F.array_join("definitions", "|")).alias("digest"), "error")


@R.add(None)
def dict_updated_entry(spark, sf_dir):
    """Passages as entries with a pronunciation, a word class, numbered senses and an etymology."""
    text = F.concat(F.lit("(pro.nun) s.f. 1. "), F.regexp_replace("text", r"\. ", ". 2. "), F.lit(" [F.: Do lat. "), F.substring("text", 1, 9), F.lit("]"))
    e = dictionary.updated_entry(text)
    return table(spark, sf_dir, "benchmark").select("item_id", e.alias("e")).select("item_id", "e.pronunciation", "e.grammar", "e.etymology", F.size("e.definitions").alias("senses"), F.md5(F.array_join(F.transform("e.definitions", lambda d: d["text"]), "|")).alias("digest"))


@R.add("""WITH p AS (SELECT text AS term, source, doc_id % 3 = 0 AS ok, n_chars AS definitions FROM (SELECT string_split(text, ' ')[1] AS text, source, doc_id, n_chars, row_number() OVER (PARTITION BY string_split(text, ' ')[1], source ORDER BY doc_id) AS n FROM documents) WHERE n = 1),
r AS (SELECT term, source, bool_or(length(term) % 2 = 0) AS ok, max(definitions) AS definitions FROM p GROUP BY term, source),
j AS (SELECT p.*, strip_accents(p.term) AS plain, NOT p.ok AND coalesce(r.ok, false) AND strip_accents(p.term) <> p.term AS use, r.definitions AS more FROM p LEFT JOIN r ON strip_accents(p.term) = r.term AND p.source = r.source)
SELECT term, source, ok OR use AS ok, CASE WHEN use THEN more ELSE definitions END AS definitions, CASE WHEN use THEN plain ELSE term END AS query_term, use AS retried FROM j""")
def dict_accent_fallback(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.element_at(F.split("text", " "), 1).alias("term"), "source", F.struct("doc_id", "n_chars").alias("x"))
    p = d.groupBy("term", "source").agg(F.min("x").alias("x")).select("term", "source", (F.col("x.doc_id") % 3 == 0).alias("ok"), F.col("x.n_chars").alias("definitions"))
    r = p.select("term", "source", (F.length("term") % 2 == 0).alias("ok"), "definitions")
    return dictionary.with_fallback(p, r, "term")


_LOG = "log AS (SELECT event_id, user_id, ts, (props::JSON->>'k')::BIGINT AS k, CASE WHEN event_type = 'error' THEN event_type END AS error, CASE event_id % 5 WHEN 0 THEN 'gpt-5.4-mini-2026' WHEN 1 THEN 'GPT-5.4-nano' WHEN 2 THEN 'gpt-5.4' WHEN 3 THEN 'gpt-5.4-pro' ELSE 'other' END AS model FROM events)"


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "k long")["k"]
    model = F.get(F.array(*map(F.lit, ["gpt-5.4-mini-2026", "GPT-5.4-nano", "gpt-5.4", "gpt-5.4-pro", "other"])), (F.col("event_id") % 5).cast("int"))
    return e.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "error", F.col("event_type")).alias("error"), model.alias("model"), (k * 10).alias("tokens_in"), F.when(F.col("event_id") % 7 == 0, k * 11).otherwise(k).alias("cached"), (k * 3).alias("tokens_out"))


_CACHED = "CASE WHEN event_id % 7 = 0 THEN k * 11 ELSE k END"
_COST = f"(greatest(0, k * 10 - {_CACHED}) * {{}}::DOUBLE + {_CACHED} * {{}}::DOUBLE + k * 3 * {{}}::DOUBLE) / 1e6"
_PRICE = f"CASE WHEN lower(model) LIKE 'gpt-5.4-mini%' THEN {_COST.format(4.125, 0.4125, 24.75)} WHEN lower(model) LIKE 'gpt-5.4-nano%' THEN {_COST.format(1.1, 0.11, 6.875)} WHEN lower(model) = 'gpt-5.4' THEN {_COST.format(13.75, 1.375, 82.5)} END"


@R.add(f"WITH {_LOG} SELECT user_id, count(*) AS calls, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS failed, sum(k * 10)::BIGINT AS tokens_in, sum(k * 3)::BIGINT AS tokens_out, round(sum({_PRICE}), 6) AS brl, round(sum({_PRICE}) / 5.5, 6) AS usd FROM log GROUP BY user_id")
def use_totals(spark, sf_dir):
    return usage.totals(_log(spark, sf_dir), "user_id").withColumns({c: F.round(c, 6) for c in ("brl", "usd")})


@R.add(f"WITH {_LOG} SELECT event_id, {_PRICE} AS brl FROM log")
def use_cost(spark, sf_dir):
    return _log(spark, sf_dir).select("event_id", usage.cost_brl(F.col("model"), F.col("tokens_in"), F.col("cached"), F.col("tokens_out")).alias("brl"))


@R.add("""WITH r AS (SELECT conv_id, turn, w AS r, i FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations) WHERE trim(w) <> ''),
f AS (SELECT conv_id, trim(r) AS reference, min(turn * 1000000 + i) AS seen FROM r GROUP BY ALL)
SELECT conv_id, reference, row_number() OVER (PARTITION BY conv_id ORDER BY seen, reference) AS place FROM f""")
def use_references(spark, sf_dir):
    return usage.references(table(spark, sf_dir, "conversations").withColumn("refs", F.split("text", " ")), "conv_id", "refs", "turn")


@R.add("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 80")
def use_recent(spark, sf_dir):
    return usage.recent(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "rank")


_DATE, _PAGE = "CASE WHEN doc_id % 5 <> 0 THEN '01/02/2014' END", "CASE WHEN doc_id % 7 <> 0 THEN 'p. ' || (doc_id // 10 + 1) END"


@R.add(f"""SELECT doc_id, '(' || CASE doc_id % 3 WHEN 0 THEN concat_ws(', ', '**' || source || '**', {_DATE}, nullif(lang, ''), {_PAGE}) WHEN 1 THEN '**' || source || '**, verbete *' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE 's/titulo' END || '*'
  ELSE concat_ws(', ', '**' || source || '**', {_PAGE}) END || ')' AS line FROM documents""")
def card_source_line(spark, sf_dir):
    n = F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, ["QUEST", "EC", "LO"])), (n % 3).cast("int"))
    page = F.when(n % 7 != 0, (F.floor(n / 10) + 1).cast("string")).otherwise(" ")
    line = texts.source_line(kind, F.col("source"), F.when(n % 2 == 0, F.col("lang")), F.when(n % 5 != 0, "01/02/2014"), F.col("lang"), page)
    return _docs(spark, sf_dir).select("doc_id", line.alias("line"))


@R.add("SELECT doc_id, CASE WHEN lang = source THEN lang ELSE concat_ws(' | ', nullif(trim(source), ''), nullif(trim(lang), ''), n_chars::VARCHAR) END AS line FROM documents")
def card_meta_order(spark, sf_dir):
    m = F.create_map(F.lit("text"), F.col("text"), F.lit("size"), F.col("n_chars").cast("string"), F.lit("area"), F.col("lang"), F.lit("title"), F.col("source"))
    return _docs(spark, sf_dir).select("doc_id", texts.metadata_order(m, ["title", "area"], ["text"]).alias("line"))

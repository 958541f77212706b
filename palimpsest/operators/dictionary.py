"""Dictionary pages: what five sources say of a term, cleaned, scored, ranked and merged.

A stage is what one source says of one term: term, source, ok, definitions, synonyms, examples, etymology, error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import definitions as cleaning
from palimpsest.functions import markup
from palimpsest.functions.normalise import fold, nfkc
from palimpsest.tables import in_small_batches

#: Trust in each source.
BASES = {"Aulete": 1.00, "Michaelis": 0.96, "Priberam": 0.92, "Wiktionary": 0.76, "Dicio": 0.66}
OTHER_BASE = 0.5
#: Order of precedence.
PRECEDENCE = ["Aulete", "Priberam", "Michaelis", "Wiktionary", "Dicio"]
MOST_TERM = 80


def check_term(term: str) -> str:
    term = (term or "").strip()
    if not term or len(term) > MOST_TERM:
        raise ValueError("an empty or too long term")
    return term


def clean(x: Column) -> Column:
    """Entities as characters, tags and [..] and (editar) dropped, white space collapsed, spaces and hyphens at the ends stripped."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    y = F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\[[^\]]+\]|(?i:\(\s*editar\s*\))", " ")
    return F.regexp_replace(F.regexp_replace(y, r"\s+", " "), r"^[ \-\n\t\r]+|[ \-\n\t\r]+$", "")


def html_paragraphs(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, place from 1, paragraph): the contents of <p> elements, an open one ends where the next begins."""
    body = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>", "")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</p>|<p[\s>]|$)"), 1)
    parts = pages.select(key, F.posexplode(found).alias("at", "raw"))
    return parts.select(key, (F.col("at") + 1).alias("place"), F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", " "), r"\s+", " "), "^ +| +$", "").alias("paragraph")).where("paragraph != ''")


def senses(x: Column) -> Column:
    """Numbered senses, else those between semicolons, else the whole text; none of an empty one."""
    def parts(pattern: str) -> Column:
        return F.filter(F.transform(F.split(clean(x), pattern), clean), lambda s: s != "")

    numbered, others = parts(r"(?=(?:^|\s)\d+\.)"), parts(r"\s*;\s+")
    return F.when(F.size(numbered) > 1, numbered).otherwise(others)


def examples(x: Column) -> Column:
    """Quoted passages of 12 to 180 characters; a passage may have opening marks in it, but no closing ones."""
    return F.regexp_extract_all(x, F.lit('[“"]([^”"]{12,180})[”"]'), 1)


def quality(source: Column, definitions: Column, synonyms: Column, etymology: Column) -> Column:
    """base x 100 + 2.2 a definition (10 at most) + 0.8 a synonym (8) + 3 for an etymology, from counts, to hundredths."""
    base = F.lit(OTHER_BASE)
    for name, b in BASES.items():
        base = F.when(source == name, b).otherwise(base)
    return F.round(base * 100 + F.least(definitions, F.lit(10)) * 2.2 + F.least(synonyms, F.lit(8)) * 0.8 + F.when(etymology, 3.0).otherwise(0.0), 2)


NO_DEFINITION = "nenhuma definicao extraida"


def stages(raw: DataFrame) -> DataFrame:
    """raw stages (arrays definitions, synonyms, examples; etymology, ok, error and any other columns) cleaned, with quality.

    A stage is ok if it was before and has a definition left; without, its error is what was known or NO_DEFINITION.
    """
    none = F.array().cast("array<string>")
    made = raw.withColumns({
        "definitions": cleaning.definitions(F.coalesce("definitions", none)),
        "synonyms": cleaning.distinct(F.coalesce("synonyms", none)),
        "examples": cleaning.distinct(F.coalesce("examples", none)),
        "etymology": F.nullif(cleaning.cleaned("etymology"), F.lit("")),
    })
    ok = F.col("ok") & (F.size("definitions") > 0)
    made = made.withColumns({"ok": ok, "error": F.when(~ok, F.coalesce(F.nullif("error", F.lit("")), F.lit(NO_DEFINITION)))})
    return made.withColumn("quality", quality(F.col("source"), F.size("definitions"), F.size("synonyms"), F.col("etymology").isNotNull()))


#: What a definition begins with, and what tells an etymology, by source.
AULETE_HEADS, AULETE_ETYMOLOGY = ["sf.", "sm."], ["Do lat.", "Do gr.", "Etim"]
PRIBERAM_CLASSES = ["nome ", "substantivo ", "adjetivo ", "verbo "]
MOST_DEFINITIONS = 10


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _first(values: Column, test) -> Column:
    return F.get(F.filter(values, test), F.lit(0))


def _cleaned(values: Column) -> Column:
    return F.transform(values, clean)


def aulete(nodes: Column) -> dict[str, Column]:
    """Paragraphs with a number or word class are definitions."""
    p = _cleaned(markup.texts(markup.select(nodes, "p")))
    told = F.filter(p, lambda t: t.rlike(r"^\d+\.") | _any(F.startswith(t, F.lit(h)) for h in AULETE_HEADS))
    return {"definitions": F.slice(told, 1, MOST_DEFINITIONS), "etymology": _first(p, lambda t: _any(F.contains(t, F.lit(e)) for e in AULETE_ETYMOLOGY)), "examples": examples(F.array_join(F.slice(told, 1, 4), " "))}


def priberam(nodes: Column) -> dict[str, Column]:
    """After a line of the word's class: numbered paragraphs, or the first longer one if it comes before any."""
    p = _cleaned(markup.texts(markup.select(nodes, "p")))
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("found"))

    def step(x: Column, t: Column) -> Column:
        head = _any(F.startswith(F.lower(t), F.lit(c)) for c in PRIBERAM_CLASSES)
        takes = x["on"] & ~head & (t.rlike(r"^\d+\.") | ((F.length(t) > 30) & (F.size(x["found"]) == 0)))
        return F.struct((x["on"] | head).alias("on"), F.when(takes, F.concat(x["found"], F.array(t))).otherwise(x["found"]).alias("found"))

    rest = F.filter(p, lambda t: ~_any(F.startswith(F.lower(t), F.lit(c)) for c in PRIBERAM_CLASSES))
    told = F.aggregate(p, start, step, lambda x: x["found"])
    etymologies = F.filter(rest, lambda t: F.contains(F.lower(t), F.lit("etimologia")))
    shown = F.filter(rest, lambda t: F.contains(F.lower(t), F.lit("exemplo")) | F.contains(F.lower(t), F.lit("ex.:")))
    return {"definitions": F.slice(told, 1, MOST_DEFINITIONS), "etymology": F.try_element_at(etymologies, F.lit(-1)), "examples": F.slice(shown, 1, 4)}


def dicio(nodes: Column) -> dict[str, Column]:
    """Paragraphs of the class significado; synonyms after a colon, between commas."""
    def after(t: Column) -> Column:
        return F.when(F.contains(t, F.lit(":")), F.regexp_extract(t, r"(?s)^[^:]*:(.*)$", 1)).otherwise(t)

    lines = F.filter(markup.select(nodes, "p", "adicional"), lambda n: F.array_contains(n["classes"], "sinonimos"))
    named = F.flatten(F.transform(markup.texts(lines), lambda t: F.split(after(clean(t)), ",")))
    quoted = F.filter(nodes, lambda n: n["tag"].isin("q", "cite", "em"))
    about = F.get(F.filter(nodes, lambda n: (n["tag"] == "") & F.contains(F.lower(n["text"]), F.lit("etimologia"))), F.lit(0))["parent"]
    return {"definitions": _cleaned(markup.texts(markup.select(nodes, "p", "significado"))), "synonyms": F.filter(F.transform(named, F.trim), lambda w: w != ""), "examples": _cleaned(markup.texts(quoted)), "etymology": F.get(nodes, about)["text"]}


def wiktionary(nodes: Column) -> dict[str, Column]:
    """Items of ordered lists, of 20 characters or more, within the content; what their bullets say are examples."""
    body = markup.within(nodes, _first(nodes, lambda n: n["id"] == "mw-content-text"))
    items = F.filter(body, lambda n: (n["tag"] == "li") & (F.get(nodes, n["parent"])["tag"] == "ol") & (F.length(clean(n["text"])) >= 20))

    def bullets(item: Column) -> Column:
        inner = markup.within(body, item)
        return F.filter(inner, lambda n: (n["tag"] == "li") & F.exists(inner, lambda u: (u["tag"] == "ul") & (u["at"] < n["at"]) & (n["at"] <= u["last"])))

    shown = _cleaned(markup.texts(F.flatten(F.transform(items, bullets))))
    is_heading = lambda n: n["tag"].isin("h2", "h3", "h4")
    mark = _first(body, lambda n: (n["tag"] == "") & F.contains(F.lower(n["text"]), F.lit("etimologia")))
    head = F.try_element_at(F.filter(body, lambda n: is_heading(n) & (n["at"] < mark["at"]) & (mark["at"] <= n["last"])), F.lit(-1))
    beside = F.filter(body, lambda n: (n["parent"] == head["parent"]) & (n["at"] > head["last"]) & (n["tag"] != ""))
    end = F.coalesce(_first(beside, is_heading)["at"], F.lit(2**31 - 1))
    said = F.filter(_cleaned(markup.texts(F.filter(beside, lambda n: n["at"] < end))), lambda t: t != "")
    return {"definitions": F.slice(_cleaned(markup.texts(items)), 1, MOST_DEFINITIONS), "examples": F.slice(F.filter(shown, lambda t: t != ""), 1, 5), "etymology": F.when(head.isNotNull(), F.array_join(F.slice(said, 1, 2), " "))}


def michaelis(nodes: Column) -> dict[str, Column]:
    """Numbered acn elements of the entry, each with what stands beside it up to the next; abt elements are examples."""
    entry = markup.within(nodes, F.get(markup.select(nodes, "div", "verbete"), F.lit(0)))
    numbers = markup.select(entry, "acn")

    def beside(n: Column) -> Column:
        after = F.filter(entry, lambda m: (m["parent"] == n["parent"]) & (m["at"] > n["last"]))
        end = F.coalesce(_first(after, lambda m: m["tag"] == "acn")["at"], F.lit(2**31 - 1))
        return F.filter(after, lambda m: m["at"] < end)

    def definition(n: Column) -> Column:
        parts = F.filter(_cleaned(markup.texts(beside(n))), lambda t: t != "")
        return F.regexp_replace(clean(F.concat(clean(n["text"]), F.lit(". "), F.array_join(parts, " "))), r"\s+\.\s+", ". ")

    shown = _cleaned(markup.texts(F.flatten(F.transform(numbers, lambda n: F.filter(beside(n), lambda m: m["tag"] == "abt")))))
    also = clean(F.get(F.filter(nodes, lambda n: F.arrays_overlap(n["classes"], F.array(F.lit("col-md-4"), F.lit("col-lg-4")))), F.lit(0))["text"])
    named = F.filter(F.split(F.replace(F.replace(also, F.lit("Veja também"), F.lit("")), F.lit("Veja tambem"), F.lit("")), r"[,\s]+"), lambda w: F.length(w) > 2)
    return {"definitions": F.slice(F.transform(numbers, definition), 1, MOST_DEFINITIONS), "synonyms": F.slice(named, 1, 10), "examples": F.slice(F.filter(shown, lambda t: t != ""), 1, 4)}


RULES = {"Aulete": aulete, "Priberam": priberam, "Michaelis": michaelis, "Wiktionary": wiktionary, "Dicio": dicio}


def extracted(pages: DataFrame, term: str, source: str = "source", html: str = "html") -> DataFrame:
    """Stages of pages (term, source, html): what the source's rule finds. A page of another source, or null, finds nothing."""
    none = F.array().cast("array<string>")
    own = in_small_batches(pages).select(F.col(term).alias("term"), F.col(source).alias("source"), markup.nodes(html).alias("_nodes"))
    parts = {"definitions": none, "synonyms": none, "examples": none, "etymology": F.lit(None).cast("string")}
    for name, rule in RULES.items():
        for part, found in rule(F.col("_nodes")).items():
            parts[part] = F.when(F.col("source") == name, found).otherwise(parts[part])
    # generated, so that the rules are evaluated once for each page and not for each use of what they find
    made = own.select("term", "source", F.inline(F.array(F.struct(*(c.alias(n) for n, c in parts.items())))))
    return stages(made.withColumns({"ok": F.lit(True), "error": F.lit(None).cast("string")}))


#: White space that closing signs have before them or opening ones behind them; a bracket that a word runs into.
_LOOSE, _TIGHT = r"\s+(?=[,.;:)\]])|(?<=[(\[])\s+", r"(?<=\S)(?=\[[A-Za-z])"


def segment(x: Column) -> Column:
    """A part of an entry on one line, without tags and editing marks, with signs next to the words they belong to."""
    text = F.regexp_replace(x, r"(?i)<[^>]*>|\(\s*editar\s*\)", " ")
    close = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), _LOOSE, "")
    return F.regexp_replace(F.regexp_replace(close, _TIGHT, " "), "^[ -]+|[ -]+$", "")


def updated_entry(text: Column) -> Column:
    """(pronunciation, grammar, definitions: array of index and text, etymology) of an entry's text.

    The pronunciation stands first in parentheses, the grammar before the first number, the etymology in the last [F.: ...].
    """
    raw = segment(nfkc(text))
    first = F.regexp_extract(raw, r"^\(([^)]+)\)\s*(.*)$", 1)
    body = F.when(first != "", F.regexp_extract(raw, r"^\(([^)]+)\)\s*(.*)$", 2)).otherwise(raw)
    number = r"(?<!\d)\d+\.\s*"
    head = F.regexp_extract(body, rf"^(.*?){number}", 1)
    senses_ = F.when(body.rlike(number), F.substring(body, F.length(head) + 1, F.length(body))).otherwise(body)
    tail = F.regexp_extract(senses_, r"(?i)^(?:.*)\[f\.:([^\]]*)\]", 1)
    has = senses_.rlike(r"(?i)\[f\.:(?!.*\[f\.:)[^\]]*\]")
    own = F.when(has, F.regexp_extract(senses_, r"(?i)^(.*)\[f\.:", 1)).otherwise(senses_)
    numbers, parts = F.regexp_extract_all(own, F.lit(r"(?<!\d)(\d+)\.\s*"), 1), F.split(own, number)
    several = F.zip_with(numbers, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda n, t: F.struct(n.cast("int").alias("index"), segment(t).alias("text")))
    one = F.array(F.struct(F.lit(1).alias("index"), segment(own).alias("text")))
    found = F.filter(F.when(F.size(numbers) > 0, several).otherwise(one), lambda d: F.coalesce(d["text"], F.lit("")) != "")
    return F.struct(clean(first).alias("pronunciation"), segment(head).alias("grammar"), found.alias("definitions"), F.when(has, segment(tail)).alias("etymology"))


def analogic(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, sense, title, term_count, classes) of the groups of related words on each page, classes without words dropped.

    classes are (label, group_count, term_count, groups, terms) in order. Words count once in a group, and once in a class.
    """
    nodes = F.col("_nodes")
    hidden = markup.within(nodes, F.get(F.filter(markup.within(nodes, F.get(markup.select(nodes, id_="analogico_aulete"), F.lit(0))), lambda n: n["id"] == "hidden_content"), F.lit(0)))
    senses_ = pages.select(key, markup.nodes(html).alias("_nodes")).select(key, "_nodes", F.posexplode(markup.select(hidden, cls="keyword")).alias("_nth", "_k"))
    inside = markup.within(nodes, F.col("_k"))
    titled = senses_.withColumn("title", clean(F.get(markup.select(inside, "h2"), F.lit(0))["text"])).where("title != ''")
    children = F.filter(inside, lambda n: (n["parent"] == F.col("_k.at")) & ((n["tag"] == "h3") | ((n["tag"] == "span") & F.array_contains(n["classes"], "analog_group"))))
    rows = titled.select(key, "_nth", "title", "_nodes", F.explode(children).alias("_c"))
    rows = rows.withColumn("_words", F.when(F.col("_c.tag") == "span", cleaning.distinct(markup.texts(markup.select(markup.within(F.col("_nodes"), F.col("_c")), cls="word"))))).drop("_nodes")
    before = Window.partitionBy(key, "_nth").orderBy("_c.at")
    head = F.last(F.when(F.col("_c.tag") == "h3", F.struct(F.col("_c.at").alias("at"), F.col("_c.text").alias("text"))), ignorenulls=True).over(before)
    grouped = rows.withColumn("_head", head).where("size(_words) > 0").groupBy(key, "_nth", "title", F.coalesce("_head.at", F.lit(-1)).alias("_at")).agg(F.first("_head.text").alias("_label"), F.transform(F.array_sort(F.collect_list(F.struct("_c.at", "_words"))), lambda g: g["_words"]).alias("groups"))
    terms = cleaning.distinct(F.flatten("groups"))
    classes = grouped.withColumn("terms", terms).withColumn("label", F.coalesce(F.nullif(clean(F.col("_label")), F.lit("")), F.lit("Sem classe")))
    one = F.struct("_at", "label", F.size("groups").alias("group_count"), F.size("terms").alias("term_count"), "groups", "terms")
    out = classes.groupBy(key, "_nth", "title").agg(F.sum(F.size("terms")).alias("term_count"), F.array_sort(F.collect_list(one)).alias("_all"))
    shown = F.transform("_all", lambda c: F.struct(*(c[n].alias(n) for n in ("label", "group_count", "term_count", "groups", "terms"))))
    return out.select(key, (F.col("_nth") + 1).alias("sense"), "title", "term_count", shown.alias("classes"))


def ranked(stages: DataFrame, term: str) -> DataFrame:
    """Stages (ok, quality, definitions: counts, source) with rank in their term: those that are ok, then the best."""
    order = Window.partitionBy(term).orderBy(F.desc("ok"), F.desc("quality"), F.desc("definitions"), "source")
    return stages.withColumn("rank", F.row_number().over(order))


def precedence(source: Column) -> Column:
    """Place in the order of precedence; others after all."""
    at = F.array_position(F.array(*map(F.lit, PRECEDENCE)), source)
    return F.when(at > 0, at).otherwise(len(PRECEDENCE) + 1)


def distinct_values(rows: DataFrame, by: str, value: str, order: list[str], most: int | None = None) -> DataFrame:
    """(by, value, place): values of each group once, whatever their case, in the first one's spelling and order."""
    clean_ = rows.withColumn("_v", F.trim(value)).where("_v != ''")
    first = clean_.groupBy(by, F.lower("_v").alias("_k")).agg(F.min(F.struct(*order, F.col("_v").alias("_v"))).alias("x"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*(F.col(f"x.{c}") for c in order), "x._v")))
    out = placed.select(by, F.col("x._v").alias(value), "place")
    return out if most is None else out.where(F.col("place") <= most)


def _once(values: Column) -> Column:
    """Strings once each whatever their case, in the first one's spelling and order."""
    keys = F.transform(values, lambda v: F.lower(v))
    return F.filter(values, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1)


def summary(stages_: DataFrame, term: str) -> DataFrame:
    """One row for each term: sources, ok, failed and retried stages, best source."""
    best = F.max_by("source", F.struct(F.col("ok").cast("int"), "quality", "source"))
    return stages_.groupBy(term).agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("retried").alias("retried"), best.alias("best"))


#: Values shown of each kind where sources are merged in order of precedence.
CAPS = {"definitions": 12, "synonyms": 14, "examples": 6}


def merged(stages_: DataFrame, term: str, by: str = "quality") -> DataFrame:
    """One row for each term: definitions, synonyms, examples and etymology of its ok stages, and what sources failed.

    by = "quality": stages in rank order, nothing cut. by = "precedence": in the sources' order, the first CAPS of each.
    Values are once each, whatever their case; the etymology is the first one known. A term has as many stages as there
    are sources.
    """
    if by == "quality":
        placed = ranked(stages_.withColumn("_n", F.size("definitions")).withColumnsRenamed({"definitions": "_definitions", "_n": "definitions"}), term).withColumnsRenamed({"definitions": "_n", "_definitions": "definitions", "rank": "_at"})
    else:
        placed = stages_.withColumn("_at", precedence(F.col("source")))
    row = F.struct("_at", "source", "ok", *CAPS, "etymology")
    all_ = placed.groupBy(term).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    good = F.filter("_all", lambda s: s["ok"])

    def values(name: str) -> Column:
        out = _once(F.flatten(F.transform(good, lambda s: s[name])))
        return F.slice(out, 1, CAPS[name]) if by == "precedence" else out

    def sources(some: Column) -> Column:
        return F.transform(some, lambda s: s["source"])

    known = F.filter(F.transform(good, lambda s: F.nullif(s["etymology"], F.lit(""))), lambda e: e.isNotNull())
    return all_.select(term, *(values(n).alias(n) for n in CAPS), F.get(known, F.lit(0)).alias("etymology"), sources(good).alias("sources_ok"), sources(F.filter("_all", lambda s: ~s["ok"])).alias("sources_failed"))


def request_id(term: Column) -> Column:
    """Sixteen hexadecimal digits that tell requests of different terms apart."""
    return F.substring(F.sha2(term, 256), 1, 16)


def with_fallback(primary: DataFrame, retry: DataFrame, term: str) -> DataFrame:
    """Stages of primary (term, source, ok, definitions); where one failed, that of the term without accents in retry, if it is ok."""
    other = retry.select(F.col(term).alias("_term"), F.col("source").alias("_source"), F.col("ok").alias("_ok"), F.col("definitions").alias("_definitions"))
    joined = primary.withColumn("_plain", fold(F.col(term))).join(other, (F.col("_plain") == F.col("_term")) & (F.col("source") == F.col("_source")), "left")
    use = ~F.col("ok") & F.coalesce("_ok", F.lit(False)) & (F.col("_plain") != F.col(term))
    return joined.select(term, "source", (F.col("ok") | use).alias("ok"), F.when(use, F.col("_definitions")).otherwise(F.col("definitions")).alias("definitions"), F.when(use, F.col("_plain")).otherwise(F.col(term)).alias("query_term"), use.alias("retried"))

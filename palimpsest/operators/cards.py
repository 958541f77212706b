"""What searches found, as lines, tables and cards of markdown."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans import boolean

#: Names of metadata that say the same, by the first one; names that are not shown; names that come first.
ALIASES = {
    "title": ["title", "titulo", "verbete", "tema", "cabecalho", "heading"],
    "date": ["date", "data"],
    "author": ["author", "autor"],
    "number": ["number", "numero", "paragraph_number", "index", "ordem", "id"],
    "pagina": ["pagina", "page"],
}
HIDDEN = ["text", "row", "number", "quest", "answer"]
PRIORITY = ["sourcebook", "title", "argumento", "area", "date", "author", "pagina", "number"]
#: Names whose value is shown with another mark than the name.
SHOWN_AS = {"sourcebook": "", "title": "", "number": "#", "pagina": "p. "}
MOST_DEFINITIONS, MOST_SYNONYMS, MOST_EXAMPLES = 5, 3, 2


def _tidy(v: Column) -> Column:
    return F.trim(F.translate(F.coalesce(v, F.lit("")), "\u00a0", " "))


def merged_metadata(base: Column, raw: Column) -> Column:
    """The map base with the entries of raw; a key that is there with another value becomes raw_<key>, raw_<key>_2 and so on.

    Values that are there already, and empty ones, go.
    """
    own = F.map_filter(F.transform_values(base, lambda k, v: _tidy(v)), lambda k, v: v != "")

    def step(m: Column, e: Column) -> Column:
        value = _tidy(e["value"])
        names = F.concat(F.array(e["key"], F.concat(F.lit("raw_"), e["key"])), F.transform(F.sequence(F.lit(2), F.size(m) + 2), lambda i: F.concat(F.lit("raw_"), e["key"], F.lit("_"), i.cast("string"))))
        # up to the first name that is free or has this value
        free = F.get(F.filter(names, lambda n: ~F.map_contains_key(m, n) | (F.coalesce(m[n], F.lit("")) == value)), F.lit(0))
        return F.when((value == "") | F.map_contains_key(m, free), m).otherwise(F.map_concat(m, F.create_map(free, value)))

    return F.aggregate(F.map_entries(raw), own, step)


def canonical_name(key: Column) -> Column:
    """The first one of the names that say the same."""
    low = F.lower(F.trim(key))
    out = low
    for first, others in ALIASES.items():
        out = F.when(low.isin(*others), first).otherwise(out)
    return out


def metadata_entries(metadata: Column, hidden: list[str] = HIDDEN) -> Column:
    """Shown entries of a map in order: known names first, then as they stand.

    Empty and hidden ones go, so do others' names of what the first name says too, and repeats whatever their case.
    """
    all_ = F.transform(F.map_entries(metadata), lambda e, i: F.struct(e["key"].alias("key"), F.lower(F.trim(e["key"])).alias("low"), canonical_name(e["key"]).alias("first"), _tidy(e["value"]).alias("value"), i.alias("at")))
    some = F.filter(all_, lambda e: (e["value"] != "") & ~e["low"].isin(*hidden))

    def form(v: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(v, r"\s+", " ")))

    def chosen(entries: Column) -> Column:
        named = F.map_from_entries(F.transform(F.filter(entries, lambda e: e["low"] == e["first"]), lambda e: F.struct(e["first"].alias("key"), form(e["value"]).alias("value"))))
        told = F.filter(entries, lambda e: (e["low"] == e["first"]) | ~F.coalesce(named[e["first"]] == form(e["value"]), F.lit(False)))
        once = F.filter(told, lambda e, i: F.array_position(F.transform(told, lambda x: F.concat(x["low"], F.lit("|"), form(x["value"]))), F.concat(e["low"], F.lit("|"), form(e["value"]))) == i + 1)
        at = F.array(*map(F.lit, PRIORITY))
        keyed = F.transform(once, lambda e: F.struct(F.when(F.array_position(at, e["first"]) > 0, F.array_position(at, e["first"])).otherwise(len(PRIORITY) + 1).alias("p"), e["at"].alias("at"), e["key"].alias("key"), e["low"].alias("low"), e["value"].alias("value")))

        def shown(e: Column) -> Column:
            out = F.concat(e["key"], F.lit(": "), e["value"])
            for name, mark in SHOWN_AS.items():
                out = F.when(e["low"] == name, F.concat(F.lit(mark), e["value"])).otherwise(out)
            return out

        return F.transform(F.array_sort(keyed), shown)

    return F.element_at(F.transform(F.array(some), chosen), 1)


def search_cards(found: DataFrame, by: list[str], order: str, body: str, source: str, metadata: str) -> DataFrame:
    """(by, cards): a card of each row that has a body, its body, source line and metadata, in order, empty lines between."""
    lines = F.concat_ws("\n", F.replace(F.trim(F.col(body)), F.lit("|"), F.lit("\n")), F.col(source), F.nullif(F.array_join(metadata_entries(F.col(metadata)), " | "), F.lit("")))
    made = found.where(F.trim(F.col(body)) != "").select(*by, F.struct(F.col(order).alias("at"), lines.alias("card")).alias("_c"))
    return made.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_c")), lambda c: c["card"]), "\n\n").alias("cards"))


def overview_cards(groups: DataFrame, by: str, label: str, shown: str, total: str, cards: str) -> DataFrame:
    """(by, markdown): a heading with label, shown and total, and the group's cards."""
    head = F.concat(F.lit("## "), F.col(label), F.lit(" ("), F.col(shown).cast("string"), F.lit("/"), F.col(total).cast("string"), F.lit(")"))
    return groups.select(by, F.concat_ws("\n\n", head, F.nullif(F.col(cards), F.lit(""))).alias("markdown"))


NO_TITLE, NO_AREA, NO_AUTHOR, NO_DATE = "s/titulo", "s/area", "s/autor", "s/data"


def entry_card(title: Column, area: Column, author: Column, number: Column, date: Column, text: Column, link: Column) -> Column:
    """An entry: **title** (*area*) ● *author* ● # number ● date, its text, and a link if it is one."""
    def known(c: Column, other: str) -> Column:
        return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(other))

    head = F.concat(F.lit("**"), known(title, NO_TITLE), F.lit("** (*"), known(area, NO_AREA), F.lit("*) ● *"), known(author, NO_AUTHOR), F.lit("* ● # "), known(number, "?"), F.lit(" ● "), known(date, NO_DATE))
    pdf = F.when(F.trim(link).rlike(r"(?i)^https?://\S+$"), F.concat(F.lit("[PDF]("), F.trim(link), F.lit(")")))
    return F.concat_ws("\n", head, F.nullif(F.trim(text), F.lit("")), pdf)


def summary_terms(summary: Column) -> Column:
    """Words and phrases of the question in a summary line (Termo: ... | Total: ...), two letters or more, the longest first."""
    asked = F.coalesce(*(F.nullif(F.trim(F.regexp_extract(summary, rf"(?is){name}:\s*(.*?)\s*{end}", 1)), F.lit("")) for name, end in (("Termo", r"\|\s*Total:"), ("Consulta", r"\|\s*Total:"), ("Termo", r"\|\s*Max:"), ("Termo", "$"), ("Consulta", "$"))))
    raw = F.regexp_extract_all(asked, F.lit(r'"[^"]+"|\S+'), 0)
    bare = F.transform(raw, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, '^"([^"]*)"$', "$1"), r"[!&|()*]", "")))
    some = F.array_distinct(F.filter(bare, lambda t: F.length(t) >= 2))
    return F.coalesce(F.transform(F.array_sort(F.transform(some, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))), lambda x: x["t"]), F.array().cast("array<string>"))


def table_cell(x: Column) -> Column:
    """Text for a cell of a markdown table."""
    return F.replace(F.regexp_replace(F.trim(x), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))


def citation_rows(found: DataFrame, paragraph: str, matched: str, book: str, title: str, page: str, similarity: str, method: str) -> DataFrame:
    """found with `line`: a row of the citation table; what is missing is N/D, 0.00 and sem_match."""
    def cell(c: str) -> Column:
        return F.coalesce(F.nullif(table_cell(F.col(c).cast("string")), F.lit("")), F.lit("N/D"))

    parts = [cell(c) for c in (paragraph, matched, book, title, page)]
    score, how = F.format_string("%.2f", F.coalesce(F.col(similarity), F.lit(0.0))), F.coalesce(F.col(method), F.lit("sem_match"))
    return found.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *parts, score, how), F.lit(" |")))


def answer_text(x: Column) -> Column:
    """A question and its answer: **question** | **W:** answer; marks of an answer that stand there are stripped. A question alone is bold."""
    head, rest = F.trim(F.element_at(F.split(x, "[|]", 2), 1)), F.trim(F.get(F.split(x, "[|]", 2), F.lit(1)))
    bare = F.trim(F.regexp_replace(rest, r"(?i)^(?:\*{0,2}W:\*{0,2}\s*)+", ""))
    return F.when(F.trim(x) == "", F.trim(x)).when(rest.isNull(), F.concat(F.lit("**"), F.trim(x), F.lit("**"))).otherwise(F.trim(F.concat(F.lit("**"), head, F.lit("** | **W:** "), bare)))


def search_summary(label: Column, term: Column, total: Column, shown: Column) -> Column:
    return F.concat(F.lit("Livro: "), label, F.lit(" | Termo: "), term, F.lit(" | Total: "), total.cast("string"), F.lit(" | Exibidos: "), shown.cast("string"))


def numbered(rank: Column, count: Column) -> Column:
    """A card's number, of two digits where there are ten cards or more."""
    return F.when(count >= 10, F.lpad(rank.cast("string"), 2, "0")).otherwise(rank.cast("string"))


def highlight_terms(query: str) -> list[str]:
    """Words and phrases of a query without stars and what is negated, the longest first."""
    out, negated = [], False
    for t in boolean.tokens(query):
        if t.kind in ("term", "phrase") and not negated and (text := t.text.replace("*", "").strip()):
            out.append(text)
        negated = t.kind == "!"
    return sorted(dict.fromkeys(out), key=lambda x: (-len(x), x))


def dictionary_card(term: Column, definitions: Column, synonyms: Column, examples: Column) -> Column:
    """A term's definitions, synonyms and examples as markdown, the first few of each."""
    def lines(c: Column, most: int) -> Column:
        return F.transform(F.slice(c, 1, most), lambda x: F.concat(F.lit("- "), x))

    syn = F.when(F.size(synonyms) > 0, F.concat(F.lit("Sinonimos: "), F.array_join(F.slice(synonyms, 1, MOST_SYNONYMS), ", ")))
    return F.concat_ws("\n", F.concat(F.lit("**"), term, F.lit("**")), F.array_join(lines(definitions, MOST_DEFINITIONS), "\n"), syn, F.nullif(F.array_join(lines(examples, MOST_EXAMPLES), "\n"), F.lit("")))


def inline_html(x: Column) -> Column:
    """Markdown within a line as HTML: links, and bold and italics by asterisks or underlines."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    x = F.regexp_replace(x, r"\[([^\]]+)\]\((https?://[^)\s]+)\)", '<a href="$2" target="_blank" rel="noopener noreferrer">$1</a>')
    for mark in (r"\*", "_"):
        x = F.regexp_replace(x, rf"(?s){mark}{{3}}(.+?){mark}{{3}}", "<strong><em>$1</em></strong>")
        x = F.regexp_replace(x, f"{mark}{mark}(.*?){mark}{mark}", "<strong>$1</strong>")
        x = F.regexp_replace(x, r"\*(.*?)\*" if mark != "_" else r"(?<!\w)_(?!\s)(.*?)(?<!\s)_(?!\w)", "<em>$1</em>")
    return x


def table_row(line: Column) -> Column:
    """Cells of a line of a markdown table."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def blocks_html(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, html): markdown by lines: headings of three levels, tables, empty lines as breaks, else paragraphs.

    A table is a line with bars, a line of hyphens (with colons for how columns stand) with as many cells, and the lines
    after it with as many. Lines are numbered within their text and never leave it.
    """
    lines = F.split(F.trim(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))), "\n")
    rows = docs.where(F.trim(F.col(text)) != "").select(key, F.posexplode(lines).alias("at", "line")).withColumn("t", F.trim("line"))
    cells, bars = table_row(F.col("t")), F.contains("t", F.lit("|"))
    rule = bars & F.forall(cells, lambda c: F.regexp_replace(c, r"\s+", "").rlike("^:?-{3,}:?$"))
    by = Window.partitionBy(key).orderBy("at")
    made = rows.withColumns({"n": F.when(bars, F.size(cells)), "rule": rule}).withColumns({"next_rule": F.lead("rule").over(by), "next_n": F.lead("n").over(by)})
    head = F.coalesce(F.col("next_rule") & (F.col("n") == F.col("next_n")), F.lit(False))
    # where a table may begin, and how far its rows go on: up to the first line with another number of cells
    made = made.withColumn("head", head).withColumn("start", F.last(F.when(head, F.struct(F.col("at").alias("at"), F.col("n").alias("n"))), ignorenulls=True).over(by))
    broken = F.max(F.when((F.col("at") > F.col("start.at")) & ~F.coalesce(F.col("n") == F.col("start.n"), F.lit(False)), 1).otherwise(0)).over(Window.partitionBy(key, "start.at").orderBy("at"))
    made = made.withColumn("table", F.when(F.col("start").isNotNull() & (broken == 0), F.col("start.at")))
    level = F.length(F.regexp_extract("t", r"^(#{1,3})\s+", 1))
    body = inline_html(F.when(level > 0, F.regexp_replace("t", r"^#{1,3}\s+", "")).otherwise(F.col("t")))
    tag = F.when(level > 0, F.concat(F.lit("h"), level.cast("string"))).otherwise(F.lit("p"))
    plain = F.when(F.col("t") == "", F.lit("<br/>")).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">")))
    stand = F.transform(table_row(F.col("t")), lambda c: F.regexp_replace(c, r"\s+", ""))
    aligned = F.transform(stand, lambda c: F.when(c.rlike("^:.*:$"), "center").when(c.rlike(":$"), "right").otherwise("left"))
    made = made.withColumn("aligns", F.max(F.when(F.col("at") == F.col("table") + 1, aligned)).over(Window.partitionBy(key, "table")))
    kind = F.when(F.col("at") == F.col("table"), "th").otherwise("td")
    row = F.array_join(F.zip_with(F.transform(cells, inline_html), "aligns", lambda c, a: F.concat(F.lit("<"), kind, F.lit(' style="text-align:'), a, F.lit('">'), c, F.lit("</"), kind, F.lit(">"))), "")
    last = F.max("at").over(Window.partitionBy(key, "table")) == F.col("at")
    in_table = F.when(F.col("at") == F.col("table"), F.concat(F.lit("<table><thead><tr>"), row, F.lit("</tr></thead><tbody>"))).when(F.col("at") == F.col("table") + 1, F.lit("")).otherwise(F.concat(F.lit("<tr>"), row, F.lit("</tr>")))
    in_table = F.concat(in_table, F.when(last, F.lit("</tbody></table>")).otherwise(F.lit("")))
    shown = made.select(key, F.struct("at", F.when(F.col("table").isNotNull(), in_table).otherwise(plain).alias("h")).alias("x"))
    return shown.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "").alias("html"))


def inline_markdown(x: Column) -> Column:
    """Inline HTML as markdown; other tags are dropped. A text without such tags stays."""
    has = x.rlike(r"(?i)<\s*/?\s*(?:strong|b|em|i|br|p)\b[^>]*>")
    y = F.regexp_replace(F.regexp_replace(x, r"(?i)<\s*br\s*/?\s*>|<\s*/\s*p\s*>", "\n"), r"(?i)<\s*p\b[^>]*>", "")
    for tags, sign in (("strong|b", "**"), ("em|i", "*")):
        y = F.regexp_replace(y, rf"(?is)<\s*(?:{tags})\b[^>]*>(.*?)<\s*/\s*(?:{tags})\s*>", rf"{re.escape(sign)}$1{re.escape(sign)}")
    y = F.regexp_replace(y, "<[^>]+>", "")
    for name, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        y = F.regexp_replace(y, f"(?i){name}", sign)
    return F.when(has, F.trim(y)).otherwise(F.trim(x))

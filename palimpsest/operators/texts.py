"""Statistics and repair of texts, highlighting, and lines of cards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.normalise import fold, fold_text, for_header

CHARS_A_PAGE, WORDS_A_MINUTE, LONG_WORD = 3000, 200, 10
#: Prefixes whose hyphen stays.
KEEP_HYPHEN = ["além", "ante", "anti", "arqui", "auto", "bem", "co", "contra", "ex", "extra", "hiper", "infra", "inter", "intra", "macro", "micro", "mini", "multi", "neo", "pós", "pre", "pró", "proto", "pseudo", "recém", "semi", "sobre", "sub", "super", "supra", "tele", "ultra", "vice"]
#: Letters of words that hyphens split, and the signs that make a rule of eight or more.
LETTERS, LOWER_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ", "a-zà-öø-ÿ"
RULE = r"^[\s\-_=~.·•]{8,}$"
#: What stands between a manual number and its item.
SPACING = {"normal_single": " ", "normal_double": "  ", "nbsp_single": "\u00a0", "nbsp_double": "\u00a0\u00a0"}
#: Signs around a page number that stands alone.
NUMBER_SIGNS = r"[\s\-–—.,;:()\[\]{}/\\|]+"


def words(x: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " "), lambda w: w != "")


def stats(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """words, chars, chars without spaces, paragraphs, pages and minutes (1 at least) of each text; lengths in code points."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.size(words(t))
    lines = F.filter(F.split(t, "\n+"), lambda p: F.trim(p) != "")
    return docs.select(
        key, n.alias("words"), F.length(t).alias("chars"), F.length(F.regexp_replace(t, r"\s", "")).alias("chars_without_spaces"), F.size(lines).alias("paragraphs"),
        F.greatest(F.lit(1), F.ceil(F.length(t) / CHARS_A_PAGE)).cast("int").alias("pages"), F.greatest(F.lit(1), F.ceil(n / WORDS_A_MINUTE)).cast("int").alias("minutes"),
    )


def word_shapes(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """syllables (groups of vowels, one a word at least), long words, and words that end in -logia."""
    w = words(F.lower(F.coalesce(F.col(text), F.lit(""))))
    syllables = F.aggregate(w, F.lit(0), lambda n, x: n + F.greatest(F.lit(1), F.regexp_count(x, F.lit("[aeiouáéíóúâêôãõàü]+"))))
    bare = F.transform(w, lambda x: F.regexp_replace(x, r"[^\p{L}]", ""))
    return docs.select(key, syllables.alias("syllables"), F.size(F.filter(bare, lambda x: F.length(x) > LONG_WORD)).alias("long_words"), F.size(F.filter(bare, lambda x: x.rlike("logia$"))).alias("logia_words"))


def _hyphen() -> str:
    """Words of two parts: as a whole where the hyphen stays (group 1), else in parts (2 and 3)."""
    keep = rf"(?i:{'|'.join(KEEP_HYPHEN)})-[{LETTERS}]{{2,}}|[{LETTERS}]{{2,}}-[{LETTERS}]{{2}}"
    return rf"(?<![{LETTERS}0-9_])(?:({keep})|([{LETTERS}]{{2,}})-([{LETTERS}]{{3,}}))(?![{LETTERS}0-9_])"


def joined_hyphens(x: Column) -> Column:
    """Words split by a hyphen within a line, joined; those with a prefix that keeps it, or a rest of two letters, stay."""
    return F.regexp_replace(x, _hyphen(), "$1$2$3")


def hyphens(x: Column) -> Column:
    """How many words joined_hyphens joins."""
    return F.size(F.filter(F.regexp_extract_all(x, F.lit(_hyphen()), 2), lambda left: left != ""))


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, place from 1, line) of non-empty lines."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("place"), "line").where("trim(line) != ''")


def joined_lines(lines_: DataFrame, key: str) -> DataFrame:
    """Lines with `joined`: one that ends in a word and a hyphen takes the first word of the next, if that is in small letters."""
    ends, begins = rf"[{LETTERS}]{{2,}}-\s*$", rf"^\s*([{LOWER_LETTERS}]{{2,}})"
    order = Window.partitionBy(key).orderBy("place")
    made = lines_.withColumns({"_next": F.lead("line").over(order), "_last": F.lag("line").over(order)})

    def meets(one: str, other: str) -> Column:
        return F.coalesce(F.col(one).rlike(ends) & F.col(other).rlike(begins), F.lit(False))

    own = F.when(meets("_last", "line"), F.regexp_replace("line", begins, "")).otherwise(F.col("line"))
    return made.select(key, "place", "line", F.when(meets("line", "_next"), F.concat(F.regexp_replace(own, r"-\s*$", ""), F.regexp_extract("_next", begins, 1))).otherwise(own).alias("joined"))


def without_rules(lines_: DataFrame) -> DataFrame:
    """Lines that are not only a rule: eight or more signs."""
    return lines_.where(~F.trim("line").rlike(RULE))


def without_headers(lines_: DataFrame, words: list[str], most: int = 5) -> DataFrame:
    """Lines that are neither a page number alone nor a running head.

    A running head has all of the words' stems in its normalised form and no more than `most` words.
    """
    norm = for_header(F.col("line"))
    head = F.lit(bool(words)) & (F.size(F.split(norm, " ")) <= most)
    for w in words:
        head = head & F.contains(norm, F.lit(w))
    number = F.regexp_replace("line", rf"(?U){NUMBER_SIGNS}", "").rlike("^[0-9]{1,4}$")
    return lines_.where(~(number | head))


def _literal(term: str) -> str:
    return "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", term)


def occurrences(x: Column, term: str) -> Column:
    """How often the term stands in the text outside of tags, whatever its case."""
    return F.regexp_count(F.regexp_replace(x, "<[^>]*>", " "), F.lit(_literal(term)))


def highlighted(x: Column, term: str) -> Column:
    return F.regexp_replace(x, _literal(term), "<mark>$0</mark>")


def highlighted_folded(x: Column, terms: list[str]) -> Column:
    """x with <mark> around the terms, whatever their case and accents; the longest of terms at one place counts.

    Folding keeps the length of composed letters, so places in the folded text are places in x: the pattern is looked
    for there, and x is cut at the same places. A text with single combining marks, which folding makes shorter, stays.
    """
    bare = [t for t in dict.fromkeys(fold_text(t) for t in sorted(terms, key=lambda t: -len(t))) if t]
    if not bare:
        return x
    either = "(?iu)" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in bare)
    folded = fold(x)
    gaps, hits = F.split(folded, either, -1), F.regexp_extract_all(folded, F.lit(f"({either})"), 1)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, pair: Column) -> Column:
        gap, hit = F.length(pair["gap"]), F.length(F.coalesce(pair["hit"], F.lit("")))
        cut = F.substring(x, s["at"] + gap, hit)
        marked = F.when(hit > 0, F.concat(F.lit("<mark>"), cut, F.lit("</mark>"))).otherwise(F.lit(""))
        return F.struct(F.concat(s["out"], F.substring(x, s["at"], gap), marked).alias("out"), (s["at"] + gap + hit).alias("at"))

    made = F.aggregate(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), start, step, lambda s: s["out"])
    return F.when(F.length(folded) == F.length(x), made).otherwise(x)


def page_list(x: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(x, "[;,]"), lambda p: F.trim(p)), lambda p: p != ""), ", ")


def titles(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"[;,\r\n]+"), lambda p: F.trim(p)), lambda p: p != "")


NO_SOURCE, NO_TITLE = "s/fonte", "s/titulo"


def source_line(kind: Column, book: Column, title: Column, date: Column, author: Column, page: Column) -> Column:
    """(**Book**, p. N) with what is known; entries (EC) name their title, questions (QUEST) date and author too."""
    def known(c: Column, other: str | None = None) -> Column:
        c = F.nullif(F.trim(F.translate(c.cast("string"), "\u00a0", " ")), F.lit(""))
        return c if other is None else F.coalesce(c, F.lit(other))

    name, at = F.concat(F.lit("**"), known(book, NO_SOURCE), F.lit("**")), F.concat(F.lit("p. "), known(page))
    entry = F.concat(F.lit("verbete *"), known(title, NO_TITLE), F.lit("*"))
    parts = F.when(kind == "EC", F.concat_ws(", ", name, entry)).when(kind == "QUEST", F.concat_ws(", ", name, known(date), known(author), at)).otherwise(F.concat_ws(", ", name, at))
    return F.concat(F.lit("("), parts, F.lit(")"))


def numbered_items(lines_: DataFrame, key: str, spacing: str = "nbsp_double") -> DataFrame:
    """Lines with `item`: a manual number in front instead of any that was there; two digits where a key has ten or more."""
    order = Window.partitionBy(key).orderBy("place")
    n = F.row_number().over(order)
    made = lines_.withColumns({"_n": n, "_all": F.count("*").over(Window.partitionBy(key))})
    bare = F.regexp_replace("line", r"^\s*\d{1,3}[.)][\s\u00a0]*", "")
    number = F.when(F.col("_all") > 9, F.lpad(F.col("_n").cast("string"), 2, "0")).otherwise(F.col("_n").cast("string"))
    return made.select(key, "place", "line", F.concat(number, F.lit("." + SPACING[spacing]), bare).alias("item"))


def shortened(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)


def metadata_order(metadata: Column, priority: list[str], hidden: list[str]) -> Column:
    """Entries of a map that are not empty or hidden, once for each value, those of `priority` first, then by key; one line."""
    entries = F.filter(F.map_entries(metadata), lambda e: ~e["key"].isin(*hidden) & (F.coalesce(F.trim(e["value"]), F.lit("")) != ""))
    at = F.array(*map(F.lit, priority))
    keyed = F.array_sort(F.transform(entries, lambda e: F.struct(F.when(F.array_position(at, e["key"]) > 0, F.array_position(at, e["key"])).otherwise(len(priority) + 1).alias("p"), e["key"].alias("k"), F.trim(e["value"]).alias("v"))))
    return F.array_join(F.array_distinct(F.transform(keyed, lambda e: e["v"])), " | ")

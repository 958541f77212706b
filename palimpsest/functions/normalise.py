"""Text normalisers. There are several and they differ on purpose; names say what each is for.

Accents are folded by translate() with a table made from the Unicode data, so all of it stays in generated code.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word character, as in Python's \w.
W = r"[\p{L}\p{N}_]"
#: A word edge, as Python's \b.
EDGE = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
SPACE = r"[\s\x1c-\x1f]"
ZERO_WIDTH = "​‌‍⁠﻿"


@functools.cache
def _table(form: str) -> tuple[str, str]:
    """Characters that decompose into one character and accents, and that character."""
    source, target = [], []
    for i in range(0x80, 0x10000):
        c = chr(i)
        base = [x for x in unicodedata.normalize(form, c) if unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != c and not 0xD800 <= i < 0xE000:
            source.append(c)
            target.append(base[0])
    return "".join(source), "".join(target)


def fold(x: Column, form: str = "NFD") -> Column:
    """Without accents: decomposed, then all non-spacing marks dropped. A text of single bytes has none and stays."""
    return F.when(F.octet_length(x) == F.length(x), x).otherwise(F.regexp_replace(F.translate(x, *_table(form)), r"\p{Mn}", ""))


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse(x: Column) -> Column:
    """White space as single spaces. Single spaces are no matches, which most are."""
    return F.regexp_replace(x, rf"(?U)(?: (?={SPACE})|[\s\x1c-\x1f&&[^ ]]){SPACE}*", " ")


def sanitise(x: Column) -> Column:
    """One line: no-break spaces as spaces, zero-width characters dropped, white space collapsed, ends stripped."""
    return F.trim(collapse(F.translate(x, " " + ZERO_WIDTH, " ")))


def plain(x: Column) -> Column:
    """sanitise, fold, lower case."""
    return F.trim(F.lower(fold(sanitise(x))))


def for_match(x: Column) -> Column:
    """plain, then only word characters, white space and asterisks. Spaces are not collapsed again."""
    return only_words(plain(x))


def only_words(x: Column) -> Column:
    # the letters that most are come first
    return F.regexp_replace(x, r"(?U)[^a-z \p{L}\p{N}_\s*]", "")


def without_markdown(x: Column) -> Column:
    return F.replace(x, F.lit("*"), F.lit(""))


def for_semantic(x: Column) -> Column:
    return for_match(without_markdown(sanitise(x)))


def for_citation(x: Column) -> Column:
    """Lower case first, then folded; punctuation stays."""
    return F.trim(collapse(fold(F.lower(x))))


def for_biblio(x: Column) -> Column:
    """Compatibility-folded lower-case letters and digits, single spaces."""
    y = F.lower(fold(_expand(x), "NFKD"))
    return F.trim(F.regexp_replace(y, "[^a-z0-9]+", " "))


def for_books(x: Column) -> Column:
    """As for_biblio, but hyphens, parentheses and dots stay, and a space at the ends too."""
    y = F.lower(fold(_expand(strip(x)), "NFKD"))
    return F.regexp_replace(F.regexp_replace(y, r"[^a-z0-9\s\-().]", " "), r"\s+", " ")


def for_external(x: Column) -> Column:
    """Lower case, collapsed, accents kept, other signs than hyphens dropped."""
    return F.regexp_replace(F.lower(F.trim(collapse(x))), r"(?U)[^\p{L}\p{N}_\sÀ-ÿ-]", "")


#: Articles that a title may begin with.
ARTICLES = ["o", "a", "os", "as", "the", "el", "la", "los", "las", "le", "les", "l"]


def for_title_score(x: Column) -> Column:
    """for_external without an article at its beginning, up to the first hyphen (colons and bars are gone by then)."""
    y = F.regexp_replace(for_external(x), rf"^(?:{'|'.join(ARTICLES)})\s+", "")
    return F.trim(F.regexp_replace(y, r"(?s)\s*[:|-].*$", ""))


def for_chunks(x: Column) -> Column:
    """No-break spaces as spaces, line feeds only, spaces and tabs collapsed, at most one empty line."""
    y = F.regexp_replace(F.translate(x, " ", " "), r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(y, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def for_header(x: Column) -> Column:
    """Folded, lower case, other characters than letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(fold(x)), "[^a-z0-9]+", " "))


def for_comparison(x: Column) -> Column:
    return F.lower(F.trim(collapse(F.translate(x, " ", " "))))


def cell(x: Column) -> Column:
    """A table cell: no-break spaces and line ends as spaces, ends stripped, not collapsed."""
    return F.trim(F.translate(x, " \r\n", "   "))


def _expand(x: Column) -> Column:
    """Ligatures and fractions that translate() can't expand."""
    for i in (*range(0xFB00, 0xFB07), 0xBC, 0xBD, 0xBE, 0x132, 0x133, 0x2026):
        x = F.replace(x, F.lit(chr(i)), F.lit(unicodedata.normalize("NFKD", chr(i))))
    return x


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility forms composed, which no function of Spark does."""
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


# The same for single values of a query, on the driver.


def plain_text(s: str) -> str:
    s = re.sub(r"\s+", " ", re.sub(f"[{ZERO_WIDTH}]", "", s.replace(" ", " "))).strip()
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").lower().strip()


def fold_text(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


def match_text(s: str) -> str:
    return re.sub(r"[^\w\s*]", "", plain_text(s))


def citation_text(s: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", s).strip()


def biblio_text(s: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return re.sub(r"[^a-z0-9]+", " ", s).strip()

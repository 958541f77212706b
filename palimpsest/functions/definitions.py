"""Cleaning of dictionary definitions: numbers, labels of grammar, and glosses in capitals."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Abbreviations that say a word's class; alone they are no definition. Dots and spaces after s, f and m may lack.
LABELS = [r"s\.?\s*f\.?", r"s\.?\s*m\.?", r"sf\.?", r"sm\.?", r"adj\.?", r"adv\.?", r"v\.?", r"vtd\.?", r"vti\.?", r"vi\.?", r"pron\.?", r"prep\.?"]
#: Capitals that glosses are written in.
CAPITALS = "A-ZÁÀÂÃÉÊÍÓÔÕÚÇ"
_LABEL = re.compile("|".join(LABELS), re.I)
_HEAD = re.compile(r"(?:\d+\.\s*)*((?i:ca\.\s*)*)")
_BLOCK = rf"([{CAPITALS}]{{3,}}(?:\s+[{CAPITALS}]{{3,}})*)"
_BEFORE, _LAST = re.compile(rf"{_BLOCK}\s*:\s*"), re.compile(rf"\s+{_BLOCK}$")
_NUMBERED, _SEMICOLON = re.compile(r"(?=(?:^|\s)\d+\.)"), re.compile(r"\s*;\s+")
MOST_GLOSS_WORDS = 4


def clean_text(s: str | None) -> str:
    """Entities as characters, tags dropped, compatibility forms composed, notes in brackets dropped, one line."""
    s = html.unescape(s or "")
    if "<" in s and ">" in s:
        s = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ", s)
    s = unicodedata.normalize("NFKC", s)
    s = re.sub(r"\[[^\]]+\]|(?i:\(\s*editar\s*\))", " ", s)
    return re.sub(r"\s+", " ", s).strip(" -\n\t\r")


def _words(block: str) -> str:
    return ", ".join(block.lower().split())


def clean_definition(s: str) -> str:
    """Without number and mark of circa; capitals are said to be synonyms; first letter large. A mere label is empty."""
    s = clean_text(s)
    s = s[_HEAD.match(s).end() :]
    if _LABEL.fullmatch(s):
        return ""
    s = _BEFORE.sub(lambda m: f" Sinonimos: {_words(m[1])}. ", s)
    s = _LAST.sub(lambda m: f". Sinonimo: {_words(m[1])}.", s)
    for pattern, new in ((r"\s+\.\s*", ". "), (r"\s+([,:])", r"\1"), (r"\s{2,}", " ")):
        s = re.sub(pattern, new, s)
    s = s.strip(" .")
    return s[:1].upper() + s[1:]


def is_gloss(s: str) -> bool:
    """A few words, all in capitals."""
    s = clean_text(s)
    return len(s.split()) <= MOST_GLOSS_WORDS and any(map(str.isalpha, s)) and s == s.upper()


def split_senses(s: str) -> list[str]:
    """Numbered senses, else those between semicolons, else the whole."""
    s = clean_text(s)
    for pattern in (_NUMBERED, _SEMICOLON):
        parts = [p for p in map(clean_text, pattern.split(s)) if p]
        if len(parts) > 1:
            return parts
    return [s] if s else []


def once(values: list[str]) -> list[str]:
    """Cleaned values that are not empty, each once whatever its case, in the first one's spelling."""
    first: dict[str, str] = {}
    for v in filter(None, map(clean_text, values)):
        first.setdefault(v.casefold(), v)
    return list(first.values())


def normalised(values: list[str]) -> list[str]:
    """Cleaned senses once each; what only names synonyms joins the sense before it, or goes if there is none."""
    out: list[str] = []
    for made in filter(None, (clean_definition(p) for v in values for p in split_senses(v))):
        more = f". Sinonimo: {made.lower()}." if is_gloss(made) else f" {made}" if made.lower().startswith(("sinonimos:", "sinonimo:")) else None
        if more is None:
            out.append(made)
        elif out:
            out[-1] += more
    return once(out)


def _each(f):
    @F.pandas_udf(ArrayType(StringType()))
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f([x for x in v if x]) for v in values])

    return run


#: Each array of raw definitions, normalised; null for null.
definitions = _each(normalised)
#: Each array of strings, cleaned and once each; null for null.
distinct = _each(once)


@F.pandas_udf(StringType())
def cleaned(values: pd.Series) -> pd.Series:
    """clean_text; null for null."""
    return pd.Series([None if v is None else clean_text(v) for v in values])

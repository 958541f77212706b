"""The boolean full-text language, compiled to Column expressions.

Terms next to each other are joined by `&`; `!` binds more than `&`, that more than `|`; parentheses group. A plain
term matches as a substring, "a phrase" as whole words with any white space between them, a term with `*` as a pattern
between word edges whose stars span words. All is compared in the form of normalise.for_match.

Three traits are part of the language. A query that isn't well-formed matches nothing; unbalanced parentheses make it a
literal. Without `|`, each literal must (after `!`: must not) also stand in the text as it is, and `!` before a group
concerns its first literal only. A row matches if its whole text or any one of its segments does, so that `a !b` finds a
row with a segment that has a and not b.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.normalise import EDGE, W, match_text

RANK = {"!": 3, "&": 2, "|": 1}


@dataclass(frozen=True)
class Token:
    kind: str  # an operator, "term" or "phrase"
    text: str = ""


def tokens(query: str) -> list[Token]:
    """A quotation mark opens a phrase only where a token starts; an open phrase ends with the query."""
    out, rest = [], query
    while rest := rest.lstrip():
        if rest[0] in "()&|!":
            out.append(Token(rest[0]))
            rest = rest[1:]
        elif rest[0] == '"':
            text, _, rest = rest[1:].partition('"')
            out.append(Token("phrase", text))
        else:
            text = re.match(r"[^\s()&|!]+", rest)[0]
            out.append(Token("term", text))
            rest = rest[len(text) :]
    return out


def postfix(items: list[Token]) -> list[Token]:
    """Reverse Polish order; operators of the same rank leave from left to right, `!` included."""
    joined: list[Token] = []
    for t in items:
        if joined and (joined[-1].text or joined[-1].kind in (")", "phrase", "term")) and t.kind not in ("&", "|", ")"):
            joined.append(Token("&"))
        joined.append(t)
    out, held = [], []
    for t in joined:
        if t.kind in RANK:
            while held and held[-1].kind != "(" and RANK[held[-1].kind] >= RANK[t.kind]:
                out.append(held.pop())
            held.append(t)
        elif t.kind == "(":
            held.append(t)
        elif t.kind == ")":
            while held and held[-1].kind != "(":
                out.append(held.pop())
            if held:
                held.pop()
        else:
            out.append(t)
    return out + held[::-1]


def balanced(query: str) -> bool:
    """Parentheses count inside of quotation marks too."""
    depth = 0
    for c in query:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


def _operand(t: Token, x: Column) -> Column:
    text = match_text(t.text)
    if t.kind == "phrase":
        words = text.split()
        return x.rlike(rf"(?U){EDGE}{r'\s+'.join(words)}{EDGE}") if words else F.lit(False)
    if not text:
        return F.lit(False)
    if "*" in text:
        return _wildcard(text.split("*"), x)
    return F.contains(x, F.lit(text))


def _wildcard(parts: list[str], x: Column) -> Column:
    """Whether x has the parts in order, the first one from a word edge on and the last one up to one.

    The first part is taken where it stands first, and so is each that follows, so that what is left for the next one
    is as long as can be: one pass, where a pattern with stars would go back for each place of the first part. Texts
    are in normalised form, on one line.
    """
    first, *inner, last = parts
    at = F.regexp_instr(x, F.lit(rf"(?U){EDGE}{first}" if first else W))
    rest = F.when(at > 0, F.substring(x, at + len(first), F.length(x)))
    for p in filter(None, inner):
        at = F.instr(rest, p)
        rest = F.when(at > 0, F.substring(rest, at + len(p), F.length(rest)))
    # without a last part: the word that the letters before are in ends somewhere
    found = rest.rlike(rf"(?U){last}{EDGE}") if last else rest.isNotNull()
    return F.contains(x, F.lit(max(parts, key=len))) & F.coalesce(found, F.lit(False))


def predicate(query: str, x: Column) -> Column:
    """Whether the normalised text x satisfies the query."""
    if not balanced(query):
        return F.contains(x, F.lit(match_text(query)))
    held: list[Column] = []
    order = postfix(tokens(query))
    if not order:
        return F.lit(True)
    for t in order:
        if t.kind == "!":
            if not held:
                return F.lit(False)
            held.append(~held.pop())
        elif t.kind in "&|":
            if len(held) < 2:
                return F.lit(False)
            b, a = held.pop(), held.pop()
            held.append(a & b if t.kind == "&" else a | b)
        else:
            held.append(_operand(t, x))
    return held[0] if len(held) == 1 else F.lit(False)


def literals(query: str) -> list[tuple[str, bool]]:
    """Literals that must (or, False, must not) stand in the text; none in a query with `|`."""
    items = tokens(query)
    if any(t.kind == "|" for t in items):
        return []
    out, wanted = [], True
    for t in items:
        if t.kind == "!":
            wanted = False
        elif t.kind in ("term", "phrase"):
            text = match_text(t.text)
            if text and "*" not in text:
                out.append((text, wanted))
            wanted = True
        elif t.kind != "(":
            wanted = True
    return out


def prefilter(query: str, x: Column) -> Column:
    parts = [F.contains(x, F.lit(t)) if wanted else ~F.contains(x, F.lit(t)) for t, wanted in literals(query)]
    return functools.reduce(operator.and_, parts, F.lit(True))


def row_matches(query: str, hay: Column, segments: Column, strict_not: bool = False) -> Column:
    """Whether a row's normalised text or one of its segments satisfies the query. strict_not: the whole text only."""
    check(query)
    if strict_not:
        return prefilter(query, hay) & predicate(query, hay)
    pre = prefilter(query, hay) | F.exists(segments, lambda s: prefilter(query, s))
    return pre & (predicate(query, hay) | F.exists(segments, lambda s: predicate(query, s)))


def possible(query: str, has: Callable[[str], Column]) -> Column:
    """Whether a row that matches can be among rows of which only has(literal) is known: whether some row may have it.

    Always true where row_matches() is for any of the rows: negations rule nothing out, phrases and patterns ask for
    each of their parts.
    """
    check(query)

    def whole(parts) -> Column:
        return functools.reduce(operator.and_, (has(p) for p in parts if p), F.lit(True))

    wanted = whole(text for text, there in literals(query) if there for text in text.split())
    if not balanced(query):
        return wanted & whole([match_text(query)])
    held: list[Column] = []
    for t in postfix(tokens(query)):
        if t.kind == "!":
            held = held[:-1] + [F.lit(bool(held))]
        elif t.kind in "&|":
            if len(held) < 2:
                return F.lit(False)
            b, a = held.pop(), held.pop()
            held.append(a & b if t.kind == "&" else a | b)
        else:
            text = match_text(t.text)
            held.append(whole(re.split(r"[\s*]+", text)) if text else F.lit(False))
    return wanted & held[0] if len(held) == 1 else F.lit(False)


def check(query: str) -> None:
    if not match_text(query or ""):
        raise ValueError("the query has nothing to search for")


__all__ = ["W", "balanced", "check", "literals", "possible", "postfix", "predicate", "prefilter", "row_matches", "tokens"]

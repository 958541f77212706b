"""Nodes of HTML pages, for selection by Column expressions."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

_NODE = StructType()
for _name in ("at", "parent", "last"):
    _NODE.add(_name, IntegerType())
_NODE.add("tag", StringType()).add("id", StringType()).add("classes", ArrayType(StringType())).add("text", StringType())
NODE = _NODE.simpleString()
#: Elements without an end, and those that an element of the same kind closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY_SAME = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
SILENT = {"script", "style", "template"}


class _Nodes(HTMLParser):
    """Elements and texts in order; texts have the tag ''. A node's `last` is the place of the last node within it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def _add(self, tag: str, attrs: dict[str, str], text: str) -> int:
        at = len(self.rows)
        self.rows.append([at, self.open[-1] if self.open else -1, at, tag, attrs.get("id") or "", (attrs.get("class") or "").split(), text])
        return at

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED_BY_SAME and self.open and self.rows[self.open[-1]][3] == tag:
            self.handle_endtag(tag)
        at = self._add(tag, dict(attrs), "")
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, dict(attrs), "")

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[depth]][3] == tag:
                for at in self.open[depth:]:
                    self.rows[at][2] = len(self.rows) - 1
                del self.open[depth:]
                return

    def handle_data(self, data):
        if data.strip() and not (self.open and self.rows[self.open[-1]][3] in SILENT):
            self._add("", {}, data.strip())

    def done(self) -> list[tuple]:
        self.close()
        for at in self.open:
            self.rows[at][2] = len(self.rows) - 1
        for at, _, last, tag, *_, text in self.rows:
            if tag:
                self.rows[at][6] = " ".join(r[6] for r in self.rows[at + 1 : last + 1] if not r[3])
        return [tuple(r) for r in self.rows]


@F.pandas_udf(ArrayType(_NODE))
def nodes(pages: pd.Series) -> pd.Series:
    """All nodes of each page: place, parent's place, last place within, tag, id, classes and text; null for null."""

    def one(page: str | None):
        if page is None:
            return None
        parser = _Nodes()
        parser.feed(page)
        return parser.done()

    return pd.Series([one(p) for p in pages])


def select(all_: Column, tag: str = "", cls: str = "", id_: str = "") -> Column:
    """The nodes with the tag, class and id that are given."""
    def fits(n: Column) -> Column:
        test = F.lit(True)
        for name, column in ((tag, n["tag"]), (id_, n["id"])):
            test = test & (column == name) if name else test
        return test & F.array_contains(n["classes"], cls) if cls else test

    return F.filter(all_, fits)


def within(all_: Column, node: Column) -> Column:
    """The nodes inside of a node, which may be null: then none."""
    return F.coalesce(F.filter(all_, lambda n: (n["at"] > node["at"]) & (n["at"] <= node["last"])), F.array().cast(f"array<{NODE}>"))


def texts(some: Column) -> Column:
    return F.transform(some, lambda n: n["text"])

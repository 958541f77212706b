"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from palimpsest.queries import answering, basic, bibliography, citing, searching, semantics

QUERIES: dict = {}
SQL: dict = {}
for _module in (searching, basic, semantics, citing, bibliography, answering):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL

"""What model answers hold: an object somewhere in a text, the text and references of nested responses.

Everything is VARIANT and array functions; a value that isn't of the expected kind counts as none, and no answer makes a
query fail.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.normalise import strip

#: How many definitions, related terms and references an answer may give.
MOST_DEFINITIONS, MOST_TERMS, MOST_REFERENCES = 8, 12, 12
#: Kinds of blocks that hold text, and what a reference may be called, the first that isn't empty.
TEXT_BLOCKS = ["output_text", "text"]
LABELS = ["filename", "file_name", "title", "file_id", "attributes.filename", "attributes.file_name", "attributes.title", "attributes.document_name", "attributes.source", "attributes.book"]

_FENCED = r"(?siU)```(?:json)?\s*(\{.*?\})\s*```"
_SPAN = r"(?s)(\{.*\})"
_END = "the end of the value"
_SIGNS = r"(?s)\\.|[\"{}]|[^\\\"{}]+|\\"


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def field(v: Column, name: str, kind: str = "variant") -> Column:
    """A field of an object by its path; null where it isn't there or of another kind."""
    return F.try_variant_get(v, f"$.{name}", kind)


def items(v: Column, name: str) -> Column:
    """The elements of an array field; none where it is no array."""
    return F.coalesce(field(v, name, "array<variant>"), F.array().cast("array<variant>"))


def text_of(v: Column) -> Column:
    """A value as stripped text: false values (null, 0, false, empty) are empty, nested ones are their JSON."""
    raw = F.try_variant_get(v, "$", "string")
    empty = v.isNull() | _is(v, "VOID") | (_is(v, "BOOLEAN") & (raw == "false")) | (~_is(v, "STRING") & F.coalesce(F.try_variant_get(v, "$", "double") == 0, F.lit(False))) | (raw.isin("[]", "{}") & ~_is(v, "STRING"))
    return F.when(F.coalesce(empty, F.lit(True)), "").when(_is(v, "BOOLEAN"), "True").otherwise(strip(raw))


def balanced(text: Column) -> Column:
    """The outermost {...} of a text, in order; braces within strings don't count, nor quotes outside of braces.

    One pass over the signs holds a depth, whether a string is open, and where the outermost brace stands.
    """
    signs = F.regexp_extract_all(text, F.lit(_SIGNS), 0)
    state = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("start"), F.array().cast("array<struct<start:int,length:int>>").alias("found"))

    def step(s: Column, sign: Column) -> Column:
        after, inside = s["at"] + F.length(sign), s["depth"] > 0
        opens, closes = ~s["quoted"] & (sign == "{"), ~s["quoted"] & inside & (sign == "}")
        ends = closes & (s["depth"] == 1)
        return F.struct(
            after.alias("at"),
            (s["depth"] + opens.cast("int") - closes.cast("int")).alias("depth"),
            F.when(inside & (sign == '"'), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            F.when(opens & ~inside, s["at"]).otherwise(s["start"]).alias("start"),
            F.when(ends, F.concat(s["found"], F.array(F.struct(s["start"].alias("start"), (after - s["start"]).alias("length"))))).otherwise(s["found"]).alias("found"),
        )

    found = F.aggregate(signs, state, step)["found"]
    return F.transform(found, lambda x: F.substring(text, x["start"], x["length"]))


def strict_json(text: Column) -> Column:
    """The value (variant) of a text that is JSON as a whole, else null. Spark's parser alone passes over what follows a value."""
    pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))), "$", "array<variant>")
    return F.when((F.size(pair) == 2) & (F.try_variant_get(F.get(pair, F.lit(1)), "$", "string") == _END), F.get(pair, F.lit(0)))


def json_block(text: Column, deep: bool = False) -> Column:
    """The first object (variant) among the whole text, its fenced blocks, and what stands from the first to the last brace.

    Null where none of these parses as an object; a text that parses as something else is looked through further. With
    deep, the outermost balanced blocks are tried at last. An object that repeats a key doesn't parse, NaN neither.
    """
    raw = strip(text)

    def first(candidates: Column) -> Column:
        parsed = F.transform(candidates, strict_json)
        return F.get(F.filter(parsed, lambda v: _is(v, "OBJECT")), F.lit(0))

    tries = [first(F.array(raw)), first(F.regexp_extract_all(raw, F.lit(_FENCED), 1)), first(F.array(F.regexp_extract(raw, _SPAN, 1)))]
    return F.coalesce(*tries, *([first(balanced(raw))] if deep else []))


def _distinct(texts: Column, most: int | None = None) -> Column:
    """Non-empty texts, each once, in order, the first `most`."""
    own = F.array_distinct(F.filter(texts, lambda t: t != ""))
    return own if most is None else F.slice(own, 1, most)


def definitions(block: Column) -> Column:
    """array<struct<term, meaning>>: the first MOST_DEFINITIONS objects of `definitions` that have both."""
    made = F.transform(F.filter(items(block, "definitions"), lambda d: _is(d, "OBJECT")), lambda d: F.struct(text_of(field(d, "term")).alias("term"), text_of(field(d, "meaning")).alias("meaning")))
    return F.slice(F.filter(made, lambda d: (d["term"] != "") & (d["meaning"] != "")), 1, MOST_DEFINITIONS)


def query_context(answer: Column, references: Column | None = None) -> Column:
    """struct of used, definitions, related_terms, disambiguated_query and references, of an answer's text.

    An answer without an object, or with none of these, gives empty ones and is not used.
    """
    block = json_block(answer)
    terms = _distinct(F.transform(items(block, "related_terms"), text_of), MOST_TERMS)
    query = text_of(field(block, "disambiguated_query"))
    known = _distinct(F.transform(references, strip), MOST_REFERENCES) if references is not None else F.array().cast("array<string>")
    used = (F.size(definitions(block)) > 0) | (F.size(terms) > 0) | (query != "")
    return F.struct(used.alias("used"), definitions(block).alias("definitions"), terms.alias("related_terms"), query.alias("disambiguated_query"), known.alias("references"))


def _value(v: Column) -> Column:
    """A text, or the value of an object that wraps one."""
    return F.when(_is(v, "OBJECT"), text_of(field(v, "value"))).otherwise(text_of(v))


def _blocks(item: Column, make: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(items(item, "content"), make))


def response_text(payload: Column) -> Column:
    """Text of a response (variant): its outputs' text blocks and own texts by lines, else its output_text."""

    def of_block(b: Column) -> Column:
        return F.when(F.lower(text_of(field(b, "type"))).isin(TEXT_BLOCKS), F.array(_value(field(b, "text")))).otherwise(F.array().cast("array<string>"))

    def of_item(i: Column) -> Column:
        own = field(i, "text")
        return F.concat(_blocks(i, of_block), F.when(_is(own, "OBJECT") | _is(own, "STRING"), F.array(_value(own))).otherwise(F.array().cast("array<string>")))

    chunks = F.filter(F.flatten(F.transform(items(payload, "output"), of_item)), lambda t: t != "")
    other = field(payload, "output_text")
    parts = F.filter(F.transform(items(payload, "output_text"), text_of), lambda t: t != "")
    # an empty list of parts reads as an empty text
    return F.when(F.size(chunks) > 0, F.array_join(chunks, "\n")).when(_is(other, "ARRAY"), F.array_join(parts, "\n")).otherwise(_value(other))


def reference_label(v: Column) -> Column:
    """The first of LABELS that isn't empty; empty without any."""
    return F.coalesce(*(F.nullif(text_of(field(v, name)), F.lit("")) for name in LABELS), F.lit(""))


def response_references(payload: Column) -> Column:
    """array<string>: labels of found files and cited files of a response, in order, each once."""

    def named(i: Column, kind: str) -> Column:
        return _is(i, "OBJECT") & (F.lower(text_of(field(i, "type"))) == kind)

    def of_item(i: Column) -> Column:
        found = F.when(named(i, "file_search_call"), F.filter(items(i, "results"), lambda r: _is(r, "OBJECT"))).otherwise(F.array().cast("array<variant>"))
        cited = _blocks(i, lambda b: F.filter(items(b, "annotations"), lambda a: named(a, "file_citation")))
        return F.transform(F.concat(found, cited), reference_label)

    return _distinct(F.flatten(F.transform(items(payload, "output"), of_item)))

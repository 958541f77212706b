"""PII: format-preserving pseudonyms by a keyed Feistel permutation, as DataFrame expressions.

Numbers that pass their check (payment cards: Luhn; IBAN: mod 97; IPv4: octets; dates: the calendar), phone and social
security numbers (by their form only, as they have no check), names of e-mail addresses (their domain stays) and secrets
(hexadecimal ones of 32 digits and more, access keys, passwords) are replaced by others of the same form. The
permutation depends on key, kind and the value without its separators, so equal values get equal pseudonyms in all
documents, and different values different ones. What fails its check stays as it is.

No shuffle and no UDF. Only texts with a digit, an @, a password, AKIA or 32 letters a-f are matched at all; patterns
start at a boundary and take possessive runs, so a scan is linear also in one word of a megabyte. A match tells its kind
by itself: what stands before a password is part of its match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import free_name

ROUNDS = 8
DIGITS = "0123456789"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Days from 0001-01-01 to 9999-12-31 are 2127 * 1717, the two halves of a date's Feistel network.
FIRST_DAY, DAY_HALVES = "0001-01-01", (2127, 1717)
#: Dates with the month first are permuted again until the day is above 12; all but 1 of 10^25 need fewer turns.
MOST_TURNS = 64

PASSWORD = r"(?<![A-Za-z])(?:password|passwd|pwd)[=:]"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "password": PASSWORD + r"[A-Za-z0-9]{6,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-])",
    "ipv4": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
}
#: A whole run of groups of digits, up to where another kind begins; card_parts() looks for the cards in it.
_SEPARATOR = r"(?:-| (?!{}))".format("|".join(KINDS[k] for k in ("date", "ipv4", "ssn", "phone")))
KINDS["card"] = rf"(?<!\d)(?!\d{{20,}}+(?!{_SEPARATOR}\d))\d(?:{_SEPARATOR}?+\d){{12,}}+"
#: What only such a run is.
CARD_RUN = r"\d{13,19}|\d+[ -][\d -]*"
CARD_DIGITS = (13, 19)
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def feistel_text(s: Column, kind: str, key: str, alphabets: tuple[str, ...] = (DIGITS,)) -> Column:
    """A permutation of the strings of one shape: each character moves within its alphabet, others stay.

    Halves take turns: a half's characters move by a keystream of SHA-256 over the digest of key, kind, round and the
    other half, so the work grows with the length only.
    """

    def moved(half: Column, other: Column, turn: Column) -> Column:
        def by_seed(seed: Column) -> Column:
            last = F.greatest(F.lit(0), F.floor((F.length(half) - 1) / 16)).cast("int")
            blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.sha2(F.concat(seed, F.lit("|"), b.cast("string")), 256))

            def char_of(stream: Column, c: Column, i: Column) -> Column:
                by = _number(F.substring(F.get(stream, F.floor(i / 16).cast("int")), (i % 16 * 4 + 1).cast("int"), F.lit(4)))
                out = c
                for a in alphabets:
                    at = F.instr(F.lit(a), c)
                    out = F.when((c != "") & (at > 0), F.substring(F.lit(a), ((at - 1 + by) % len(a) + 1).cast("int"), F.lit(1))).otherwise(out)
                return out

            return _let(blocks, lambda stream: F.array_join(F.transform(_chars(half), lambda c, i: char_of(stream, c, i)), ""))

        return _let(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other), 256), by_seed)

    n = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), n).alias("a"), F.substring(s, n + 1, F.length(s)).alias("b"))
    turns = F.array(*(F.lit(i) for i in range(ROUNDS)))
    return F.aggregate(turns, start, lambda h, i: F.struct(h["b"].alias("a"), moved(h["a"], h["b"], i).alias("b")), lambda h: F.concat(h["a"], h["b"]))


def feistel_pair(a: Column, b: Column, halves: tuple[int, int], kind: str, key: str, done) -> Column:
    """A permutation of the pairs of numbers below the two halves."""

    def step(h: Column, turn: Column) -> Column:
        def by(x: Column, n: int) -> Column:
            return _number(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), x.cast("string")), 256), 1, 12)) % n

        odd = turn % 2 == 1
        return F.struct(F.when(odd, h["a"]).otherwise((h["a"] + by(h["b"], halves[0])) % halves[0]).alias("a"), F.when(odd, (h["b"] + by(h["a"], halves[1])) % halves[1]).otherwise(h["b"]).alias("b"))

    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step, done)


def luhn(digits: Column) -> Column:
    """The Luhn sum, divisible by 10 for a valid number."""
    def part(c: Column, i: Column) -> Column:
        return _let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))

    return F.aggregate(F.transform(_chars(F.reverse(digits)), part), F.lit(0), lambda x, y: x + y)


def mod97(chars: Column) -> Column:
    """The number of a string of digits and capitals (A = 10 ...), modulo 97."""
    return F.aggregate(_chars(chars), F.lit(0), lambda x, c: F.when(c.rlike("[0-9]"), (x * 10 + F.instr(F.lit(DIGITS), c) - 1) % 97).otherwise((x * 100 + F.instr(F.lit(UPPER), c) + 9) % 97).cast("int"))


def _put_back(shape: Column, chars: Column, which: str = "[A-Z0-9]") -> Column:
    """shape with its characters of the class replaced in turn by chars."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(x: Column, c: Column) -> Column:
        hit = c.rlike(which)
        return F.struct(F.concat(x["out"], F.when(hit, F.substring(chars, x["at"], F.lit(1))).otherwise(c)).alias("out"), (x["at"] + F.when(hit, 1).otherwise(0)).alias("at"))

    return F.aggregate(_chars(shape), start, step, lambda x: x["out"])


def _bare(m: Column, other: str = "[^0-9]") -> Column:
    return F.regexp_replace(m, other, "")


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), feistel_text(F.substring(d, F.lit(2), F.length(d) - 2), "card", key))
        whole = _let(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn(d) % 10 == 0, _let(whole, lambda w: _put_back(m, w)))

    return _let(_bare(m), new)


def card_parts(m: Column) -> Column:
    """A run of groups of digits as parts (m, kind): cards, and with a null kind what stands before, between and behind them.

    From left to right, a card is the longest row of whole groups that begins here, has 13 to 19 digits and passes Luhn.
    """

    def part(groups: Column, start: Column, end: Column, kind: str | None) -> Column:
        return F.struct(F.array_join(F.slice(groups, start, end - start + 1), "").alias("m"), F.lit(kind).cast("string").alias("kind"))

    def of_groups(groups: Column) -> Column:
        n = F.size(groups)

        def end_from(i: Column) -> Column:
            def valid(j: Column) -> Column:
                return _let(_bare(F.array_join(F.slice(groups, i, j - i + 1), "")), lambda d: F.when(F.length(d).between(*CARD_DIGITS), luhn(d) % 10 == 0).otherwise(False))

            return F.struct(i.alias("start"), F.array_max(F.filter(F.sequence(i, F.least(i + CARD_DIGITS[1] - 1, n)), valid)).alias("end"))

        found = F.filter(F.transform(F.sequence(F.lit(1), n), end_from), lambda x: x["end"].isNotNull())
        none = F.array().cast("array<struct<start:int,end:int,before:int>>")
        start = F.struct(none.alias("cards"), F.lit(0).alias("last"))

        def step(x: Column, c: Column) -> Column:
            more = F.concat(x["cards"], F.array(F.struct(c["start"].alias("start"), c["end"].alias("end"), x["last"].alias("before"))))
            return F.when(c["start"] > x["last"], F.struct(more.alias("cards"), c["end"].alias("last"))).otherwise(x)

        def parts(x: Column) -> Column:
            cards = F.transform(x["cards"], lambda c: F.array(part(groups, c["before"] + 1, c["start"] - 1, None), part(groups, c["start"], c["end"], "card")))
            return F.concat(F.flatten(cards), F.array(part(groups, x["last"] + 1, n, None)))

        return _let(F.aggregate(found, start, step), parts)

    return _let(F.regexp_extract_all(m, F.lit(r"\d+[ -]?"), 0), of_groups)


def _iban(m: Column, key: str) -> Column:
    def new(x: Column) -> Column:
        country, body = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x))
        made = _let(feistel_text(body, "iban", key, (DIGITS, UPPER)), lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(mod97(F.concat(body, country, F.substring(x, 3, 2))) == 1, _let(made, lambda w: _put_back(m, w)))

    return _let(_bare(m, "[^A-Z0-9]"), new)


def _ipv4(m: Column, key: str) -> Column:
    def new(o: Column) -> Column:
        def text(h: Column) -> Column:
            return F.concat_ws(".", *(y.cast("string") for x in (h["a"], h["b"]) for y in (F.floor(x / 256), x % 256)))

        return F.when(F.forall(o, lambda x: x <= 255), feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "ipv4", key, text))

    return _let(F.transform(F.split(m, "[.]"), lambda x: x.cast("int")), new)


def _moved_day(day: Column, kind: str, key: str) -> Column:
    """Another day (days since FIRST_DAY), by a permutation of all days of the calendar."""
    return feistel_pair(F.floor(day / DAY_HALVES[1]), day % DAY_HALVES[1], DAY_HALVES, kind, key, lambda h: (h["a"] * DAY_HALVES[1] + h["b"]).cast("int"))


def _date(m: Column, key: str) -> Column:
    """Year, month, day; else day, month, year; else, where that is no date, month, day, year.

    What can only be read with the month first stays so: its day is above 12, and that of its pseudonym too.
    """
    start = F.lit(FIRST_DAY).cast("date")
    first = F.substring(m, 1, 4).rlike("^[0-9]{4}$")
    sep = F.when(first, F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))

    def read(*parts: Column) -> Column:
        return F.datediff(F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"), start)

    def shown(day: Column, *forms: str) -> Column:
        return _let(F.date_add(start, day), lambda d: F.concat_ws("|", *(F.date_format(d, f) for f in forms)))

    def put(day: Column, *forms: str) -> Column:
        return F.regexp_replace(shown(day, *forms), "[|]", sep)

    y, a, b = F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)
    iso = _let(read(F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2)), lambda d: F.when(d >= 0, put(_moved_day(d, "date", key), "yyyy", "MM", "dd")))
    day_first = _let(read(y, b, a), lambda d: F.when(d >= 0, put(_moved_day(d, "date", key), "dd", "MM", "yyyy")))

    def above_12(day: Column) -> Column:
        return F.dayofmonth(F.date_add(start, day)) > 12

    def walked(day: Column) -> Column:
        turns = F.sequence(F.lit(1), F.lit(MOST_TURNS))
        return F.aggregate(turns, _moved_day(day, "month first", key), lambda d, _: F.when(above_12(d), d).otherwise(_moved_day(d, "month first", key)))

    month_first = _let(read(y, a, b), lambda d: F.when((d >= 0) & above_12(d), put(walked(d), "MM", "dd", "yyyy")))
    return F.when(first, iso).otherwise(F.coalesce(day_first, month_first))


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    local = F.lower(F.substring(m, F.lit(1), at - 1))
    return F.concat(feistel_text(local, "email", key, (DIGITS, LOWER)), F.substring(m, at, F.length(m)))


def _digits(m: Column, kind: str, key: str) -> Column:
    return _let(feistel_text(_bare(m), kind, key), lambda d: _put_back(m, d))


def _phone(m: Column, key: str) -> Column:
    """The country code, if it stands apart, stays."""
    country = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)
    return F.concat(country, _digits(F.substring(m, F.length(country) + 1, F.length(m)), "phone", key))


def _password(m: Column, key: str) -> Column:
    """What stands before it stays."""
    head = F.regexp_extract(m, "^[a-z]+[=:]", 0)
    return F.concat(head, feistel_text(F.substring(m, F.length(head) + 1, F.length(m)), "password", key, (DIGITS + LOWER + UPPER,)))


def kind_of(m: Column) -> Column:
    """The kind of a match, by its form."""
    out = F.lit(None).cast("string")
    for k, p in list(KINDS.items())[::-1]:
        out = F.when(m.rlike(f"^(?:{CARD_RUN if k == 'card' else p})$"), k).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of one match; null if the value fails its check."""
    by = {
        "email": _email(m, key), "secret": feistel_text(m, "secret", key, (DIGITS + "abcdef",)), "key": F.concat(F.lit("AKIA"), feistel_text(F.substring(m, 5, 16), "key", key, (DIGITS + UPPER,))), "password": _password(m, key), "iban": _iban(m, key), "date": _date(m, key),
        "ipv4": _ipv4(m, key), "ssn": _digits(m, "ssn", key), "phone": _phone(m, key), "card": _card(m, key),
    }
    out = F.lit(None).cast("string")
    for k, c in by.items():
        out = F.when(kind == k, c).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, column: str = "text", report: str | None = None) -> DataFrame:
    """docs with pseudonyms in the column; with `report`, a further column of that name: an array of (kind, new) in order.

    A null text stays null with a null report; a text without such values, or an empty one, stays as it is with an empty
    one. Each row depends on its own text and the key only, so equal rows stay equal; all other columns stay, whatever
    their names. ValueError without a key, or if docs has a column named as the report. Empty table: empty result.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    if report is not None and report.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {report} already")
    text, found, new = F.col(column), free_name(docs, "_found"), free_name(docs, "_new")
    some = text.rlike("[0-9@]|(?:password|passwd|pwd)[=:]|AKIA|[a-f]{32}")
    made = docs.withColumn(found, F.when(some, F.transform(F.regexp_extract_all(text, F.lit(PATTERN), 0), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))))
    made = made.withColumn(found, F.transform(found, lambda x: F.when(x["kind"] == "card", card_parts(x["m"])).otherwise(F.array(x))))
    made = made.withColumn(new, F.transform(found, lambda parts: F.transform(parts, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), pseudonym(x["m"], x["kind"], key).alias("new")))))
    whole = F.transform(new, lambda parts: F.array_join(F.transform(parts, lambda x: F.coalesce(x["new"], x["m"])), ""))
    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), whole, lambda t, x: F.concat(t, F.coalesce(x, F.lit("")))), "")
    out = {column: F.when(F.size(found) > 0, joined).otherwise(text)}
    if report is not None:
        none = F.array().cast("array<struct<kind:string,new:string>>")
        said = F.transform(F.filter(F.flatten(new), lambda x: x["new"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("new")))
        out[report] = F.when(text.isNotNull(), F.coalesce(said, none))
    return made.withColumns(out).drop(found, new)

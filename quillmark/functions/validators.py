"""Validators of identifiers, dates, names, addresses and amounts as Spark columns.

Each takes a string column and returns struct(ok, normalized, error): a refusal has ok false, a soft finding ok true
with an error. Null and blank values are refused as empty_value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Validator = Callable[[Column], Column]
VALIDATORS: dict[str, Validator] = {}
CHECKSUM = frozenset({"curp", "rfc", "sin_luhn", "mrz_td1", "mrz_td2", "mrz_td3"})

# fixed values: prefixes that the tax office has issued
EIN_PREFIXES = (
    "01 02 03 04 05 06 10 11 12 13 14 15 16 20 21 22 23 24 25 26 27 30 31 32 33 34 35 36 37 38 39 40 41 42 43 44 45 46 47 48 "
    "50 51 52 53 54 55 56 57 58 59 60 61 62 63 64 65 66 67 68 71 72 73 74 75 76 77 80 81 82 83 84 85 86 87 88 90 91 92 93 94 95 98 99"
).split()
# fixed values: state codes and check alphabets of Mexican identifiers
CURP_STATES = "AS BC BS CC CL CM CS CH DF DG GT GR HG JC MC MN MS NT NL OC PL QT QR SP SL SR TC TS TL VZ YN ZS NE".split()
CURP_ALPHABET = "0123456789ABCDEFGHIJKLMNÑOPQRSTUVWXYZ"
RFC_ALPHABET = "0123456789ABCDEFGHIJKLMN&OPQRSTUVWXYZ Ñ"
# fixed values: English and Spanish month names
MONTHS = {
    1: "jan january ene enero", 2: "feb february febrero", 3: "mar march marzo", 4: "apr april abr abril", 5: "may mayo", 6: "jun june junio",
    7: "jul july julio", 8: "aug august ago agosto", 9: "sep sept september septiembre setiembre", 10: "oct october octubre",
    11: "nov november noviembre", 12: "dec december dic diciembre",
}


def register(name: str) -> Callable[[Validator], Validator]:
    def keep(f: Validator) -> Validator:
        VALIDATORS[name] = f
        return f

    return keep


def _answer(ok: bool, normalized: Column | str, error: Column | str = "") -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(ok).alias("ok"), as_column(normalized).alias("normalized"), as_column(error).alias("error"))


def _refuse(error: Column | str) -> Column:
    return _answer(False, "", error)


def _first(*cases: tuple[Column, Column], otherwise: Column) -> Column:
    out = None
    for when, then in cases:
        out = F.when(when, then) if out is None else out.when(when, then)
    return out.otherwise(otherwise)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _compact(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, "[^0-9A-Za-zÑñ&]", ""))


def _squash(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, r"\s+", " "))


def _wrong_length(v: Column, n: int) -> tuple[Column, Column]:
    return F.length(v) != n, _refuse(F.concat(F.lit("bad_length:"), F.length(v), F.lit(f"!={n}")))


def _grouped(d: Column, *sizes: int) -> Column:
    parts, at = [], 1
    for n in sizes:
        parts.append(F.substring(d, at, n))
        at += n
    return F.concat_ws("-", *parts)


def luhn(digits: Column) -> Column:
    """True if a string of two digits or more passes Luhn; its last digit is the check digit."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.when(digits.rlike("^[0-9]{2,}$"), F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)


def weighted_sum(text: Column, alphabet: str, weight: Callable[[Column], Column]) -> Column:
    """Sum over the characters of their place in the alphabet times weight(place in the text, from 0)."""
    return F.aggregate(F.transform(F.split(text, ""), lambda c, i: (F.position(c, F.lit(alphabet)) - 1) * weight(i)), F.lit(0), lambda a, x: a + x)


def mrz_digit(text: Column) -> Column:
    """The 7-3-1 check digit of a machine-readable zone field."""
    value = lambda c: F.when(c == "<", 0).otherwise(F.position(c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1)
    weight = lambda i: F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int"))
    return (F.aggregate(F.transform(F.split(text, ""), lambda c, i: (value(c) * weight(i)).cast("int")), F.lit(0), lambda a, x: a + x) % 10).cast("string")


def real_date(year: Column, month: Column, day: Column) -> Column:
    """The ISO string of a calendar date, or null."""
    return F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd"), "yyyy-MM-dd")


@register("ssn")
def ssn(v: Column) -> Column:
    d = _digits(v)
    area = F.substring(d, 1, 3)
    return _first(
        _wrong_length(d, 9),
        (d.between("987654320", "987654329"), _refuse("reserved_for_advertising:never_issued")),
        (area.isin("000", "666") | d.startswith("9"), _refuse(F.concat(F.lit("invalid_area:"), area))),
        (F.substring(d, 4, 2) == "00", _refuse("invalid_group:00")),
        (F.substring(d, 6, 4) == "0000", _refuse("invalid_serial:0000")),
        otherwise=_answer(True, _grouped(d, 3, 2, 4)),
    )


@register("ein")
def ein(v: Column) -> Column:
    d = _digits(v)
    prefix = F.substring(d, 1, 2)
    return _first(_wrong_length(d, 9), (~prefix.isin(*EIN_PREFIXES), _refuse(F.concat(F.lit("invalid_irs_prefix:"), prefix))), otherwise=_answer(True, _grouped(d, 2, 7)))


@register("itin")
def itin(v: Column) -> Column:
    d = _digits(v)
    group = F.substring(d, 4, 2)
    issued = group.between("50", "65") | group.between("70", "88") | group.between("90", "92") | group.between("94", "99")
    return _first(
        _wrong_length(d, 9),
        (~d.startswith("9"), _refuse(F.concat(F.lit("invalid_prefix:"), F.substring(d, 1, 1), F.lit("!=9")))),
        (~issued, _refuse(F.concat(F.lit("invalid_group:"), group))),
        (F.substring(d, 6, 4) == "0000", _refuse("invalid_serial:0000")),
        otherwise=_answer(True, _grouped(d, 3, 2, 4)),
    )


@register("sin_luhn")
def sin_luhn(v: Column) -> Column:
    d = _digits(v)
    first = F.substring(d, 1, 1)
    return _first(_wrong_length(d, 9), (~luhn(d), _refuse("luhn_check_failed")), otherwise=_answer(True, _grouped(d, 3, 3, 3), F.when(first.isin("0", "8"), F.concat(F.lit("unassigned_prefix:"), first)).otherwise("")))


@register("curp")
def curp(v: Column) -> Column:
    c = _compact(v)
    due = ((10 - weighted_sum(F.substring(c, 1, 17), CURP_ALPHABET, lambda i: 18 - i) % 10) % 10).cast("string")
    century = F.when(F.substring(c, 17, 1).rlike("[0-9]"), 1900).otherwise(2000)
    born = real_date(F.substring(c, 5, 2).cast("int") + century, F.substring(c, 7, 2), F.substring(c, 9, 2))
    state = F.substring(c, 12, 2)
    notes = F.concat_ws("; ", F.when(born.isNull(), "embedded_birth_date_invalid"), F.when(~state.isin(*CURP_STATES), F.concat(F.lit("unknown_entity_code:"), state)))
    return _first(
        _wrong_length(c, 18),
        (~c.rlike("^[A-ZÑ]{4}[0-9]{6}[HMX][A-ZÑ]{5}[0-9A-Z][0-9]$"), _refuse("bad_format")),
        (F.substring(c, 18, 1) != due, _refuse(F.concat(F.lit("check_digit_failed:"), F.substring(c, 18, 1), F.lit("!="), due))),
        otherwise=_answer(True, c, notes),
    )


@register("rfc")
def rfc(v: Column) -> Column:
    c = _compact(v)
    n = F.length(c)
    body = F.lpad(F.substring(c, F.lit(1), n - 1), 12, " ")
    rest = weighted_sum(body, RFC_ALPHABET, lambda i: 13 - i) % 11
    due = F.substring(F.lit(RFC_ALPHABET), ((11 - rest) % 11).cast("int") + 1, F.lit(1))
    block = F.substring(c, F.when(n == 12, 4).otherwise(5), F.lit(6))
    year = F.substring(block, 1, 2).cast("int")
    founded = real_date(year + F.when(year >= 30, 1900).otherwise(2000), F.substring(block, 3, 2), F.substring(block, 5, 2))
    last = F.right(c, F.lit(1))
    return _first(
        ((n == 10) & c.rlike("^[A-ZÑ&]{4}[0-9]{6}$"), _answer(True, c, "no_homoclave:check_digit_unavailable")),
        (~n.isin(12, 13), _refuse(F.concat(F.lit("bad_length:"), n))),
        (~((n == 12) & c.rlike("^[A-ZÑ&]{3}[0-9]{6}[0-9A-Z]{3}$") | (n == 13) & c.rlike("^[A-ZÑ&]{4}[0-9]{6}[0-9A-Z]{3}$")), _refuse("bad_format")),
        (founded.isNull(), _refuse("embedded_date_invalid")),
        (last != due, _answer(True, c, F.concat(F.lit("check_digit_soft_fail:"), last, F.lit("!="), due))),
        otherwise=_answer(True, c),
    )


def mrz_lines(v: Column) -> Column:
    """The lines of a zone: upper case, guillemets read as fillers, no white space, blank lines dropped."""
    text = F.translate(F.upper(v), "«‹", "<<")
    return F.filter(F.transform(F.split(text, r"\R"), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: x != "")


def _zone(v: Column, count: int, width: int, checks: Callable[[Callable, Callable], list[tuple[str, Column, Column]]]) -> Column:
    """checks(part, at): part(line, a, b) are columns a to b (0-based, end exclusive) of a line, at(line, a) one of them."""
    lines = mrz_lines(v)
    part = lambda k, a, b: F.substring(F.get(lines, F.lit(k)), a + 1, b - a)
    failed = F.array_compact(F.array(*[F.when((printed != "<") & ~(mrz_digit(payload) == printed), F.lit(name)) for name, payload, printed in checks(part, lambda k, a: part(k, a, a + 1))]))
    sizes = F.array_join(F.transform(lines, lambda x: F.length(x).cast("string")), ", ")
    return _first(
        ((F.size(lines) != count) | F.exists(lines, lambda x: F.length(x) != width), _refuse(F.concat(F.lit(f"bad_shape:expected_{count}x{width}_got_["), sizes, F.lit("]")))),
        (F.exists(lines, lambda x: ~x.rlike("^[A-Z0-9<]+$")), _refuse("illegal_characters")),
        (F.size(failed) > 0, _refuse(F.concat(F.lit("check_digit_failed:"), F.array_join(failed, ",")))),
        otherwise=_answer(True, F.array_join(lines, "\n")),
    )


@register("mrz_td3")
def mrz_td3(v: Column) -> Column:
    return _zone(v, 2, 44, lambda p, at: [("document_number", p(1, 0, 9), at(1, 9)), ("date_of_birth", p(1, 13, 19), at(1, 19)), ("expiry_date", p(1, 21, 27), at(1, 27)), ("personal_number", p(1, 28, 42), at(1, 42)), ("composite", F.concat(p(1, 0, 10), p(1, 13, 20), p(1, 21, 43)), at(1, 43))])


@register("mrz_td2")
def mrz_td2(v: Column) -> Column:
    return _zone(v, 2, 36, lambda p, at: [("document_number", p(1, 0, 9), at(1, 9)), ("date_of_birth", p(1, 13, 19), at(1, 19)), ("expiry_date", p(1, 21, 27), at(1, 27)), ("composite", F.concat(p(1, 0, 10), p(1, 13, 20), p(1, 21, 35)), at(1, 35))])


@register("mrz_td1")
def mrz_td1(v: Column) -> Column:
    return _zone(v, 3, 30, lambda p, at: [("document_number", p(0, 5, 14), at(0, 14)), ("date_of_birth", p(1, 0, 6), at(1, 6)), ("expiry_date", p(1, 8, 14), at(1, 14)), ("composite", F.concat(p(0, 5, 30), p(1, 0, 7), p(1, 8, 15), p(1, 18, 29)), at(1, 29))])


@register("iso_date")
def iso_date(v: Column) -> Column:
    t = _squash(v)
    got = F.date_format(F.try_to_date(t, "yyyy-MM-dd"), "yyyy-MM-dd")
    return _first((~t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), _refuse("bad_format:expected_YYYY-MM-DD")), (got.isNull(), _refuse("not_a_calendar_date")), otherwise=_answer(True, got))


def _month(word: Column) -> Column:
    table = F.create_map(*[x for n, names in MONTHS.items() for name in names.split() for x in (F.lit(name), F.lit(n))])
    return F.try_element_at(table, F.lower(word))


@register("generic_date")
def generic_date(v: Column, order: str = "DMY") -> Column:
    """Year first, then a month's name before or after the day, then numbers; order decides what nothing else does."""
    t = _squash(F.regexp_replace(_squash(v), r"(?i)\bdel?\b", " "))
    get = lambda pattern, k: F.regexp_extract(t, pattern, k)
    ymd, mdy, dmy, num = r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", r"(\p{L}{3,12})\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})", r"([0-9]{1,2})\s*[-/ ]\s*(\p{L}{3,12})\.?,?\s*[-/ ]?\s*([0-9]{4})", r"([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4})"
    a, b, raw = get(num, 1).cast("int"), get(num, 2).cast("int"), get(num, 3)
    short = F.length(raw) == 2
    year = raw.cast("int") + F.when(short, F.when(raw.cast("int") >= 30, 1900).otherwise(2000)).otherwise(0)
    day_first = (a > 12) | ((b <= 12) & F.lit(order == "DMY"))
    day, month = F.when(day_first, a).otherwise(b), F.when(day_first, b).otherwise(a)
    notes = F.concat_ws("; ", F.when(short, F.concat(F.lit("two_digit_year:assumed_"), year)), F.when((a <= 12) & (b <= 12), F.lit(f"ambiguous_day_month:assumed_{order}")))
    done = lambda d, note="": F.when(d.isNull(), _refuse("not_a_calendar_date")).otherwise(_answer(True, d, note))
    return _first(
        (t == "", _refuse("empty_value")),
        (t.rlike(ymd), done(real_date(get(ymd, 1), get(ymd, 2), get(ymd, 3)))),
        (_month(get(mdy, 1)).isNotNull(), done(real_date(get(mdy, 3), _month(get(mdy, 1)), get(mdy, 2)))),
        (_month(get(dmy, 2)).isNotNull(), done(real_date(get(dmy, 3), _month(get(dmy, 2)), get(dmy, 1)))),
        (t.rlike(num), done(real_date(year, month, day), notes)),
        otherwise=_refuse("unparseable_date"),
    )


_DATE_LIKE = r"^\s*[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{2,4}\s*$"


@register("name")
def name(v: Column) -> Column:
    t = F.regexp_replace(_squash(v), "^[ :;,\\-–—]+|[ :;,\\-–—]+$", "")
    letters, digits = F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit(r"\p{Nd}"))
    return _first(
        (t == "", _refuse("empty_value")),
        (t.rlike(_DATE_LIKE), _refuse("looks_like_a_date")),
        (letters < 2, _refuse("no_letters")),
        (digits * 3 > letters, _refuse(F.concat(F.lit("too_many_digits:"), digits))),
        (F.length(t) > 120, _refuse(F.concat(F.lit("too_long:"), F.length(t)))),
        otherwise=_answer(True, t, F.when(F.size(F.split(t, " ")) > 8, "suspiciously_many_tokens").otherwise("")),
    )


@register("address")
def address(v: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(v, r"\s*\n\s*", ", ")), r"[ \t]+", " "), r"^[ ,;:\-]+|[ ,;:\-]+$", "")
    return _first(
        (F.length(t) < 6, _refuse(F.concat(F.lit("too_short:"), F.length(t)))),
        (t.rlike(_DATE_LIKE), _refuse("looks_like_a_date")),
        (~t.rlike(r"\p{L}{3}"), _refuse("no_word_of_three_letters")),
        (F.length(t) > 400, _refuse(F.concat(F.lit("too_long:"), F.length(t)))),
        otherwise=_answer(True, t),
    )


def check(validator: str, v: Column) -> Column:
    """The named validator's answer. An unknown name is a soft finding, never a refusal."""
    f = VALIDATORS.get(validator)
    known = f(v) if f else _answer(True, _squash(v), f"unknown_validator:{validator}")
    return known if f is None else F.when(F.coalesce(F.trim(v), F.lit("")) == "", _refuse("empty_value")).otherwise(known)


def verification(validator: str) -> str:
    return "checksum" if validator in CHECKSUM else "format" if validator in VALIDATORS else "none"


@register("amount")
def amount(v: Column) -> Column:
    """Currency off; brackets or a trailing minus are negative; the decimal mark is the last of two kinds, a single comma
    before one or two last digits; otherwise the point."""
    t = _squash(v)
    negative = t.rlike(r"^\(.*\)$") | t.endswith("-")
    bare = F.regexp_replace(F.regexp_replace(t, r"(?i)(?:INR|USD|MXN|CAD|EUR|GBP|RS\.?|₹|\$|€|£|MX\$|C\$)", ""), r"^[ ()\-+]+|[ ()\-+]+$", "")
    n = F.regexp_replace(bare, r"[\s']", "")
    commas, both = F.regexp_count(n, F.lit(",")), n.contains(",") & n.contains(".")
    comma_decimal = (both & n.rlike(",[^.]*$")) | (~both & (commas == 1) & n.rlike(",[0-9]{1,2}$"))
    plain = F.when(comma_decimal, F.translate(F.regexp_replace(n, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(n, ",", ""))
    return _first(
        (~bare.rlike("[0-9]"), _refuse("no_digits")),
        (~bare.rlike(r"^[0-9.,\s']*$"), _refuse("non_numeric_characters")),
        (~plain.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), _refuse("malformed_number")),
        otherwise=_answer(True, F.concat(F.when(negative, "-").otherwise(""), plain)),
    )

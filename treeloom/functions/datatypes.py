"""Schema datatypes: lexical checks, facets, comparison and canonical values as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import matches
from .text import collapse_space, is_name, is_ncname, is_nmtoken, replace_space

# fixed values: lexical forms
_TZ = r"(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
_YEAR = r"-?([1-9][0-9]{3,}|0[0-9]{3})"
_MONTH, _DAY = r"(0[1-9]|1[0-2])", r"(0[1-9]|[12][0-9]|3[01])"
_TIME = r"(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?)"
_DECIMAL = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)"
_NUMBER = r"([0-9]+(\.[0-9]+)?)"

LEXICAL = {
    "boolean": r"true|false|1|0",
    "decimal": _DECIMAL,
    "float": rf"{_DECIMAL}([eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "integer": r"[+-]?[0-9]+",
    "nonNegativeInteger": r"\+?[0-9]+",
    "positiveInteger": r"\+?0*[1-9][0-9]*",
    "nonPositiveInteger": r"-[0-9]+|[+-]?0+",
    "negativeInteger": r"-[0-9]+",
    "hexBinary": r"([0-9A-Fa-f]{2})*",
    "base64Binary": r"([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?",
    "language": r"[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*",
    "time": _TIME + _TZ,
    "duration": rf"-?P(?=.)([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T(?=.)([0-9]+H)?([0-9]+M)?({_NUMBER}S)?)?",
    "dayTimeDuration": rf"-?P(?=.)([0-9]+D)?(T(?=.)([0-9]+H)?([0-9]+M)?({_NUMBER}S)?)?",
    "yearMonthDuration": r"-?P(?=.)([0-9]+Y)?([0-9]+M)?",
    "gYear": _YEAR + _TZ,
    "gYearMonth": rf"{_YEAR}-{_MONTH}{_TZ}",
    "gMonth": rf"--{_MONTH}(--)?{_TZ}",
    "gDay": rf"---{_DAY}{_TZ}",
}
RANGES = {
    "long": (-(1 << 63), (1 << 63) - 1), "int": (-(1 << 31), (1 << 31) - 1), "short": (-(1 << 15), (1 << 15) - 1), "byte": (-128, 127),
    "unsignedLong": (0, (1 << 64) - 1), "unsignedInt": (0, (1 << 32) - 1), "unsignedShort": (0, 65535), "unsignedByte": (0, 255),
}
INTEGERS = frozenset(("integer", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", *RANGES))
#: Types whose white space is kept, or replaced; it is collapsed for all others.
KEEPS_SPACE, REPLACES_SPACE = frozenset(("string", "anySimpleType", "anyType")), frozenset(("normalizedString",))
ANYTHING = frozenset(("string", "normalizedString", "anySimpleType", "anyAtomicType", "anyType"))
#: Built-in derivations, child to parent.
DERIVED_FROM = {
    "normalizedString": "string", "token": "normalizedString", "language": "token", "NMTOKEN": "token", "Name": "token", "NCName": "Name",
    "ID": "NCName", "IDREF": "NCName", "ENTITY": "NCName", "integer": "decimal", "nonPositiveInteger": "integer",
    "negativeInteger": "nonPositiveInteger", "nonNegativeInteger": "integer", "positiveInteger": "nonNegativeInteger", "long": "integer",
    "int": "long", "short": "int", "byte": "short", "unsignedLong": "nonNegativeInteger", "unsignedInt": "unsignedLong",
    "unsignedShort": "unsignedInt", "unsignedByte": "unsignedShort",
}


def _full(value: Column, pattern: str) -> Column:
    return value.rlike(rf"\A(?:{pattern})\z")


def _real_day(year: Column, month: Column, day: Column) -> Column:
    y, m, d = year.cast("decimal(38,0)"), month.cast("int"), day.cast("int")
    leap = (F.abs(y) % 4 == 0) & ((F.abs(y) % 100 != 0) | (F.abs(y) % 400 == 0))
    most = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return (y != 0) & (d <= most)


def is_valid(value: Column, type_name: str) -> Column:
    """Whether the text is of the built-in type; an unknown name allows everything."""
    t = type_name.split(":")[-1]
    v = value
    if t in ANYTHING:
        return F.lit(True)
    if t == "error":
        return F.lit(False)
    if t == "token":
        return v == collapse_space(v)
    if t == "anyURI":
        opened, closed = F.regexp_count(v, F.lit(r"\[")), F.regexp_count(v, F.lit(r"\]"))
        return ~v.rlike(r"[\x00-\x1F\x7F]") & (opened == closed) & ~v.rlike("%(?![0-9A-Fa-f]{2})")
    if t in ("hexBinary", "base64Binary"):
        return _full(F.regexp_replace(v, r"[ \t\r\n]", ""), LEXICAL[t])
    if t in ("float", "double"):
        return _full(v, LEXICAL["float"])
    if t in RANGES:
        least, most = RANGES[t]
        number = F.when(F.length(v) <= 38, v.try_cast("decimal(38,0)"))
        stripped = F.regexp_replace(v, r"\A([+-]?)0+(?=[0-9])", "$1").try_cast("decimal(38,0)")
        n = F.coalesce(number, stripped)
        inside = F.coalesce((n >= F.lit(least).cast("decimal(38,0)")) & (n <= F.lit(str(most)).cast("decimal(38,0)")), F.lit(False))
        return _full(v, LEXICAL["integer"] if least else LEXICAL["nonNegativeInteger"]) & inside
    if t in ("dateTime", "dateTimeStamp", "date"):
        zone = _TZ[:-1] if t == "dateTimeStamp" else _TZ
        clock = "" if t == "date" else "T" + _TIME
        shape = _full(v, f"{_YEAR}-{_MONTH}-{_DAY}{clock}{zone}")
        head = r"\A(-?[0-9]+)-([0-9]{2})-([0-9]{2})"
        year, month, day = (F.regexp_extract(v, head, k) for k in (1, 2, 3))
        # the last four digits of a year decide its length; the year 0000 doesn't exist
        last = F.regexp_extract(year, r"([0-9]{4})\z", 1)
        there = F.regexp_replace(year, "[-0]", "") != ""
        return F.when(shape, there & _real_day(F.concat(F.lit("4"), last), month, day)).otherwise(False)
    if t == "gYear":
        return _full(v, LEXICAL[t]) & ~v.rlike(r"\A-?0000(?![0-9])")
    if t == "gYearMonth":
        return _full(v, LEXICAL[t]) & ~v.rlike(r"\A-?0000-")
    if t == "gMonthDay":
        shape = _full(v, rf"--{_MONTH}-{_DAY}{_TZ}")
        return F.when(shape, _real_day(F.lit("2000"), v.substr(3, 2), v.substr(6, 2))).otherwise(False)
    if t == "Name":
        return is_name(v)
    if t in ("NCName", "ID", "IDREF", "ENTITY"):
        return is_ncname(v)
    if t == "NMTOKEN":
        return is_nmtoken(v)
    if t in ("IDREFS", "ENTITIES", "NMTOKENS"):
        one = {"IDREFS": is_ncname, "ENTITIES": is_ncname, "NMTOKENS": is_nmtoken}[t]
        items = list_items(v)
        return (F.size(items) > 0) & F.forall(items, one)
    if t in ("QName", "NOTATION"):
        parts = F.split(v, ":")
        return (F.size(parts) <= 2) & F.forall(parts, is_ncname)
    return _full(v, LEXICAL[t]) if t in LEXICAL else F.lit(True)


def list_items(value: Column) -> Column:
    return F.filter(F.split(value, r"[ \t\n\r]+"), lambda x: x != "")


def with_space_rule(value: Column, type_name: str, rule: str | None = None) -> Column:
    t = type_name.split(":")[-1]
    rule = rule or ("preserve" if t in KEEPS_SPACE else "replace" if t in REPLACES_SPACE else "collapse")
    return {"preserve": lambda v: v, "replace": replace_space, "collapse": collapse_space}[rule](value)


# --- comparison -------------------------------------------------------------------------------------------------


def duration_part(value: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(value, pattern, 1).try_cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))


def duration_months_seconds(value: Column) -> tuple[Column, Column]:
    """Months and seconds of a duration, with its sign."""
    date, time = F.substring_index(value, "T", 1), F.when(F.contains(value, F.lit("T")), F.substring_index(value, "T", -1)).otherwise("")
    sign = F.when(value.startswith("-"), -1).otherwise(1)
    months = duration_part(date, r"(\d+)Y") * 12 + duration_part(date, r"(\d+)M")
    seconds = duration_part(date, r"(\d+)D") * 86400 + duration_part(time, r"(\d+)H") * 3600 + duration_part(time, r"(\d+)M") * 60 + duration_part(time, r"(\d+(?:\.\d+)?)S")
    return months * sign, seconds * sign


def compare_durations(a: Column, b: Column) -> Column:
    """-1, 0, 1, or null where months of 28 to 31 days give different orders."""
    (am, as_), (bm, bs) = duration_months_seconds(a), duration_months_seconds(b)
    signs = [F.signum((am - bm) * (days * 86400) + (as_ - bs)).cast("int") for days in (28, 29, 30, 31)]
    same = (signs[0] == signs[1]) & (signs[1] == signs[2]) & (signs[2] == signs[3])
    return F.when(same, signs[0])


def zone_minutes(value: Column) -> Column:
    z = F.regexp_extract(value, r"([+-]\d{2}:\d{2})\z", 1)
    minutes = z.substr(2, 2).try_cast("int") * 60 + z.substr(5, 2).try_cast("int")
    return F.coalesce(F.when(z.startswith("-"), -minutes).otherwise(minutes), F.lit(0))


def utc_millis(value: Column, type_name: str) -> Column:
    """Milliseconds of a dateTime, date or time, in UTC; any year, by the count of days."""
    t = type_name.split(":")[-1]
    date = F.lit("1970-01-01") if t == "time" else F.regexp_extract(value, r"\A(-?\d+-\d{2}-\d{2})", 1)
    head = r"\A(-?\d+)-(\d{2})-(\d{2})"
    y, m, d = (F.regexp_extract(date, head, k).try_cast("long") for k in (1, 2, 3))
    # days from civil date, with the year beginning in March
    year = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(year / 400).cast("long")
    of_era = year - era * 400
    of_year = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5).cast("long") + d - 1
    days = era * 146097 + of_era * 365 + F.floor(of_era / 4).cast("long") - F.floor(of_era / 100).cast("long") + of_year - 719468
    clock = F.regexp_extract(value, r"(\d{2}:\d{2}:\d{2}(?:\.\d+)?)", 1)
    h, mi, s = clock.substr(1, 2).try_cast("long"), clock.substr(4, 2).try_cast("long"), F.substring(clock, 7, 20).try_cast("double")
    day_part = F.lit(0).cast("long") if t == "date" else (h * 3600 + mi * 60) * 1000 + F.floor(s * 1000).cast("long")
    return days * 86_400_000 + day_part - zone_minutes(value) * 60_000


def compare_decimals(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for decimal numbers of any length, digit by digit; null where one isn't a decimal number."""
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)

    def parts(v: Column) -> tuple[Column, Column, Column]:
        plain = F.regexp_replace(v, r"\A[+-]", "")
        whole = F.regexp_replace(F.substring_index(plain, ".", 1), r"\A0+", "")
        fraction = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.substring_index(plain, ".", -1), r"0+\z", "")).otherwise("")
        sign = F.when((whole == "") & (fraction == ""), 0).when(v.startswith("-"), -1).otherwise(1)
        return sign, whole, fraction

    (sa, wa, fa), (sb, wb, fb) = parts(a), parts(b)
    larger = F.when(F.length(wa) != F.length(wb), order(F.length(wa), F.length(wb))).when(wa != wb, order(wa, wb)).otherwise(order(fa, fb))
    out = F.when(sa != sb, order(sa, sb)).otherwise(sa * larger)
    return F.when(_full(a, _DECIMAL) & _full(b, _DECIMAL), out)


def compare(a: Column, b: Column, type_name: str) -> Column:
    """-1, 0 or 1; null where the values are incomparable."""
    t = type_name.split(":")[-1]
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1).when(x == y, 0)
    if t in ("dateTime", "dateTimeStamp", "date", "time"):
        return F.coalesce(order(utc_millis(a, t), utc_millis(b, t)), order(a, b))
    if t in ("duration", "dayTimeDuration", "yearMonthDuration"):
        return compare_durations(a, b)
    if t == "gYear":
        year = lambda v: F.regexp_extract(v, r"\A(-?\d+)", 1).try_cast("long")
        return order(year(a), year(b))
    if t == "gYearMonth":
        key = lambda v: F.regexp_extract(v, r"\A(-?\d+)-(\d{2})", 1).try_cast("long") * 12 + F.regexp_extract(v, r"\A-?\d+-(\d{2})", 1).try_cast("long")  # noqa: E731, E501
        return order(key(a), key(b))
    if t in ("gMonth", "gDay", "gMonthDay"):
        key = lambda v: F.regexp_replace(v, r"(Z|[+-]\d{2}:\d{2})\z", "")
        return order(key(a), key(b))
    short = (F.length(a) <= 12) & (F.length(b) <= 12)  # these fit a decimal exactly
    exact = F.when(short, order(a.try_cast("decimal(38,12)"), b.try_cast("decimal(38,12)"))).otherwise(compare_decimals(a, b))
    return F.coalesce(exact, order(a.try_cast("double"), b.try_cast("double")), order(a, b))


# --- facets -----------------------------------------------------------------------------------------------------


@dataclass
class Facets:
    """Facets of a restriction; ``patterns`` holds a group of alternatives for each derivation step."""

    white_space: str | None = None
    enumeration: Sequence[str] = ()
    patterns: Sequence[Sequence[str]] = field(default_factory=list)
    min_inclusive: str | None = None
    max_inclusive: str | None = None
    min_exclusive: str | None = None
    max_exclusive: str | None = None
    length: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    total_digits: int | None = None
    fraction_digits: int | None = None
    is_list: bool = False


def facet_length(value: Column, type_name: str, is_list: bool = False) -> Column:
    """Items of a list, octets of binary data, code points of anything else."""
    t = type_name.split(":")[-1]
    if is_list or t in ("IDREFS", "ENTITIES", "NMTOKENS"):
        return F.size(list_items(value))
    if t == "hexBinary":
        return F.floor(F.length(F.regexp_replace(value, r"\s", "")) / 2).cast("int")
    if t == "base64Binary":
        squeezed = F.regexp_replace(value, r"\s", "")
        return (F.floor(F.length(squeezed) / 4) * 3 - F.length(F.regexp_extract(squeezed, "(=*)$", 1))).cast("int")
    return F.length(value)


def digits(value: Column) -> tuple[Column, Column]:
    """Significant digits in total, and of the fraction."""
    plain = F.regexp_replace(value, r"\A[+-]", "")
    whole = F.regexp_replace(F.substring_index(plain, ".", 1), r"\A0+", "")
    fraction = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.substring_index(plain, ".", -1), r"0+\z", "")).otherwise("")
    return F.greatest(F.length(whole) + F.length(fraction), F.lit(1)), F.length(fraction)


def satisfies(value: Column, facets: Facets, type_name: str = "string") -> Column:
    """Whether the value meets all facets; white space is treated first."""
    v = with_space_rule(value, type_name, facets.white_space) if facets.white_space else value
    t = type_name.split(":")[-1]
    tests = []
    if facets.enumeration:
        tests.append(v.isin(list(facets.enumeration)))
    for group in facets.patterns:
        any_of = F.lit(False)
        for pattern in group:
            any_of = any_of | matches(v, pattern)
        tests.append(any_of)
    for bound, allowed in ((facets.min_inclusive, (0, 1)), (facets.max_inclusive, (-1, 0)), (facets.min_exclusive, (1,)), (facets.max_exclusive, (-1,))):
        if bound is not None:  # what can't be compared passes
            tests.append(F.coalesce(compare(v, F.lit(bound), t).isin(*allowed), F.lit(True)))
    if t not in ("QName", "NOTATION"):
        n = facet_length(v, t, facets.is_list)
        tests += [test for bound, test in ((facets.length, n == facets.length), (facets.min_length, n >= facets.min_length), (facets.max_length, n <= facets.max_length)) if bound is not None] if any(b is not None for b in (facets.length, facets.min_length, facets.max_length)) else []
    total, fraction = digits(v)
    if facets.total_digits is not None:
        tests.append(total <= facets.total_digits)
    if facets.fraction_digits is not None:
        tests.append(fraction <= facets.fraction_digits)
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


# --- canonical values -------------------------------------------------------------------------------------------


def canonical_value(value: Column, type_name: str) -> Column:
    """One text for each value of a type; equal values have equal texts."""
    t = type_name.split(":")[-1]
    v = with_space_rule(value, t)
    if t == "boolean":
        return F.when(v.isin("1", "true"), "true").when(v.isin("0", "false"), "false").otherwise(v)
    if t in INTEGERS:
        bare = F.regexp_replace(F.regexp_replace(v, r"\A\+", ""), r"\A(-?)0+(?=[0-9])", "$1")
        return F.when(bare == "-0", "0").otherwise(bare)
    if t == "decimal":
        sign = F.when(v.startswith("-"), "-").otherwise("")
        plain = F.regexp_replace(v, r"\A[+-]", "")
        whole = F.regexp_replace(F.substring_index(plain, ".", 1), r"\A0+", "")
        fraction = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.substring_index(plain, ".", -1), r"0+\z", "")).otherwise("")
        body = F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("."), F.when(fraction == "", "0").otherwise(fraction))
        return F.when(body == "0.0", body).otherwise(F.concat(sign, body))
    if t in ("float", "double"):
        return F.when(v.isin("INF", "+INF"), "INF").otherwise(F.coalesce(v.try_cast("double").cast("string"), v))
    if t == "hexBinary":
        return F.upper(F.regexp_replace(v, r"\s", ""))
    if t == "base64Binary":
        return F.regexp_replace(v, r"\s", "")
    if t in ("dateTime", "dateTimeStamp", "time", "date", "gYear", "gYearMonth", "gMonthDay", "gDay", "gMonth"):
        utc = F.regexp_replace(v, r"[+-]00:00\z", "Z")
        return F.regexp_replace(F.regexp_replace(utc, r"(\.[0-9]*?)0+(?=Z|[+-]|\z)", "$1"), r"\.(?=Z|[+-]|\z)", "")
    return v

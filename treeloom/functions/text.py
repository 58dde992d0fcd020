"""String functions and predicates on characters, names and references, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the ranges of the XML 1.0 and 1.1 recommendations
CHAR_10 = r"\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}"
CHAR_11 = r"\x01-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}"
NAME_START = (
    r"A-Z_a-z\xC0-\xD6\xD8-\xF6\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}\x{2070}-\x{218F}"
    r"\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}"
)
NAME_REST = NAME_START + r"\-.0-9\xB7\x{300}-\x{36F}\x{203F}-\x{2040}"
WHITE = r"[ \t\r\n]"


def is_legal(text: Column, version: str = "1.0") -> Column:
    return ~text.rlike(f"[^{CHAR_11 if version == '1.1' else CHAR_10}]")


def is_legal_for(text: Column, version: Column) -> Column:
    """Legality by the document's own version."""
    return F.when(version == "1.1", is_legal(text, "1.1")).otherwise(is_legal(text))


def strip_illegal(text: Column, version: str = "1.0") -> Column:
    return F.regexp_replace(text, f"[^{CHAR_11 if version == '1.1' else CHAR_10}]", "")


def is_name(text: Column) -> Column:
    return text.rlike(rf"\A[:{NAME_START}][:{NAME_REST}]*\z")


def is_ncname(text: Column) -> Column:
    return text.rlike(rf"\A[{NAME_START}][{NAME_REST}]*\z")


def is_nmtoken(text: Column) -> Column:
    return text.rlike(rf"\A[:{NAME_REST}]+\z")


def is_white(text: Column) -> Column:
    return text.rlike(rf"\A{WHITE}*\z")


def has_parameter_reference(text: Column) -> Column:
    return text.rlike(r"%[^\s;%]+;")


def supported_encoding(encoding: Column) -> Column:
    return F.upper(encoding).isin("UTF-8", "UTF-16", "UTF-16LE", "UTF-16BE")


def escape_text(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit("&quot;"))


def escape_attribute(text: Column) -> Column:
    return escape_quotes(escape_text(text))


def escape_canonical(text: Column) -> Column:
    """Text and attribute values of the canonical form."""
    out = escape_attribute(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    for plain, reference in (("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(plain), F.lit(reference))
    return out


def normalize_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def normalize_spaces(text: Column) -> Column:
    """Runs of white space become one blank; the ends are not trimmed."""
    return F.regexp_replace(text, "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+", " ")


def replace_space(text: Column) -> Column:
    return F.translate(text, "\t\n\r", "   ")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[\t\n\r ]+", " "))


def escape_pattern(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[\]{}()^$?*+.])", r"\\$1")


def looking_at(search: str, text: Column, start: int) -> Column:
    return F.substring(text, start + 1, len(search)) == search


def prefix_of(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(":")), F.substring_index(name, ":", 1)).otherwise("")


def local_of(name: Column) -> Column:
    """What follows the first colon."""
    return F.when(F.contains(name, F.lit(":")), F.substring(name, F.instr(name, ":") + 1, F.length(name))).otherwise(name)


def singular(name: Column) -> Column:
    """Item name of an array: ``ies`` becomes ``y``, a final ``s`` goes, ``item`` otherwise."""
    n = F.length(name)
    return (
        F.when((n > 3) & name.endswith("ies"), F.concat(name.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 1) & name.endswith("s"), name.substr(F.lit(1), n - 1))
        .otherwise("item")
    )


def unwrap_urn(public_id: Column) -> Column:
    """Public identifier of a ``urn:publicid:`` name."""
    out = F.substring(F.trim(public_id), 14, 1 << 30)
    for coded, plain in (("+", " "), (":", "//"), (";", "::"), ("%2B", "+"), ("%3A", ":"), ("%2F", "/"), ("%3B", ";"), ("%27", "'"), ("%3F", "?"), ("%23", "#"), ("%25", "%")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return F.when(F.trim(public_id).startswith("urn:publicid:"), out).otherwise(F.trim(public_id))


def attribute(attrs: Column, name: str) -> Column:
    """Value of the attribute ``name``, null where it is absent."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]


def has_attribute(attrs: Column, name: str) -> Column:
    return F.exists(attrs, lambda a: a["name"] == name)


def set_attribute(attrs: Column, name: str, value: Column) -> Column:
    """Replace in place, or append."""
    put = F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    return F.when(has_attribute(attrs, name), F.transform(attrs, lambda a: F.when(a["name"] == name, put).otherwise(a))).otherwise(F.array_append(attrs, put))


def remove_attribute(attrs: Column, name: str) -> Column:
    return F.filter(attrs, lambda a: a["name"] != name)

"""Queries on text functions, datatypes, facets and patterns, over a fixed list of literals and over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import datatypes as dt
from ..functions import patterns as pt
from ..functions import text as tx
from .synth import table

LITERALS = [
    "", " ", "0", "1", "-1", "+1", "00012", "-0", "127", "128", "-128", "-129", "255", "256", "32767", "32768", "65536", "2147483647", "2147483648",
    "-2147483648", "-2147483649", "4294967295", "4294967296", "9223372036854775807", "9223372036854775808", "18446744073709551615",
    "18446744073709551616", "1.", ".5", "1.50", "-12.340", "1e5", "1.5E-3", "INF", "-INF", "NaN", "inf", "true", "false", "TRUE", "t", "0a", "0aFF",
    "abc", "YWJj", "YWI=", "YQ==", "Y===", "en", "en-US", "x-klingon", "toolonglanguage", "a b", " a  b ", "a:b", ":a", "a:b:c", "_x", "9x", "x-1.y",
    "2024-02-29", "2023-02-29", "2024-13-01", "2024-04-31", "0000-01-01", "-0044-03-15", "12024-01-01", "2024-01-01Z", "2024-01-01+14:00",
    "2024-01-01+14:01", "2024-01-01T00:00:00", "2024-01-01T24:00:00", "2024-01-01T24:00:01", "2024-01-01T12:30:45.678Z", "2024-01-01T12:30",
    "12:00:00", "23:59:60", "12:00:00.5+05:30", "P1Y", "P", "PT", "P1DT2H", "P1M2DT3H4M5.6S", "-P7D", "PT1S", "P1Y2M", "P1YT", "--02-29", "--02-30",
    "---31", "---32", "--11", "--11--", "--13", "2024", "2024-05", "999", "http://x/%41", "http://x/%4", "http://[::1]/", "http://[/", "tab\tbed", "x\n",
]
_SQL_ROWS = "(values " + ", ".join("('" + v.replace("'", "''") + "')" for v in LITERALS) + ") t(v)"


def literals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v,) for v in LITERALS], "v string")


def _types(*names: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return literals(spark).select("v", *[dt.is_valid(F.col("v"), n).alias(n) for n in names])

    return query


def _full(pattern: str) -> str:
    return "regexp_full_match(v, '(?s:" + pattern.replace("'", "''") + ")')"


_TZ = "(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
_YMD = "(-?)([1-9][0-9]{3,}|0[0-9]{3})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
_TIME = "(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]+)?|24:00:00(\\.0+)?)"
_REAL = "coalesce(not regexp_matches(v, '^-?0000-') and try_cast(regexp_extract(v, '([0-9]{3}[0-9])-[0-9]{2}-[0-9]{2}', 1)::int % 400 + 2000 || regexp_extract(v, '[0-9]{4}(-[0-9]{2}-[0-9]{2})', 1) as date) is not null, false)"


def _day_case(pattern: str) -> str:
    return f"case when {_full(pattern)} then {_REAL} else false end"


def _range(low: str, high: str, pattern: str = "[+-]?[0-9]+") -> str:
    return f"case when {_full(pattern)} then try_cast(regexp_replace(v, '^[+]', '') as hugeint) between {low} and {high} else false end"


def _columns(**checks: str) -> str:
    return "select v, " + ", ".join(f'{sql} as "{name}"' for name, sql in checks.items()) + f" from {_SQL_ROWS}"


_DEC = "[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)"
_NAME1, _NAMER = "A-Za-z_", "A-Za-z_0-9.-"


def facet_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    facets = dt.Facets(patterns=[[r"Brand#\d{2}", r"X.*"], [r"[\c-[x]]*#[1-3]\d"]])
    return p.select("p_partkey", dt.satisfies(F.col("p_brand"), facets).alias("ok"), pt.matches(F.col("p_brand"), r"\i\c*#\d+").alias("named"))


def facet_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    value = F.concat((cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    p = table(spark, sf_dir, "part").select("p_partkey", value.alias("v"))
    return p.select("p_partkey", dt.satisfies(F.col("v"), dt.Facets(min_inclusive="950", max_exclusive="1200.5"), "decimal").alias("inside"), dt.satisfies(F.col("v"), dt.Facets(min_exclusive="1000.00", max_inclusive="+1500"), "decimal").alias("other"))


def facet_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", dt.satisfies(F.col("p_name"), dt.Facets(min_length=8, max_length=20)).alias("chars"), dt.satisfies(F.col("p_type"), dt.Facets(length=3, is_list=True)).alias("items"), dt.satisfies(F.hex(F.col("p_brand").cast("binary")), dt.Facets(length=8), "hexBinary").alias("octets"), dt.satisfies(F.base64(F.col("p_brand").cast("binary")), dt.Facets(length=8), "base64Binary").alias("octets64"))


def facet_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    decimals = literals(spark).where(dt.is_valid(F.col("v"), "decimal"))
    return decimals.select("v", dt.satisfies(F.col("v"), dt.Facets(total_digits=3), "decimal").alias("total"), dt.satisfies(F.col("v"), dt.Facets(fraction_digits=1), "decimal").alias("fraction"))


def facet_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", dt.satisfies(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("\n")), dt.Facets(white_space="collapse", enumeration=("BUILDING", "MACHINERY")), "token").alias("ok"))


def facet_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals(spark).select("v", *[dt.with_space_rule(F.col("v"), "string", r).alias(r) for r in ("preserve", "replace", "collapse")])


def duration_partial_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["P1M", "P30D", "P28D", "P27D", "P31D", "P32D", "P1Y", "P12M", "P365D", "P367D", "PT24H", "P1D", "-P1D", "PT0S", "P1M1D"]
    rows = spark.createDataFrame([(a, b) for a in values for b in values], "a string, b string")
    return rows.select("a", "b", dt.compare(F.col("a"), F.col("b"), "duration").alias("c"))


_DURATIONS = {"P1M": (1, 0), "P30D": (0, 30), "P28D": (0, 28), "P27D": (0, 27), "P31D": (0, 31), "P32D": (0, 32), "P1Y": (12, 0), "P12M": (12, 0), "P365D": (0, 365), "P367D": (0, 367), "PT24H": (0, 1), "P1D": (0, 1), "-P1D": (0, -1), "PT0S": (0, 0), "P1M1D": (1, 1)}


def temporal_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the events in two zones: the same instants compare equal."""
    e = table(spark, sf_dir, "events")
    here = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    there = F.date_format(F.expr("ts + interval 90 minutes"), "yyyy-MM-dd'T'HH:mm:ss'+01:30'")
    later = F.date_format(F.expr("ts + interval 1 second"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select("event_id", dt.utc_millis(here, "dateTime").alias("millis"), dt.compare(here, there, "dateTime").alias("same"), dt.compare(here, later, "dateTime").alias("before"))


def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    kinds = [("decimal", ["1.", ".5", "1.50", "-12.340", "00012", "-0", "+1", "0"]), ("integer", ["00012", "-0", "+1", "-5"]), ("boolean", ["1", "true", "0", "false"]), ("hexBinary", ["0aFF"]), ("dateTime", ["2024-01-01T12:30:45.500+00:00", "2024-01-01T12:30:45.000Z"]), ("token", [" a  b "])]
    rows = spark.createDataFrame([(t, x) for t, xs in kinds for x in xs], "t string, v string")
    out = F.lit(None).cast("string")
    for t, _ in kinds:
        out = F.when(F.col("t") == t, dt.canonical_value(v, t)).otherwise(out)
    return rows.select("t", "v", out.alias("canonical"))


def is_xml_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w"))
    return words.agg(F.count("*").alias("words"), F.sum(tx.is_name(F.col("w")).cast("long")).alias("names"), F.sum(tx.is_ncname(F.col("w")).cast("long")).alias("ncnames"), F.sum(tx.is_nmtoken(F.col("w")).cast("long")).alias("nmtokens"))


def illegal_char_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("text"), F.lit("\x01"))).otherwise(F.col("text")).alias("t"))
    return d.select("doc_id", tx.is_legal(F.col("t")).alias("legal"), tx.is_legal(F.col("t"), "1.1").alias("legal11"), F.md5(tx.strip_illegal(F.col("t"))).alias("stripped"))


def legal_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("1.0", "a\x01"), ("1.1", "a\x01"), ("1.1", "a\x00"), ("1.0", "ok\t")], "version string, t string")
    return rows.select("version", F.length("t").alias("n"), tx.is_legal_for(F.col("t"), F.col("version")).alias("legal"), tx.supported_encoding(F.lit("utf-8")).alias("enc"))


def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n = F.col("p_name")
    return p.select("p_partkey", tx.escape_text(F.concat(n, F.lit(" <&>"))).alias("clean"), tx.escape_quotes(F.concat(F.lit('"'), n)).alias("unquoted"), tx.normalize_lines(F.concat(n, F.lit("\r\n\r"))).alias("lines"), tx.normalize_spaces(F.concat(F.lit(" \t"), n)).alias("spaces"), tx.escape_pattern(F.concat(n, F.lit("(a.b)*"))).alias("pattern"), tx.looking_at("e", n, 1).alias("at"), tx.singular(n).alias("item"), tx.is_white(F.lit(" \n")).alias("white"), tx.has_parameter_reference(F.concat(F.lit("%"), F.lit("pe;"))).alias("pe"))


def pattern_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of the schema dialect against the literals."""
    v = F.col("v")
    return literals(spark).select("v", pt.matches(v, r"[a-z-[aeiou]]+").alias("consonants"), pt.matches(v, r"\d{1,3}").alias("digits"), pt.matches(v, r"[\i-[:]][\c-[:]]*").alias("ncname"), pt.matches(v, r"a.b|[^a]*").alias("dots"), pt.matches(v, r"\p{Lu}+").alias("upper"), pt.matches(v, r"^?x|\s*").alias("plain"))


QUERIES = {
    "type_integer_family": _types("integer", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger"),
    "type_ranges": _types("long", "int", "short", "byte", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte"),
    "type_decimal_float_boolean": _types("decimal", "float", "double", "boolean"),
    "type_binary_language_uri": _types("hexBinary", "base64Binary", "language", "anyURI"),
    "type_names": _types("Name", "NCName", "NMTOKEN", "NMTOKENS", "IDREFS", "QName", "token", "string"),
    "type_datetime_family": _types("dateTime", "dateTimeStamp", "date", "time"),
    "type_duration": _types("duration", "dayTimeDuration", "yearMonthDuration"),
    "type_gregorian": _types("gYear", "gYearMonth", "gMonth", "gMonthDay", "gDay"),
} | {f.__name__: f for f in (
    facet_pattern, facet_range, facet_length, facet_digits, facet_enumeration, facet_whitespace, duration_partial_order, temporal_comparison, canonical_values,
    is_xml_name, illegal_char_filter, legal_by_version, string_functions, pattern_translation,
)}

_MSTR = "(values " + ", ".join(f"('{a}', {m}, {d})" for a, (m, d) in _DURATIONS.items()) + ")"
_SIGN = "sign((x.m - y.m) * {0} + (x.d - y.d))"
_CANON = [("decimal", "1.", "1.0"), ("decimal", ".5", "0.5"), ("decimal", "1.50", "1.5"), ("decimal", "-12.340", "-12.34"), ("decimal", "00012", "12.0"), ("decimal", "-0", "0.0"), ("decimal", "+1", "1.0"), ("decimal", "0", "0.0"), ("integer", "00012", "12"), ("integer", "-0", "0"), ("integer", "+1", "1"), ("integer", "-5", "-5"), ("boolean", "1", "true"), ("boolean", "true", "true"), ("boolean", "0", "false"), ("boolean", "false", "false"), ("hexBinary", "0aFF", "0AFF"), ("dateTime", "2024-01-01T12:30:45.500+00:00", "2024-01-01T12:30:45.5Z"), ("dateTime", "2024-01-01T12:30:45.000Z", "2024-01-01T12:30:45Z"), ("token", " a  b ", "a b")]
_N1 = "[:A-Z_a-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{2FF}]"
_NR = "[:A-Z_a-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{2FF}0-9.\\x{B7}-]"
_LIST = "list_filter(regexp_split_to_array(v, '[ \\t\\n\\r]+'), lambda x: x != '')"
ORACLES = {
    "type_integer_family": _columns(integer=_full("[+-]?[0-9]+"), nonNegativeInteger=_full("[+]?[0-9]+"), positiveInteger=_full("[+]?0*[1-9][0-9]*"), nonPositiveInteger=_full("-[0-9]+|[+-]?0+"), negativeInteger=_full("-[0-9]+")),
    "type_ranges": _columns(long=_range("-9223372036854775808", "9223372036854775807"), int=_range("-2147483648", "2147483647"), short=_range("-32768", "32767"), byte=_range("-128", "127"), unsignedLong=_range("0", "18446744073709551615", "[+]?[0-9]+"), unsignedInt=_range("0", "4294967295", "[+]?[0-9]+"), unsignedShort=_range("0", "65535", "[+]?[0-9]+"), unsignedByte=_range("0", "255", "[+]?[0-9]+")),
    "type_decimal_float_boolean": _columns(decimal=_full(_DEC), float=_full(_DEC + "([eE][+-]?[0-9]+)?|[+-]?INF|NaN"), double=_full(_DEC + "([eE][+-]?[0-9]+)?|[+-]?INF|NaN"), boolean="v in ('true', 'false', '1', '0')"),
    "type_binary_language_uri": _columns(hexBinary="regexp_full_match(regexp_replace(v, '[ \\t\\r\\n]', '', 'g'), '([0-9A-Fa-f]{2})*')", base64Binary="regexp_full_match(regexp_replace(v, '[ \\t\\r\\n]', '', 'g'), '([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?')", language=_full("[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*"), anyURI="not regexp_matches(v, '[\\x00-\\x1F\\x7F]') and length(replace(v, '[', '')) = length(replace(v, ']', '')) and not regexp_matches(regexp_replace(v, '%[0-9A-Fa-f]{2}', '', 'g'), '%')"),
    "type_names": _columns(Name=_full(f"[:{_NAME1}][:{_NAMER}]*"), NCName=_full(f"[{_NAME1}][{_NAMER}]*"), NMTOKEN=_full(f"[:{_NAMER}]+"), NMTOKENS=f"len({_LIST}) > 0 and len(list_filter({_LIST}, lambda x: not regexp_full_match(x, '[:{_NAMER}]+'))) = 0", IDREFS=f"len({_LIST}) > 0 and len(list_filter({_LIST}, lambda x: not regexp_full_match(x, '[{_NAME1}][{_NAMER}]*'))) = 0", QName=_full(f"[{_NAME1}][{_NAMER}]*(:[{_NAME1}][{_NAMER}]*)?"), token="v = trim(regexp_replace(v, '[ \\t\\r\\n]+', ' ', 'g'))", string="true"),
    "type_datetime_family": _columns(dateTime=_day_case(_YMD + "T" + _TIME + _TZ), dateTimeStamp=_day_case(_YMD + "T" + _TIME + _TZ[:-1]), date=_day_case(_YMD + _TZ), time=_full(_TIME + _TZ)),
    "type_duration": _columns(duration=_full("-?P([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T([0-9]+H)?([0-9]+M)?([0-9]+(\\.[0-9]+)?S)?)?") + " and not regexp_matches(v, '[PT]$')", dayTimeDuration=_full("-?P([0-9]+D)?(T([0-9]+H)?([0-9]+M)?([0-9]+(\\.[0-9]+)?S)?)?") + " and not regexp_matches(v, '[PT]$')", yearMonthDuration=_full("-?P([0-9]+Y)?([0-9]+M)?") + " and not regexp_matches(v, 'P$')"),
    "type_gregorian": _columns(gYear=_full("-?([1-9][0-9]{3,}|0[0-9]{3})" + _TZ) + " and not starts_with(v, '0000')", gYearMonth=_full("-?([1-9][0-9]{3,}|0[0-9]{3})-(0[1-9]|1[0-2])" + _TZ), gMonth=_full("--(0[1-9]|1[0-2])(--)?" + _TZ), gMonthDay=_full("--(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])" + _TZ) + " and not regexp_matches(v, '^--(02-3|(04|06|09|11)-31)')", gDay=_full("---(0[1-9]|[12][0-9]|3[01])" + _TZ)),
    "facet_pattern": "select p_partkey, regexp_full_match(p_brand, 'Brand#[0-9]{2}|X.*') and regexp_full_match(p_brand, '[A-Za-wyz0-9._:-]*#[1-3][0-9]') as ok, regexp_full_match(p_brand, '[A-Za-z_:][A-Za-z0-9._:-]*#[0-9]+') as named from part",
    "facet_range": "select p_partkey, round(p_retailprice * 100) >= 95000 and round(p_retailprice * 100) < 120050 as inside, round(p_retailprice * 100) > 100000 and round(p_retailprice * 100) <= 150000 as other from part",
    "facet_length": "select p_partkey, length(p_name) between 8 and 20 as chars, len(list_filter(string_split(p_type, ' '), lambda x: x != '')) = 3 as items, length(p_brand) = 8 as octets, length(p_brand) = 8 as octets64 from part",
    "facet_digits": f"select v, greatest(1, length(ltrim(split_part(ltrim(v, '+-'), '.', 1), '0')) + length(rtrim(split_part(v, '.', 2), '0'))) <= 3 as total, length(rtrim(split_part(v, '.', 2), '0')) <= 1 as fraction from {_SQL_ROWS} where {_full(_DEC)}",
    "facet_enumeration": "select c_custkey, c_mktsegment in ('BUILDING', 'MACHINERY') as ok from customer",
    "facet_whitespace": f"select v, v as preserve, translate(v, chr(9) || chr(10) || chr(13), '   ') as replace, trim(regexp_replace(v, '[ \\t\\r\\n]+', ' ', 'g')) as collapse from {_SQL_ROWS}",
    "duration_partial_order": f"select x.a, y.a as b, cast(case when {_SIGN.format(28)} = {_SIGN.format(29)} and {_SIGN.format(29)} = {_SIGN.format(30)} and {_SIGN.format(30)} = {_SIGN.format(31)} then {_SIGN.format(28)} end as integer) as c from {_MSTR} x(a, m, d), {_MSTR} y(a, m, d)",
    "temporal_comparison": "select event_id, epoch_ms(date_trunc('second', ts)) as millis, 0 as same, -1 as before from events",
    "canonical_values": "select * from (values " + ", ".join(f"('{t}', '{v}', '{c}')" for t, v, c in _CANON) + ") x(t, v, canonical)",
    "is_xml_name": f"select count(*) as words, count(*) filter (where regexp_full_match(w, '{_N1}{_NR}*')) as names, count(*) filter (where regexp_full_match(w, '{_N1}{_NR}*') and not contains(w, ':')) as ncnames, count(*) filter (where regexp_full_match(w, '{_NR}+')) as nmtokens from (select unnest(string_split(text, ' ')) as w from documents)",
    "illegal_char_filter": "select doc_id, doc_id % 7 != 0 as legal, true as legal11, md5(text) as stripped from documents",
    "legal_by_version": "select * from (values ('1.0', 2, false, true), ('1.1', 2, true, true), ('1.1', 2, false, true), ('1.0', 3, true, true)) x(version, n, legal, enc)",
    "string_functions": "select p_partkey, p_name || ' &lt;&amp;&gt;' as clean, '&quot;' || p_name as unquoted, p_name || chr(10) || chr(10) as lines, ' ' || p_name as spaces, p_name || '\\(a\\.b\\)\\*' as pattern, substr(p_name, 2, 1) = 'e' as at, case when length(p_name) > 3 and p_name like '%ies' then left(p_name, -3) || 'y' when p_name like '_%s' then left(p_name, -1) else 'item' end as item, true as white, true as pe from part",
    "pattern_translation": _columns(consonants=_full("[b-df-hj-np-tv-z]+"), digits=_full("[0-9]{1,3}"), ncname=_full(f"[{_NAME1}][{_NAMER}]*"), dots="regexp_full_match(v, 'a[^\\n\\r]b') or regexp_full_match(v, '[^a]*')", upper=_full("[A-Z]+"), plain="regexp_full_match(v, '[\\^]?x') or regexp_full_match(v, '[ \\t\\n\\r]*')"),
}

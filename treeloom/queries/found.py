"""Queries on grammars and entities that documents name themselves, and on grammars of a user's own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import attribute
from ..operators.serialize import to_text
from ..plans.assess import Entered
from ..plans.catalog import Catalog
from ..plans.lineage import stored
from ..sources.discovery import defaults_by_model, with_external
from ..sources.tokenizer import nodes_of, parse
from . import synth
from .synth import table
from .typed import text

CATALOG = '<catalog xmlns="urn:oasis:names:tc:entity:xmlns:xml:catalog" prefer="public"><public publicId="-//T//R0//EN" uri="r0.dtd"/><system systemId="urn:r1" uri="r1.dtd"/></catalog>'


def dtd_found_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External subsets by public identifier and by system identifier of a catalog, relative to the document, and one that isn't there: its entity stays a reference."""
    c, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "region")
    key = F.col("c_custkey")
    way = key % 4
    ids = F.when(way == 0, 'PUBLIC "-//T//R0//EN" "none"').when(way == 1, 'SYSTEM "urn:r1"').when(way == 2, "SYSTEM '../r2.dtd'").otherwise('SYSTEM "gone.dtd"')
    xml = text("<!DOCTYPE c ", ids, "><c><n>", F.col("c_name"), "</n>&who;</c>")
    docs = c.select(key.alias("doc_id"), xml.alias("xml"))
    files = r.select(text("/d/r", F.col("r_regionkey"), ".dtd").alias("path"), text('<!ENTITY who "', F.col("r_name"), '"><!ATTLIST n k CDATA "', F.col("r_regionkey"), '">').alias("text"))
    bases = docs.select("doc_id", F.lit("/d/docs/x.xml").alias("base"))
    catalog = Catalog("/d/cat.xml", {"/d/cat.xml": CATALOG}.__getitem__)
    nodes = nodes_of(parse(with_external(docs, files, catalog, bases))).where("kind != 'doctype'")
    return to_text(nodes).select(F.col("doc_id").alias("c_custkey"), "xml")


def grammar_text(path: str) -> str:
    """RelaxNG grammars by place: ``/g/n<k>.rng`` gives every ``v`` the default ``k``; some aren't there."""
    number = path.removeprefix("/g/n").removesuffix(".rng")
    if not number.isdigit() or int(number) % 5 == 4:
        raise KeyError(path)
    return f'<element name="c" xmlns="http://relaxng.org/ns/structure/1.0" xmlns:a="http://relaxng.org/ns/compatibility/annotations/1.0"><element name="v"><optional><attribute name="k" a:defaultValue="{number}"/></optional><text/></element></element>'


def rng_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document names its nation's grammar, relative to its own place; defaults of all come in one pass."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    model = F.when(key % 7 == 6, "").otherwise(text('<?xml-model href="../n', F.col("c_nationkey"), '.rng" schematypens="http://relaxng.org/ns/structure/1.0"?>'))
    xml = text(model, "<c><v", F.when(key % 3 == 0, ' k="own"').otherwise(""), ">1</v></c>")
    nodes = stored(nodes_of(parse(c.select(key.alias("doc_id"), xml.alias("xml")))))
    bases = c.select(key.alias("doc_id"), F.lit("/g/docs/x.xml").alias("base"))
    filled = defaults_by_model(nodes, grammar_text, bases)
    return filled.where("name = 'v'").select(F.col("doc_id").alias("c_custkey"), attribute(F.col("attrs"), "k").alias("k"))


class Ladder:
    """A user's grammar: what stands in what, by name, and attributes that must be numbers."""

    def __init__(self, steps: Mapping[str | None, Sequence[str]], numbers: Sequence[str]):
        self.steps, self.numbers = steps, frozenset(numbers)

    def start(self, number: int) -> Any:
        return None

    def enter(self, state: Any, ns: str, name: str, attrs: Sequence[str], bound: Mapping[str, str]) -> Entered:
        known = name in self.steps.get(state, ())
        names, values = attrs[::2], attrs[1::2]
        wrong = [n if n in self.numbers and not v.isdigit() else None for n, v in zip(names, values, strict=True)]
        return Entered(name if known else "?", declared=0 if known else None, tokens=wrong)

    def token(self, ns: str, name: str) -> str:
        return f"{name} "


def grammar_of_ones_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read with a grammar that knows lines and quantities only, and wants numbers in two attributes."""
    grammar = Ladder({None: ["order"], "order": ["line"], "line": ["qty"]}, ["key", "flag"])
    nodes = nodes_of(parse(synth.orders(spark, sf_dir), grammar=grammar)).where("kind = 'element'")
    told = F.concat(F.when(F.col("declared").isNull(), F.array(F.concat(F.lit("unknown "), "name"))).otherwise(F.array().cast("array<string>")), F.transform(F.array_compact("tokens"), lambda t: F.concat(F.lit("no number in "), t)))
    return nodes.select(F.explode(told).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (dtd_found_outside, rng_by_document, grammar_of_ones_own)}

_LINES = "lineitem l join orders o on o.o_orderkey = l.l_orderkey"
ORACLES = {
    "dtd_found_outside": """select c_custkey, '<c><n' || case when c_custkey % 4 = 3 then '' else ' k="' || c_custkey % 4 || '"' end || '>' || c_name || '</n>' || case when c_custkey % 4 = 3 then '&who;' else r_name end || '</c>' as xml from customer left join region on r_regionkey = c_custkey % 4""",
    "rng_by_document": "select c_custkey, case when c_custkey % 3 = 0 then 'own' when c_custkey % 7 = 6 or c_nationkey % 5 = 4 then null else c_nationkey::varchar end as k from customer",
    "grammar_of_ones_own": f"select 'unknown price100' as rule, count(*) as n from {_LINES} union all select 'no number in flag', count(*) from {_LINES}",
}

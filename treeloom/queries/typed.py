"""Queries on schema types by state: namespaces, named types, IDs by type, rising keys, many schemas at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import attribute
from ..operators import validate as val
from ..operators.defaults import fill_by_rule, texts_by_rule
from ..plans.assess import NamespaceScope, SchemaGrammar
from ..plans.lineage import stored
from ..plans.xsd import Schema, compile_schema
from ..sources.tokenizer import nodes_of, parse
from .synth import element, table

XS = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"'
INSTANCE = "http://www.w3.org/2001/XMLSchema-instance"


def judged(docs: DataFrame, schema: Schema) -> DataFrame:
    """Violations of ``doc_id, xml`` rows, parsed with the schema at hand."""
    grammar = SchemaGrammar([schema])
    return val.xsd_violations(stored(nodes_of(parse(docs, grammar=grammar, tasks=2 * docs.sparkSession.sparkContext.defaultParallelism))), grammar)


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def joined(rows: DataFrame, by: str, name: str, one: Column, order: Column) -> DataFrame:
    """Texts of a group put together in a fixed order."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("at"), one.alias("x")))), lambda r: r["x"]), "").alias(name))


TWO_SPACES = {
    "t.xsd": f"""{XS} xmlns:t="urn:t" xmlns:o="urn:o" targetNamespace="urn:t" elementFormDefault="qualified"><xs:import namespace="urn:o" schemaLocation="o.xsd"/>
<xs:element name="d"><xs:complexType><xs:sequence><xs:element ref="t:p"/><xs:element ref="o:p"/></xs:sequence></xs:complexType></xs:element>
<xs:element name="p"><xs:complexType><xs:sequence><xs:element name="v" type="xs:int"/></xs:sequence></xs:complexType></xs:element></xs:schema>""",
    "o.xsd": f"""{XS} targetNamespace="urn:o"><xs:element name="p"><xs:complexType><xs:sequence><xs:element name="v" type="xs:NCName"/><xs:element name="w" type="xs:date" minOccurs="0"/></xs:sequence></xs:complexType></xs:element></xs:schema>""",
}


def xsd_one_name_in_two_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t:p`` and ``o:p`` in one model, by changing prefixes: numbers in the one, words in the other."""
    key, word = F.col("c_custkey"), F.col("c_mktsegment")
    one, other = F.when(key % 3 == 0, word).otherwise(key.cast("string")), F.when(key % 4 == 0, key.cast("string")).otherwise(word)
    t, o = F.when(key % 2 == 0, "t").otherwise("o"), F.when(key % 2 == 0, "o").otherwise("t")  # prefixes change sides
    date = F.when(key % 5 == 0, "<w>2024-02-30</w>").when(key % 5 == 1, "<w>2024-02-29</w>").otherwise("")
    xml = text("<", t, ":d xmlns:", t, '="urn:t" xmlns:', o, '="urn:o"><', t, ":p><", t, ":v>", one, "</", t, ":v></", t, ":p><", o, ":p><v>", other, "</v>", date, "</", o, ":p></", t, ":d>")
    found = judged(table(spark, sf_dir, "customer").select(key.alias("doc_id"), xml.alias("xml")), compile_schema("t.xsd", TWO_SPACES))
    return found.groupBy(F.col("doc_id").alias("c_custkey"), "rule").agg(F.count("*").alias("n"))


_NARROWED = """<xs:complexType name="base"><xs:sequence><xs:element name="p"><xs:complexType><xs:sequence><xs:element name="v"/></xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType>
<xs:complexType name="res"><xs:complexContent><xs:restriction base="base"><xs:sequence><xs:element name="p"><xs:complexType><xs:sequence><xs:element name="v" type="xs:int"/></xs:sequence></xs:complexType></xs:element></xs:sequence></xs:restriction></xs:complexContent></xs:complexType>
<xs:simpleType name="few"><xs:restriction base="xs:int"><xs:maxInclusive value="9"/></xs:restriction></xs:simpleType>"""
NARROWED_XSD = f'{XS}>{_NARROWED}<xs:element name="d"><xs:complexType><xs:sequence><xs:element name="e" type="base"/><xs:element name="n" type="xs:int"/></xs:sequence></xs:complexType></xs:element></xs:schema>'


def xsd_type_rules_all_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type named two levels up narrows a value, by whatever prefix the instance namespace has; a simple type narrows a number; some names are of no type."""
    key = F.col("c_custkey")
    prefix = F.when(key % 2 == 0, "i").otherwise("xsi")
    named = F.when(key % 3 == 0, text(" ", prefix, ':type="res"')).when(key % 3 == 1, "").otherwise(text(" ", prefix, ':type="none"'))
    value = F.when(key % 5 < 3, F.col("c_mktsegment")).otherwise(key.cast("string"))
    few = F.when(key % 7 < 4, text(" ", prefix, ':type="few"')).otherwise("")
    xml = text("<d xmlns:", prefix, f'="{INSTANCE}"><e', named, "><p><v>", value, "</v></p></e><n", few, ">", (key % 20).cast("string"), "</n></d>")
    found = judged(table(spark, sf_dir, "customer").select(key.alias("doc_id"), xml.alias("xml")), compile_schema("s", {"s": NARROWED_XSD}))
    return found.groupBy(F.col("doc_id").alias("c_custkey"), "rule").agg(F.count("*").alias("n"))


IDS_XSD = f"""{XS}><xs:simpleType name="code"><xs:restriction base="xs:ID"><xs:pattern value="p[0-9]+"/></xs:restriction></xs:simpleType><xs:simpleType name="refs"><xs:list itemType="xs:IDREF"/></xs:simpleType>
<xs:simpleType name="either"><xs:union memberTypes="xs:integer xs:IDREF"/></xs:simpleType>
<xs:element name="g"><xs:complexType><xs:sequence><xs:element name="x" maxOccurs="unbounded"><xs:complexType><xs:sequence><xs:element name="k" type="code"/><xs:element name="r" type="refs"/></xs:sequence>
<xs:attribute name="id"/><xs:attribute name="u" type="either"/></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>"""


def xsd_ids_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDs in elements by a derived type, references in a list and in a union's member; an attribute ``id`` of no such type repeats freely."""
    n = F.col("p_partkey")
    name = lambda m: text("p", m)
    own = name(n - F.when(n % 10 == 7, 1).otherwise(0))
    one = element("x", element("k", own), element("r", name(n), " ", name(n + 1)), id=F.lit("same"), u=F.when(n % 2 == 0, n.cast("string")).otherwise(name(n + 2)))
    docs = joined(table(spark, sf_dir, "part").withColumn("doc_id", F.floor(n / 100)), "doc_id", "xml", one, n)
    found = judged(docs.select("doc_id", text("<g>", F.col("xml"), "</g>").alias("xml")), compile_schema("s", {"s": IDS_XSD}))
    return found.groupBy("doc_id", "rule", "message").agg(F.count("*").alias("n"))


NESTED_XSD = f"""{XS}><xs:complexType name="c"><xs:attribute name="k"/></xs:complexType><xs:complexType name="cs"><xs:sequence><xs:element name="c" type="c" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType>
<xs:element name="w"><xs:complexType><xs:sequence><xs:element name="g" type="cs" minOccurs="0" maxOccurs="unbounded"><xs:key name="held"><xs:selector xpath="c"/><xs:field xpath="@k"/></xs:key></xs:element>
<xs:element name="old"><xs:complexType><xs:sequence><xs:element name="g" type="cs"/></xs:sequence></xs:complexType></xs:element>
<xs:element name="r" type="c" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType><xs:keyref name="asked" refer="held"><xs:selector xpath="r"/><xs:field xpath="@k"/></xs:keyref></xs:element></xs:schema>"""


def identity_rising_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of inner groups answer a reference further up, unless two groups hold one value; groups of another rule, though of the same name, have no key."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    one = lambda name, k: text(f"<{name} k=", '"', k, '"/>')
    held = c.select((F.col("c_custkey") % 40).alias("doc_id"), "c_nationkey", "c_custkey", one("c", F.col("c_custkey") % 89).alias("x"))
    groups = held.groupBy("doc_id", "c_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "x"))), lambda r: r["x"]), "").alias("xs"))
    inner = joined(groups, "doc_id", "groups", text("<g>", F.col("xs"), "</g>"), F.col("c_nationkey"))
    asked = joined(o.select((F.col("o_custkey") % 40).alias("doc_id"), "o_orderkey"), "doc_id", "refs", one("r", F.col("o_orderkey") % 97), F.col("o_orderkey"))
    docs = inner.join(asked, "doc_id", "full").select("doc_id", text("<w>", F.coalesce("groups", F.lit("")), '<old><g><c k="1"/><c k="1"/><c/></g></old>', F.coalesce("refs", F.lit("")), "</w>").alias("xml"))
    found = judged(docs, compile_schema("s", {"s": NESTED_XSD}))
    return found.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


QNAME_XSD = f'{XS} targetNamespace="urn:q" elementFormDefault="qualified"><xs:element name="d"><xs:complexType><xs:sequence><xs:element name="e"><xs:complexType><xs:simpleContent><xs:extension base="xs:QName"><xs:attribute name="a" type="xs:QName"/></xs:extension></xs:simpleContent></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>'


def xsd_qnames_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A qualified name needs a prefix that is bound where it stands: by the root, by the element itself, by none."""
    key = F.col("c_custkey")
    prefix = F.get(F.array(*[F.lit(p) for p in ("q:", "r:", "s:", "")]), (key % 4).cast("int"))
    own = F.when(key % 3 == 0, ' xmlns:s="urn:s"').otherwise("")
    xml = text('<q:d xmlns:q="urn:q" xmlns:r="urn:r"><q:e', own, ' a="', prefix, 'x">', prefix, F.col("c_mktsegment"), "</q:e></q:d>")
    found = judged(table(spark, sf_dir, "customer").select(key.alias("doc_id"), xml.alias("xml")), compile_schema("s", {"s": QNAME_XSD}))
    return found.groupBy(F.col("doc_id").alias("c_custkey"), "rule").agg(F.count("*").alias("n"))


def located(path: str) -> str:
    """Schemas by place: ``/x/n<k>.xsd`` lets values up to k stand, ``/x/o.xsd`` is for another namespace."""
    if path == "/x/o.xsd":
        return f'{XS} targetNamespace="urn:o"><xs:element name="y" type="xs:NCName"/></xs:schema>'
    most = path.removeprefix("/x/n").removesuffix(".xsd")
    if not most.isdigit() or int(most) % 7 == 6:
        raise KeyError(path)
    return f'{XS} xmlns:o="urn:o"><xs:element name="r"><xs:complexType><xs:sequence><xs:element name="v"><xs:simpleType><xs:restriction base="xs:int"><xs:maxInclusive value="{most}"/></xs:restriction></xs:simpleType></xs:element><xs:any namespace="urn:o" minOccurs="0"/></xs:sequence></xs:complexType></xs:element></xs:schema>'


def xsd_many_schemas_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document names its nation's schema, relative to its own place, some a second one for another namespace; all are judged in one pass."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    second = key % 3 == 0
    locations = text(' xsi:noNamespaceSchemaLocation="../n', nation, '.xsd"', F.when(second, ' xsi:schemaLocation="urn:o /x/o.xsd"').otherwise(""))
    other = F.when(second, text('<o:y xmlns:o="urn:o">', F.when(key % 2 == 0, key.cast("string")).otherwise(F.col("c_mktsegment")), "</o:y>")).otherwise("")
    xml = text(f'<r xmlns:xsi="{INSTANCE}"', locations, "><v>", (key % 25).cast("string"), "</v>", other, "</r>")
    c = table(spark, sf_dir, "customer")
    nodes = stored(nodes_of(parse(c.select(key.alias("doc_id"), xml.alias("xml")), tasks=2 * spark.sparkContext.defaultParallelism)))
    bases = c.select(key.alias("doc_id"), F.lit("/x/docs/one.xml").alias("base"))
    found = val.violations_by_location(nodes, located, bases=bases)
    return found.groupBy(F.col("doc_id").alias("c_custkey"), "rule").agg(F.count("*").alias("n"))


DEFAULTS_XSD = f"""{XS} xmlns="urn:d" targetNamespace="urn:d" elementFormDefault="qualified"><xs:attribute name="lang" type="xs:string"/>
<xs:complexType name="one"><xs:simpleContent><xs:extension base="xs:string"><xs:attribute ref="lang" default="en"/><xs:attribute name="p" default="one"/></xs:extension></xs:simpleContent></xs:complexType>
<xs:complexType name="two"><xs:simpleContent><xs:restriction base="one"><xs:attribute ref="lang" fixed="fr"/></xs:restriction></xs:simpleContent></xs:complexType>
<xs:element name="d"><xs:complexType><xs:sequence><xs:element name="v" type="one" default="none"/><xs:element name="h"><xs:complexType><xs:sequence><xs:element name="v" default="inner"/></xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>"""


def xsd_defaults_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namesakes with defaults of their own, a named type with others, and a default of a namespace that takes the prefix bound there."""
    key = F.col("c_custkey")
    prefix = F.get(F.array(*[F.lit(p) for p in ("a", "b", "")]), (key % 3).cast("int"))
    declared = F.when(prefix == "", ' xmlns="urn:d"').otherwise(text(' xmlns="urn:d" xmlns:', prefix, '="urn:d"'))
    given = F.when(key % 5 == 0, text(" xmlns:q='urn:d' q:lang='own'")).when(key % 5 == 1, text(f' xmlns:i="{INSTANCE}" i:type="two"')).otherwise("")
    xml = text("<d", declared, "><v", given, ">", F.when(key % 2 == 0, F.col("c_name")).otherwise(""), "</v><h><v/></h></d>")
    grammar = SchemaGrammar([compile_schema("s", {"s": DEFAULTS_XSD})])
    nodes = stored(nodes_of(parse(table(spark, sf_dir, "customer").select(key.alias("doc_id"), xml.alias("xml")), grammar=grammar)))
    filled = fill_by_rule(nodes, grammar).where("name = 'v'").select("doc_id", "pre", "path", "attrs")
    lang = F.array_join(F.transform(F.filter("attrs", lambda a: a["name"].rlike("(^|:)lang$")), lambda a: F.concat(a["name"], F.lit("="), a["value"])), ",")
    return filled.join(texts_by_rule(nodes, grammar), ["doc_id", "pre"]).select(F.col("doc_id").alias("c_custkey"), "path", lang.alias("lang"), attribute(F.col("attrs"), "p").alias("p"), "text")


def namespaces_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bindings of each element as a column: inherited, undone and bound anew."""
    key = F.col("c_custkey")
    inner = F.when(key % 3 == 0, ' xmlns=""').when(key % 3 == 1, ' xmlns:p="urn:q"').otherwise("")
    xml = text('<d xmlns="urn:d" xmlns:p="urn:p"><e', inner, '><f xmlns:n="urn:', key, '"/></e><p:e/></d>')
    nodes = nodes_of(parse(table(spark, sf_dir, "customer").select(key.alias("doc_id"), xml.alias("xml")), grammar=NamespaceScope()))
    shown = F.array_join(F.transform(F.sort_array(F.map_entries("scope")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return nodes.select(F.col("doc_id").alias("c_custkey"), "path", F.replace(shown, F.lit("xml=http://www.w3.org/XML/1998/namespace"), F.lit("xml")).alias("bound"))


QUERIES = {f.__name__: f for f in (
    xsd_one_name_in_two_namespaces, xsd_type_rules_all_below, xsd_ids_by_type, identity_rising_keys, xsd_qnames_in_scope, xsd_many_schemas_at_once, xsd_defaults_by_rule, namespaces_in_scope,
)}

_NATIONS = "c_nationkey % 7 = 6"
_IDS = "(select p_partkey as n, p_partkey // 100 as doc, 'p' || (p_partkey - case when p_partkey % 10 = 7 then 1 else 0 end) as id from part)"
_HELD = "(select c_custkey % 40 as doc, c_nationkey as g, cast(c_custkey % 89 as varchar) as k from customer)"
ORACLES = {
    "xsd_one_name_in_two_namespaces": "select c_custkey, 'value-type' as rule, ((c_custkey % 3 = 0)::int + (c_custkey % 4 = 0)::int + (c_custkey % 5 = 0)::int)::bigint as n from customer where c_custkey % 3 = 0 or c_custkey % 4 = 0 or c_custkey % 5 = 0",
    "xsd_type_rules_all_below": "select c_custkey, rule, sum(n)::bigint as n from (select c_custkey, 'type-unknown' as rule, 1 as n from customer where c_custkey % 3 = 2 union all select c_custkey, 'value-type', 1 from customer where c_custkey % 3 = 0 and c_custkey % 5 < 3 union all select c_custkey, 'value-type', 1 from customer where c_custkey % 7 < 4 and c_custkey % 20 > 9) group by 1, 2",
    "xsd_ids_by_type": f"""select doc as doc_id, rule, message, count(*) as n from (
select doc, 'id-repeated' as rule, 'repeated ID ' || id as message from {_IDS} where (doc, id) in (select (doc, id) from {_IDS} group by doc, id having count(*) > 1)
union all select doc, 'idref-dangling', 'no ID ' || ref from (select doc, unnest([('p' || n), ('p' || (n + 1))] || case when n % 2 = 1 then ['p' || (n + 2)] else [] end) as ref from {_IDS}) where (doc, ref) not in (select (doc, id) from {_IDS})) group by 1, 2, 3""",
    "identity_rising_keys": f"""with held as (select doc, k, count(distinct g) as gs from {_HELD} group by 1, 2), refs as (select o_custkey % 40 as doc, cast(o_orderkey % 97 as varchar) as k from orders)
select doc as doc_id, 'key' as rule, count(*) as n from (select doc, g, k from {_HELD} group by 1, 2, 3 having count(*) > 1) group by 1
union all select r.doc, 'keyref', count(*) from refs r left join held h on h.doc = r.doc and h.k = r.k where coalesce(h.gs, 0) != 1 group by 1""",
    "xsd_qnames_in_scope": "select c_custkey, rule, 1::bigint as n from customer, (values ('value-type'), ('attribute-type')) v(rule) where c_custkey % 4 = 2 and c_custkey % 3 != 0",
    "xsd_defaults_by_rule": """select c_custkey, '/d/v' as path, case c_custkey % 5 when 0 then 'q:lang=own' when 1 then case c_custkey % 3 when 0 then 'a:' when 1 then 'b:' else '' end || 'lang=fr' else case c_custkey % 3 when 0 then 'a:' when 1 then 'b:' else '' end || 'lang=en' end as lang, 'one' as p, case when c_custkey % 2 = 0 then c_name else 'none' end as text from customer
union all select c_custkey, '/d/h/v', '', null, 'inner' from customer""",
    "namespaces_in_scope": """select c_custkey, path, case path when '/d' then '=urn:d p=urn:p xml' when '/d/p:e' then '=urn:d p=urn:p xml' else case when c_custkey % 3 = 0 then '' else '=urn:d ' end || case when path = '/d/e/f' then 'n=urn:' || c_custkey || ' ' else '' end || case when c_custkey % 3 = 1 then 'p=urn:q' else 'p=urn:p' end || ' xml' end as bound from customer, (values ('/d'), ('/d/e'), ('/d/e/f'), ('/d/p:e')) v(path)""",
    "xsd_many_schemas_at_once": f"""select c_custkey, rule, sum(n)::bigint as n from (select c_custkey, 'schema-missing' as rule, 1 as n from customer where {_NATIONS}
union all select c_custkey, 'value-type', 1 from customer where not ({_NATIONS}) and c_custkey % 25 > c_nationkey union all select c_custkey, 'value-type', 1 from customer where not ({_NATIONS}) and c_custkey % 6 = 0) group by 1, 2""",
}

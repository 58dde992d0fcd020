"""Validation: rule tables met with node rows give violations (``doc_id, pre, rule, message``).

All violations are found; ``first_violation`` picks the first of each document.  Rule
tables are as large as a grammar, so they are broadcast.  Where documents are parsed with
the grammar at hand, elements come with their rules, child sequences and texts, and their
checks need no shuffle at all; only identity constraints do.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.datatypes import Facets, canonical_value, list_items
from ..functions.text import is_ncname, is_nmtoken, prefix_of
from ..model import ASSESSED, XSI
from ..plans.assess import SchemaGrammar
from ..plans.dtd import Dtd
from ..plans.lineage import stored
from ..plans.xsd import AttributeRule, Schema, SimpleType, Wildcard
from ..sources.tokenizer import assess
from .identity import dangling_references, duplicate_ids, incomplete, repeated, rising, tuples, unmatched


def violation(rows: DataFrame, rule: str, message: Column) -> DataFrame:
    return rows.select("doc_id", "pre", F.lit(rule).alias("rule"), message.alias("message"))


def fault(broken: Column, rule: str, message: Column) -> Column:
    """A rule and message where ``broken`` holds, null elsewhere."""
    return F.when(broken, F.struct(F.lit(rule).alias("rule"), message.alias("message")))


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def first_violation(violations: DataFrame) -> DataFrame:
    """``doc_id, rule, message``: the first in document order."""
    return violations.groupBy("doc_id").agg(F.min(F.struct("pre", "rule", "message")).alias("v")).select("doc_id", "v.rule", "v.message")


def verdicts(nodes: DataFrame, violations: DataFrame) -> DataFrame:
    """``doc_id, is_valid, errors``: a row for each document, messages joined."""
    errors = violations.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "message"))), lambda v: v["message"]), "; ").alias("errors"))
    docs = nodes.where("pre = 0").select("doc_id")
    return docs.join(errors, "doc_id", "left").select("doc_id", F.col("errors").isNull().alias("is_valid"), F.coalesce("errors", F.lit("")).alias("errors"))


def child_sequences(nodes: DataFrame, token: Column | None = None) -> DataFrame:
    """Elements with ``sequence`` (child tokens, each with a blank behind), ``text``, ``own_text`` and ``n_nodes``.

    One grouping by parent, unless a grammar has given them to the rows while these were read.
    """
    filled = ~F.col("text").rlike(r"\A[ \t\r\n]*\z")
    if "sequence" in nodes.columns:
        return nodes.where("kind = 'element'").select("doc_id", "pre", "post", "name", "ns_uri", "attrs", "parent", "level", "path", "sequence", "text", "n_nodes", filled.alias("own_text"))
    token = F.concat(F.col("name"), F.lit(" ")) if token is None else token
    inner = nodes.where("parent >= 0").select(
        "doc_id", F.col("parent").alias("pre"), "sib", F.when(F.col("kind") == "element", token).alias("token"),
        F.when(F.col("kind").isin("text", "cdata"), F.col("value")).alias("value"),
    )
    grouped = inner.groupBy("doc_id", "pre").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("sib", "token")))), lambda t: t["token"]), "").alias("sequence"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("sib", "value")))), lambda t: t["value"]), "").alias("text"),
        F.count("*").alias("n_nodes"),
    )
    el = nodes.where("kind = 'element'").select("doc_id", "pre", "post", "name", "ns_uri", "attrs", "parent", "level", "path")
    met = el.join(grouped, ["doc_id", "pre"], "left").na.fill("", ["sequence", "text"]).na.fill(0, ["n_nodes"])
    return met.withColumn("own_text", filled)


# --- DTD --------------------------------------------------------------------------------------------------------


def dtd_violations(nodes: DataFrame, grammar: Dtd, check_ids: bool = False) -> DataFrame:
    """Violations of a DTD; prefixed elements are never checked, ID and IDREF only on demand.

    The rules of an element are gathered in one row, so all its checks are made in one pass.
    """
    tables = grammar.tables(nodes.sparkSession)
    gathered = (
        tables["dtd_attributes"]
        .groupBy("element")
        .agg(F.collect_list(F.struct("attribute", "type", "allowed", "use", "default_value")).alias("rules"))
    )
    rules = F.broadcast(tables["dtd_elements"].withColumnRenamed("name", "element").join(gathered, "element", "full"))
    met = child_sequences(nodes).where(~F.contains(F.col("name"), F.lit(":"))).join(rules, F.col("name") == F.col("element"), "left")
    unparsed = F.array(*[F.lit(n) for n, e in grammar.entities.items() if e[3] is not None]).cast("array<string>")
    names = F.filter(F.split("sequence", " "), lambda x: x != "")
    named = lambda before, after="": F.concat(F.lit(before), F.col("name"), F.lit(after))
    of_element = [
        fault(F.col("kind").isNull(), "element-undeclared", named("undeclared element ")),
        fault((F.col("kind") == "EMPTY") & (F.col("n_nodes") > 0), "content-empty", named("content in empty element ")),
        fault((F.col("kind") == "MIXED") & (F.size(F.array_except(names, "names")) > 0), "content-mixed", named("child not allowed in ")),
        fault((F.col("kind") == "ELEMENT") & (~F.rlike(F.col("sequence"), F.col("pattern")) | F.col("own_text")), "content-model", named("content of ", " doesn't match")),
    ]
    own = F.coalesce("rules", F.array().cast("array<struct<attribute:string,type:string,allowed:array<string>,use:string,default_value:string>>"))

    def of_attribute(a: Column) -> Column:
        rule = F.get(F.filter(own, lambda r: r["attribute"] == a["name"]), F.lit(0))
        value, kind, items = a["value"], rule["type"], list_items(a["value"])
        good = (
            F.when(kind.isin("ID", "IDREF", "ENTITY"), is_ncname(value))
            .when(kind.isin("IDREFS", "ENTITIES"), (F.size(items) > 0) & F.forall(items, is_ncname))
            .when(kind == "NMTOKEN", is_nmtoken(value))
            .when(kind == "NMTOKENS", (F.size(items) > 0) & F.forall(items, is_nmtoken))
            .when(kind.isin("ENUMERATION", "NOTATION"), F.array_contains(rule["allowed"], value))
            .otherwise(True)
        )
        label = F.concat(F.lit("attribute "), a["name"], F.lit(" of "), F.col("name"))
        return F.array(
            fault(kind.isNull() & ~a["name"].startswith("xml"), "attribute-undeclared", F.concat(F.lit("undeclared "), label)),
            fault(~good, "attribute-type", F.concat(F.lit("bad value for "), label)),
            fault((rule["use"] == "fixed") & (value != rule["default_value"]), "attribute-fixed", F.concat(F.lit("fixed value changed for "), label)),
            fault(kind.isin("ENTITY", "ENTITIES") & (F.size(F.array_except(items, unparsed)) > 0), "attribute-entity", F.concat(F.lit("undeclared entity in "), label)),
        )

    lacking = F.filter(own, lambda r: (r["use"] == "required") & ~F.exists("attrs", lambda a: a["name"] == r["attribute"]))
    missing = F.transform(lacking, lambda r: F.struct(F.lit("attribute-required").alias("rule"), F.concat(F.lit("missing attribute "), r["attribute"], F.lit(" of "), F.col("name")).alias("message")))
    faults = F.concat(F.array(*of_element), F.flatten(F.transform("attrs", of_attribute)), missing)
    out = met.select("doc_id", "pre", F.inline(F.filter(faults, lambda f: f["rule"].isNotNull())))
    if not check_ids:
        return out
    typed = [(r.element, r.name, r.type) for r in grammar.attributes.values() if r.type in ("ID", "IDREF", "IDREFS")]
    kinds = nodes.sparkSession.createDataFrame(typed, "name string, attribute string, type string")
    given = nodes.where("kind = 'element'").select("doc_id", "pre", "name", F.explode("attrs").alias("a"))
    given = given.select("doc_id", "pre", "name", F.col("a.name").alias("attribute"), F.col("a.value").alias("value")).join(F.broadcast(kinds), ["name", "attribute"])
    ids = given.where("type = 'ID'").select("doc_id", "pre", "value")
    refs = given.where("type != 'ID'").select("doc_id", "pre", F.explode(list_items(F.col("value"))).alias("value"))
    twice = ids.join(duplicate_ids(ids), ["doc_id", "value"])
    dangling = violation(dangling_references(refs, ids), "idref-dangling", F.concat(F.lit("no ID "), F.col("value")))
    return all_of([out, violation(twice, "id-repeated", F.concat(F.lit("repeated ID "), F.col("value"))), dangling])


# --- XML Schema -------------------------------------------------------------------------------------------------


_WILD = "struct<form:string,spaces:array<string>,strictness:string>"


def _wild_row(w: Wildcard | None) -> tuple | None:
    return None if w is None else (w.covers[0], sorted(w.covers[1]) if len(w.covers) > 1 else [], w.strictness)


def _covers(w: Column, ns: Column) -> Column:
    inside = F.array_contains(w["spaces"], ns)
    return F.when(w["form"] == "any", F.lit(True)).when(w["form"] == "not", ~inside).otherwise(inside)


def chosen(which: Column, ways: dict[int, Column], otherwise: Column) -> Column:
    """The expression that ``which`` numbers, as one flat choice."""
    out = None
    for k, way in ways.items():
        out = F.when(which == k, way) if out is None else out.when(which == k, way)
    return otherwise if out is None else out.otherwise(otherwise)


def accepts_bound(kind: SimpleType, value: Column, scope: Column) -> Column:
    """Whether a text is of the type, and its qualified names have prefixes that ``scope`` binds."""
    if not kind.has_base(("QName", "NOTATION")):
        return kind.accepts(value)
    if kind.members:
        return kind.accepts(value) & reduce(Column.__or__, [accepts_bound(m, value, scope) for m in kind.members])
    prefixes = F.transform(list_items(value), prefix_of)
    return kind.accepts(value) & F.forall(prefixes, lambda p: (p == "") | (p == "xml") | F.map_contains_key(scope, p))


def id_roles(kind: SimpleType, value: Column) -> Column:
    """``array<struct<role, value>>``: the IDs (role ``ID``) and references (``IDREF``) that a text of the type holds."""
    none = F.array().cast("array<struct<role:string,value:string>>")
    if kind.members:
        return F.coalesce(*[F.when(m.accepts(value), id_roles(m, value)) for m in kind.members], none)
    base = (kind.item or kind).base
    role = {"ID": "ID", "IDREF": "IDREF", "IDREFS": "IDREF"}.get(base)
    if kind.item is not None and kind.item.members:
        return F.flatten(F.transform(list_items(value), lambda v: id_roles(kind.item, v)))
    return none if role is None else F.transform(list_items(value), lambda v: F.struct(F.lit(role).alias("role"), v.alias("value")))


def grammar_of(schema: Schema | SchemaGrammar) -> SchemaGrammar:
    return SchemaGrammar([schema]) if isinstance(schema, Schema) else schema


def xsd_violations(nodes: DataFrame, schema: Schema | SchemaGrammar, number: str | None = None) -> DataFrame:
    """Violations of a compiled schema, ID values and identity constraints included.

    ``nodes`` are node rows, best those of ``parse(docs, grammar=SchemaGrammar([schema]))``:
    then each element has its rule already.  Other rows are read once more in document
    order; with several schemas, the column ``number`` says which one judges a document.

    An element is met with the rule for its name and namespace in its parent's type, or with
    the global rule; ``xsi:type`` (by any prefix of its namespace) names another type, which
    rules all that lies below and must derive from the declared one by methods that aren't
    blocked.  ``xsi:nil`` empties.  What a wildcard covers is checked as it says: ``skip``
    leaves out the whole subtree, ``lax`` checks what is declared at the top, ``strict`` (the
    default) wants a declaration.
    """
    grammar = grammar_of(schema)
    judged = nodes if ASSESSED.fieldNames()[0] in nodes.columns else assess(nodes, grammar, number)
    met, kinds = with_rules(judged, grammar)
    out = met.select("doc_id", "pre", F.inline(F.filter(faults_of(met, grammar, kinds), lambda f: f["rule"].isNotNull())))
    return all_of([out, *id_violations(met, kinds), *identity_violations(nodes, judged, grammar)])


def declarations(spark: SparkSession, grammar: SchemaGrammar) -> DataFrame:
    """The rules as a table: element, its content, the type of its value, its attributes and those required, by ``rule_id``."""
    rows = [
        (k, r.ns, r.name, r.type.kind, r.type.simple.name if r.type.simple else None, sorted(a.name for a in r.type.attributes.values()), sorted(a.name for a in r.type.attributes.values() if a.use == "required"), r.default, r.fixed, r.nillable)
        for k, r in enumerate(grammar.rules)
    ]
    return spark.createDataFrame(rows, "rule_id int, ns string, name string, content string, value_type string, attributes array<string>, required array<string>, default_value string, fixed string, nillable boolean")


def with_rules(judged: DataFrame, grammar: SchemaGrammar) -> tuple[DataFrame, list[SimpleType]]:
    """Assessed elements beside their rules, and the distinct simple types by number."""
    spark, rules = judged.sparkSession, grammar.rules
    kinds: list[SimpleType] = []

    def kind_of(t: SimpleType | None) -> int | None:
        if t is None:
            return None
        if t not in kinds:
            kinds.append(t)
        return kinds.index(t)

    tops: dict[int, dict[str, int]] = {}
    for n, s in enumerate(grammar.schemas):
        tops[n] = {f"{ns}}}{name}": kind_of(t) for (ns, name), t in s.global_attributes().items()}
    rows, declared = [], []
    for k, r in enumerate(rules):
        own: list[AttributeRule] = list(r.type.attributes.values())
        number = grammar.schema_of[k]
        rows.append((
            k, r.type.kind, rf"\A{r.type.pattern}\z", r.type.abstract, kind_of(r.type.simple), sorted(a.token for a in own if a.use == "required"), {a.token: kind_of(a.type) for a in own},
            {a.token: a.fixed for a in own if a.fixed is not None}, _wild_row(r.type.any_attribute), tops[number] if r.type.any_attribute and r.type.any_attribute.strictness != "skip" else {},
        ))
        named = [t for (n, _, _), t in grammar.named.items() if n == number]
        permitted = None if r.type.kind == "ANY" else [t for t in named if r.allows(rules[t].type)]
        declared.append((k, r.fixed, r.default, r.nillable, r.abstract, permitted))
    table = spark.createDataFrame(
        rows, f"rule_id int, content string, pattern string, abstract_type boolean, value_kind int, needed array<string>, attr_kinds map<string,int>, attr_fixed map<string,string>, attr_wild {_WILD}, attr_top map<string,int>"
    )
    declarations = spark.createDataFrame(declared, "declared int, fixed string, default_value string, nillable boolean, abstract_element boolean, permitted array<int>")
    elements = judged.where("kind = 'element' and not skipped").withColumn("rule_id", F.coalesce("typed", "declared"))
    bare = (F.col("sequence") == "") & (F.col("text") == "")
    met = elements.join(F.broadcast(table), "rule_id", "left").join(F.broadcast(declarations), "declared", "left").withColumn("bare", bare)
    value = F.when(F.col("bare") & F.col("default_value").isNotNull(), F.col("default_value")).otherwise(F.col("text"))
    given = F.filter(F.arrays_zip("attrs", "tokens"), lambda a: a["tokens"].isNotNull())
    # look-ups by name are made once for each attribute: its type, a wildcard that covers it, the type declared at the top, a fixed value
    look = lambda a: F.struct(a["attrs"]["name"].alias("name"), a["attrs"]["value"].alias("value"), a["tokens"].alias("token"), F.try_element_at("attr_kinds", a["tokens"]).alias("own"), F.try_element_at("attr_fixed", a["tokens"]).alias("fixed"))
    wild = F.col("attr_wild")
    covers = lambda a: F.coalesce(a["own"].isNull() & _covers(wild, F.substring_index(a["token"], "}", 1)) & wild.isNotNull(), F.lit(False))
    more = lambda a: F.struct(*[a[n].alias(n) for n in ("name", "value", "token", "own", "fixed")], covers(a).alias("covered"), F.when(a["own"].isNull(), F.try_element_at("attr_top", a["token"])).alias("top"))
    looked_up = F.transform(F.transform(given, look), more)
    none = F.array().cast("array<struct<name:string,value:string,token:string,own:int,fixed:string,covered:boolean,top:int>>")
    return met.withColumn("content_value", value).withColumn("given", F.when(F.size("attrs") > 0, F.coalesce(looked_up, none)).otherwise(none)), kinds


#: Up to so many content models are tested as literals.
MOST_LITERALS = 100

#: Attributes of the ``xml`` namespace that any element may have, with their types.
BUILT_IN = {
    "}xml:lang": SimpleType("language", "anySimpleType", members=(SimpleType("language", "language"), SimpleType("none", "string", Facets(enumeration=("",))))),
    "}xml:space": SimpleType("space", "NCName", Facets(enumeration=("default", "preserve"))),
    "}xml:base": SimpleType("anyURI", "anyURI"),
    "}xml:id": SimpleType("ID", "ID"),
}


def faults_of(met: DataFrame, grammar: SchemaGrammar, kinds: list[SimpleType]) -> Column:
    """All that is wrong with an element, its content and attributes, as one array of rules and messages."""
    c, rules = F.col, grammar.rules
    named = lambda text: F.concat(F.lit(text), c("name"))
    accepted = lambda which, value: chosen(which, {k: accepts_bound(t, value, c("scope")) for k, t in enumerate(kinds)}, F.lit(True))
    filled, own_text = ~c("nil"), ~c("text").rlike(r"\A[ \t\r\n]*\z")
    # fixed values are compared in the type's value space
    compared = {}
    for k, r in enumerate(rules):
        if r.fixed is not None and r.type.simple is not None and not r.type.simple.members and r.type.simple.item is None:
            base = r.type.simple.base
            compared[k] = canonical_value(c("text"), base) != canonical_value(F.lit(r.fixed), base)
    changed = chosen(c("declared"), compared, c("text") != c("fixed"))
    simple = filled & (c("content") == "SIMPLE")
    # patterns that are literals are compiled once; more of them than make a fair expression come from the rules' rows
    models = {k: rf"\A{r.type.pattern}\z" for k, r in enumerate(rules) if r.type.kind in ("ELEMENT", "MIXED")}
    few = len(models) <= MOST_LITERALS
    in_model = chosen(c("rule_id"), {k: c("sequence").rlike(m) for k, m in models.items()}, F.lit(True)) if few else F.rlike(c("sequence"), c("pattern"))
    of_element = [
        fault(c("xsi_type").isNotNull() & c("typed").isNull(), "type-unknown", F.concat(F.lit("no type "), c("xsi_type"), F.lit(" for "), c("name"))),
        fault(c("abstract_type") | F.coalesce("abstract_element", F.lit(False)), "element-abstract", named("abstract ")),
        fault(c("typed").isNotNull() & c("declared").isNotNull() & ~F.coalesce(F.array_contains("permitted", c("typed")), F.lit(True)), "type-blocked", F.concat(F.lit("type "), c("xsi_type"), F.lit(" may not stand in "), c("name"))),
        fault(c("nil") & ~F.coalesce("nillable", F.lit(False)), "nil-not-allowed", named("not nillable: ")),
        fault(c("nil") & ~c("bare"), "nil-content", named("content in nilled ")),
        fault(filled & (c("content") == "EMPTY") & (c("n_nodes") > 0) & ~c("bare"), "content-empty", named("content in empty element ")),
        fault(filled & c("content").isin("ELEMENT", "MIXED") & ~in_model, "content-model", named("children don't match in ")),
        fault(filled & (c("content") == "ELEMENT") & own_text, "content-text", named("text in ")),
        fault(simple & (c("sequence") != ""), "content-simple", named("children in simple ")),
        fault(simple & ~accepted(c("value_kind"), c("content_value")), "value-type", named("bad value of ")),
        fault(filled & c("fixed").isNotNull() & ~c("bare") & changed, "value-fixed", named("fixed value changed in ")),
    ]
    undeclared = fault(c("rule_id").isNull() & ~c("loose"), "element-undeclared", named("undeclared element "))
    fixed_bases = sorted({a.type.base for r in rules for a in r.type.attributes.values() if a.fixed is not None})

    def of_attribute(a: Column) -> Column:
        own, covered, fixed, unchanged = a["own"], a["covered"], a["fixed"], F.lit(True)
        shared = F.when(covered, a["top"])
        for base in fixed_bases:
            same = [k for k, t in enumerate(kinds) if t.base == base]
            unchanged = F.when(fixed.isNotNull() & own.isin(same), canonical_value(a["value"], base) == canonical_value(fixed, base)).otherwise(unchanged)
        label = F.concat(F.lit("attribute "), a["name"], F.lit(" of "), c("name"))
        return F.array(
            fault(own.isNull() & (~covered | ((c("attr_wild")["strictness"] == "strict") & shared.isNull())), "attribute-undeclared", F.concat(F.lit("undeclared "), label)),
            fault(~accepted(F.coalesce(own, shared), a["value"]), "attribute-type", F.concat(F.lit("bad value for "), label)),
            fault(~unchanged, "attribute-fixed", F.concat(F.lit("fixed value changed for "), label)),
        )

    def of_built_in(a: Column) -> Column:
        good = F.lit(True)
        for token, kind in BUILT_IN.items():
            good = F.when(a["token"] == token, kind.accepts(a["value"])).otherwise(good)
        return F.array(fault(~good, "attribute-type", F.concat(F.lit("bad value for attribute "), a["name"], F.lit(" of "), c("name"))))

    undeclared_xml = lambda a: a["name"].startswith("xml:") & a["own"].isNull()
    built_in = F.flatten(F.transform(F.filter("given", undeclared_xml), of_built_in))
    checked = F.filter("given", lambda a: (c("content") != "ANY") & ~undeclared_xml(a))
    lacking = F.array_except("needed", F.transform("given", lambda a: a["token"]))
    missing = F.transform(lacking, lambda n: F.struct(F.lit("attribute-required").alias("rule"), F.concat(F.lit("missing attribute "), F.regexp_extract(n, r"\A[^}]*\}(.*)\z", 1), F.lit(" of "), c("name")).alias("message")))
    return F.when(c("rule_id").isNotNull(), F.concat(F.array(*of_element), F.flatten(F.transform(checked, of_attribute)), built_in, missing)).otherwise(F.array(undeclared, of_element[0]))


def id_violations(met: DataFrame, kinds: list[SimpleType]) -> list[DataFrame]:
    """IDs that repeat in a document, and references to none; both by type, in elements and attributes."""
    ways = {k: t for k, t in enumerate(kinds) if t.has_base(("ID", "IDREF", "IDREFS"))}
    roles = lambda which, value: chosen(which, {k: id_roles(t, value) for k, t in ways.items()}, F.array().cast("array<struct<role:string,value:string>>"))
    of_element = F.when((F.col("content") == "SIMPLE") & ~F.col("nil"), roles(F.col("value_kind"), F.col("content_value")))
    which = lambda a: F.coalesce(a["own"], a["top"])
    own = lambda a: F.when(which(a).isNull() & (a["token"] == "}xml:id"), id_roles(BUILT_IN["}xml:id"], a["value"])).otherwise(roles(which(a), a["value"]))
    of_attributes = F.flatten(F.transform("given", own))
    empty = F.array().cast("array<struct<role:string,value:string>>")
    held = F.concat(F.coalesce(of_element, empty), F.coalesce(of_attributes, empty))
    found = stored(met.where(F.col("rule_id").isNotNull()).select("doc_id", "pre", F.inline(held)))
    ids, refs = found.where("role = 'ID'").select("doc_id", "pre", "value"), found.where("role = 'IDREF'").select("doc_id", "pre", "value")
    twice = ids.join(duplicate_ids(ids), ["doc_id", "value"])
    return [
        violation(twice, "id-repeated", F.concat(F.lit("repeated ID "), F.col("value"))),
        violation(dangling_references(refs, ids), "idref-dangling", F.concat(F.lit("no ID "), F.col("value"))),
    ]


def identity_violations(nodes: DataFrame, judged: DataFrame, grammar: SchemaGrammar) -> list[DataFrame]:
    """Broken ``unique``, ``key`` and ``keyref``; scopes are the elements of the declaring rule, not all of its name.

    A keyref finds keys of its own element and those that rise from scopes further below.
    """
    scopes_of: dict[int, list[int]] = {}  # places of one rule: it may stand in several types
    rule_at = {}
    for k, r in enumerate(grammar.rules):
        if r.constraints and grammar.places[k].context != "(type)":
            scopes_of.setdefault(id(r), []).append(k)
            rule_at[id(r)] = (r, grammar.schema_of[k])
    found: dict[tuple[int, str], DataFrame] = {}
    starts: dict[tuple[int, str], DataFrame] = {}
    for key, places in scopes_of.items():
        rule, schema = rule_at[key]
        known = judged.where((F.col("kind") == "element") & F.col("declared").isin(places)).select("doc_id", "pre")
        scopes = nodes.join(known, ["doc_id", "pre"]) if judged is not nodes else nodes.where((F.col("kind") == "element") & F.col("declared").isin(places))
        for _, name, selector, fields, _ in rule.constraints:
            rows = tuples(scopes, nodes, selector, fields)
            at = scopes.select("doc_id", "pre", "post")
            found[schema, name] = found[schema, name].union(rows) if (schema, name) in found else rows
            starts[schema, name] = starts[schema, name].union(at) if (schema, name) in starts else at
    out = []
    done = set()
    for key in scopes_of:
        rule, schema = rule_at[key]
        for kind, name, _, _, refer in rule.constraints:
            if (schema, name) in done:
                continue
            done.add((schema, name))
            own = found[schema, name]
            if kind == "keyref":
                if (schema, refer) in found:
                    keys = found[schema, refer]
                    if starts[schema, refer] is not starts[schema, name]:
                        keys = keys.unionByName(rising(starts[schema, name], own, starts[schema, refer], keys), allowMissingColumns=True)
                    out.append(violation(unmatched(own, keys), "keyref", F.lit(f"no key {refer} for {name}")))
                continue
            at_scope = repeated(own).withColumn("pre", F.col("anc_pre"))
            out.append(violation(at_scope, kind, F.lit(f"repeated value of {name}")))
            if kind == "key":
                out.append(violation(incomplete(own), "key-field", F.lit(f"missing field of {name}")))
    return out


def instance_attribute(name: str) -> Column:
    """Value of an attribute of the instance namespace: any prefix that the element itself doesn't bind to another one."""
    bound = lambda prefix: F.get(F.filter("attrs", lambda x: x["name"] == F.concat(F.lit("xmlns:"), prefix)), F.lit(0))["value"]
    found = F.filter("attrs", lambda a: a["name"].endswith(f":{name}") & (F.coalesce(bound(prefix_of(a["name"])), F.lit(XSI)) == XSI))
    return F.get(found, F.lit(0))["value"]


def schema_locations(nodes: DataFrame) -> DataFrame:
    """``doc_id, ns, location`` from ``schemaLocation`` and ``noNamespaceSchemaLocation`` of the instance namespace."""
    el = nodes.where("kind = 'element' and size(attrs) > 0")
    words = list_items(instance_attribute("schemaLocation"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / 2).cast("int") - 1), lambda k: F.struct(F.get(words, (k * 2).cast("int")).alias("ns"), F.get(words, (k * 2 + 1).cast("int")).alias("location")))
    given = el.where(F.size(words) >= 2).select("doc_id", F.inline(pairs))
    plain = el.select("doc_id", F.lit(""), instance_attribute("noNamespaceSchemaLocation").alias("location")).where("location is not null")
    return given.union(plain).distinct()


def violations_by_location(
    nodes: DataFrame, read: Callable[[str], str], most: int = 1000, bases: DataFrame | None = None, locate: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Each document judged by the schemas that it names itself, all documents in one pass.

    A document's locations together are one schema, so elements of several namespaces may
    each have their own.  Relative locations are taken from the document's own place, if
    ``bases`` (``doc_id, base``) gives it.  ``locate`` may put a catalog's answers in:
    it gets the distinct ``ns, location`` and adds ``place``, null where it knows none.
    ``read`` gives the text of a schema by its place and raises ``KeyError`` or ``OSError``
    where there is none: the violation is ``schema-missing`` for the documents that name it.

    Each combination of places is compiled once on the driver, however many documents name
    it; more than ``most`` combinations are refused.  Rules of all schemas are one table,
    and the elements are assessed in one pass.  Documents that name no schema get no row.
    """
    spark = nodes.sparkSession
    named = schema_locations(nodes)
    if bases is not None:
        folder = F.regexp_replace("base", "[^/]*$", "")
        relative = ~F.col("location").rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)") & F.col("base").isNotNull()
        named = named.join(bases, "doc_id", "left").withColumn("location", F.when(relative, F.concat(folder, "location")).otherwise(F.col("location")))
    named = stored(named.select("doc_id", "ns", "location"))
    if locate is not None:
        answers = locate(named.select("ns", "location").distinct())
        named = named.join(answers, ["ns", "location"], "left").withColumn("location", F.coalesce("place", "location"))
    keyed = stored(named.groupBy("doc_id").agg(F.sort_array(F.collect_set("location")).alias("places")))
    combinations = [tuple(r["places"]) for r in keyed.select("places").distinct().limit(most + 1).collect()]
    if len(combinations) > most:
        raise ValueError(f"more than {most} combinations of schema locations")
    schemas, numbers, lost = [], [], []
    for places in sorted(combinations):
        try:
            schemas.append(Schema([posixpath.normpath(p) if "://" not in p else p for p in places], read))
            numbers.append((list(places), len(schemas) - 1))
        except (KeyError, OSError):
            lost.append((list(places),))
    grammar = SchemaGrammar(schemas)
    numbered = keyed.join(F.broadcast(spark.createDataFrame(numbers, "places array<string>, number int")), "places").select("doc_id", "number")
    missing = keyed.join(F.broadcast(spark.createDataFrame(lost, "places array<string>")), "places").select(
        "doc_id", F.lit(0).alias("pre"), F.lit("schema-missing").alias("rule"), F.concat(F.lit("no schema at "), F.array_join("places", ", ")).alias("message")
    )
    return xsd_violations(nodes.join(numbered, "doc_id"), grammar, "number").union(missing) if schemas else missing

"""XML Schema documents compiled on the driver.

The result is a table of element rules (one for each name in its context), tables of
attributes and identity constraints, and simple types that become Catalyst expressions.
Content models become patterns over child tokens ``uri}local ``; ``xs:all`` too, by
lookaheads.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import datatypes as dt
from ..operators.json import Node, build_tree
from . import wildcards as wild

XS = "http://www.w3.org/2001/XMLSchema"
_FACETS = {"minInclusive": "min_inclusive", "maxInclusive": "max_inclusive", "minExclusive": "min_exclusive", "maxExclusive": "max_exclusive"}
_COUNTS = {"length": "length", "minLength": "min_length", "maxLength": "max_length", "totalDigits": "total_digits", "fractionDigits": "fraction_digits"}
Name = tuple[str, str]  # namespace, local name


@dataclass(frozen=True)
class SimpleType:
    """``base`` is a built-in name; a list has an item type, a union members."""

    name: str
    base: str = "string"
    facets: dt.Facets = field(default_factory=dt.Facets)
    item: SimpleType | None = None
    members: tuple[SimpleType, ...] = ()
    parent: SimpleType | None = field(default=None, repr=False, compare=False)

    def has_base(self, names: Collection[str]) -> bool:
        """Whether values, items or some member's values are of one of these built-in types."""
        return self.base in names or bool(self.item and self.item.has_base(names)) or any(m.has_base(names) for m in self.members)

    def derives_from(self, base: SimpleType) -> bool:
        """Whether the type is ``base``, a restriction of it, or of a member of it."""
        at: SimpleType | None = self
        while at is not None:
            if at == base or any(at.derives_from(m) for m in base.members):
                return True
            at = at.parent
        plain = base == SimpleType(base.name, base.name)
        built_in = self.base
        while plain and built_in is not None:
            if built_in == base.name or base.name == "anySimpleType":
                return True
            built_in = dt.DERIVED_FROM.get(built_in)
        return False

    def accepts(self, value: Column) -> Column:
        """Whether a text is of the type."""
        v = value if self.members else dt.with_space_rule(value, "NMTOKENS" if self.item else self.base, self.facets.white_space)
        if self.members:
            out = F.lit(False)
            for m in self.members:
                out = out | m.accepts(value)
        elif self.item:
            out = F.forall(dt.list_items(v), self.item.accepts)
        else:
            out = dt.is_valid(v, self.base)
        return out & dt.satisfies(v, replace(self.facets, white_space=None, is_list=self.item is not None), self.base)

    def member_of(self, value: Column) -> Column:
        """Name of the first union member that accepts a text."""
        return F.coalesce(*[F.when(m.accepts(value), F.lit(m.name)) for m in self.members])


@dataclass(frozen=True)
class AttributeRule:
    name: str
    type: SimpleType
    use: str = "optional"
    default: str | None = None
    fixed: str | None = None
    ns: str = ""

    @property
    def token(self) -> str:
        return f"{self.ns}}}{self.name}"


class Wildcard(NamedTuple):
    """The namespaces that a wildcard covers, and how strictly it has them checked."""

    covers: wild.Constraint
    strictness: str = "strict"


ANYTHING = Wildcard(("any",), "lax")


@dataclass
class ComplexType:
    name: str
    kind: str = "ELEMENT"  # EMPTY, ANY, MIXED, ELEMENT or SIMPLE
    pattern: str = ""
    simple: SimpleType | None = None
    attributes: dict[str, AttributeRule] = field(default_factory=dict)
    any_attribute: Wildcard | None = None
    base: str | None = None
    method: str | None = None
    abstract: bool = False
    children: list[ElementRule] = field(default_factory=list)
    references: list[Name] = field(default_factory=list)  # global elements that the model names
    wildcards: list[Wildcard] = field(default_factory=list)  # in the order of the model
    block: frozenset[str] = frozenset()
    parent: ComplexType | SimpleType | None = field(default=None, repr=False, compare=False)

    def steps_from(self, base: ComplexType) -> list[str] | None:
        """Methods by which the type derives from ``base``, none for itself; None where it doesn't."""
        at, methods = self, []
        while at is not base:
            simple = at if isinstance(at, SimpleType) else at.simple if at.parent is None else None
            if simple is not None:
                if base.simple is None or base.parent is not None or not simple.derives_from(base.simple):
                    return None
                return methods if simple == base.simple else [*methods, "restriction"]
            if at.parent is None:
                return None
            methods.append(at.method)
            at = at.parent
        return methods


@dataclass
class ElementRule:
    context: str  # name of the enclosing element, "" for a global declaration
    ns: str
    name: str
    type: ComplexType
    default: str | None = None
    fixed: str | None = None
    nillable: bool = False
    abstract: bool = False
    constraints: list[tuple[str, str, str, tuple[str, ...], str | None]] = field(default_factory=list)  # kind, name, selector, fields, refer
    head: Name | None = None
    block: frozenset[str] = frozenset()

    def allows(self, kind: ComplexType) -> bool:
        """Whether an instance may name ``kind`` by xsi:type: derived from the declared type, by no blocked method."""
        if self.type.kind == "ANY":
            return True
        steps = kind.steps_from(self.type)
        return steps is not None and not (self.block | self.type.block).intersection(steps)


def _attr(e: Node, name: str, default: str | None = None) -> str | None:
    return next((v for k, v in e.attrs if k == name), default)


def _kids(e: Node, *names: str) -> list[Node]:
    return [c for c in e.content if c.kind == "element" and (not names or c.name.split(":")[-1] in names)]


def _token(ns: str, local: str) -> str:
    return f"\\Q{ns}}}{local} \\E"


def occurs(e: Node) -> str:
    low, high = int(_attr(e, "minOccurs", "1")), _attr(e, "maxOccurs", "1")
    if high == "unbounded":
        return {0: "*", 1: "+"}.get(low, f"{{{low},}}")
    return {(0, 1): "?", (1, 1): ""}.get((low, int(high)), f"{{{low},{high}}}")


def wildcard(tokens: str, target: str) -> str:
    """A wildcard's namespace list as a pattern for one child token."""
    if tokens == "##any":
        return "(?:[^} ]*}[^ ]+ )"
    if tokens == "##other":
        return f"(?:(?!\\Q{target}}}\\E)[^}} ]+}}[^ ]+ )"
    ways = [{"##local": "", "##targetNamespace": target}.get(t, t) for t in tokens.split()]
    return "(?:(?:" + "|".join(f"\\Q{w}\\E" for w in ways) + ")}[^ ]+ )"


def wildcard_allows(tokens: str, ns: Column, target: str) -> Column:
    """Whether a wildcard covers a namespace."""
    if tokens == "##any":
        return F.lit(True)
    if tokens == "##other":
        return ~ns.isin("", target)
    return ns.isin([{"##local": "", "##targetNamespace": target}.get(t, t) for t in tokens.split()])


class Schema:
    """A compiled schema; ``read`` gives the text of a schema document by its path.

    Several paths are read as one schema, as where an instance names one for each namespace.
    """

    def __init__(self, path: str | Sequence[str], read: Callable[[str], str]):
        self.read, self.documents = read, {}
        self.parts: dict[str, dict[Name, tuple[Node, Doc]]] = {k: {} for k in ("element", "complexType", "simpleType", "attribute", "group", "attributeGroup", "notation")}
        self.types: dict[Name, ComplexType | SimpleType] = {}
        for p in [path] if isinstance(path, str) else path:
            self._load(p, None)
        self.globals = {name: self._element(node, doc, "") for name, (node, doc) in self.parts["element"].items()}
        self._substitute()

    def merged(self, other: Schema) -> Schema:
        """Both schemas in one: of two components of one kind and name the first's holds, of elements the other's."""
        out = Schema.__new__(Schema)
        out.read, out.documents, out.types = self.read, self.documents | other.documents, {}
        out.parts = {kind: (own | other.parts[kind] if kind == "element" else other.parts[kind] | own) for kind, own in self.parts.items()}
        out.globals = {name: out._element(node, doc, "") for name, (node, doc) in out.parts["element"].items()}
        out._substitute()
        return out

    # -- documents

    def _load(self, path: str, including: str | None) -> None:
        if (path, including) in self.documents:
            return
        root = next(n for n in build_tree(self.read(path)) if n.kind == "element")
        doc = Doc(path, _attr(root, "targetNamespace") or including or "", {k[6:]: v for k, v in root.attrs if k == "xmlns" or k.startswith("xmlns:")}, _attr(root, "elementFormDefault") == "qualified", root, _attr(root, "attributeFormDefault") == "qualified")
        self.documents[path, including] = doc
        for e in _kids(root, "include", "import", "redefine"):
            location = _attr(e, "schemaLocation")
            if location:
                kind = e.name.split(":")[-1]
                self._load(posixpath.normpath(posixpath.join(posixpath.dirname(path), location)), None if kind == "import" else doc.target)
                if kind == "redefine":
                    for part in _kids(e):
                        self._redefine(part, doc)
        for e in _kids(root):
            table = self.parts.get(e.name.split(":")[-1])
            if table is not None and _attr(e, "name"):
                table.setdefault((doc.target, _attr(e, "name")), (e, doc))

    def _redefine(self, e: Node, doc: Doc) -> None:
        table = self.parts.get(e.name.split(":")[-1])
        if table is None:
            return
        name = (doc.target, _attr(e, "name"))
        if name in table:  # the redefined type refers to the original by its own name
            table[doc.target, f"{name[1]}#original"] = table[name]
            for d in _kids(e) + [x for c in _kids(e) for x in _kids(c)]:
                d.attrs = [(k, v + "#original" if k == "base" and v.split(":")[-1] == name[1] else v) for k, v in d.attrs]
        table[name] = (e, doc)

    # -- types

    def _find(self, kind: str, name: Name) -> tuple[Node, Doc]:
        table = self.parts[kind]
        if name in table:
            return table[name]
        raise ValueError(f"undeclared {kind} {name[1]}")

    def type(self, name: Name) -> ComplexType | SimpleType:
        if name[0] == XS:
            return ComplexType("anyType", "ANY", any_attribute=ANYTHING, wildcards=[ANYTHING]) if name[1] == "anyType" else SimpleType(name[1], name[1])
        if name not in self.types:
            kind = "complexType" if name in self.parts["complexType"] else "simpleType"
            node, doc = self._find(kind, name)
            if kind == "simpleType":
                self.types[name] = self._simple(node, doc)
            else:
                self.types[name] = ComplexType(name[1])  # may be recursive
                self._complex(node, doc, self.types[name])
        return self.types[name]

    def _simple(self, e: Node, doc: Doc) -> SimpleType:
        name = _attr(e, "name") or ""
        for d in _kids(e, "restriction", "list", "union"):
            kind, inner = d.name.split(":")[-1], [self._simple(s, doc) for s in _kids(d, "simpleType")]
            if kind == "list":
                item = inner[0] if inner else self.type(doc.qname(_attr(d, "itemType")))
                return SimpleType(name, "anySimpleType", item=item)
            if kind == "union":
                named = [self.type(doc.qname(q)) for q in (_attr(d, "memberTypes") or "").split()]
                return SimpleType(name, "anySimpleType", members=(*named, *inner))
            base = inner[0] if inner else self.type(doc.qname(_attr(d, "base")))
            return self._restricted(name, base, d)
        raise ValueError(f"simple type {name} without a derivation")

    def _restricted(self, name: str, base: SimpleType, d: Node) -> SimpleType:
        """Facets of the base hold on; patterns of a step are alternatives to each other."""
        changes: dict = {}
        values = [_attr(c, "value") for c in _kids(d, "enumeration")]
        if values:
            changes["enumeration"] = tuple(values)
        patterns = [_attr(c, "value") for c in _kids(d, "pattern")]
        if patterns:
            changes["patterns"] = [*base.facets.patterns, patterns]
        for c in _kids(d):
            kind = c.name.split(":")[-1]
            if kind in _FACETS:
                changes[_FACETS[kind]] = _attr(c, "value")
            elif kind in _COUNTS:
                changes[_COUNTS[kind]] = int(_attr(c, "value"))
            elif kind == "whiteSpace":
                changes["white_space"] = _attr(c, "value")
        return replace(base, name=name, facets=replace(base.facets, **changes), parent=base)

    def _complex(self, e: Node, doc: Doc, out: ComplexType) -> None:
        mixed = _attr(e, "mixed") == "true"
        out.abstract = _attr(e, "abstract") == "true"
        out.block = doc.blocked(e)
        simple, whole = _kids(e, "simpleContent"), _kids(e, "complexContent")
        own = e
        prefix = ""
        if simple or whole:
            content = (simple or whole)[0]
            mixed = mixed or _attr(content, "mixed") == "true"
            own = _kids(content, "restriction", "extension")[0]
            out.method = own.name.split(":")[-1]
            base_name = doc.qname(_attr(own, "base"))
            base, out.base = self.type(base_name), base_name[1]
            out.parent = base
            if simple:
                out.kind = "SIMPLE"
                value = base if isinstance(base, SimpleType) else base.simple
                inner = _kids(own, "simpleType")
                value = self._simple(inner[0], doc) if inner else value
                out.simple = self._restricted(base_name[1], value, own) if out.method == "restriction" else value
            if isinstance(base, ComplexType):
                out.attributes |= base.attributes
                if out.method == "extension":
                    prefix, out.children = base.pattern, [*base.children]
                    out.references, out.wildcards = [*base.references], [*base.wildcards]
                    mixed = mixed or base.kind == "MIXED"
        self._attributes(own, doc, out)
        if out.method == "extension" and isinstance(base, ComplexType) and base.any_attribute:
            other = out.any_attribute
            out.any_attribute = Wildcard(wild.union(base.any_attribute.covers, other.covers), wild.laxer(base.any_attribute.strictness, other.strictness)) if other else base.any_attribute
        if out.kind != "SIMPLE":
            out.pattern = prefix + "".join(self._particle(p, doc, out) for p in _kids(own, "sequence", "choice", "all", "group"))
            out.kind = "MIXED" if mixed else "ELEMENT" if out.pattern else "EMPTY"

    def _attributes(self, e: Node, doc: Doc, out: ComplexType) -> None:
        for a in _kids(e, "attribute"):
            ref = _attr(a, "ref")
            node, where = (a, doc) if ref is None else (None, None)
            ns = doc.target if ref is None and _attr(a, "form", "qualified" if doc.attributes_qualified else "unqualified") == "qualified" else ""
            if ref is not None and ref.startswith("xml:"):
                name, kind, node = ref, SimpleType("string", "string"), a
            else:
                if ref is not None:
                    node, where = self._find("attribute", doc.qname(ref))
                    ns = where.target
                name, inner = _attr(node, "name"), _kids(node, "simpleType")
                given = _attr(node, "type")
                kind = self._simple(inner[0], where) if inner else self.type(where.qname(given)) if given else SimpleType("anySimpleType", "anySimpleType")
            use = _attr(a, "use", "optional")
            if use == "prohibited":
                out.attributes.pop(name, None)
            else:
                out.attributes[name] = AttributeRule(name, kind, use, _attr(a, "default", _attr(node, "default")), _attr(a, "fixed", _attr(node, "fixed")), ns)
        for g in _kids(e, "attributeGroup"):
            node, where = self._find("attributeGroup", doc.qname(_attr(g, "ref")))
            self._attributes(node, where, out)
        for w in _kids(e, "anyAttribute"):
            own, other = self._wildcard(w, doc), out.any_attribute
            out.any_attribute = Wildcard(wild.intersection(own.covers, other.covers), wild.stricter(own.strictness, other.strictness)) if other else own

    @staticmethod
    def _wildcard(e: Node, doc: Doc) -> Wildcard:
        return Wildcard(wild.parse(_attr(e, "namespace", "##any"), doc.target), _attr(e, "processContents", "strict"))

    def global_attributes(self) -> dict[Name, SimpleType]:
        """Types of the attributes declared at the top, which wildcards look up."""
        out = {}
        for name, (node, doc) in self.parts["attribute"].items():
            inner, given = _kids(node, "simpleType"), _attr(node, "type")
            out[name] = self._simple(inner[0], doc) if inner else self.type(doc.qname(given)) if given else SimpleType("anySimpleType", "anySimpleType")
        return out

    # -- particles

    def _particle(self, e: Node, doc: Doc, owner: ComplexType) -> str:
        kind = e.name.split(":")[-1]
        if _attr(e, "maxOccurs") == "0":
            return ""
        if kind == "element":
            ref = _attr(e, "ref")
            if ref is not None:
                ns, local = doc.qname(ref)
                owner.references.append((ns, local))
                return f"(?:@{ns}}}{local}@){occurs(e)}"  # its substitutes are put in later
            rule = self._element(e, doc, "?")
            owner.children.append(rule)
            return f"(?:{_token(rule.ns, rule.name)}){occurs(e)}"
        if kind == "any":
            owner.wildcards.append(self._wildcard(e, doc))
            return wildcard(_attr(e, "namespace", "##any"), doc.target) + occurs(e)
        if kind == "group":
            node, where = self._find("group", doc.qname(_attr(e, "ref")))
            return "(?:" + "".join(self._particle(p, where, owner) for p in _kids(node, "sequence", "choice", "all")) + ")" + occurs(e)
        parts = [p for p in (self._particle(c, doc, owner) for c in _kids(e, "element", "any", "group", "sequence", "choice", "all")) if p]
        if kind == "all":
            once = [re.sub(r"[?]\Z", "", p) for p in parts]
            needed = "".join(f"(?=(?:[^ ]+ )*?{p})" for p in parts if not p.endswith("?"))
            never_twice = "".join(f"(?!(?:[^ ]+ )*?{p}(?:[^ ]+ )*?{p})" for p in once)
            return f"(?:{needed}{never_twice}(?:{'|'.join(once) or '(?!)'})*){'?' if _attr(e, 'minOccurs') == '0' else ''}"
        return "(?:" + ("|" if kind == "choice" else "").join(parts) + ")" + occurs(e) if parts else ""

    def _element(self, e: Node, doc: Doc, context: str) -> ElementRule:
        given = _attr(e, "type")
        if given:
            kind = self.type(doc.qname(given))
        elif inner := _kids(e, "complexType"):
            kind = ComplexType(_attr(e, "name"))
            self._complex(inner[0], doc, kind)
        elif inner := _kids(e, "simpleType"):
            kind = self._simple(inner[0], doc)
        elif context == "" and _attr(e, "substitutionGroup"):
            head = doc.qname(_attr(e, "substitutionGroup"))
            node, where = self._find("element", head)
            kind = self._element(node, where, "").type
        else:
            kind = self.type((XS, "anyType"))
        kind = wrapped(kind)
        qualified = context == "" or _attr(e, "form", "qualified" if doc.qualified else "unqualified") == "qualified"
        constraints = [
            (c.name.split(":")[-1], _attr(c, "name"), _attr(_kids(c, "selector")[0], "xpath"), tuple(_attr(f, "xpath") for f in _kids(c, "field")), (_attr(c, "refer") or "").split(":")[-1] or None)
            for c in _kids(e, "unique", "key", "keyref")
        ]
        head = _attr(e, "substitutionGroup")
        return ElementRule(context, doc.target if qualified else "", _attr(e, "name"), kind, _attr(e, "default"), _attr(e, "fixed"), _attr(e, "nillable") == "true", _attr(e, "abstract") == "true", constraints, doc.qname(head) if head else None, doc.blocked(e))

    def members(self, head: Name) -> list[Name]:
        """Elements that may stand for ``head``, itself first, over any number of steps; abstract ones aside."""
        found, edge = [head], [head]
        while edge:
            edge = [n for n, r in self.globals.items() if r.head in edge and n not in found]
            found += edge
        return [n for n in found if n in self.globals and not self.globals[n].abstract and self._may_stand(n, head)]

    def _may_stand(self, name: Name, head: Name) -> bool:
        """Whether the head's ``block`` lets an element stand for it."""
        if name == head or head not in self.globals:
            return True
        rule = self.globals[head]
        steps = self.globals[name].type.steps_from(rule.type) or []
        return "substitution" not in rule.block and not (rule.block | rule.type.block).intersection(steps)

    def _substitute(self) -> None:
        def put(m: re.Match) -> str:
            return "(?:" + "|".join(_token(*n) for n in self.members((m[1], m[2]))) + ")" if self.members((m[1], m[2])) else "(?!)"

        for kind in self._all_types():
            kind.pattern = re.sub(r"\(\?:@([^}@]*)\}([^@]+)@\)", put, kind.pattern)

    def _all_types(self) -> list[ComplexType]:
        found: list[ComplexType] = []
        edge = [r.type for r in self.globals.values()] + [t for t in self.types.values() if isinstance(t, ComplexType)]
        while edge:
            fresh = [t for k, t in enumerate(edge) if all(t is not f for f in found) and all(t is not s for s in edge[:k])]
            found += fresh
            edge = [r.type for t in fresh for r in t.children]
        return found

    # -- results

    def elements(self) -> list[ElementRule]:
        """Rules for each element in the context of its parent's name; global ones have the context "".

        A named complex type has a rule of its own (context "(type)"), and its children have
        the type's name in parentheses as a context, for elements that name it by xsi:type.
        """
        types = [t for t in (self.type(n) for n in self.parts["complexType"] if "#" not in n[1]) if isinstance(t, ComplexType)]
        out, seen = [*self.globals.values(), *(ElementRule("(type)", "", t.name, t) for t in types)], []
        edge = [(r.name, r.type) for r in self.globals.values()] + [(f"({t.name})", t) for t in types]
        while edge:
            (parent, kind), edge = edge[0], edge[1:]
            if any(kind is k and parent == p for p, k in seen):
                continue
            seen.append((parent, kind))
            for r in kind.children:
                if not any(o.context == parent and (o.ns, o.name) == (r.ns, r.name) for o in out):
                    out.append(replace(r, context=parent))
                edge.append((r.name, r.type))
        return out

    def places(self) -> list[Place]:
        """Rules for each element in the context of its parent's type, whatever the parent's name.

        Contexts are ``#0``, ``#1`` ... for the types met; "" for global elements and
        "(type)" for the named types, simple ones included, by namespace and name.
        """
        kinds: list[ComplexType] = []

        def key(kind: ComplexType) -> str:
            known = next((n for n, k in enumerate(kinds) if k is kind), len(kinds))
            if known == len(kinds):
                kinds.append(kind)
            return f"#{known}"

        names = [n for part in ("complexType", "simpleType") for n in self.parts[part] if "#" not in n[1]]
        tops = [*self.globals.values(), *(ElementRule("(type)", *n, wrapped(self.type(n))) for n in dict.fromkeys(names))]
        out = [Place(r.context, key(r.type), r) for r in tops]
        done = 0
        while done < len(kinds):
            inside: dict[Name, Place] = {}
            for r in kinds[done].children:
                inside.setdefault((r.ns, r.name), Place(f"#{done}", key(r.type), r))
            out += inside.values()
            done += 1
        return out

    def derivation(self) -> list[tuple[str, str, str]]:
        """``type, base, method`` of all named complex types with a base."""
        return [(t.name, t.base, t.method) for t in (self.type(n) for n in self.parts["complexType"]) if t.base]

    def attribute_defaults(self) -> dict[tuple[str | None, str, str], str]:
        """(namespace, element, attribute) to the default or fixed value."""
        out: dict[tuple[str | None, str, str], str] = {}
        for r in self.elements():
            for a in r.type.attributes.values():
                value = a.default if a.default is not None else a.fixed
                if value is not None:
                    out.setdefault((r.ns, r.name, a.name), value)
        return out


def wrapped(kind: ComplexType | SimpleType) -> ComplexType:
    """A simple type as the type of an element."""
    return ComplexType(kind.name, "SIMPLE", simple=kind) if isinstance(kind, SimpleType) else kind


class Place(NamedTuple):
    """A rule, the type that it stands in and the type of its element."""

    context: str
    own: str
    rule: ElementRule


@dataclass
class Doc:
    path: str
    target: str
    spaces: dict[str, str]
    qualified: bool
    root: Node
    attributes_qualified: bool = False

    def blocked(self, e: Node) -> frozenset[str]:
        """Methods that an element or type shuts out, by itself or by the document's default."""
        words = frozenset((_attr(e, "block", _attr(self.root, "blockDefault", "")) or "").split())
        return frozenset(("extension", "restriction", "substitution")) if "#all" in words else words

    def qname(self, name: str) -> Name:
        prefix, _, local = name.rpartition(":")
        return (self.spaces.get(prefix, self.spaces.get(f":{prefix}", "")), local)

    def __post_init__(self):
        self.spaces = {k.removeprefix(":"): v for k, v in self.spaces.items()}


def compile_schema(path: str, sources: Mapping[str, str]) -> Schema:
    """Compile from texts by path."""
    return Schema(path, lambda p: sources[p])

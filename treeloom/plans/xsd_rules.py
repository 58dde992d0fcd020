"""Rules for schema documents: each check yields (rule, message) pairs; an empty list means none is broken."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

from ..functions.patterns import PatternError, translate
from ..operators.json import Node, build_tree
from .xsd import Doc, _attr, _kids

XS = "http://www.w3.org/2001/XMLSchema"
NCNAME = re.compile(r"[^\W\d][\w.\-·]*\Z")
Found = Iterator[tuple[str, str]]
_TOP = ("element", "complexType", "simpleType", "attribute", "group", "attributeGroup", "notation")
_ORDER = ("minInclusive", "minExclusive", "maxInclusive", "maxExclusive")
_COUNTS = ("length", "minLength", "maxLength", "totalDigits", "fractionDigits")
_FACETS = (*_ORDER, *_COUNTS, "enumeration", "pattern", "whiteSpace")
_PARTICLES = ("sequence", "choice", "all")


def local(e: Node) -> str:
    return e.name.split(":")[-1]


def walk(e: Node, parent: Node | None = None) -> Iterator[tuple[Node, Node | None]]:
    """Elements below with their parents, document order; annotations' content aside."""
    yield e, parent
    if local(e) not in ("appinfo", "documentation"):
        for c in _kids(e):
            yield from walk(c, e)


def number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


class Document:
    """A parsed schema document with its top-level components by kind and name."""

    def __init__(self, text: str):
        self.root = next(n for n in build_tree(text) if n.kind == "element")
        spaces = {k[6:]: v for k, v in self.root.attrs if k == "xmlns" or k.startswith("xmlns:")}
        self.doc = Doc("", _attr(self.root, "targetNamespace") or "", spaces, False, self.root)
        self.all = list(walk(self.root))
        self.top = {k: {_attr(e, "name"): e for e in _kids(self.root, k) if _attr(e, "name")} for k in _TOP}
        for r in _kids(self.root, "redefine"):
            for e in _kids(r):
                if local(e) in self.top and _attr(e, "name"):
                    self.top[local(e)].setdefault(_attr(e, "name"), e)
        self.open = any(local(e) in ("import", "include", "redefine") for e in _kids(self.root))

    def knows(self, name: str, *kinds: str) -> bool:
        """Whether a reference leads somewhere, as far as this document can tell."""
        ns, own = self.doc.qname(name)
        if ns == XS:
            return True
        return self.open or ns != self.doc.target or any(own in self.top[k] for k in kinds)

    def own(self, name: str | None, *kinds: str) -> Node | None:
        if name is None or self.doc.qname(name)[0] != self.doc.target:
            return None
        return next((self.top[k][name.split(":")[-1]] for k in kinds if name.split(":")[-1] in self.top[k]), None)


def derivation(e: Node) -> Node | None:
    """The restriction or extension of a type."""
    inner = [e, *_kids(e, "simpleContent", "complexContent")]
    return next((d for i in inner for d in _kids(i, "restriction", "extension")), None)


def names(d: Document) -> Found:
    for kind in _TOP:
        for e in _kids(d.root, kind):
            if not NCNAME.match(_attr(e, "name") or ""):
                yield "SEM-01", f"top-level {kind} needs a name"


def notations(d: Document) -> Found:
    for e in _kids(d.root, "notation"):
        if _attr(e, "public") is None and _attr(e, "system") is None:
            yield "SEM-02", "notation without an identifier"
    for n, c in Counter(_attr(e, "name") for e in _kids(d.root, "notation")).items():
        if c > 1:
            yield "SEM-02", f"notation {n} twice"
    for e, parent in d.all:
        if local(e) == "notation" and parent is not d.root:
            yield "SEM-03", "notation below the top"
        if local(e) == "restriction" and d.doc.qname(_attr(e, "base") or "") == (XS, "NOTATION"):
            values = [_attr(v, "value") for v in _kids(e, "enumeration")]
            if not values or any(v.split(":")[-1] not in d.top["notation"] for v in values):
                yield "SEM-04", "NOTATION without declared enumeration"


def ids(d: Document) -> Found:
    seen: Counter = Counter()
    for e, _ in d.all:
        own = _attr(e, "id")
        if own is not None:
            seen[own] += 1
            if not NCNAME.match(own):
                yield "SEM-05", f"id {own}"
    for own, n in seen.items():
        if n > 1:
            yield "SEM-08", f"id {own} twice"


def annotations(d: Document) -> Found:
    for e, _ in d.all:
        notes = _kids(e, "annotation")
        if local(e) in ("schema", "redefine"):
            pass
        elif len(notes) > 1 or notes and _kids(e)[0] is not notes[0]:
            yield "SEM-06", f"annotation in {local(e)}"
        if local(e) == "annotation" and any(local(c) not in ("appinfo", "documentation") for c in _kids(e)):
            yield "SEM-06", "content of annotation"


def imports(d: Document) -> Found:
    for e in _kids(d.root, "include", "redefine"):
        if not _attr(e, "schemaLocation") or local(e) == "include" and any(local(c) != "annotation" for c in _kids(e)):
            yield "SEM-07", local(e)
    spaces = [_attr(e, "namespace") or "" for e in _kids(d.root, "import")]
    for ns, n in Counter(spaces).items():
        if ns == d.doc.target or n > 1:
            yield "SEM-14", f"import of {ns or 'no namespace'}"


def included(d: Document, other: Document) -> Found:
    if other.doc.target not in ("", d.doc.target):
        yield "SEM-15", "an included document has another namespace"


def twice(d: Document) -> Found:
    rules = {"group": "SEM-09", "attributeGroup": "SEM-10", "complexType": "SEM-11", "element": "SEM-12", "simpleType": "SEM-13"}
    for kind, rule in rules.items():
        for name, n in Counter(_attr(e, "name") for e in _kids(d.root, kind)).items():
            if n > 1:
                yield rule, f"{kind} {name} twice"
    both = set(d.top["complexType"]) & set(d.top["simpleType"])
    for name in sorted(both):
        yield "SEM-11", f"type {name} twice"


def facets(d: Document) -> Found:
    for e, _ in d.all:
        if local(e) != "restriction":
            continue
        given = {local(f): _attr(f, "value") for f in _kids(e) if local(f) in _FACETS}
        for kind, n in Counter(local(f) for f in _kids(e) if local(f) in (*_ORDER, *_COUNTS, "whiteSpace")).items():
            if n > 1:
                yield "SEM-16", f"{kind} twice"
        if "length" in given and {"minLength", "maxLength"} & set(given) or {"minInclusive", "minExclusive"} <= set(given) or {"maxInclusive", "maxExclusive"} <= set(given):
            yield "SEM-16", "facets exclude each other"
        if any(given.get(k) is not None and not re.fullmatch(r"\+?\d+", given[k]) for k in _COUNTS) or given.get("whiteSpace", "collapse") not in ("preserve", "replace", "collapse"):
            yield "SEM-16", "value of a facet"
        pairs = (("minLength", "maxLength"), ("fractionDigits", "totalDigits"), *((a, b) for a in _ORDER[:2] for b in _ORDER[2:]))
        if any(number(given.get(a)) is not None and number(given.get(b)) is not None and number(given[a]) > number(given[b]) for a, b in pairs):
            yield "SEM-16", "range of facets"
        for f in _kids(e, "pattern"):
            try:
                translate(_attr(f, "value") or "")
            except PatternError as problem:
                yield "SEM-16", f"pattern: {problem}"
        base = d.own(_attr(e, "base"), "simpleType")
        above = derivation(base) if base is not None else None
        if above is not None:
            old = {local(f): _attr(f, "value") for f in _kids(above) if local(f) in _FACETS}
            for kind, sign in (("maxInclusive", 1), ("maxLength", 1), ("minInclusive", -1), ("minLength", -1), ("totalDigits", 1)):
                a, b = number(given.get(kind)), number(old.get(kind))
                if a is not None and b is not None and sign * a > sign * b:
                    yield "SEM-21", f"{kind} is wider than in the base"
        if base is not None and _kids(base, "list", "union") and {*given} & {*_ORDER, "totalDigits", "fractionDigits"}:
            yield "SEM-21", "facet doesn't apply"


def finals(d: Document) -> Found:
    stops = lambda e, method: set((_attr(e, "final", _attr(d.root, "finalDefault", "")) or "").split()) & {method, "#all"}
    for e, _ in d.all:
        kind = local(e)
        if kind in ("restriction", "extension") and (base := d.own(_attr(e, "base"), "simpleType", "complexType")) is not None and stops(base, kind):
            yield ("SEM-17" if local(base) == "simpleType" else "SEM-18"), f"final {_attr(base, 'name')}"
        used = [_attr(e, "itemType")] if kind == "list" else (_attr(e, "memberTypes") or "").split() if kind == "union" else []
        for name in used:
            base = d.own(name, "simpleType") if name else None
            if base is not None and stops(base, kind):
                yield "SEM-17", f"final {name}"


def references(d: Document) -> Found:
    for e, parent in d.all:
        kind, base = local(e), _attr(e, "base")
        if kind in ("restriction", "extension"):
            owner = local(parent) if parent is not None else ""
            if base is None and not _kids(e, "simpleType"):
                yield ("SEM-19" if owner.endswith("Content") else "SEM-42"), "derivation without a base"
            elif base is not None and not d.knows(base, "simpleType", "complexType"):
                yield ("SEM-19" if owner.endswith("Content") else "SEM-42"), f"unknown base {base}"
            elif base is not None and owner == "complexContent" and d.own(base, "simpleType") is not None:
                yield "SEM-19", f"{base} is a simple type"
        if kind in ("element", "attribute"):
            ref, given = _attr(e, "ref"), _attr(e, "type")
            if ref is not None and not ref.startswith("xml:") and not d.knows(ref, kind) or given is not None and not d.knows(given, "simpleType", "complexType"):
                yield "SEM-20", f"unknown reference in {kind}"
        if kind in ("group", "attributeGroup") and _attr(e, "ref") and not d.knows(_attr(e, "ref"), kind):
            yield "SEM-20", f"unknown {kind}"
        for name in [_attr(e, "itemType")] if kind == "list" and _attr(e, "itemType") else (_attr(e, "memberTypes") or "").split() if kind == "union" else []:
            if not d.knows(name, "simpleType"):
                yield "SEM-42", f"unknown type {name}"


def elements(d: Document) -> Found:
    for e, parent in d.all:
        kind = local(e)
        if kind == "element":
            others = {k for k, _ in e.attrs} & {"type", "nillable", "default", "fixed", "form", "block"}
            if _attr(e, "ref") is not None and (_attr(e, "name") is not None or others or _kids(e, "simpleType", "complexType")):
                yield "SEM-22", "ref beside a declaration"
            if _attr(e, "default") is not None and _attr(e, "fixed") is not None or _attr(e, "type") and _kids(e, "simpleType", "complexType"):
                yield "SEM-22", "default beside fixed, or two types"
        if kind in ("element", "attribute"):
            value = _attr(e, "default", _attr(e, "fixed"))
            base = d.doc.qname(_attr(e, "type") or "")
            if value is not None and base[0] == XS and not fits(value, base[1]):
                yield "SEM-23", f"value {value} isn't of its type"
        if kind == "attribute":
            use = _attr(e, "use", "optional")
            if _attr(e, "default") is not None and (use != "optional" or _attr(e, "fixed") is not None) or use not in ("optional", "required", "prohibited"):
                yield "SEM-30", "use and default"
        if kind == "all":
            placed = parent is not None and local(parent) in ("complexType", "group", "restriction", "extension")
            if not placed or _attr(e, "maxOccurs", "1") != "1" or any(_attr(c, "maxOccurs", "1") not in ("0", "1") for c in _kids(e, "element")):
                yield "SEM-24", "xs:all"
        if kind in ("element", "any", "group", *_PARTICLES):
            low, high = _attr(e, "minOccurs", "1"), _attr(e, "maxOccurs", "1")
            if not low.isdigit() or not (high.isdigit() or high == "unbounded") or high.isdigit() and low.isdigit() and int(low) > int(high):
                yield "SEM-31", f"occurrence of {kind}"
        if kind in ("any", "anyAttribute"):
            tokens = _attr(e, "namespace", "##any").split()
            if any(t.startswith("##") and t not in ("##any", "##other", "##local", "##targetNamespace") for t in tokens) or len(tokens) > 1 and {"##any", "##other"} & set(tokens):
                yield "SEM-32", "namespaces of a wildcard"


def fits(value: str, type_name: str) -> bool:
    """A default's lexical check, for the common built-in types."""
    from ..functions.datatypes import LEXICAL, RANGES

    if type_name == "ID":
        return False
    if type_name in RANGES:
        low, high = RANGES[type_name]
        return bool(re.fullmatch(r"[+-]?\d+", value.strip())) and low <= int(value) <= high
    simple = {k: v for k, v in LEXICAL.items() if "(?" not in v}
    return type_name not in simple or bool(re.fullmatch(simple[type_name], value.strip()))


_STEP = r"(?:\.|(?:child::)?(?:[^\W\d][\w.\-]*:)?(?:\*|[^\W\d][\w.\-]*))"
_WAY = rf"(?:\.//)?{_STEP}(?:/{_STEP})*"
_FIELD = rf"(?:\.//)?(?:{_STEP}/)*(?:{_STEP}|(?:@|attribute::)(?:[^\W\d][\w.\-]*:)?(?:\*|[^\W\d][\w.\-]*))"


def constraints(d: Document) -> Found:
    found = [(e, p) for e, p in d.all if local(e) in ("unique", "key", "keyref")]
    for name, n in Counter(_attr(e, "name") for e, _ in found).items():
        if n > 1:
            yield "SEM-25", f"constraint {name} twice"
    sizes = {_attr(e, "name"): len(_kids(e, "field")) for e, _ in found if local(e) != "keyref"}
    for e, parent in found:
        if local(e) == "keyref":
            refer = (_attr(e, "refer") or "").split(":")[-1]
            if refer not in sizes or sizes[refer] != len(_kids(e, "field")):
                yield "SEM-26", f"keyref to {refer}"
        if parent is None or local(parent) != "element" or len(_kids(e, "selector")) != 1 or not _kids(e, "field"):
            yield "SEM-27", "shape of a constraint"
        for part, pattern in (("selector", _WAY), ("field", _FIELD)):
            for s in _kids(e, part):
                ways = re.sub(r"\s+", "", _attr(s, "xpath") or "").split("|")
                if not all(re.fullmatch(pattern, w) for w in ways):
                    yield "SEM-29", f"xpath of a {part}"


def attributes_of(d: Document, e: Node) -> dict[str, Node]:
    inner = [e, *_kids(e, "simpleContent", "complexContent")]
    inner += [x for i in inner for x in _kids(i, "restriction", "extension")]
    return {_attr(a, "name", _attr(a, "ref")): a for i in inner for a in _kids(i, "attribute")}


def restrictions(d: Document) -> Found:
    for e, _ in d.all:
        way = derivation(e) if local(e) == "complexType" else None
        base = d.own(_attr(way, "base"), "complexType") if way is not None and local(way) == "restriction" else None
        if base is None or derivation(base) is not None:
            continue
        known, wild = attributes_of(d, base), _kids(base, "anyAttribute")
        if not wild and not _kids(base, "attributeGroup") and any(_attr(a, "name", _attr(a, "ref")) not in known for a in _kids(way, "attribute")):
            yield "SEM-28", "a restriction adds an attribute"
        own = _kids(way, "anyAttribute")
        if own and (not wild or not within(_attr(own[0], "namespace", "##any"), _attr(wild[0], "namespace", "##any"))):
            yield "SEM-28", "a restriction widens a wildcard"


def within(inner: str, outer: str) -> bool:
    """Whether one wildcard's namespaces are among another's."""
    if outer == "##any" or inner == outer:
        return True
    if inner in ("##any", "##other"):
        return False
    return set(inner.split()) <= set(outer.split()) if outer != "##other" else not {"##targetNamespace", "##local"} & set(inner.split())


def shapes(d: Document) -> Found:
    for e, _ in d.all:
        kind, kids = local(e), [local(c) for c in _kids(e) if local(c) != "annotation"]
        if kind == "simpleType" and (len(kids) != 1 or kids[0] not in ("restriction", "list", "union")):
            yield "SEM-33", "content of a simple type"
        if kind == "list" and (_attr(e, "itemType") is None) == ("simpleType" not in kids) or kind == "union" and _attr(e, "memberTypes") is None and "simpleType" not in kids:
            yield "SEM-34", kind
        if kind == "complexType":
            parts = [k for k in kids if k in ("simpleContent", "complexContent")]
            if len(parts) > 1 or parts and any(k in _PARTICLES for k in kids) or "simpleContent" in kids and _attr(e, "mixed") == "true":
                yield "SEM-35", "content of a complex type"
        if kind == "group" and _attr(e, "name") is not None and (len(kids) != 1 or kids[0] not in _PARTICLES):
            yield "SEM-36", "a group has one compositor"
        allowed = {"block": {"#all", "extension", "restriction", "substitution"}, "final": {"#all", "extension", "restriction", "list", "union"}}
        for name, tokens in allowed.items():
            if not set((_attr(e, name) or "").split()) <= tokens:
                yield "SEM-37", f"{name} of {kind}"
        if kind == "list" and _attr(e, "itemType") and (item := d.own(_attr(e, "itemType"), "simpleType")) is not None and _kids(item, "list"):
            yield "SEM-41", "a list of lists"


def cycles(d: Document) -> Found:
    def loop(start: str, step: Callable[[str], str | None]) -> bool:
        seen, at = {start}, step(start)
        while at is not None and at not in seen:
            seen.add(at)
            at = step(at)
        return at is not None and at == start

    redefined = {_attr(e, "name") for r in _kids(d.root, "redefine") for e in _kids(r)}

    def head(name: str) -> str | None:
        e = d.top["element"].get(name)
        of = _attr(e, "substitutionGroup") if e is not None else None
        return of.split(":")[-1] if of else None

    def base(name: str) -> str | None:
        e = d.top["complexType"].get(name) or d.top["simpleType"].get(name)
        way = derivation(e) if e is not None else None
        return _attr(way, "base").split(":")[-1] if way is not None and d.own(_attr(way, "base"), "complexType", "simpleType") is not None else None

    for name in d.top["element"]:
        if loop(name, head):
            yield "SEM-38", f"{name} substitutes itself"
        top = d.top["element"].get(head(name) or "")
        if top is not None and name != head(name):
            stop = set((_attr(top, "final") or "").split())
            kind, own = d.own(_attr(d.top["element"][name], "type"), "complexType"), _attr(top, "type")
            way = derivation(kind) if kind is not None else None
            if "#all" in stop or way is not None and local(way) in stop and _attr(way, "base") == own:
                yield "SEM-39", f"{name} may not substitute {_attr(top, 'name')}"
    for name in [*d.top["complexType"], *d.top["simpleType"]]:
        if name not in redefined and loop(name, base):
            yield "SEM-40", f"{name} derives from itself"


CHECKS = (names, notations, ids, annotations, imports, twice, facets, finals, references, elements, constraints, restrictions, shapes, cycles)


def check_schema(text: str) -> list[tuple[str, str]]:
    """(rule, message) of all broken rules of one document."""
    d = Document(text)
    return [found for check in CHECKS for found in check(d)]


def check_together(texts: list[str]) -> list[tuple[str, str]]:
    """Rules across documents: the first includes the others."""
    first, *others = map(Document, texts)
    return [found for o in others for found in included(first, o)]


def _xsd(body: str, attrs: str = "") -> str:
    return f'<xs:schema xmlns:xs="{XS}"{attrs}>{body}</xs:schema>'


_INT = '<xs:simpleType name="t"{0}><xs:restriction base="xs:int">{1}</xs:restriction></xs:simpleType>'
_CT = '<xs:complexType name="c"{0}>{1}</xs:complexType>'
_KEY = '<xs:element name="e"><xs:key name="k"><xs:selector xpath="{0}"/><xs:field xpath="{1}"/></xs:key>{2}</xs:element>'
#: One schema document for each rule that breaks it.
BAD_EXAMPLES = {
    "SEM-01": _xsd('<xs:element type="xs:int"/>'),
    "SEM-02": _xsd('<xs:notation name="n"/>'),
    "SEM-03": _xsd('<xs:element name="e"><xs:notation name="n" public="p"/></xs:element>'),
    "SEM-04": _xsd('<xs:simpleType name="t"><xs:restriction base="xs:NOTATION"/></xs:simpleType>'),
    "SEM-05": _xsd('<xs:element name="e" id="1x"/>'),
    "SEM-06": _xsd('<xs:element name="e"><xs:annotation/><xs:annotation/></xs:element>'),
    "SEM-07": _xsd("<xs:include/>"),
    "SEM-08": _xsd('<xs:element name="e" id="x"/><xs:element name="f" id="x"/>'),
    "SEM-09": _xsd('<xs:group name="g"><xs:all/></xs:group>' * 2),
    "SEM-10": _xsd('<xs:attributeGroup name="g"/>' * 2),
    "SEM-11": _xsd('<xs:complexType name="c"/>' * 2),
    "SEM-12": _xsd('<xs:element name="e"/>' * 2),
    "SEM-13": _xsd(_INT.format("", "") * 2),
    "SEM-14": _xsd('<xs:import namespace="urn:a" schemaLocation="a"/>' * 2),
    "SEM-16": _xsd(_INT.format("", '<xs:minInclusive value="9"/><xs:maxInclusive value="1"/>')),
    "SEM-17": _xsd(_INT.format(' final="restriction"', "") + '<xs:simpleType name="u"><xs:restriction base="t"/></xs:simpleType>'),
    "SEM-18": _xsd(_CT.format(' final="#all"', "") + '<xs:complexType name="d"><xs:complexContent><xs:extension base="c"/></xs:complexContent></xs:complexType>'),
    "SEM-19": _xsd(_CT.format("", '<xs:complexContent><xs:extension base="nothing"/></xs:complexContent>')),
    "SEM-20": _xsd('<xs:element name="e" type="nothing"/>'),
    "SEM-21": _xsd(_INT.format("", '<xs:maxInclusive value="5"/>') + '<xs:simpleType name="u"><xs:restriction base="t"><xs:maxInclusive value="6"/></xs:restriction></xs:simpleType>'),
    "SEM-22": _xsd('<xs:element name="e" default="1" fixed="1"/>'),
    "SEM-23": _xsd('<xs:element name="e" type="xs:int" default="x"/>'),
    "SEM-24": _xsd(_CT.format("", '<xs:sequence><xs:all/></xs:sequence>')),
    "SEM-25": _xsd(_KEY.format("a", "@b", "") + _KEY.format("a", "@b", "").replace('"e"', '"f"')),
    "SEM-26": _xsd(_KEY.format("a", "@b", '<xs:keyref name="r" refer="none"><xs:selector xpath="a"/><xs:field xpath="@b"/></xs:keyref>')),
    "SEM-27": _xsd('<xs:element name="e"><xs:key name="k"><xs:selector xpath="a"/></xs:key></xs:element>'),
    "SEM-28": _xsd(_CT.format("", "") + '<xs:complexType name="d"><xs:complexContent><xs:restriction base="c"><xs:attribute name="a"/></xs:restriction></xs:complexContent></xs:complexType>'),
    "SEM-29": _xsd(_KEY.format("/a[1]", "@b", "")),
    "SEM-30": _xsd('<xs:attributeGroup name="g"><xs:attribute name="a" use="required" default="1"/></xs:attributeGroup>'),
    "SEM-31": _xsd(_CT.format("", '<xs:sequence minOccurs="3" maxOccurs="2"/>')),
    "SEM-32": _xsd(_CT.format("", '<xs:sequence><xs:any namespace="##what"/></xs:sequence>')),
    "SEM-33": _xsd('<xs:simpleType name="t"/>'),
    "SEM-34": _xsd('<xs:simpleType name="t"><xs:union/></xs:simpleType>'),
    "SEM-35": _xsd(_CT.format(' mixed="true"', '<xs:simpleContent><xs:extension base="xs:int"/></xs:simpleContent>')),
    "SEM-36": _xsd('<xs:group name="g"/>'),
    "SEM-37": _xsd('<xs:element name="e" block="nonsense"/>'),
    "SEM-38": _xsd('<xs:element name="e" substitutionGroup="f"/><xs:element name="f" substitutionGroup="e"/>'),
    "SEM-39": _xsd('<xs:element name="e" final="#all"/><xs:element name="f" substitutionGroup="e"/>'),
    "SEM-40": _xsd(_CT.format("", '<xs:complexContent><xs:extension base="d"/></xs:complexContent>') + '<xs:complexType name="d"><xs:complexContent><xs:extension base="c"/></xs:complexContent></xs:complexType>'),
    "SEM-41": _xsd('<xs:simpleType name="t"><xs:list itemType="xs:int"/></xs:simpleType><xs:simpleType name="u"><xs:list itemType="t"/></xs:simpleType>'),
    "SEM-42": _xsd('<xs:simpleType name="t"><xs:union memberTypes="nothing"/></xs:simpleType>'),
}

_RESTRICTED = '<xs:simpleType name="u"><xs:restriction base="{}"/></xs:simpleType>'
_DERIVED = '<xs:complexType name="d"><xs:complexContent><xs:{} base="c">{}</xs:{}></xs:complexContent></xs:complexType>'
#: For each rule a schema document close to its bad example that breaks none.
GOOD_EXAMPLES = {
    "SEM-01": _xsd('<xs:element name="e" type="xs:int"/>'),
    "SEM-02": _xsd('<xs:notation name="n" public="p"/><xs:notation name="m" system="s"/>'),
    "SEM-03": _xsd('<xs:notation name="n" public="p"/><xs:element name="e"/>'),
    "SEM-04": _xsd('<xs:notation name="n" public="p"/><xs:simpleType name="t"><xs:restriction base="xs:NOTATION"><xs:enumeration value="n"/></xs:restriction></xs:simpleType>'),
    "SEM-05": _xsd('<xs:element name="e" id="x1"/>'),
    "SEM-06": _xsd('<xs:annotation/><xs:annotation/><xs:element name="e"><xs:annotation><xs:documentation>d</xs:documentation></xs:annotation></xs:element>'),
    "SEM-07": _xsd('<xs:include schemaLocation="a"/>'),
    "SEM-08": _xsd('<xs:element name="e" id="x"/><xs:element name="f" id="y"/>'),
    "SEM-09": _xsd('<xs:group name="g"><xs:all/></xs:group><xs:group name="h"><xs:all/></xs:group>'),
    "SEM-10": _xsd('<xs:attributeGroup name="g"/><xs:attributeGroup name="h"/>'),
    "SEM-11": _xsd('<xs:complexType name="c"/><xs:complexType name="d"/>'),
    "SEM-12": _xsd('<xs:element name="e"/><xs:element name="f"/>'),
    "SEM-13": _xsd(_INT.format("", "") + _RESTRICTED.format("t")),
    "SEM-14": _xsd('<xs:import namespace="urn:a" schemaLocation="a"/><xs:import namespace="urn:b" schemaLocation="a"/>'),
    "SEM-16": _xsd(_INT.format("", '<xs:minInclusive value="1"/><xs:maxInclusive value="1"/>')),
    "SEM-17": _xsd(_INT.format(' final="list union"', "") + _RESTRICTED.format("t")),
    "SEM-18": _xsd(_CT.format(' final="restriction"', "") + _DERIVED.format("extension", "", "extension")),
    "SEM-19": _xsd(_CT.format("", "") + _DERIVED.format("extension", "", "extension")),
    "SEM-20": _xsd('<xs:element name="e" type="t"/>' + _INT.format("", "")),
    "SEM-21": _xsd(_INT.format("", '<xs:maxInclusive value="5"/>') + '<xs:simpleType name="u"><xs:restriction base="t"><xs:maxInclusive value="5"/></xs:restriction></xs:simpleType>'),
    "SEM-22": _xsd('<xs:element name="e" default="1"/><xs:element name="f" fixed="1"/>'),
    "SEM-23": _xsd('<xs:element name="e" type="xs:int" default="7"/>'),
    "SEM-24": _xsd(_CT.format("", '<xs:all><xs:element name="e"/></xs:all>')),
    "SEM-25": _xsd(_KEY.format("a", "@b", "") + _KEY.format("a", "@b", "").replace('"e"', '"f"').replace('"k"', '"l"')),
    "SEM-26": _xsd(_KEY.format("a", "@b", '<xs:keyref name="r" refer="k"><xs:selector xpath="a"/><xs:field xpath="@b"/></xs:keyref>')),
    "SEM-27": _xsd(_KEY.format("a", "@b", "")),
    "SEM-28": _xsd(_CT.format("", '<xs:attribute name="a"/>') + _DERIVED.format("restriction", '<xs:attribute name="a"/>', "restriction")),
    "SEM-29": _xsd(_KEY.format(".//a|b/c", "./d/@b", "")),
    "SEM-30": _xsd('<xs:attributeGroup name="g"><xs:attribute name="a" use="optional" default="1"/></xs:attributeGroup>'),
    "SEM-31": _xsd(_CT.format("", '<xs:sequence minOccurs="2" maxOccurs="2"/>')),
    "SEM-32": _xsd(_CT.format("", '<xs:sequence><xs:any namespace="##local urn:a"/></xs:sequence>')),
    "SEM-33": _xsd('<xs:simpleType name="t"><xs:list itemType="xs:int"/></xs:simpleType>'),
    "SEM-34": _xsd('<xs:simpleType name="t"><xs:union memberTypes="xs:int xs:date"/></xs:simpleType>'),
    "SEM-35": _xsd(_CT.format("", '<xs:simpleContent><xs:extension base="xs:int"/></xs:simpleContent>')),
    "SEM-36": _xsd('<xs:group name="g"><xs:choice/></xs:group>'),
    "SEM-37": _xsd('<xs:element name="e" block="extension substitution"/>'),
    "SEM-38": _xsd('<xs:element name="e" substitutionGroup="f"/><xs:element name="f"/>'),
    "SEM-39": _xsd('<xs:element name="e" final="restriction"/><xs:element name="f" substitutionGroup="e"/>'),
    "SEM-40": _xsd(_CT.format("", "") + _DERIVED.format("extension", "", "extension")),
    "SEM-41": _xsd(_INT.format("", "") + '<xs:simpleType name="u"><xs:list itemType="t"/></xs:simpleType>'),
    "SEM-42": _xsd(_INT.format("", "") + '<xs:simpleType name="u"><xs:union memberTypes="t xs:date"/></xs:simpleType>'),
}

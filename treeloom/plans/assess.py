"""What grammars say about elements while a document is read.

A grammar is a small object that travels to the tasks; the reader hands it each element as
it opens, from the top down, with the state that it returned for the parent.  So the type
of an element follows from the types above it, not from names: two namespaces may share a
local name, and an ``xsi:type`` rules everything below it.

Any object with the methods of ``Grammar`` serves; ``DtdGrammar`` and ``SchemaGrammar`` are
the ones of the engine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any, NamedTuple, Protocol

from ..model import XSI
from . import wildcards as wild
from .xsd import XS, ElementRule, Place, Schema, SimpleType


class Entered(NamedTuple):
    """What is known of an element when it opens."""

    state: Any  # handed back for its children
    declared: int | None = None  # rule of the declaration
    typed: int | None = None  # rule of the type that the instance names
    xsi_type: str | None = None
    nil: bool = False
    loose: bool = False  # no declaration is needed
    skipped: bool = False  # not to be checked at all
    scope: list[tuple[str, str]] | None = None  # prefixes in scope with their namespaces, where they are needed
    tokens: Sequence[str | None] = ()  # ``namespace}local`` of each attribute, null for those that aren't checked


class Grammar(Protocol):
    def start(self, number: int) -> Any:
        """The state above the root, for the grammar of this number."""

    def enter(self, state: Any, ns: str, name: str, attrs: Sequence[str], bound: Mapping[str, str]) -> Entered:
        """An element opens: ``attrs`` are names and values in turn, ``bound`` the prefixes in scope."""

    def token(self, ns: str, name: str) -> str:
        """How an element stands in its parent's sequence, with a blank behind."""


def in_scope(bound: Mapping[str, str]) -> list[tuple[str, str]]:
    """Bindings as a column holds them: the default namespace under the empty prefix, undone ones left out."""
    return sorted((p, uri) for p, uri in bound.items() if uri and p != "xmlns")


class NamespaceScope:
    """No rules, but every element with the namespaces that are in scope where it stands."""

    def start(self, number: int) -> None:
        return None

    def enter(self, state: None, ns: str, name: str, attrs: Sequence[str], bound: Mapping[str, str]) -> Entered:
        return Entered(None, scope=in_scope(bound))

    def token(self, ns: str, name: str) -> str:
        return f"{ns}}}{name.rpartition(':')[2]} "


class DtdGrammar:
    """Elements by their names as written; checks need no more than the sequence of children."""

    def start(self, number: int) -> None:
        return None

    def enter(self, state: None, ns: str, name: str, attrs: Sequence[str], bound: Mapping[str, str]) -> Entered:
        return Entered(None)

    def token(self, ns: str, name: str) -> str:
        return f"{name} "


class SchemaGrammar:
    """One or more compiled schemas; the state is the type that children follow, with its schema's number.

    Rules are numbered over all schemas (``rules``), so one table of rules serves documents
    of different schemas in one pass.
    """

    def __init__(self, schemas: Sequence[Schema]):
        self.schemas = list(schemas)
        self.rules: list[ElementRule] = []
        self.places: list[Place] = []
        self.schema_of: list[int] = []  # by rule
        self.steps: dict[tuple[str, str, str], int] = {}
        self.tops: dict[tuple[int, str, str], int] = {}
        self.named: dict[tuple[int, str, str], int] = {}
        self.inner: list[str] = []  # by rule: the type that its children follow
        self.memo: dict[tuple, tuple] = {}
        self.names: dict[tuple[str, ...], tuple] = {}
        self.wilds: dict[str, list[tuple[wild.Constraint, str]]] = {}
        self.referred: dict[str, frozenset[tuple[str, str]]] = {}
        kinds: list[SimpleType] = []
        for number, schema in enumerate(schemas):
            self._add(number, schema)
            kinds += [k for r in self.rules for k in (r.type.simple, *(a.type for a in r.type.attributes.values())) if k]
        spaced = any(a.ns and (a.default is not None or a.fixed is not None) for r in self.rules for a in r.type.attributes.values())
        self.wants_scope = spaced or any(k.has_base(("QName", "NOTATION")) for k in kinds)

    def _add(self, number: int, schema: Schema) -> None:
        for p in schema.places():
            k, own = len(self.rules), f"{number}{p.own}"
            self.rules.append(p.rule)
            self.places.append(p)
            self.schema_of.append(number)
            self.inner.append(own)
            if p.context == "":
                self.tops.setdefault((number, p.rule.ns, p.rule.name), k)
            elif p.context == "(type)":
                self.named.setdefault((number, p.rule.ns, p.rule.name), k)
            else:
                self.steps.setdefault((f"{number}{p.context}", p.rule.ns, p.rule.name), k)
            t = p.rule.type
            if t.wildcards and own not in self.wilds:
                self.wilds[own] = [(w.covers, w.strictness) for w in t.wildcards]
                self.referred[own] = frozenset(n for head in t.references for n in schema.members(head))

    def __getstate__(self) -> dict:
        """Tasks need the look-ups alone."""
        return {k: v for k, v in self.__dict__.items() if k not in ("schemas", "rules", "places", "schema_of")}

    def start(self, number: int) -> tuple[int, str | None, str]:
        return (number, None, "")

    def token(self, ns: str, name: str) -> str:
        return f"{ns}}}{name.rpartition(':')[2]} "

    def enter(self, state: tuple[int, str | None, str], ns: str, name: str, attrs: Sequence[str], bound: Mapping[str, str]) -> Entered:
        if state[2] == "skip":
            return Entered(state, skipped=True)
        plain, tokens = self._plain_tokens(attrs) if attrs else (True, ())
        if not plain or self.wants_scope:
            return self._enter(state, ns, name, attrs, bound)
        # nothing but the state and the name decides
        known = self.memo.get((state, ns, name))
        if known is None:
            found = self._enter(state, ns, name, (), bound)
            known = found[:-1]
            if found.declared is not None:  # as many as the grammar has places
                self.memo[state, ns, name] = known
        return Entered._make((*known, tokens))

    def _plain_tokens(self, attrs: Sequence[str]) -> tuple[bool, list[str | None] | None]:
        """Whether no attribute has a prefix, and the tokens then; remembered for a bounded number of lists of names."""
        names = tuple(attrs[::2])
        found = self.names.get(names)
        if found is None:
            plain = not any(":" in n for n in names)
            found = (plain, [None if n == "xmlns" else f"}}{n}" for n in names] if plain else None)
            if len(self.names) < 10_000:
                self.names[names] = found
        return found

    def _enter(self, state: tuple[int, str | None, str], ns: str, name: str, attrs: Sequence[str], bound: Mapping[str, str]) -> Entered:
        number, own, mode = state
        local = name.rpartition(":")[2]
        xsi, tokens = {}, ()
        if attrs:
            tokens = [None] * (len(attrs) // 2)
            for k in range(0, len(attrs), 2):
                prefix, colon, rest = attrs[k].partition(":")
                if not colon:
                    if prefix != "xmlns":
                        tokens[k // 2] = f"}}{prefix}"
                elif prefix == "xml":
                    tokens[k // 2] = f"}}{attrs[k]}"
                elif prefix != "xmlns":
                    uri = bound.get(prefix)
                    if uri == XSI:
                        xsi[rest] = attrs[k + 1]
                    else:
                        tokens[k // 2] = f"{'?' if uri is None else uri}}}{rest}"
        near = self.steps.get((own, ns, local)) if own is not None else None
        declared, strictness = near, None
        if near is None:
            declared = self.tops.get((number, ns, local))
            if own in self.wilds and (ns, local) not in self.referred[own]:
                strictness = next((how for covers, how in self.wilds[own] if wild.allows(covers, ns)), None)
                if strictness == "skip":
                    return Entered((number, None, "skip"), skipped=True)
        typed, named = None, xsi.get("type")
        if named is not None:
            prefix, _, kind = named.strip().rpartition(":")
            typed = self.named.get((number, bound.get(prefix) or "", kind))
            if bound.get(prefix) == XS and typed is None:
                named = None  # built-in types are taken as declared
        if declared is not None or typed is not None:
            mode = ""
        elif strictness == "lax":
            mode = "lax"
        rule = declared if typed is None else typed
        inner = self.inner[rule] if rule is not None else None
        nil = bool(xsi) and xsi.get("nil", "").strip() in ("true", "1")
        scope = in_scope(bound) if self.wants_scope else None
        return Entered((number, inner, mode), declared, typed, named and named.strip(), nil, mode == "lax", False, scope, tokens)

"""Document type definitions compiled on the driver into small rule tables.

The standard library's parser reads the declarations (conditional sections and parameter
entities included); content models become patterns over the names of the children, each
followed by a blank.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession

EMPTY, ANY, MIXED, NAME, CHOICE, SEQUENCE = 1, 2, 3, 4, 5, 6
_KINDS = {EMPTY: "EMPTY", ANY: "ANY", MIXED: "MIXED"}
_REPEAT = ("", "?", "*", "+")
#: Attributes types that are lists of tokens or single tokens; all others are texts.
PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}


@dataclass(frozen=True)
class AttributeRule:
    element: str
    name: str
    type: str  # CDATA, ID, IDREF(S), NMTOKEN(S), ENTITY, ENTITIES, NOTATION or ENUMERATION
    values: tuple[str, ...]
    use: str  # required, implied, fixed or optional (it has a default)
    default: str | None


@dataclass
class Dtd:
    """A compiled grammar; of several declarations of one thing the first holds."""

    models: dict[str, tuple[str, str | None, tuple[str, ...], str]] = field(default_factory=dict)  # kind, pattern, names, source
    attributes: dict[tuple[str, str], AttributeRule] = field(default_factory=dict)
    entities: dict[str, tuple[str | None, str | None, str | None, str | None]] = field(default_factory=dict)
    parameters: dict[str, str | None] = field(default_factory=dict)
    notations: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)

    def merged(self, other: Dtd) -> Dtd:
        """Keep-first union."""
        both = (getattr(other, n) | getattr(self, n) for n in ("models", "attributes", "entities", "parameters", "notations"))
        return Dtd(*both)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The rule tables as DataFrames; as small as the grammar, so they may be broadcast."""
        rows = {
            "dtd_elements": ([(n, k, p, list(c)) for n, (k, p, c, _) in self.models.items()], "name string, kind string, pattern string, names array<string>"),
            "dtd_attributes": ([(a.element, a.name, a.type, list(a.values), a.use, a.default) for a in self.attributes.values()], "element string, attribute string, type string, allowed array<string>, use string, default_value string"),
            "dtd_entities": ([(n, *e) for n, e in self.entities.items()], "name string, value string, public_id string, system_id string, notation string"),
            "dtd_notations": ([(n, *e) for n, e in self.notations.items()], "name string, public_id string, system_id string"),
        }
        return {name: spark.createDataFrame(data, schema) for name, (data, schema) in rows.items()}


def model_pattern(model: tuple) -> str:
    """A content model as a pattern over ``name `` tokens."""
    kind, repeat, name, parts = model
    if kind == NAME:
        body = f"(?:{re.escape(name)} )"
    else:
        body = "(?:" + ("|" if kind == CHOICE else "").join(model_pattern(p) for p in parts) + ")"
    return body + _REPEAT[repeat]


def model_source(model: tuple) -> str:
    """A content model printed as in a declaration."""
    kind, repeat, name, parts = model
    if kind in (EMPTY, ANY):
        return _KINDS[kind]
    if kind == NAME:
        return name + _REPEAT[repeat]
    inner = [model_source(p) for p in parts]
    if kind == MIXED:
        return "(" + "|".join(["#PCDATA", *inner]) + ")" + ("*" if inner else "")
    return "(" + ("|" if kind == CHOICE else ",").join(inner) + ")" + _REPEAT[repeat]


def model_names(model: tuple) -> tuple[str, ...]:
    """All child names of a model, sorted."""
    own = {model[2]} if model[0] == NAME else set()
    return tuple(sorted(own.union(*(model_names(p) for p in model[3]))))


def compile_dtd(text: str, external: Mapping[str, str] | None = None) -> Dtd:
    """Compile an external subset; ``external`` holds the texts of entities by system id.  Raises ValueError."""
    out, sources = Dtd(), {"dtd:": text, **(external or {})}
    p = expat.ParserCreate("utf-8")
    p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_ALWAYS)

    def element(name: str, model: tuple) -> None:
        kind = model[0]
        pattern = rf"\A{model_pattern(model)}\z" if kind in (CHOICE, SEQUENCE) else None
        out.models.setdefault(name, (_KINDS.get(kind, "ELEMENT"), pattern, model_names(model), model_source(model)))

    def attlist(owner: str, name: str, kind: str, default: str | None, required: int) -> None:
        values: tuple[str, ...] = ()
        if "(" in kind:
            values = tuple(kind[kind.index("(") + 1 : -1].split("|"))
            kind = "NOTATION" if kind.startswith("NOTATION") else "ENUMERATION"
        use = ("fixed" if required else "optional") if default is not None else "required" if required else "implied"
        out.attributes.setdefault((owner, name), AttributeRule(owner, name, kind, values, use, default))

    def entity(name: str, parameter: int, value: str | None, _base, system_id, public_id, notation) -> None:
        if parameter:
            out.parameters.setdefault(name, value)
        else:
            out.entities.setdefault(name, (value, public_id, system_id, notation))

    def load(context: str, _base, system_id: str | None, public_id: str | None) -> int:
        found = sources.get(system_id or "", sources.get(public_id or ""))
        if found is None:
            return 1
        if "\0" in found:
            raise ValueError("NUL in an external entity")
        child = p.ExternalEntityParserCreate(context)
        child.Parse(found.encode("utf-8"), True)
        return 1

    p.ElementDeclHandler, p.AttlistDeclHandler, p.EntityDeclHandler = element, attlist, entity
    p.NotationDeclHandler = lambda name, _base, system_id, public_id: out.notations.setdefault(name, (public_id, system_id))
    p.ExternalEntityRefHandler = load
    try:
        p.Parse(b'<!DOCTYPE r SYSTEM "dtd:"><r/>', True)
    except expat.ExpatError as e:
        raise ValueError(f"bad DTD: {e}") from e
    return out

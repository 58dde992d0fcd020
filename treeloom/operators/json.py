"""XML to JSON and back, in the light and in the lossless form.

Values are JSON text: member order is the order of the document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tokenizer import DocumentParser, NodeRows

# fixed values: the members that aren't child elements
RESERVED = ("_attributes", "_text", "_cdata", "_comments", "_processingInstructions", "_content")
_KINDS = {"text": "text", "cdata": "cdata", "comment": "comment", "pi": "processingInstruction"}


def item_name(name: str) -> str:
    if len(name) > 3 and name.endswith("ies"):
        return name[:-3] + "y"
    return name[:-1] if len(name) > 1 and name.endswith("s") else "item"


class Node:
    __slots__ = ("kind", "name", "attrs", "value", "content")

    def __init__(self, kind: str, name: str | None, attrs: list[tuple[str, str]], value: str | None):
        self.kind, self.name, self.attrs, self.value, self.content = kind, name, attrs, value, []


def build_tree(xml: str) -> list[Node]:
    """The top-level nodes of a document; raises ValueError where it isn't well formed."""
    rows = NodeRows()
    DocumentParser(rows).parse(0, xml)
    c = rows.columns
    if c["kind"] == ["error"]:
        raise ValueError(c["value"][0])
    nodes, top = [], []
    for k, kind in enumerate(c["kind"]):
        a, b = rows.offsets[k], rows.offsets[k + 1]
        node = Node(kind, c["name"][k], list(zip(rows.attr_names[a:b], rows.attr_values[a:b], strict=True)), c["value"][k])
        nodes.append(node)
        (top if c["parent"][k] < 0 else nodes[c["parent"][k]].content).append(node)
    return top


def _one_or_all(values: list):
    return values[0] if len(values) == 1 else values


def _instruction(node: Node) -> dict:
    return {"target": node.name} | ({"data": node.value} if node.value else {})


def element_value(e: Node, lossless: bool):
    """JSON value of an element; with ``lossless`` the order of its content is noted where it isn't implied."""
    groups: dict[str, list] = {}
    by_kind: dict[str, list] = {"text": [], "cdata": [], "comment": [], "pi": []}
    order, entries = [], []
    for node in e.content:
        if node.kind == "element":
            group = groups.setdefault(node.name, [])
            order.append(("element", node.name, len(group)))
            entries.append({"kind": "element", "name": node.name, "occurrence": len(group)})
            group.append(element_value(node, lossless))
            continue
        by_kind[node.kind].append(_instruction(node) if node.kind == "pi" else node.value)
        order.append((_KINDS[node.kind],))
        entries.append({"kind": _KINDS[node.kind]} | ({"target": node.name, "data": node.value} if node.kind == "pi" else {"value": node.value}))
    texts = by_kind["text"]
    told = bool(texts) and (not groups or any(t.strip() for t in texts))
    others = by_kind["cdata"] or by_kind["comment"] or by_kind["pi"]
    if not e.attrs and not groups and not others:
        return "".join(texts) if told else ""
    if not e.attrs and not others and not told and list(groups) == [item_name(e.name)]:
        return groups[item_name(e.name)]
    out: dict = {}
    if e.attrs:
        out["_attributes"] = dict(e.attrs)
    if told:
        out["_text"] = "".join(texts)
    for kind, key in (("cdata", "_cdata"), ("comment", "_comments")):
        if by_kind[kind]:
            out[key] = _one_or_all(by_kind[kind])
    if by_kind["pi"]:
        out["_processingInstructions"] = by_kind["pi"]
    out |= {name: _one_or_all(values) for name, values in groups.items()}
    if lossless and entries:
        implied = [("text",)] * told + [(_KINDS[k],) for k in ("cdata", "comment", "pi") for _ in by_kind[k]]
        implied += [("element", name, n) for name, values in groups.items() for n in range(len(values))]
        if order != implied:
            out["_content"] = entries
    return out


def document_value(top: list[Node], lossless: bool):
    root = next(n for n in top if n.kind == "element")
    value = element_value(root, lossless)
    if not lossless:
        return value
    out: dict = {"rootName": root.name, "root": value}
    before, after, met_root, met_doctype = [], [], False, False
    for node in top:
        if node.kind == "element":
            met_root = True
        elif node.kind == "declaration":
            if node.attrs:
                out["declaration"] = dict(node.attrs)
        elif node.kind == "doctype":
            met_doctype = True
            ids = dict(node.attrs)
            parts = {"name": node.name, "publicId": ids.get("public_id"), "systemId": ids.get("system_id"), "internalSubset": node.value}
            out["doctype"] = {k: v for k, v in parts.items() if v}
        else:
            entry = {"type": "processingInstruction"} | _instruction(node) if node.kind == "pi" else {"type": node.kind, "value": node.value}
            if met_root:
                after.append(entry)
            else:
                before.append(entry | ({"afterDoctype": True} if met_doctype else {}))
    return out | ({"prolog": before} if before else {}) | ({"epilog": after} if after else {})


def _attribute_text(name: str, value) -> str:
    plain = str(value).lower() if isinstance(value, bool) else str(value)
    return f' {name}="{escape(plain, {chr(34): "&quot;"})}"'


def _number(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def element_text(name: str, value, context: str | None = None) -> str:
    """XML text of a JSON value as the element ``name``."""
    attrs, inner = "", ""
    if isinstance(value, list):
        item = item_name(context or name)
        inner = "".join(element_text(item, v, item) for v in value)
        if not value:
            return f"<{name}></{name}>"
    elif isinstance(value, dict):
        attrs = "".join(_attribute_text(k, v) for k, v in (value.get("_attributes") or {}).items() if v is not None)
        inner = _ordered(value) if value.get("_content") else _unordered(value)
    elif isinstance(value, str):
        inner = escape(value)
    elif value is not None:
        inner = _number(value)
    return f"<{name}{attrs}>{inner}</{name}>" if inner else f"<{name}{attrs}/>"


def _misc(kind: str, entry: dict) -> str:
    if kind == "text":
        return escape(entry["value"])
    if kind == "cdata":
        return f"<![CDATA[{entry['value']}]]>"
    if kind == "comment":
        return f"<!--{entry['value']}-->"
    return f"<?{entry['target']} {entry.get('data') or ''}?>"


def _ordered(value: dict) -> str:
    out = []
    for entry in value["_content"]:
        if entry["kind"] != "element":
            out.append(_misc(entry["kind"], entry))
            continue
        own = value.get(entry["name"], [])
        own = own if isinstance(own, list) else [own]
        if entry["occurrence"] < len(own):
            out.append(element_text(entry["name"], own[entry["occurrence"]]))
    return "".join(out)


def _unordered(value: dict) -> str:
    listed = lambda key: [] if key not in value else value[key] if isinstance(value[key], list) else [value[key]]
    out = [escape(value.get("_text") or "")]
    out += [_misc("cdata", {"value": v}) for v in listed("_cdata")]
    out += [_misc("comment", {"value": v}) for v in listed("_comments")]
    out += [_misc("processingInstruction", p) for p in value.get("_processingInstructions") or []]
    for name, child in value.items():
        if name not in RESERVED:
            out += [element_text(name, v) for v in (child if isinstance(child, list) else [child])]
    return "".join(out)


def is_lossless(value) -> bool:
    return isinstance(value, dict) and isinstance(value.get("rootName"), str) and "root" in value


def infer_root(value) -> str | None:
    """The only member that isn't reserved, if there is exactly one."""
    names = [k for k in value if k not in RESERVED] if isinstance(value, dict) else []
    return names[0] if len(names) == 1 else None


def document_text(value, root_name: str | None = "json") -> str:
    """XML text of a JSON document in either form; ``root_name`` None: infer it."""
    if not is_lossless(value):
        return element_text(root_name or infer_root(value) or "json", value)
    out = []
    if value.get("declaration"):
        d = {"version": "1.0", "encoding": "utf-8"} | value["declaration"]
        out.append("<?xml" + "".join(f' {k}="{d[k]}"' for k in ("version", "encoding", "standalone") if d.get(k)) + "?>")
    prolog = value.get("prolog") or []
    out += [_misc(e["type"], e) for e in prolog if not e.get("afterDoctype")]
    if doctype := value.get("doctype"):
        public, system, subset = (doctype.get(k) for k in ("publicId", "systemId", "internalSubset"))
        ids = f' PUBLIC "{public}" "{system}"' if public and system else f' SYSTEM "{system}"' if system else f' PUBLIC "{public}"' if public else ""
        out.append(f"<!DOCTYPE {doctype['name']}{ids}{f' [{subset}]' if subset else ''}>")
    out += [_misc(e["type"], e) for e in prolog if e.get("afterDoctype")]
    out.append(element_text(value["rootName"], value["root"]))
    return "".join(out + [_misc(e["type"], e) for e in value.get("epilog") or []])


def xml_to_json(xml: Column, lossless: bool = False) -> Column:
    """JSON text of each document; null where it isn't well formed."""

    def convert(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(document_value(build_tree(text), lossless), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(convert, na_action="ignore").astype(object)

    return run(xml)


def json_to_xml(value: Column, root_name: str | None = "json") -> Column:
    """XML text of each JSON document; null where it isn't JSON."""

    def convert(text: str | None) -> str | None:
        try:
            return None if text is None else document_text(json.loads(text), root_name)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(convert, na_action="ignore").astype(object)

    return run(value)


def is_lossless_json(value: Column) -> Column:
    """Whether JSON text has a root name and a root, without Python."""
    return F.coalesce(F.get_json_object(value, "$.rootName").isNotNull() & F.array_contains(F.json_object_keys(value), "root"), F.lit(False))


def root_name_of(value: Column) -> Column:
    """Inferred root name, without Python."""
    names = F.array_except(F.json_object_keys(value), F.array(*[F.lit(r) for r in RESERVED]))
    return F.when(F.size(names) == 1, F.get(names, F.lit(0)))


def write_json(docs: DataFrame, path: str, lossless: bool = False) -> None:
    """One JSON document a line."""
    docs.select(xml_to_json(F.col("xml"), lossless).alias("value")).where("value is not null").write.text(path)


#: The record separator: no XML document can hold it, so it parts documents in a container.
PART = "\x1e"


def write_xml(docs: DataFrame, path: str, one_file_each: bool = False) -> None:
    """Whole documents (``doc_id, xml``), character for character; documents without text are left out.

    By default a file holds many documents, a record separator behind each; ids aren't kept.
    With ``one_file_each`` a document is a file of its own, in a folder that names its id,
    with a line feed behind it.
    """
    given = docs.where("xml is not null")
    if one_file_each:
        given.select(F.col("doc_id"), F.col("xml").alias("value")).repartition("doc_id").write.partitionBy("doc_id").text(path)
    else:
        given.select(F.col("xml").alias("value")).write.option("lineSep", PART).text(path)


def read_xml(spark: SparkSession, path: str, one_file_each: bool = False) -> DataFrame:
    """``doc_id, xml`` as ``write_xml`` wrote them; without ids of their own, documents get a hash of their text."""
    if one_file_each:
        files = spark.read.text(path, wholetext=True)
        return files.select(F.col("doc_id").cast("long"), F.expr("substring(value, 1, length(value) - 1)").alias("xml"))
    rows = spark.read.option("lineSep", PART).text(path)
    return rows.select(F.xxhash64("value").alias("doc_id"), F.col("value").alias("xml"))

"""RelaxNG grammars as a source of attribute defaults (they validate nothing).

The tree is simplified on the driver: foreign elements go, external references and
includes are put in, ``div`` is dissolved, equally named definitions are joined.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from ..operators.json import Node, build_tree

RNG = "http://relaxng.org/ns/structure/1.0"
ANNOTATIONS = "http://relaxng.org/ns/compatibility/annotations/1.0"


def _local(name: str) -> str:
    return name.split(":")[-1]


class RelaxNg:
    """``defaults``: (namespace, element, attribute) to the default value; the first holds."""

    def __init__(self, path: str, read: Callable[[str], str]):
        self.read, self.defines, self.defaults = read, {}, {}
        root = self._load(path, ())
        self._define(root)
        self._harvest(root, None, set())

    def _load(self, path: str, chain: tuple[str, ...], parent_scope: dict | None = None) -> Node:
        if path in chain:
            raise ValueError(f"grammar refers to itself: {path}")
        root = next(n for n in build_tree(self.read(path)) if n.kind == "element")
        return self._clean(root, {"": ""} | (parent_scope or {}), "", path, (*chain, path))

    def _clean(self, e: Node, scope: dict[str, str], ns: str, path: str, chain: tuple[str, ...]) -> Node:
        attrs = dict(e.attrs)
        scope = scope | {k[6:]: v for k, v in e.attrs if k == "xmlns" or k.startswith("xmlns:")}
        ns = attrs.get("ns", ns)
        out = Node("element", _local(e.name), [("ns", ns)], None)
        for k, v in e.attrs:
            prefix, _, local = k.rpartition(":")
            if prefix and scope.get(prefix) == ANNOTATIONS and local == "defaultValue":
                out.attrs.append(("default", v))
            elif not prefix and k in ("name", "href", "combine"):
                out.attrs.append((k, v.strip()))
        for c in e.content:
            if c.kind == "text" and _local(e.name) in ("name", "value"):
                out.value = (out.value or "") + c.value.strip()
            if c.kind != "element":
                continue
            inner = scope | {k[6:]: v for k, v in c.attrs if k == "xmlns" or k.startswith("xmlns:")}
            prefix = c.name.split(":")[0] if ":" in c.name else ""
            if inner.get(prefix, "") != RNG:
                continue  # foreign
            child = self._clean(c, scope, ns, path, chain)
            if child.name == "div":
                out.content += child.content
            elif child.name in ("externalRef", "include"):
                href = dict(child.attrs).get("href", "")
                loaded = self._load(posixpath.normpath(posixpath.join(posixpath.dirname(path), href)), chain)
                inside = [n for n in loaded.content] if child.name == "include" else [loaded]
                overridden = {dict(n.attrs).get("name") for n in child.content if n.name == "define"}
                out.content += child.content + [n for n in inside if not (n.name == "define" and dict(n.attrs).get("name") in overridden)]
            else:
                out.content.append(child)
        return out

    def _define(self, e: Node) -> None:
        for c in e.content:
            if c.name == "define":
                self.defines.setdefault(dict(c.attrs).get("name"), []).extend(c.content)
            self._define(c)

    def _names(self, e: Node) -> list[tuple[str, str]]:
        """(namespace, local name) of an element or attribute pattern."""
        attrs = dict(e.attrs)
        if "name" in attrs:
            ns = attrs["ns"] if e.name == "element" else ""
            return [(ns, _local(attrs["name"]))]
        found = []
        for c in e.content:
            if c.name == "name" and c.value:
                found.append((dict(c.attrs)["ns"], _local(c.value)))
            elif c.name == "choice":
                found += self._names(c)
        return found

    def _harvest(self, e: Node, owner: list[tuple[str, str]] | None, seen: set[str]) -> None:
        for c in e.content:
            if c.name == "element":
                self._harvest(c, self._names(c), set())
            elif c.name == "attribute" and owner:
                default = dict(c.attrs).get("default")
                if default is not None:
                    for ns, element in owner:
                        for _, name in self._names(c):
                            self.defaults.setdefault((ns, element, name), default)
            elif c.name == "ref":
                name = dict(c.attrs).get("name")
                if owner is not None and name not in seen:
                    self._harvest(Node("element", "define", [], None) if name not in self.defines else _with(self.defines[name]), owner, seen | {name})
            elif c.name != "define" or owner is None:
                self._harvest(c, owner, seen)


def _with(content: list[Node]) -> Node:
    out = Node("element", "define", [], None)
    out.content = content
    return out

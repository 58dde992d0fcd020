"""Entity catalogs: compiled on the driver to one table of entries, resolved by joins.

Resolution of a system identifier or URI: the longest rewrite prefix is applied; if any
delegate prefix matches, only the delegates' catalogs count, longest prefix first; then an
exact entry, then the longest suffix (for system identifiers also the file name).  Public
identifiers: delegates, then an exact entry.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unwrap_urn
from ..operators.json import build_tree

_ENTRIES = {
    "public": ("publicId", "uri"), "system": ("systemId", "uri"), "uri": ("name", "uri"),
    "rewriteURI": ("uriStartString", "rewritePrefix"), "rewriteSystem": ("systemIdStartString", "rewritePrefix"),
    "systemSuffix": ("systemIdSuffix", "uri"), "uriSuffix": ("uriSuffix", "uri"),
    "delegatePublic": ("publicIdStartString", "catalog"), "delegateSystem": ("systemIdStartString", "catalog"), "delegateURI": ("uriStartString", "catalog"),
}
SCHEMA = "catalog string, kind string, key string, target string, ord int"


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Catalog:
    """Entries of a catalog and all it refers to: ``(catalog, kind, key, target, ord)``, the first of a key holds."""

    def __init__(self, path: str, read: Callable[[str], str] = _read):
        self.path, self.read, self.entries, self.prefer = path, read, [], "public"
        self._load(path, path, ())

    def _load(self, owner: str, path: str, chain: tuple[str, ...]) -> None:
        if path in chain:
            raise ValueError(f"catalog refers to itself: {path}")
        root = next(n for n in build_tree(self.read(path)) if n.kind == "element")
        if path == self.path:
            self.prefer = dict(root.attrs).get("prefer", "public")
        self._collect(root, owner, path, posixpath.dirname(path), (*chain, path))

    def _collect(self, element, owner: str, path: str, base: str, chain: tuple[str, ...]) -> None:
        attrs = dict(element.attrs)
        base = posixpath.join(base, attrs["xml:base"]) if "xml:base" in attrs else base
        kind = element.name.split(":")[-1]
        if kind in _ENTRIES and all(a in attrs for a in _ENTRIES[kind]):
            key, target = (attrs[a] for a in _ENTRIES[kind])
            if kind == "rewriteURI" or kind == "rewriteSystem":
                resolved = target
            else:
                resolved = target if "://" in target or os.path.isabs(target) else posixpath.normpath(posixpath.join(base, target))
            self.entries.append((owner, kind, key, resolved, len(self.entries)))
            if kind.startswith("delegate") and resolved not in chain and resolved not in {e[0] for e in self.entries}:
                self._load(resolved, resolved, chain)
        elif kind == "nextCatalog" and "catalog" in attrs:
            self._load(owner, posixpath.normpath(posixpath.join(base, attrs["catalog"])), chain)
        for child in element.content:
            if child.kind == "element":
                self._collect(child, owner, path, base, chain)

    def table(self, spark: SparkSession) -> DataFrame:
        """As many rows as the catalogs have entries, so it may be broadcast."""
        return spark.createDataFrame(self.entries, SCHEMA)

    def _best(self, owner: str, kind: str, key: Column, matches: Callable[[Column, str], Column], value: Callable[[str, str], Column]) -> Column:
        """Value of the longest matching entry, the first of equally long ones; null without one."""
        rows = [(k, t) for o, kd, k, t, _ in self.entries if o == owner and kd == kind]
        out = F.lit(None).cast("string")
        for k, t in reversed(sorted(rows, key=lambda r: -len(r[0]))):
            out = F.when(matches(key, k), value(k, t)).otherwise(out)
        return out

    def _exact(self, owner: str, kind: str, key: Column) -> Column:
        return self._best(owner, kind, key, lambda c, k: c == k, lambda k, t: F.lit(t))

    def _resolve(self, owner: str, key: Column, rewrite: str | None, delegate: str, exact: str, suffix: str | None) -> Column:
        starts = lambda c, k: c.startswith(k)
        if rewrite:
            rest = lambda k, t: F.concat(F.lit(t), F.substring(key, len(k) + 1, 1 << 30))
            key = F.coalesce(self._best(owner, rewrite, key, starts, rest), key)
        found = self._exact(owner, exact, key)
        if suffix:
            found = F.coalesce(found, self._best(owner, suffix, key, lambda c, k: c.endswith(k), lambda k, t: F.lit(t)))
        if exact == "system":  # by file name
            named = lambda c, k: F.substring_index(c, "/", -1) == posixpath.basename(k)
            found = F.coalesce(found, self._best(owner, exact, key, named, lambda k, t: F.lit(t)))
        delegates = sorted([(k, t) for o, kd, k, t, _ in self.entries if o == owner and kd == delegate], key=lambda r: -len(r[0]))
        if delegates:
            through = F.coalesce(*[F.when(key.startswith(k), self._resolve(t, key, rewrite, delegate, exact, suffix)) for k, t in delegates])
            any_of = F.lit(False)
            for k, _ in delegates:
                any_of = any_of | key.startswith(k)
            found = F.when(any_of, through).otherwise(found)
        return found

    def match_system(self, key: Column) -> Column:
        return self._resolve(self.path, key, "rewriteSystem", "delegateSystem", "system", "systemSuffix")

    def match_public(self, key: Column) -> Column:
        return self._resolve(self.path, unwrap_urn(key), None, "delegatePublic", "public", None)

    def match_uri(self, key: Column) -> Column:
        return self._resolve(self.path, key, "rewriteURI", "delegateURI", "uri", "uriSuffix")

    def resolve_entity(self, public_id: Column, system_id: Column) -> Column:
        """By the catalog's preference."""
        ways = [self.match_public(public_id), self.match_system(system_id)]
        return F.coalesce(*(ways if self.prefer == "public" else ways[::-1]))


def resolve_by_join(keys: DataFrame, entries: DataFrame, kind: str, key: str = "key") -> DataFrame:
    """``keys`` with ``target`` of the longest entry of one kind: the same as a broadcast join, for large catalogs."""
    own = entries.where(F.col("kind") == kind).select(F.col("key").alias("entry"), "target", "ord")
    how = {"systemSuffix": f"endswith({key}, entry)", "uriSuffix": f"endswith({key}, entry)"}.get(kind, f"startswith({key}, entry)")
    met = keys.join(F.broadcast(own), F.expr(how if kind not in ("public", "system", "uri") else f"{key} = entry"), "left")
    rank = F.struct(F.length("entry"), -F.col("ord"))
    columns = keys.columns
    return met.groupBy(*columns).agg(F.max_by("target", rank).alias("target"), F.max_by("entry", rank).alias("entry"))

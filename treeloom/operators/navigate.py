"""Tree navigation as joins and windows over node rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import attribute, local_of


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'element'")


def roots(nodes: DataFrame) -> DataFrame:
    return elements(nodes).where("level = 0")


def children(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Child elements, beside their parent's columns prefixed with ``parent_``."""
    up = parents.select("doc_id", F.col("pre").alias("parent"), F.col("name").alias("parent_name"), F.col("attrs").alias("parent_attrs"))
    return elements(nodes).join(up, ["doc_id", "parent"])


def first_child(parents: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """``doc_id, parent, child``: the first child element called ``name`` of each parent."""
    found = children(parents, elements(nodes).where(F.col("name") == name))
    return found.groupBy("doc_id", "parent").agg(F.min_by("pre", "sib").alias("child"))


def below(scopes: DataFrame, nodes: DataFrame, self_too: bool = False, wanted: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Nodes (elements must be among them) beside each scope above them (``anc_pre``), or that they are, with ``self_too``.

    Of the nodes those for which ``wanted`` holds are given; ``keep`` names columns of ``scopes`` to be kept.

    The last element of a level that has opened before a node is its ancestor there, so one
    pass in document order gives each node its ancestors at the levels where scopes stand;
    these meet the scopes by equality.  No interval join: work follows the nodes, times the
    levels of scopes, however many scopes a document has.
    """
    scopes = scopes.withColumn("anc_level", F.size(F.split("path", "/")) - 2)
    levels = sorted(r[0] for r in scopes.select("anc_level").distinct().collect())
    upto = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_element = F.col("kind") == "element"
    at = lambda level: F.last(F.when(is_element & (F.col("level") == level), F.col("pre")), ignorenulls=True).over(upto)
    reaches = lambda level: (F.col("level") > level) | (is_element & (F.col("level") == level)) if self_too else F.col("level") > level
    above = F.array_compact(F.array(*[F.when(reaches(level), at(level)) for level in levels]).cast("array<int>"))
    placed = nodes.select("*", above.alias("above"))
    met = (placed if wanted is None else placed.where(wanted)).select(*nodes.columns, F.explode("above").alias("anc_pre"))
    return met.join(scopes.select("doc_id", F.col("pre").alias("anc_pre"), "anc_level", *keep), ["doc_id", "anc_pre"]).select(*nodes.columns, "anc_pre", "anc_level", *keep)


def descendants(ancestors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes below each ancestor (an element with its ``path``); the ancestor's place is ``anc_pre``, its level ``anc_level``."""
    return below(ancestors, nodes)


def _text(rows: DataFrame, *by: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("pre", "value")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("text"))


def _own_texts(nodes: DataFrame, with_cdata: bool) -> DataFrame:
    """``doc_id, pre, text`` of the elements that have text nodes right below them."""
    kinds = ["text", "cdata"] if with_cdata else ["text"]
    rows = nodes.where(F.col("kind").isin(kinds) & (F.col("parent") >= 0))
    return _text(rows, "doc_id", "parent").withColumnRenamed("parent", "pre")


def own_text(nodes: DataFrame, with_cdata: bool = False) -> DataFrame:
    """``doc_id, pre, text``: the text nodes right below each element."""
    return elements(nodes).select("doc_id", "pre").join(_own_texts(nodes, with_cdata), ["doc_id", "pre"], "left").na.fill("", ["text"])


def deep_text(ancestors: DataFrame, nodes: DataFrame, with_cdata: bool = False) -> DataFrame:
    """``doc_id, pre, text``: all text below each of ``ancestors``."""
    kinds = ["text", "cdata"] if with_cdata else ["text"]
    found = _text(descendants(ancestors, nodes).where(F.col("kind").isin(kinds)), "doc_id", "anc_pre").withColumnRenamed("anc_pre", "pre")
    return ancestors.select("doc_id", "pre").join(found, ["doc_id", "pre"], "left").na.fill("", ["text"])


def first_instruction(nodes: DataFrame, target: str) -> DataFrame:
    """``doc_id, data`` of the first processing instruction for ``target``."""
    rows = nodes.where((F.col("kind") == "pi") & (F.col("name") == target))
    return rows.groupBy("doc_id").agg(F.min_by("value", "pre").alias("data"))


def occurrence(nodes: DataFrame) -> Column:
    """Place among equally named siblings, from 0, as a window."""
    return F.row_number().over(Window.partitionBy("doc_id", "parent", "name").orderBy("sib")) - 1


def compile_selector(selector: str) -> str:
    """A selector as a pattern over an element's path, relative to ``/scope``.

    Steps: ``.``, ``./a/b``, ``.//a``, ``child::a``, ``*``; ``|`` joins alternatives.
    Prefixes are ignored.
    """
    ways = []
    for way in selector.split("|"):
        way = re.sub(r"\s+", "", way)
        anywhere = way.startswith(".//")
        steps = [s.removeprefix("child::") for s in re.sub(r"^\.?/{0,2}", "", way).split("/") if s and s != "."]
        names = ["[^/]+" if s.split(":")[-1] == "*" else f"(?:[^/:]+:)?{re.escape(s.split(':')[-1])}" for s in steps]
        ways.append(("(?:/[^/]+)*" if anywhere else "") + "".join(f"/{n}" for n in names))
    return rf"\A(?:{'|'.join(ways)})\z"


def select(scopes: DataFrame, nodes: DataFrame, selector: str) -> DataFrame:
    """Elements that ``selector`` reaches from each scope, with ``anc_pre``.

    A selector of plain steps goes down one level a step, by equality on the parent, so a
    large document is spread over tasks by its parents; alternatives and ``.//`` take one pass
    in document order (see ``below``).
    """
    plain = re.sub(r"\s+", "", selector)
    if "|" not in plain and not plain.startswith((".//", "/")):
        names = [s.removeprefix("child::").split(":")[-1] for s in plain.split("/") if s and s != "."]
        known = elements(nodes)
        if not names:
            return known.join(scopes.select("doc_id", "pre", F.col("pre").alias("anc_pre")), ["doc_id", "pre"])
        at = scopes.select("doc_id", F.col("pre").alias("anc_pre"), F.col("pre").alias("parent"))
        for k, name in enumerate(names):
            met = (known if name == "*" else known.where(local_of(F.col("name")) == name)).join(at, ["doc_id", "parent"])
            if k < len(names) - 1:
                at = met.select("doc_id", "anc_pre", F.col("pre").alias("parent"))
        return met
    pattern = compile_selector(selector)
    # what can't end a path that the selector reaches is dropped before scopes are met, but after ancestors are known
    ends = F.col("path").rlike(pattern.replace(r"\A", "", 1))
    own = scopes.withColumn("anc_path", F.length("path"))
    inside = below(own, elements(nodes), self_too=True, wanted=ends, keep=["anc_path"])
    relative = F.col("path").substr(F.col("anc_path") + 1, F.length("path"))
    return inside.where(relative.rlike(pattern)).select(*nodes.columns, "anc_pre")


def field(selected: DataFrame, nodes: DataFrame, path: str, alias: str) -> DataFrame:
    """``selected`` with a field's value: ``@a``, ``attribute::a``, ``.``, or a child path."""
    path = re.sub(r"\s+", "", path).removeprefix("./") if path != "." else path
    if path.startswith(("@", "attribute::")):
        return selected.withColumn(alias, attribute(F.col("attrs"), path.removeprefix("@").removeprefix("attribute::").split(":")[-1]))
    if path == ".":
        texts = _own_texts(nodes, with_cdata=True)
        return selected.join(texts.withColumnRenamed("text", alias), ["doc_id", "pre"], "left").na.fill("", [alias])
    texts = own_text(nodes, with_cdata=True)
    below = select(selected.select("doc_id", "pre", "post", "path").distinct(), nodes, path)
    found = below.join(texts, ["doc_id", "pre"]).groupBy("doc_id", F.col("anc_pre").alias("pre")).agg(F.min_by("text", "pre").alias(alias))
    return selected.join(found, ["doc_id", "pre"], "left")


def namespace_by_ancestor(nodes: DataFrame) -> DataFrame:
    """``doc_id, pre, ns_uri`` by the nearest ancestor that binds the prefix, as a join; the parser's column is the same."""
    from ..functions.text import prefix_of

    el = elements(nodes)
    bound = el.select("doc_id", "pre", "post", "level", F.explode("attrs").alias("a")).where("a.name = 'xmlns' or a.name like 'xmlns:%'")
    bound = bound.select(
        F.col("doc_id").alias("b_doc"), F.col("pre").alias("b_pre"), F.col("post").alias("b_post"), F.col("level").alias("b_level"),
        F.when(F.col("a.name") == "xmlns", "").otherwise(F.expr("substring(a.name, 7)")).alias("b_prefix"), F.col("a.value").alias("b_uri"),
    )
    holders = el.where(F.exists("attrs", lambda a: (a["name"] == "xmlns") | a["name"].startswith("xmlns:")))
    met = below(holders, el.withColumn("prefix", prefix_of(F.col("name"))), self_too=True)
    found = met.join(bound, F.expr("doc_id = b_doc and anc_pre = b_pre and prefix = b_prefix")).groupBy("doc_id", "pre").agg(F.max_by("b_uri", "b_level").alias("ns_uri"))
    return el.select("doc_id", "pre").join(found, ["doc_id", "pre"], "left").na.fill("", ["ns_uri"])

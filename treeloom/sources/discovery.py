"""Grammars and entities that documents name themselves, found by joins and put in in one pass."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.defaults import gathered_rules, merge_gathered
from ..operators.navigate import first_instruction
from ..plans.catalog import Catalog
from ..plans.lineage import stored
from ..plans.relaxng import RelaxNg

_QUOTED = "(\"[^\"]*\"|'[^']*')"
_DOCTYPE = rf"<!DOCTYPE\s+[^\s\[>]+\s+(?:SYSTEM\s+|PUBLIC\s+{_QUOTED}\s*){_QUOTED}"
_ENTITY = rf"<!ENTITY\s+(?:%\s+)?[^\s%]+\s+(?:SYSTEM\s+|PUBLIC\s+{_QUOTED}\s*){_QUOTED}"


def _unquoted(text: Column) -> Column:
    return F.nullif(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(""))


def external_ids(docs: DataFrame) -> DataFrame:
    """``doc_id, public_id, system_id`` of the external subset and the external entities that documents (``doc_id, xml``) declare."""
    subset = F.when(F.contains("xml", F.lit("<!DOCTYPE")), F.col("xml"))
    found = [F.struct(F.regexp_extract(subset, _DOCTYPE, 1).alias("public_id"), F.regexp_extract(subset, _DOCTYPE, 2).alias("system_id"))]
    of_entity = F.arrays_zip(F.regexp_extract_all(subset, F.lit(_ENTITY), F.lit(1)).alias("public_id"), F.regexp_extract_all(subset, F.lit(_ENTITY), F.lit(2)).alias("system_id"))
    every = docs.where(subset.isNotNull()).select("doc_id", F.explode(F.concat(F.array(*found), of_entity)).alias("e"))
    return every.select("doc_id", _unquoted(F.col("e.public_id")).alias("public_id"), _unquoted(F.col("e.system_id")).alias("system_id")).where("system_id is not null").distinct()


def joined_path(base: Column, location: Column) -> Column:
    """A location relative to the folder of ``base``, ``..`` and ``.`` resolved; absolute ones stay."""
    absolute = location.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)") | base.isNull()
    steps = F.filter(F.split(F.concat(F.regexp_replace(base, "[^/]*$", ""), location), "/"), lambda s: s != ".")
    up = lambda out, s: F.when((s == "..") & (F.size(out) > 1), F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(F.array_append(out, s))
    return F.when(absolute, location).otherwise(F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/"))


def with_external(docs: DataFrame, files: DataFrame, catalog: Catalog | None = None, bases: DataFrame | None = None) -> DataFrame:
    """``docs`` with a column ``external``: the texts of what they declare outside, by system identifier, for ``parse``.

    A catalog's answer comes first, then the location relative to the document's ``base``
    (``bases``: ``doc_id, base``), then as it is given; ``files`` (``path, text``) holds the
    texts.  What isn't there is left out: references to it then become ``entity`` nodes.
    """
    ids = external_ids(docs)
    if bases is not None:
        ids = ids.join(bases, "doc_id", "left")
    else:
        ids = ids.withColumn("base", F.lit(None).cast("string"))
    known = catalog.resolve_entity(F.coalesce("public_id", F.lit("")), F.col("system_id")) if catalog else F.lit(None).cast("string")
    located = ids.withColumn("path", F.coalesce(known, joined_path(F.col("base"), F.col("system_id"))))
    texts = located.join(files.select("path", F.col("text").alias("found")), "path").groupBy("doc_id").agg(
        F.map_from_entries(F.collect_set(F.struct("system_id", "found"))).alias("external")
    )
    return docs.join(texts, "doc_id", "left")


def model_references(nodes: DataFrame) -> DataFrame:
    """``doc_id, href`` of the first ``xml-model`` instruction that names a RelaxNG grammar."""
    data = first_instruction(nodes, "xml-model")
    value = lambda name: _unquoted(F.regexp_extract("data", rf"(?:^|\s){name}\s*=\s*{_QUOTED}", 1))
    space = value("schematypens")
    right = space.isNull() | (space == "http://relaxng.org/ns/structure/1.0")
    return data.select("doc_id", F.when(right, value("href")).alias("href")).where("href is not null")


def defaults_by_model(nodes: DataFrame, read: Callable[[str], str], bases: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """``nodes`` with the attribute defaults of the RelaxNG grammar that each document names; all documents in one pass.

    Every grammar named is compiled once on the driver (``most`` at most); the rules of all
    are one table, met by grammar and element.  A grammar that ``read`` doesn't find
    (``KeyError`` or ``OSError``) gives no defaults, and neither does none.
    """
    named = model_references(nodes)
    if bases is not None:
        named = named.join(bases, "doc_id", "left").select("doc_id", joined_path(F.col("base"), F.col("href")).alias("href"))
    named = stored(named)
    hrefs = sorted(r["href"] for r in named.select("href").distinct().limit(most + 1).collect())
    if len(hrefs) > most:
        raise ValueError(f"more than {most} grammars")
    rows = []
    for href in hrefs:
        try:
            grammar = RelaxNg(posixpath.normpath(href), read)
        except (KeyError, OSError):
            continue
        rows += [(href, ns, e, a, v, 0) for (ns, e, a), v in grammar.defaults.items()]
    rules = nodes.sparkSession.createDataFrame(rows, "href string, ns string, element string, attribute string, default_value string, priority int")
    return merge_gathered(nodes.join(named, "doc_id", "left"), gathered_rules(rules, "href"), "href").select(nodes.columns)

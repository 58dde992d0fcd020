"""Identity: ID and IDREF, unique, key and keyref, as grouped checks and anti-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .navigate import field, select

TUPLE = "doc_id", "anc_pre"


def duplicate_ids(ids: DataFrame) -> DataFrame:
    """``doc_id, value, n`` of ID values (``doc_id, value``) that occur more than once in a document."""
    return ids.groupBy("doc_id", "value").agg(F.count("*").alias("n")).where("n > 1")


def dangling_references(references: DataFrame, ids: DataFrame) -> DataFrame:
    """References (``doc_id, value``) without an ID in their document."""
    return references.join(ids.select("doc_id", "value").distinct(), ["doc_id", "value"], "left_anti")


def tuples(scopes: DataFrame, nodes: DataFrame, selector: str, fields: Sequence[str]) -> DataFrame:
    """``doc_id, anc_pre, pre, f0, f1 ...``: the selected elements of each scope with their fields."""
    found = select(scopes, nodes, selector)
    for k, path in enumerate(fields):
        found = field(found, nodes, path, f"f{k}")
    return found.select("doc_id", "anc_pre", "pre", *[f"f{k}" for k in range(len(fields))])


def _names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("doc_id", "anc_pre", "pre")]


def repeated(rows: DataFrame) -> DataFrame:
    """Full tuples that occur more than once in a scope, with ``n``."""
    names = _names(rows)
    return rows.dropna(subset=names).groupBy("doc_id", "anc_pre", *names).agg(F.count("*").alias("n")).where("n > 1")


def incomplete(rows: DataFrame) -> DataFrame:
    """Tuples of a key that lack a field."""
    return rows.where(" or ".join(f"{n} is null" for n in _names(rows)))


def unmatched(references: DataFrame, keys: DataFrame) -> DataFrame:
    """Full keyref tuples without a key tuple in the same scope."""
    names = _names(references)
    return references.dropna(subset=names).join(keys.select("doc_id", "anc_pre", *names).distinct(), ["doc_id", "anc_pre", *names], "left_anti")


def rising(scopes: DataFrame, references: DataFrame, key_scopes: DataFrame, keys: DataFrame) -> DataFrame:
    """Key tuples that rise to ``scopes`` (``doc_id, pre, post``) from key scopes further below, with the upper scope as ``anc_pre``.

    A key holds above its scope unless several scopes side by side hold the same values; of
    scopes inside each other the outer one counts.  Only values that ``references`` of a
    scope ask for are looked up, by equality on document and values.
    """
    names = _names(references)
    upper = scopes.select("doc_id", F.col("pre").alias("anc_pre"), F.col("post").alias("anc_post")).distinct()
    asked = references.dropna(subset=names).select("doc_id", "anc_pre", *names).distinct().join(upper, ["doc_id", "anc_pre"])
    lower = key_scopes.select("doc_id", F.col("pre").alias("key_pre"), F.col("post").alias("key_post")).distinct()
    held = keys.dropna(subset=names).select("doc_id", F.col("anc_pre").alias("key_pre"), *names).distinct().join(lower, ["doc_id", "key_pre"])
    met = asked.join(held, ["doc_id", *names]).where("key_pre > anc_pre and key_pre <= anc_post")
    before = Window.partitionBy("doc_id", "anc_pre", *names).orderBy("key_pre").rowsBetween(Window.unboundedPreceding, -1)
    outer = met.withColumn("covered", F.max("key_post").over(before)).where("covered is null or key_pre > covered")
    return outer.groupBy("doc_id", "anc_pre", *names).agg(F.count("*").alias("n")).where("n = 1").drop("n")

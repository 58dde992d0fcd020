"""Attribute defaults: a broadcast rule table put into the elements that lack them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import local_of
from ..plans.assess import SchemaGrammar

SCHEMA = "ns string, element string, attribute string, default_value string, priority int"


def default_table(spark: SparkSession, *sources: dict[tuple[str | None, str, str], str]) -> DataFrame:
    """Defaults of several grammars, the first grammar first; keys are (namespace or None, element, attribute)."""
    rows = [(ns, e, a, v, p) for p, source in enumerate(sources) for (ns, e, a), v in source.items()]
    return spark.createDataFrame(rows, SCHEMA)


def merge_defaults(nodes: DataFrame, defaults: DataFrame) -> DataFrame:
    """``nodes`` whose elements have the declared defaults for the attributes they lack.

    A rule with a namespace comes before one without, an earlier grammar before a later.
    The rules are as many as the grammars declare, so they are gathered by element and
    broadcast; documents aren't moved.
    """
    return merge_gathered(nodes, gathered_rules(defaults))


def gathered_rules(defaults: DataFrame, *keys: str) -> DataFrame:
    """The rules of each element (and of each value of ``keys``, such as the grammar) in one row."""
    rule = F.struct("priority", F.col("ns").isNull().alias("any_ns"), "attribute", "ns", "default_value")
    return defaults.groupBy("element", *keys).agg(F.sort_array(F.collect_list(rule)).alias("rules"))


def merge_gathered(nodes: DataFrame, rules: DataFrame, *keys: str) -> DataFrame:
    own = nodes.withColumn("element", F.when(F.col("kind") == "element", local_of(F.col("name"))))
    fits = F.filter("rules", lambda r: r["ns"].isNull() | (r["ns"] == F.coalesce("ns_uri", F.lit(""))))
    missing = F.filter(fits, lambda r: ~F.exists("attrs", lambda a: a["name"] == r["attribute"]))
    # of several rules for one attribute the first holds
    first = F.aggregate(
        missing,
        F.array().cast("array<struct<name:string,value:string>>"),
        lambda out, r: F.when(F.exists(out, lambda o: o["name"] == r["attribute"]), out).otherwise(
            F.array_append(out, F.struct(r["attribute"].alias("name"), r["default_value"].alias("value")))
        ),
    )
    met = own.join(F.broadcast(rules), ["element", *keys], "left")
    return met.withColumn("attrs", F.when(F.col("rules").isNotNull(), F.concat("attrs", first)).otherwise(F.col("attrs"))).select(nodes.columns)


_PAIRS = "array<struct<name:string,value:string>>"


def fill_by_rule(nodes: DataFrame, grammar: SchemaGrammar) -> DataFrame:
    """``nodes`` (parsed with the grammar) whose elements have the default and fixed attributes of their own type.

    The type is the one that the element has where it stands, ``xsi:type`` included, so
    namesakes of other types stay as they are.  A default of a namespace takes a prefix that
    is bound to it where the element stands (the first in order), and its plain name where
    none is; elements below a skipping wildcard are left alone.
    """
    rows = []
    for k, r in enumerate(grammar.rules):
        given = [(a.ns, a.name, a.token, a.default if a.default is not None else a.fixed) for a in r.type.attributes.values()]
        own = [g for g in given if g[3] is not None]
        if own:
            rows.append((k, own))
    rules = nodes.sparkSession.createDataFrame(rows, "rule_id int, missing array<struct<ns:string,local:string,token:string,value:string>>")
    met = nodes.withColumn("rule_id", F.coalesce("typed", "declared")).join(F.broadcast(rules), "rule_id", "left")
    lacking = F.filter("missing", lambda m: ~F.coalesce(F.array_contains("tokens", m["token"]), F.lit(False)))

    def named(m):
        bound = F.array_min(F.map_keys(F.map_filter("scope", lambda p, uri: (uri == m["ns"]) & (p != ""))))
        name = F.when((m["ns"] != "") & bound.isNotNull(), F.concat(bound, F.lit(":"), m["local"])).otherwise(m["local"])
        return F.struct(name.alias("name"), m["value"].alias("value"))

    filled = F.concat("attrs", F.coalesce(F.transform(lacking, named), F.array().cast(_PAIRS)))
    return met.withColumn("attrs", F.when(F.col("missing").isNotNull() & ~F.col("skipped"), filled).otherwise(F.col("attrs"))).select(nodes.columns)


def texts_by_rule(nodes: DataFrame, grammar: SchemaGrammar) -> DataFrame:
    """``doc_id, pre, name, text`` of elements parsed with the grammar: own text, the declared default or fixed value where the element is empty."""
    values = [(k, r.default if r.default is not None else r.fixed) for k, r in enumerate(grammar.rules) if r.default is not None or r.fixed is not None]
    declared = nodes.sparkSession.createDataFrame(values, "declared int, default_text string")
    met = nodes.where("kind = 'element'").join(F.broadcast(declared), "declared", "left")
    empty = (F.col("text") == "") & (F.col("sequence") == "") & ~F.col("nil")
    return met.select("doc_id", "pre", "name", F.when(empty & F.col("default_text").isNotNull(), F.col("default_text")).otherwise(F.col("text")).alias("text"))


def insert_text_defaults(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_id, pre, text``: own text of each element, the declared default where it has no content (``element, default_text``)."""
    own = nodes.where("kind = 'element'").withColumn("element", local_of(F.col("name")))
    value = nodes.where("kind in ('text', 'cdata') and parent >= 0").groupBy("doc_id", F.col("parent").alias("pre")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "value"))), lambda p: p["value"]), "").alias("text")
    )
    empty = F.col("pre") == F.col("post")
    return (
        own.join(F.broadcast(texts), "element", "left")
        .join(value, ["doc_id", "pre"], "left")
        .select("doc_id", "pre", "name", F.when(empty & F.col("default_text").isNotNull(), F.col("default_text")).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    )

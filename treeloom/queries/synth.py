"""XML documents made of the relational tables, inside each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_attribute, escape_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def element(name: str, *content, **attrs) -> F.Column:
    """An element's text as an expression; attributes and content are columns or texts."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v.cast("string")
    head = [F.lit(f"<{name}")]
    for k, v in attrs.items():
        head += [F.lit(f' {k.rstrip("_")}="'), as_column(v), F.lit('"')]
    return F.concat(*head, F.lit(">"), *map(as_column, content), F.lit(f"</{name}>"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, xml``: an order with its lines, by number.

    Merged, since the lines already lie by order: a broadcast found at run time would leave
    the documents in as many tasks as the orders have files, and parsing needs all cores.
    """
    li = table(spark, sf_dir, "lineitem")
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("long").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price100")
    )
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    text = F.transform(
        "lines",
        lambda x: element("line", element("qty", x["qty"]), element("price100", x["price100"]), n=x["l_linenumber"], part=x["l_partkey"], supp=x["l_suppkey"], flag=x["l_returnflag"]),
    )
    o = table(spark, sf_dir, "orders")
    return o.hint("merge").join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("doc_id"),
        element("order", F.coalesce(F.array_join(text, ""), F.lit("")), key=F.col("o_orderkey"), cust=F.col("o_custkey"), status=F.col("o_orderstatus")).alias("xml"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, xml`` in the namespace ``urn:c``; every third customer has no segment."""
    c = table(spark, sf_dir, "customer")
    seg = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(' seg="'), F.col("c_mktsegment"), F.lit('"'))).otherwise("")
    return c.select(
        F.col("c_custkey").alias("doc_id"),
        F.concat(F.lit('<c:customer xmlns:c="urn:c" key="'), F.col("c_custkey").cast("string"), F.lit('"'), seg, F.lit("><c:name>"), escape_text(F.col("c_name")), F.lit("</c:name><bal100>"), F.round(F.col("c_acctbal") * 100).cast("long").cast("string"), F.lit("</bal100></c:customer>")).alias("xml"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, xml``: text escaped and as CDATA, a comment and a processing instruction."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit('<doc id="'), F.col("doc_id").cast("string"), F.lit('" lang="'), escape_attribute(F.col("lang")), F.lit('" source="'), escape_attribute(F.col("source")), F.lit('"><t>'), escape_text(F.col("text")), F.lit("</t><!-- n --><?src x?><![CDATA["), F.col("text"), F.lit("]]></doc>")).alias("xml"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, xml``: a conversation's turns as empty elements named by their role."""
    c = table(spark, sf_dir, "conversations")
    turns = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda t: F.concat(F.lit("<"), t["role"], F.lit("/>"))), "")
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.lit("<conv>"), turns, F.lit("</conv>")).alias("xml"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("doc_id"), element("event", element("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), element("value100", F.round(F.col("value") * 100).cast("long")), element("props", escape_text(F.col("props"))), id=F.col("event_id"), type=F.col("event_type")).alias("xml"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order heads, broken in seven ways by ``o_orderkey % 8``; 0 is intact."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 8
    key = F.col("o_orderkey").cast("string")
    xml = (
        F.when(k == 0, F.concat(F.lit("<order><k>"), key, F.lit("</k></order>")))
        .when(k == 1, F.concat(F.lit("<order><k>"), key, F.lit("</q></order>")))
        .when(k == 2, F.concat(F.lit('<order a="1" a="2">'), key, F.lit("</order>")))
        .when(k == 3, F.concat(F.lit("<order>]]>"), key, F.lit("</order>")))
        .when(k == 4, F.concat(F.lit("<order>&nothing;"), key, F.lit("</order>")))
        .when(k == 5, F.concat(F.lit("<order>"), key, F.lit("</order><order/>")))
        .when(k == 6, F.concat(F.lit("<order>a & b"), key, F.lit("</order>")))
        .otherwise(F.concat(F.lit("<order><k>"), key, F.lit("</k>")))
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), xml.alias("xml"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document: parts that refer to the part behind them, the last one to none."""
    p = table(spark, sf_dir, "part")
    one = F.struct("p_partkey", F.concat(F.lit('<part id="p'), F.col("p_partkey").cast("string"), F.lit('" ref="p'), (F.col("p_partkey") + 1).cast("string"), F.lit('"/>')).alias("xml"))
    # as many documents as blocks of a thousand parts
    return p.groupBy((F.floor(F.col("p_partkey") / 1000)).cast("long").alias("doc_id")).agg(F.concat(F.lit("<parts>"), F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["xml"]), ""), F.lit("</parts>")).alias("xml"))

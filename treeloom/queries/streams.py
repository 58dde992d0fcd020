"""Queries on documents that arrive in pieces, replayed from files by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NODES
from ..plans.lineage import fresh_folder
from ..streaming import CHUNKS, ITEMS, TIMED_CHUNKS, json_items, parse_pieces, split_chunks
from .synth import table


def replayed(spark: SparkSession, stream: DataFrame, schema) -> DataFrame:
    """All that a stream gives out until its source is used up."""
    target = fresh_folder(spark)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", fresh_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(target)


def gathered(rows: DataFrame, by: Column, order: str, one: Column, head: str, between: str, tail: Column) -> DataFrame:
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), one.alias("x")))), lambda r: r["x"])
    return rows.groupBy(by.alias("doc_id")).agg(F.concat(F.lit(head), F.array_join(parts, between)).alias("body")).select("doc_id", F.concat("body", tail).alias("whole"))


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents that hold all customers."""
    key = F.col("c_custkey")
    one = F.concat(F.lit('<o k="'), key.cast("string"), F.lit('">'), F.round(F.col("c_acctbal") * 100).cast("long").cast("string"), F.lit("</o>"))
    return gathered(table(spark, sf_dir, "customer"), key % 20, "c_custkey", one, '<?xml version="1.0"?><db xmlns="urn:a">', "", F.lit("</db>"))


def stream_nodes_while_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of 997 characters, some files of them at a time; nodes are given out at each, state holds open elements."""
    source = fresh_folder(spark)
    split_chunks(_accounts(spark, sf_dir), 997, "whole").repartitionByRange(6, "chunk").write.parquet(source)
    nodes = replayed(spark, parse_pieces(spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 2).parquet(source)), NODES)
    inner = nodes.where("kind != 'declaration'")
    return inner.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("pre").alias("pres"), F.sum("post").alias("posts"), F.sum(F.when(F.col("kind") == "text", F.col("value").cast("long"))).alias("bal100"), F.count_if(F.col("ns_uri") == "urn:a").alias("in_space"))


def stream_unfinished_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document never gets its last chunk, every seventh is broken: event time passes, and each is told by one row."""
    source, c = fresh_folder(spark), table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    xml = F.concat(F.lit("<c><n>"), F.col("c_name"), F.when(key % 7 == 0, "</m>").otherwise("</n>"), F.lit("<m/><m/><m/><m/></c>"))
    chunks = split_chunks(c.select(key.alias("doc_id"), xml.alias("xml")), 16).where("not last or doc_id % 3 != 0")
    day = lambda d: F.to_timestamp(F.lit(f"2024-01-0{d}"))
    chunks.withColumn("at", day(1)).repartition(3, "chunk").write.parquet(source)
    for d in (3, 5):  # other documents, days later
        spark.range(1).select((-F.lit(d)).cast("long").alias("doc_id"), F.lit(0).alias("chunk"), F.lit(True).alias("last"), F.lit("<x/>").alias("text"), day(d).alias("at")).write.mode("append").parquet(source)
    stream = spark.readStream.schema(TIMED_CHUNKS).option("maxFilesPerTrigger", 3).parquet(source)
    nodes = replayed(spark, parse_pieces(stream, patience="1 hour"), NODES).where("doc_id >= 0")
    return nodes.groupBy(F.col("doc_id").alias("c_custkey")).agg(F.count_if(F.col("kind") == "element").alias("elements"), F.max(F.when(F.col("kind") == "error", F.col("value"))).alias("error"))


def stream_json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of events in chunks of 61 characters: an item is given out when it ends; rubbish behind the end and an end too early are errors."""
    e, source = table(spark, sf_dir, "events"), fresh_folder(spark)
    one = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "type": "'), F.col("event_type"), F.lit('", "props": '), F.col("props"), F.lit("}"))
    doc = F.col("user_id") % 32
    ends = F.when(F.col("doc_id") % 5 == 1, "] x").when(F.col("doc_id") % 5 == 2, "").otherwise(" ]\n")
    docs = gathered(e, doc, "event_id", one, "[ ", " ,", ends)
    split_chunks(docs, 61, "whole").repartitionByRange(4, "chunk").write.parquet(source)
    items = replayed(spark, json_items(spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 2).parquet(source)), ITEMS)
    return items.groupBy("doc_id").agg(F.count("item").alias("n"), F.sum(F.get_json_object("item", "$.id").cast("long")).alias("ids"), F.sum(F.get_json_object("item", "$.props.k").cast("long")).alias("ks"), F.count("error").alias("errors"))


QUERIES = {f.__name__: f for f in (stream_nodes_while_reading, stream_unfinished_documents, stream_json_items)}

ORACLES = {
    "stream_nodes_while_reading": "select c_custkey % 20 as doc_id, 1 + 2 * count(*) as n, (1 + count(*) * 2) * (count(*) * 2 + 2) // 2 as pres, (1 + count(*) * 2) * (count(*) * 2 + 2) // 2 + 3 * count(*) as posts, cast(sum(cast(round(c_acctbal * 100) as bigint)) as bigint) as bal100, 1 + count(*) as in_space from customer group by 1",
    "stream_unfinished_documents": "select c_custkey, case when c_custkey % 7 = 0 then 0 when c_custkey % 3 = 0 then 2 else 6 end::bigint as elements, case when c_custkey % 7 = 0 then 'mismatched tag' when c_custkey % 3 = 0 then 'document not finished' end as error from customer",
    "stream_json_items": """with docs as (select user_id % 32 as doc_id, event_id, cast(json_extract(props, '$.k') as bigint) as k from events)
select doc_id, count(*) as n, cast(sum(event_id) as bigint) as ids, cast(sum(k) as bigint) as ks, cast(max(case when doc_id % 5 in (1, 2) then 1 else 0 end) as bigint) as errors from docs group by 1""",
}

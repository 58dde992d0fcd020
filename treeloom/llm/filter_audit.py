"""Filter interaction audit: what each of five filters removes, in every order of applying them.

Each document's failures are one small bit mask.  The replay is relational: every document
meets the 120 orders (a table of fixed size, broadcast), its first failing step is worked
out, the five steps are exploded, and conditional counts are added up in the map tasks;
only a row for each part, order and step and task is shuffled.  Text is read once, to make
the mask and a digest of the text.

Edge cases: a null text is empty, a null ``lang`` is the part of the empty string; a row
without a doc_id is never later than another, so it doesn't fail E (its text still isn't
an earlier one for others); repeated rows are counted each, and don't fail E for one
another; a doc_id that is rated more than once counts as good, or toxic, if one rating says
so; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, cut, hot_keys, salted_join, whole_text

FILTERS = "ABCDE"
BITS = {name: 1 << at for at, name in enumerate(FILTERS)}
BLANKS = r"[\x20\x09-\x0D]+"


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, fails, digest, spot`` for every row; ``fails`` holds the bits of A to D, ``spot`` hashes the digest."""
    text = whole_text()
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    words = F.array_remove(F.split("text", BLANKS), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length("text") - F.length(F.regexp_replace("text", f"[{UPPER[0]}-{UPPER[-1]}]+", ""))
    bit = lambda name, broken: F.when(broken, BITS[name]).otherwise(0)
    fails = (
        bit("A", n < 200)
        .bitwiseOR(bit("B", 100 * distinct < 50 * n))
        .bitwiseOR(bit("C", 100 * capitals > 3 * F.length("text")))
        .bitwiseOR(bit("D", F.col("text").rlike(r"[#$%&*|]")))
    )
    flagged = read.select("doc_id", "part", fails.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest"))
    return flagged.withColumn("spot", F.xxhash64("digest"))


def with_copies(flagged: DataFrame) -> DataFrame:
    """Add the bit of E where a smaller doc_id has the same text; a text with many copies is spread over tasks."""
    first = (
        flagged.groupBy("spot", "digest")
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("count"))
        .where("count > 1")
    )
    first = cut(first)
    hot = hot_keys(first.groupBy("spot").agg(F.sum("count").alias("count")), "spot")
    met = salted_join(flagged, first.drop("count"), "spot", hot, "doc_id", "left", also=("digest",))
    late = F.when(F.col("doc_id") > F.col("first"), BITS["E"]).otherwise(0)
    return met.select("doc_id", "part", F.col("fails").bitwiseOR(late).alias("fails"))


def orders(spark: SparkSession) -> DataFrame:
    """``filter_order, bits``: all 120 orders of the five filters."""
    every = ["".join(p) for p in permutations(FILTERS)]
    return spark.createDataFrame([(o, [BITS[x] for x in o]) for o in every], "filter_order string, bits array<int>")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` with ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``docs`` has ``doc_id, text, lang``; ``labels`` has ``doc_id, quality, toxic``.
    """
    flagged = cut(failures(docs))
    rated = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    masks = with_copies(flagged).join(rated, "doc_id", "left").select("part", "fails", "good", "toxic")

    fails_at = lambda step: F.col("fails").bitwiseAND(F.col("bits")[step]) != 0
    first = F.when(fails_at(0), 1)
    for step in range(1, len(FILTERS)):
        first = first.when(fails_at(step), step + 1)
    replayed = (
        masks.crossJoin(F.broadcast(orders(docs.sparkSession)))
        .withColumn("first", first.otherwise(len(FILTERS) + 1))
        .select("part", "filter_order", "fails", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit"))
        .withColumn("step", F.col("at") + 1)
    )
    here = F.col("first") == F.col("step")
    counted = replayed.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if((F.col("fails").bitwiseAND(F.col("bit")) != 0) & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("fails") == F.col("bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    own = Window.partitionBy("part", F.substr("filter_order", "step", F.lit(1)))
    return counted.withColumn("shapley", F.sum("removed").over(own))

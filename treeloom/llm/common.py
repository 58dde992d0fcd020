"""Shared helpers: table access, lineage cuts, joins with hot keys, ASCII lower-casing."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables under ``sf_dir``, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only where it is unset take a local folder (single-machine tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="treeloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there: later reads don't recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key is hot with more than this share of all rows (one in ``HOT_PARTS``), and with more than ``HOT_LEAST`` rows.
HOT_PARTS, HOT_LEAST = 1000, 1000


def hot_keys(counts: DataFrame, key: str) -> dict[int, int]:
    """Hot values of a long column and the number of parts that each needs, from ``counts`` (``key, count``).

    Fewer than ``HOT_PARTS`` keys can each hold more than that share, so the result is bounded.
    """
    total = counts.agg(F.sum("count")).first()[0] or 0
    part = max(HOT_LEAST, total // HOT_PARTS)
    return {r[key]: -(-r["count"] // part) for r in counts.where(F.col("count") > part).select(key, "count").collect()}


def salted_join(many: DataFrame, one: DataFrame, key: str, hot: dict[int, int], by: str, how: str = "inner", also: tuple[str, ...] = ()) -> DataFrame:
    """``many.join(one, [key, *also])`` where rows of a hot key are spread by ``by``; ``one`` is repeated for each of its parts."""
    if not hot:
        return many.join(one, [key, *also], how)
    known = F.create_map(*[F.lit(x).cast(kind) for pair in hot.items() for x, kind in zip(pair, ("long", "int"), strict=True)])
    parts = F.coalesce(known[F.col(key)], F.lit(1))
    spread = many.withColumn("hot_part", F.pmod(F.xxhash64(by), parts).cast("int"))
    repeated = one.withColumn("hot_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.join(repeated, [key, "hot_part", *also], how).drop("hot_part")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))

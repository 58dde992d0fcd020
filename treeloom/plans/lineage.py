"""Results kept in the shared checkpoint folder: parsed once, read by many branches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where it is unset on one machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="treeloom-"))
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession) -> str:
    """A folder of its own that all executors see."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as columns and read from there; survives lost executors."""
    folder = fresh_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

"""Small relations kept for several uses in one plan."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names; only local mode, as in tests, may do without."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        named = context.getCheckpointDir()
    return named


def stored(df: DataFrame) -> DataFrame:
    """The relation as a table in the checkpoint folder.

    Unlike a cached relation, a stored one lets Spark see that two branches of a
    plan are the same and run their shuffles once, and it survives lost executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/docsift-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class FolderRefused(RuntimeError):
    pass


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine, if the session runs on it alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise FolderRefused("set spark.checkpoint.dir to a folder that all executors share")
    return os.environ.setdefault("QUILTREL_LOCAL_SHARED", tempfile.mkdtemp(prefix="quiltrel-"))


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """df, stored and read back: what follows never computes it again, whichever executor is lost."""
    path = fresh_folder(df.sparkSession, f"tables/{label}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Boundaries between the ordered stages of a long plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where it names none, one of this session's own.

    The session's own folder is on this machine, so it is for local masters only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    own = tempfile.mkdtemp(prefix="subtide-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder, computed now.

    What comes after plans from the table alone, so a stage that is used
    twice is neither planned nor computed twice, reads only the columns it
    needs, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/subtide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

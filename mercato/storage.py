"""Intermediate tables that several jobs read."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once as Parquet to the shared folder: read columnar, whole after the loss of any executor, and in no cache.

    The files stay, as those of a checkpoint do, and are left to the folder's retention.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(observation: Observation) -> dict | None:
    """What was observed while an action ran; None if Spark found out that the frame is empty and dropped the observation with it."""
    try:
        return observation.get or None
    except Py4JJavaError:
        return None

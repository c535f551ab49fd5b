"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters whose case is folded where only A-Z counts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """Words between runs of ASCII white space."""
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")


def remainder_of_id(key: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"


class Stored:
    """Intermediate tables as Parquet in the shared folder: they survive lost executors and cut the lineage."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        # The schema is known, so reading it back starts no job.
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Remove the files of a table saved here that nothing reads any more."""
        for file in df.inputFiles()[:1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getParent().getName() == self.folder.rsplit("/", 1)[1]:
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

"""CSV whose quoted fields hold line breaks, read by many tasks per file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_multiline_csv(spark: SparkSession, path: str, schema: T.StructType, options: Mapping[str, str]) -> DataFrame:
    """Rows of the CSV files under ``path``, as Spark's ``multiLine`` reader gives them, which reads each file in a single task.

    Spark splits the files by byte ranges as it does for text. Whether a line break lies within quotes follows from the number of quotes before it: each
    range counts its lines with an odd number of quotes, prefix sums over the ranges of a file give every range its start, and a running sum
    within the range does the rest. Lines that are whole records go straight to the parser; only lines of records that span several are
    grouped. A record may reach over any number of ranges.

    Quotes are escaped by doubling, and quotes in unquoted fields are not allowed: they are malformed, and ``mode`` FAILFAST stops at the first record
    that does not fit the schema. A file whose last quote is not closed stops the load, since no task should gather the rest of it. The
    first record of each file must be the schema's column names. Empty lines are left out, a carriage return at a record's end is
    dropped. A folder without rows gives no rows.
    """
    lines = _lines(spark, path)
    ranges = lines.groupBy("file", "start").agg(F.sum("odd").alias("odds"), F.min_by(F.col("line").endswith("\r"), "place").alias("returns"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    in_file = F.sum("odds").over(Window.partitionBy("file"))
    closed = F.when(in_file % 2 == 1, F.raise_error(F.concat(F.lit("A quote is not closed in "), "file"))).otherwise(F.lit(0))
    # As in Spark's reader the end of the first line tells what ends a file's lines; within quotes that is read as a line break.
    returns = F.bool_or((F.col("start") == 0) & F.col("returns")).over(Window.partitionBy("file"))
    offsets = ranges.select(
        "file", "start", (F.coalesce(F.sum("odds").over(earlier), F.lit(0)) + closed).alias("offset"), returns.alias("returns")
    )

    within = Window.partitionBy("file", "start").orderBy("place")
    before = F.coalesce(F.sum("odd").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = (
        lines.withColumns({"before": before, "first": (F.col("start") == 0) & (F.row_number().over(within) == 1)})
        .join(offsets, ["file", "start"])
        .withColumn("odds_before", F.col("offset") + F.col("before"))
    )
    # The k-th pair of lines with an odd number of quotes opens and closes the k-th record of several lines; between them the count is odd.
    several = (F.col("odd") == 1) | (F.col("odds_before") % 2 == 1)
    single = marked.where(~several).select("first", _without_return(F.col("line")).alias("record"))
    parts = F.sort_array(F.collect_list(F.struct("start", "place", "line")))
    joined = (
        marked.where(several)
        .groupBy("file", F.floor(F.col("odds_before") / 2).alias("record"))
        .agg(
            F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"),
            F.bool_or("first").alias("first"),
            F.bool_or("returns").alias("returns"),
        )
        .withColumn("text", F.when(F.col("returns"), F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text")))
        .select("first", _without_return(F.col("text")).alias("record"))
    )
    names = ",".join(schema.names)
    header = F.lower(F.translate("record", '"', "")) == names.lower()
    checked = F.when(F.col("first") & ~header, F.raise_error(F.concat(F.lit("Unexpected header: "), "record"))).otherwise(~F.col("first"))
    records = single.union(joined).where(checked & (F.col("record") != ""))
    parsed = F.from_csv("record", schema.toDDL(), {**options, "multiLine": "true"})
    return records.select(parsed.alias("r")).select("r.*")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the first byte of their range, their place in it, and whether they have an odd number of quotes.

    The lines of a range are read by one task in their order, so the numbers that Spark gives a task's rows rise within a range.
    """
    line = F.col("value")
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("place"),
            line.alias("line"),
            ((F.length(line) - F.length(F.replace(line, F.lit('"')))) % 2).alias("odd"),
        )
    )


def _without_return(text: Column) -> Column:
    return F.when(text.endswith("\r"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)

"""Calendar expressions that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(moment: Column | str) -> Column:
    """First instant of the month as ``timestamp_ntz``.

    Goes through DATE because ``date_trunc`` answers with a zoned timestamp.
    """
    moment = F.col(moment) if isinstance(moment, str) else moment
    return F.trunc(moment.cast("date"), "month").cast("timestamp_ntz")


def month_index(moment: Column | str) -> Column:
    """Months since year 0, so that the difference of two indexes counts calendar months."""
    moment = F.col(moment) if isinstance(moment, str) else moment
    return F.year(moment) * 12 + F.month(moment) - 1


def month_from_index(index: Column | str) -> Column:
    index = F.col(index) if isinstance(index, str) else index
    year = F.floor(index / 12).cast("int")
    return F.make_date(year, (index % 12 + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")


def days_late(delivered: Column | str, promised: Column | str) -> Column:
    """Calendar days from promised to delivered; NULL when either is missing."""
    delivered = F.col(delivered) if isinstance(delivered, str) else delivered
    promised = F.col(promised) if isinstance(promised, str) else promised
    return F.datediff(delivered.cast("date"), promised.cast("date"))

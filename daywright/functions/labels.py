"""Window labels and date text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats.
LABEL_SEPARATOR = " → "
DATE_FORMAT = "yyyy-MM-dd"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def window_label(start: Column, end: Column) -> Column:
    return F.concat(
        F.date_format(start, DATE_FORMAT), F.lit(LABEL_SEPARATOR), F.date_format(end, DATE_FORMAT)
    )


def window_label_start(label: Column) -> Column:
    return F.to_date(F.split(label, LABEL_SEPARATOR)[0], DATE_FORMAT)


def iso_datetime(d: Column) -> Column:
    return F.date_format(d, ISO_FORMAT)

"""Typed columns from text, with account of what could not be read.

Nothing here stops a job: text that can't be read becomes missing, and the row says which columns
that befell. Text that stands for "no value" is missing without being unreadable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text that means "no value", in lower case: fixed values.
NO_VALUE = ("", "na", "n/a", "nan", "null", "none", "-")

#: Layouts of a time, tried in this order after the ISO one. Digits alone are seconds or milliseconds since 1970.
TIME_FORMATS = ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd.MM.yyyy HH:mm", "dd.MM.yyyy", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")

#: Digits from which on a number of the epoch counts milliseconds.
MILLISECOND_DIGITS = 12

REJECTS, CORRUPT = "_rejects", "_corrupt"


def parse_time(text: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """TIMESTAMP_NTZ of a text in ISO form, in one of the formats, or in digits of the epoch; else null."""
    text = F.trim(text)
    digits = text.rlike("^-?[0-9]{9,}$")
    count = text.try_cast("bigint")
    micros = F.when(F.length(F.regexp_replace(text, "^-", "")) >= MILLISECOND_DIGITS, F.try_multiply(count, F.lit(1000))).otherwise(
        F.try_multiply(count, F.lit(1_000_000))
    )
    # The difference of two readings of one clock, so the session's zone plays no part.
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    inside = micros.between(-(1 << 56), 1 << 57)
    stamped = epoch + F.make_dt_interval(secs=(F.when(inside, micros) / F.lit(1_000_000)).cast("decimal(18,6)"))
    spelt = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.when(digits, stamped).otherwise(F.coalesce(text.try_cast("timestamp_ntz"), *spelt))


def read_text(c: Column, kind: str, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """A text as the named type; null where it can't be read or stands for no value."""
    known = F.when(has_value(c), c)
    return parse_time(known, formats) if kind in ("time", "timestamp_ntz") else F.trim(known).try_cast(kind)


def has_value(c: Column) -> Column:
    return c.isNotNull() & ~F.lower(F.trim(c)).isin(*NO_VALUE)


def typed(text: DataFrame, kinds: Mapping[str, str], formats: Sequence[str] = TIME_FORMATS) -> DataFrame:
    """The named text columns as the given types, and ``_rejects``: (column, text) of each value that can't be read.

    A kind is a type's name, or ``time``. The other columns stay. A row cut short or too long by its
    file (``_corrupt``) is a reject as a whole, under the name ``_corrupt``.
    """
    read = {c: read_text(F.col(_quoted(c)), kind, formats) for c, kind in kinds.items()}
    # First the values under other names: a column read twice would be parsed twice.
    made = text.withColumns({f"_typed_{i}": value for i, value in enumerate(read.values())})

    def reject(name: str, value: Column, bad: Column) -> Column:
        return F.when(bad, F.struct(F.lit(name).alias("column_name"), value.alias("text")))

    found = [
        reject(c, F.col(_quoted(c)), has_value(F.col(_quoted(c))) & F.col(f"_typed_{i}").isNull()) for i, c in enumerate(kinds)
    ]
    if CORRUPT in text.columns:
        found.append(reject(CORRUPT, F.col(CORRUPT), F.col(CORRUPT).isNotNull()))
    rejects = F.filter(F.array(*found), lambda r: r.isNotNull()) if found else F.array().cast("array<struct<column_name:string,text:string>>")
    place = {c: f"_typed_{i}" for i, c in enumerate(kinds)}
    columns = [F.col(place[c]).alias(c) if c in place else F.col(_quoted(c)) for c in text.columns if c != CORRUPT]
    return made.withColumn(REJECTS, rejects).select(*columns, REJECTS)


def reject_counts(read: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, values, values that could not be read and the first of them in order; one pass.

    ``_corrupt`` counts whole rows.
    """
    names = [*columns, CORRUPT]

    def of(name: str) -> Column:
        return F.get(F.filter(REJECTS, lambda r: r["column_name"] == name), F.lit(0))["text"]

    cells = []
    for name in names:
        present = F.count(F.col(_quoted(name))) if name in read.columns else F.lit(0).cast("long")
        cells.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count(F.lit(1)).alias("rows"),
                present.alias("values"),
                F.count(of(name)).alias("unreadable"),
                F.min(of(name)).alias("first_unreadable"),
            )
        )
    return read.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"

"""Parquet sources of the market tables."""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daywright.operators.cleaning import repair_timestamps
from daywright.operators.ingest import read_text

# File names: fixed values.
MARKET_FILES = {
    "markets": "finance_politics_markets.parquet",
    "tokens": "finance_politics_tokens.parquet",
    "trades": "finance_politics_trades.parquet",
    "odds_history": "finance_politics_odds_history.parquet",
    "event_stats": "finance_politics_event_stats.parquet",
    "summary": "finance_politics_summary.parquet",
}
EDA_TABLES = ("markets", "odds_history", "summary")

# Columns and types of the tables: fixed values.
MARKET_SCHEMAS = {
    "markets": "market_id string, question string, slug string, event_slug string, category string, volume double, "
    "active boolean, closed boolean, created_at timestamp_ntz, end_date timestamp_ntz",
    "tokens": "market_id string, token_id string, outcome string",
    "trades": "trade_id string, market_id string, token_id string, timestamp timestamp_ntz, price double, size double, "
    "side string, maker_address string, taker_address string",
    "odds_history": "market_id string, token_id string, timestamp timestamp_ntz, price double",
    "event_stats": "event_slug string, market_count bigint, total_volume double, first_market_start timestamp_ntz, "
    "last_market_end timestamp_ntz",
    "summary": "market_id string, question string, slug string, volume double, active boolean, token_count bigint, "
    "trade_count bigint, first_trade timestamp_ntz, last_trade timestamp_ntz",
}


@dataclass(frozen=True)
class Problem:
    """What a load could not use: a whole table, or a file of one."""

    table: str
    path: str
    reason: str


def _first_line(error: Exception) -> str:
    return str(error).splitlines()[0]


def as_declared(df: DataFrame, declared: T.StructType) -> DataFrame:
    """The rows with the declared columns, in their order and types; other columns follow.

    An absent column is null. Values of another type are converted; text is read as times and numbers are, and
    what can't be converted is null.
    """
    have = {f.name: f.dataType for f in df.schema.fields}

    def column(field: T.StructField) -> Column:
        kind = field.dataType.simpleString()
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        c = F.col(f"`{field.name}`")
        if have[field.name] == field.dataType:
            return c
        if isinstance(have[field.name], T.StringType):
            return read_text(c, kind).alias(field.name)
        return c.try_cast(field.dataType).alias(field.name)

    names = {f.name for f in declared.fields}
    return df.select(*[column(f) for f in declared.fields], *[F.col(f"`{c}`") for c in have if c not in names])


def load_table(spark: SparkSession, path: str, declared: T.StructType, name: str = "") -> tuple[DataFrame | None, list[Problem]]:
    """A table of one file or a folder of files whose columns may differ, and the files that can't be read.

    Files that agree on their columns make one scan, whatever their number; only footers are read to
    tell. Columns that are missing, reordered or of another width come out as declared. Nothing
    readable: no table.
    """
    try:
        files = [r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect()]
    except (PySparkException, Py4JJavaError) as error:
        return None, [Problem(name, path, _first_line(error))]
    by_schema: dict[str, list[str]] = {}
    problems = []
    for file in files:
        try:
            by_schema.setdefault(spark.read.parquet(file).schema.json(), []).append(file)
        except (PySparkException, Py4JJavaError) as error:
            problems.append(Problem(name, file, _first_line(error)))
    out = None
    for schema, same in by_schema.items():
        part = as_declared(spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*same), declared)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None and not problems:
        problems.append(Problem(name, path, "no files"))
    return out, problems


def load_market_tables(
    spark: SparkSession,
    folder: str,
    names: Sequence[str] = tuple(MARKET_FILES),
    repair: bool = True,
    problems: list[Problem] | None = None,
) -> dict[str, DataFrame]:
    """Name -> table for what can be read; a warning for each table or file that can't, also put into ``problems``."""
    tables = {}
    for name in names:
        declared = spark.createDataFrame([], MARKET_SCHEMAS[name]).schema
        table, found = load_table(spark, f"{folder.rstrip('/')}/{MARKET_FILES[name]}", declared, name)
        for problem in found:
            warnings.warn(f"{name}: cannot read {problem.path}: {problem.reason}", stacklevel=2)
        if problems is not None:
            problems.extend(found)
        if table is not None:
            tables[name] = repair_timestamps(table) if repair else table
    return tables

"""The link graph of the market tables: joined facts and an audit of the links' integrity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daywright.settings import expansion_partitions


@dataclass(frozen=True)
class Link:
    """Rows of ``child`` name a row of ``parent`` by the key columns, which have the same names in both."""

    child: str
    parent: str
    key: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.child}->{self.parent}"


#: The links of the six tables.
LINKS = (
    Link("tokens", "markets", ("market_id",)),
    Link("trades", "tokens", ("market_id", "token_id")),
    Link("odds_history", "tokens", ("market_id", "token_id")),
    Link("summary", "markets", ("market_id",)),
    Link("markets", "event_stats", ("event_slug",)),
)


def _key(columns: Sequence[str]) -> Column:
    """The key as one text; null if a part of it is."""
    parts = [F.col(c).cast("string") for c in columns]
    # The length before each part keeps ("a", "bc") and ("ab", "c") apart.
    return F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]) if len(parts) > 1 else parts[0]


def _counted(batches: Iterator) -> Iterator:
    """Rows (columns, key, side) in; each batch's different rows with their number `n` out."""
    import pyarrow as pa

    for batch in batches:
        met = pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([([], "count_all")])
        yield from met.rename_columns([*batch.schema.names, "n"]).to_batches()


def link_audit(tables: dict[str, DataFrame], links: Sequence[Link] = LINKS) -> DataFrame:
    """Per link whose two tables are there: what doesn't hold together.

    ``child_rows``, those without a key, ``orphan_rows`` (no such parent) and ``orphan_keys``;
    ``parent_keys``, ``duplicate_keys`` (more than one parent row) and ``childless_keys``.

    No join: each table is read once and gives a key for each set of key columns it is linked by; one
    aggregate by (columns, key) counts the rows of all tables with that key, which serves every link on
    these columns. Equal keys of a batch are counted before the shuffle, so a market with a third of
    all trades is one row a batch by then, and no task holds the keys of its whole input.
    """
    links = [e for e in links if e.child in tables and e.parent in tables]
    sides: dict[tuple[str, ...], list[str]] = {}  # the tables that meet on these columns
    for e in links:
        met = sides.setdefault(tuple(e.key), [])
        met.extend(t for t in dict.fromkeys((e.child, e.parent)) if t not in met)
    if not links:
        raise ValueError(f"no link between {sorted(tables)}")
    numbers = {key: k for k, key in enumerate(sides)}
    tagged = None
    for name, table in tables.items():
        cells = [
            F.struct(F.lit(numbers[key]).alias("columns"), _key(key).alias("key"), F.lit(met.index(name)).alias("side"))
            for key, met in sides.items()
            if name in met
        ]
        if cells:
            rows = table.select(F.inline(F.array(*cells)))
            tagged = rows if tagged is None else tagged.unionByName(rows)
    counted = tagged.mapInArrow(_counted, "columns int, key string, side int, n bigint")
    # A task keeps a row for each of its keys, of which a small shuffled block holds many.
    dealt = counted.repartition(expansion_partitions(tagged.sparkSession), "columns", "key")
    rows_of = [f"n{k}" for k in range(max(map(len, sides.values())))]
    met = dealt.groupBy("columns", "key").agg(*[F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(rows_of)])
    ends = [
        F.struct(
            F.lit(numbers[tuple(e.key)]).alias("of"),
            F.lit(e.name).alias("link"),
            *[F.col(rows_of[sides[tuple(e.key)].index(t)]).alias(c) for t, c in ((e.child, "child"), (e.parent, "parent"))],
        )
        for e in links
    ]
    known, child, parent = F.col("key").isNotNull(), F.col("child"), F.col("parent")
    met = met.select("columns", "key", F.inline(F.array(*ends))).where((F.col("columns") == F.col("of")) & (child + parent > 0))
    orphan = known & (child > 0) & (parent == 0)
    return met.groupBy("link").agg(
        F.sum("child").alias("child_rows"),
        F.coalesce(F.sum(F.when(~known, child)), F.lit(0)).alias("keyless_rows"),
        F.coalesce(F.sum(F.when(orphan, child)), F.lit(0)).alias("orphan_rows"),
        F.count_if(orphan).alias("orphan_keys"),
        F.count_if(known & (parent > 0)).alias("parent_keys"),
        F.count_if(known & (parent > 1)).alias("duplicate_keys"),
        F.count_if(known & (parent > 0) & (child == 0)).alias("childless_keys"),
    )


def link_odds(odds: DataFrame, tokens: DataFrame, markets: DataFrame) -> DataFrame:
    """Odds by token, with the token's outcome and the market's question and event: records, first, last, low and high.

    Odds are reduced to a row a token before they meet the other tables, so a market with most of the
    records is a few rows in the join. Odds without a token or market stay, with nulls.
    """
    at = F.col("timestamp")
    per_token = odds.groupBy("market_id", "token_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.min(at).alias("first_time"),
        F.max(at).alias("last_time"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.max_by("price", F.when(F.col("price").isNotNull(), at)).alias("last_odds"),
    )
    token = tokens.select("market_id", "token_id", "outcome")
    market = markets.select("market_id", "question", "event_slug")
    return per_token.join(token, ["market_id", "token_id"], "left").join(market, "market_id", "left")


def link_events(event_stats: DataFrame, markets: DataFrame) -> DataFrame:
    """Events of either side: what their statistics state and what their markets add up to.

    Markets are reduced to a row an event first. ``known`` tells whether there are statistics, ``agrees``
    whether count and volume are the stated ones.
    """
    counted = markets.where(F.col("event_slug").isNotNull()).groupBy("event_slug").agg(
        F.count(F.lit(1)).alias("markets"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume")
    )
    stated = event_stats.select(
        "event_slug", F.col("market_count").alias("stated_markets"), F.col("total_volume").alias("stated_volume"), F.lit(True).alias("known")
    )
    both = stated.join(counted, "event_slug", "full").fillna(0, ["markets"]).fillna(0.0, ["volume"])
    same = (F.col("stated_markets") == F.col("markets")) & (F.abs(F.col("stated_volume") - F.col("volume")) < 0.005)
    return both.withColumns({"known": F.coalesce("known", F.lit(False)), "agrees": F.coalesce(same, F.lit(False))})

"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities.

Texts are dealt into blocks by a hash, each block lying in one old shard; equal texts share a block.
A text that holds over 1 / `HEAVY` of all bytes is a block of its own, and only if no new shard can
hold it whole is it cut, by doc_id. Block sizes, a table of bounded length, go to the driver; the flow
between old and new shards is solved there with a cost of one for each byte that changes shard, blocks
are chosen to carry it, and rows take their block's new shard. What whole blocks leave uneven is
evened out by the moves that cost least. Then the documents move: the files of the shards that change
are written, texts and all, and the others keep theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywright.llm.common import col, stored
from daywright.settings import scratch_path

BLOCKS, HEAVY, CUTS = 8192, 512, 1024

#: Rows that one task numbers.
NUMBERED = 200_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units from each source to each sink, all supply placed, at the least cost: successive shortest paths."""
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        # Shortest way from a source with supply to a sink with room; residual edges lead back from sinks.
        far = {("s", i): (0, None) for i in range(n) if left[i]}
        for _ in range(n + m):
            changed = False
            for i in range(n):
                if ("s", i) in far:
                    for j in range(m):
                        d = far["s", i][0] + cost[i][j]
                        if ("t", j) not in far or d < far["t", j][0]:
                            far["t", j], changed = (d, i), True
            for j in range(m):
                if ("t", j) in far:
                    for i in range(n):
                        if flow[i][j]:
                            d = far["t", j][0] - cost[i][j]
                            if ("s", i) not in far or d < far["s", i][0]:
                                far["s", i], changed = (d, j), True
            if not changed:
                break
        ends = [j for j in range(m) if room[j] and ("t", j) in far]
        if not ends:
            raise ValueError("the new capacities are less than the old sizes")
        j = end = min(ends, key=lambda j: (far["t", j][0], j))
        path = []
        while True:
            i = far["t", j][1]
            path.append((i, j, 1))
            back = far["s", i][1]
            if back is None:
                break
            path.append((i, back, -1))
            j = back
        step = min([left[i], room[end], *[flow[a][b] for a, b, sign in path if sign < 0]])
        for a, b, sign in path:
            flow[a][b] += sign * step
        left[i] -= step
        room[end] -= step
    return flow


def transfers(blocks: list[tuple[int, int, int]], old: int, capacity: list[int]) -> dict[int, int]:
    """Block -> new shard, for blocks (id, old shard, bytes): the flow's amounts, carried by whole blocks."""
    supply = [0] * old
    for _, shard, size in blocks:
        supply[shard] += size
    new = len(capacity)
    cost = [[int(i != j) for j in range(new)] for i in range(old)]
    want = min_cost_flow(supply, capacity, cost)
    placed, size_of, home, total = {}, {}, {}, [0] * new
    for block, shard, size in sorted(blocks, key=lambda b: (-b[2], b[0])):
        to = max(range(new), key=lambda j: (want[shard][j], j == shard, -j))
        placed[block], size_of[block], home[block] = to, size, shard
        want[shard][to] -= size
        total[to] += size
    # Whole blocks overshoot a little: single moves even that out, first of blocks that move anyway or go home.
    for _ in range(64 * new):
        over = max(range(new), key=lambda j: total[j] - capacity[j])
        under = min(range(new), key=lambda j: total[j] - capacity[j])
        gap = (total[over] - capacity[over] - (total[under] - capacity[under])) // 2
        if gap <= capacity[under] // 2000:
            break
        best = min(
            (b for b, j in placed.items() if j == over and 0 < size_of[b] < 2 * gap),
            key=lambda b: (2 * abs(gap - size_of[b]) > gap, (home[b] == over) - (home[b] == under), abs(gap - size_of[b]), b),
            default=None,
        )
        if best is None:
            break
        placed[best] = under
        total[over] -= size_of[best]
        total[under] += size_of[best]
    return placed


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.lit("block"), F.coalesce(text, F.lit("")))


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(col("text"), F.lit(""))
    return docs.select(
        col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        text_hash(col("text")).alias("h"),
        F.xxhash64(col("doc_id"), col("text")).alias("row"),
        *more,
    )


def _laid(docs: DataFrame, shards: int, old_shards: int, capacity: list[int] | None, texts: bool) -> DataFrame | None:
    """(doc_id, size, text_crc32, old_shard, shard, slot) of every document, with `whole`, its columns, if `texts`; none for no rows."""
    rows = stored(_sized(docs), "sizes")
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return None
    capacity = capacity or even(total, shards)
    # At most HEAVY rows by their definition, so the broadcast below has a bound.
    heavy = rows.groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > total / HEAVY).orderBy("h").collect()
    limit = max(capacity)
    listed = [(r["h"], BLOCKS + k * CUTS, 1 if r["bytes"] <= limit else min(CUTS, int(64 * r["bytes"] / limit))) for k, r in enumerate(heavy)]
    spark = docs.sparkSession
    known = spark.createDataFrame(listed, "h long, first int, parts int")
    block = F.coalesce(F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.pmod("h", F.lit(BLOCKS)).cast("int"))

    def marked(rows, *more):
        old = F.pmod(F.pmod("h", F.lit(BLOCKS)), F.lit(old_shards)).cast("int").alias("old_shard")
        return rows.join(F.broadcast(known), "h", "left").select("doc_id", "size", "text_crc32", "row", block.alias("block"), old, *more)

    sizes = marked(rows).groupBy("block", "old_shard").agg(F.sum("size").alias("bytes")).collect()  # at most (BLOCKS + HEAVY x CUTS) rows
    placed = transfers([(r["block"], r["old_shard"], r["bytes"]) for r in sizes], old_shards, capacity)
    moves = spark.createDataFrame([(b, s) for b, s in placed.items()], "block int, shard int")
    parts = max(1, -(-count // NUMBERED))

    def sent(marked):
        return marked.join(F.broadcast(moves), "block").withColumn("part", F.pmod("row", F.lit(parts * 4)).cast("int"))

    more = ["whole"] if texts else []
    at = sent(marked(_sized(docs, F.struct(*map(col, docs.columns)).alias("whole")), *more) if texts else marked(rows))
    at = at.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row")) - 1)
    held = sent(marked(rows)).groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = held.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    out = at.join(before, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"), *more)


def reshard(docs: DataFrame, shards: int, old_shards: int, capacity: list[int] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) of every document.

    The old layout deals blocks of texts over `old_shards`; `capacity` has the new shards' bytes (near
    equal by default; they must sum to the total at least). Size is the text's UTF-8 bytes plus 1.
    Null texts count as empty; repeated rows get slots of their own; an empty table gives no rows.
    Slots are numbered within a shard without a gap, in parts that one task can number.
    """
    laid = _laid(docs, shards, old_shards, capacity, False)
    if laid is None:
        none = [F.lit(0).alias("old_shard"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")]
        return _sized(docs).select("doc_id", "size", "text_crc32", *none)
    return laid


def resharded(docs: DataFrame, shards: int, old_shards: int, capacity: list[int] | None = None) -> DataFrame:
    """(old_shard, shard, slot, whole) of every document, moved as `reshard` says; `whole` has all its columns.

    The files of the shards that a row leaves or enters are written, one folder a shard, and read back;
    rows of the others come from where they lie. Repeated rows and ids are rows of their own.
    """
    laid = _laid(docs, shards, old_shards, capacity, True)
    names = ("old_shard", "shard", "slot", "whole")
    if laid is None:
        none = [F.lit(0).alias("old_shard"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")]
        return docs.select(*none, F.struct(*map(col, docs.columns)).alias("whole"))
    laid = laid.select(*names)
    moved = laid.where("old_shard != shard")
    changed = sorted(r["s"] for r in moved.select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect())  # at most a row a shard
    path = scratch_path(docs.sparkSession, "shards")
    laid.where(F.col("shard").isin(changed)).write.partitionBy("shard").parquet(path)
    written = docs.sparkSession.read.schema(laid.schema).parquet(path).select(*names)
    return written if len(changed) == max(shards, old_shards) else written.unionAll(laid.where(~F.col("shard").isin(changed)))


def rewrite(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Writes the files of the shards that change, below `path` by shard, rows in many tasks a shard; returns those shards.

    A shard changes if a row comes or goes. `placed` is the result of `reshard` on `docs` (doc_id must be
    unique there); shards not returned keep their old files.
    """
    moved = placed.where("old_shard != shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    changed = sorted(r["s"] for r in moved.collect())  # at most a row a shard
    rows = docs.join(placed.where(F.col("shard").isin(changed)).select("doc_id", "shard", "slot"), "doc_id")
    rows.repartition("shard", F.pmod("slot", F.lit(64))).write.partitionBy("shard").parquet(path)
    return changed

"""Exact de-duplication by a content sort.

Texts are compared without the characters `[\\x20\\x09-\\x0D]`. Sampled splitters range-partition
the rows by the normalised bytes, an external sort inside each range puts equal texts next to one
another, and each text is compared in full with its neighbour.

The order is (first bytes of the normalised text, SHA-256 of the whole of it, code points of the
original text descending, id). The digest stands for the bytes after the first ones, so that the
splitters, which pass through the driver, have a bounded size however long a text is; the equality
of two neighbours is always decided on their whole texts. Length and id belong to the sort key, so
a text that a third of all rows share is cut into as many ranges as its rows fill. The runs at the
edges of the ranges (two a range) are then compared across the edge and added up.

Nulls and odd rows: a null text counts as empty; empty texts equal one another. A null id comes
after all others. Rows that repeat in full are copies of each other, and one of them stays. An
empty table gives no rows. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daywright.llm.common import col, stored

#: Bytes of the normalised text in a splitter, before the digest of the whole.
HEAD_BYTES = 32

#: The characters that don't count: space and the ASCII controls tab to carriage return.
IGNORED = " \t\n\x0b\x0c\r"

#: A run of equal texts is the first one of its range, the last one, or both.
FIRST, LAST = 1, 2


def _sorted_texts(docs: DataFrame, id_col: str, text_col: str, row) -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(""))
    shown = docs.select(row.alias("row"), F.translate(text, IGNORED, "").alias("norm"), F.length(text).alias("chars"), col(id_col).alias("id"))
    keyed = shown.select("*", F.substring(F.col("norm").cast("binary"), 1, HEAD_BYTES).alias("head"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    order = ["head", "text_sha256", F.desc("chars"), F.asc_nulls_last("id")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "text_sha256", "norm")


def _runs(heads_only: bool):
    """Marks the runs of equal neighbours of a sorted partition; holds one batch and the small columns of one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before, held, count, runs_done = None, [], 0, 0

        def marked(small: pa.Table, starts, sizes, edge: int, text: str | None) -> pa.Table:
            n = small.num_rows
            kept = np.zeros(n, bool)
            kept[starts] = True
            keep = small["row"].take(pa.array(np.repeat(starts, sizes)))
            texts = [text] + [None] * (n - 1) if edge else pa.nulls(n, pa.string())
            return pa.table(
                {
                    "row": small["row"],
                    "text_sha256": small["text_sha256"],
                    "keep": keep,
                    "size": pa.array(np.repeat(sizes, sizes), pa.int64()),
                    "kept": pa.array(kept),
                    "part": pa.array(np.full(n, part, np.int32)),
                    "edge": pa.array(np.full(n, edge, np.int32)),
                    "edge_text": pa.array(texts, pa.string()),
                }
            )

        def closed(last: bool) -> pa.Table:
            """The held run. Of a run whose copies go, only the first row is held."""
            edge = (FIRST if runs_done == 0 else 0) | (LAST if last else 0)
            small = pa.concat_tables(held)
            if heads_only:
                out = marked(small, np.array([0]), np.array([1]), edge, before)
                return out.set_column(3, "size", pa.array([count], pa.int64()))
            return marked(small, np.array([0]), np.array([count]), edge, before)

        for batch in batches:
            if not batch.num_rows:
                continue
            texts, n = batch.column("norm"), batch.num_rows
            new = np.ones(n, bool)
            new[0] = before is None or texts[0].as_py() != before
            if n > 1:
                new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            small = pa.Table.from_batches([batch]).select(["row", "text_sha256"])
            cuts = np.flatnonzero(new)
            lead = int(cuts[0]) if len(cuts) else n
            if lead:
                count += lead
                if not heads_only:
                    held.append(small.slice(0, lead))
            if len(cuts):
                if count:
                    yield from closed(False).combine_chunks().to_batches()
                    runs_done += 1
                sizes = np.diff(cuts)
                if len(sizes) and not runs_done:  # the first run of all carries its text
                    count, before = int(sizes[0]), texts[0].as_py()
                    held = [small.slice(0, 1 if heads_only else count)]
                    yield from closed(False).combine_chunks().to_batches()
                    runs_done, cuts, sizes = 1, cuts[1:], sizes[1:]
                if len(sizes):
                    done = small.slice(int(cuts[0]), int(cuts[-1] - cuts[0]))
                    out = marked(done, cuts[:-1] - cuts[0], sizes, 0, None)
                    yield from (out.filter(out["kept"]) if heads_only else out).combine_chunks().to_batches()
                    runs_done += len(sizes)
                count = n - int(cuts[-1])
                held = [small.slice(int(cuts[-1]), 1 if heads_only else count)]
            before = texts[n - 1].as_py()
        if count:
            yield from closed(True).combine_chunks().to_batches()

    return run


def _chains(runs: DataFrame) -> DataFrame:
    """Runs at the edges of ranges that are one run, by whole texts: (part, edge, opens, total, chain_keep).

    At most two rows a range take part; the texts meet in a join, only (range, run) is ordered in one task.
    """
    edges = runs.where("edge_text IS NOT NULL").select("part", "edge", "edge_text", "size", "keep")
    firsts, lasts = (edges.where(F.col("edge").bitwiseAND(bit) > 0) for bit in (FIRST, LAST))
    in_order = Window.orderBy("part")
    follows = firsts.select(F.lag("part").over(in_order).alias("part"), F.col("part").alias("next"))
    goes_on = (
        lasts.select("part", F.col("edge_text").alias("text"))
        .join(follows, "part")
        .join(firsts.select(F.col("part").alias("next"), F.col("edge_text").alias("next_text")), "next")
        .where(F.col("text") == F.col("next_text"))
        .select(F.col("next").alias("part"), F.lit(True).alias("linked"))
    )
    tied = edges.drop("edge_text").join(goes_on, "part", "left")
    opens = ~(F.coalesce("linked", F.lit(False)) & (F.col("edge").bitwiseAND(FIRST) > 0))
    numbered = tied.select("part", "edge", "size", "keep", opens.alias("opens"), F.sum(opens.cast("int")).over(Window.orderBy("part", "edge")).alias("chain"))
    whole = numbered.groupBy("chain").agg(F.sum("size").alias("total"), F.min_by("keep", F.struct("part", "edge")).alias("chain_keep"))
    return numbered.join(whole, "chain").select("part", "edge", "opens", "total", "chain_keep")


def _classes(docs: DataFrame, id_col: str, text_col: str, row, heads_only: bool) -> DataFrame:
    ordered = _sorted_texts(docs, id_col, text_col, row)
    row_type = ordered.schema["row"].dataType
    marks = T.StructType().add("row", row_type).add("text_sha256", "string").add("keep", row_type).add("size", "long")
    marks = marks.add("kept", "boolean").add("part", "integer").add("edge", "integer").add("edge_text", "string")
    runs = stored(ordered.mapInArrow(_runs(heads_only), marks), "exact-dedup")
    joined = runs.drop("edge_text").join(F.broadcast(_chains(runs)), ["part", "edge"], "left")
    return joined.select(
        "row",
        F.when(F.col("total").isNull(), F.col("keep")).otherwise(F.col("chain_keep")).alias("keep"),
        F.coalesce("total", "size").alias("group_size"),
        (F.col("kept") & F.coalesce("opens", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, the id of the row that stays of all equal texts, their number, whether it
    stays itself, and the digest of its normalised text.

    The row with the most code points in the original text stays, then the smallest id.
    """
    out = _classes(docs, id_col, text_col, F.struct(col(id_col).alias("id")), False)
    return out.select(F.col("row.id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", "kept", "text_sha256")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    fields = [col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    out = _classes(docs, id_col, text_col, F.struct(*fields), True).where("kept")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])

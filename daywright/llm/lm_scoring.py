"""Cross-entropy difference of two matched bigram models over the tokens of one public tokenizer.

Target and background model have the same order, smoothing and vocabulary; their counts cover every
text of their tables. A document's score is the mean over its tokens of the target loss less the
background loss: the lower, the more like the target.

    P1(b) = (c(b) + D) / (N + D V)        P(b | a) = (c(a, b) + K P1(b)) / (c(a) + K)

Texts are encoded once, into blocks of bounded size. Each block counts its own pairs, and its keys
leave it in `RANGES` hash ranges. A range's counts are added up over all blocks, and every block gets
back the totals of just the pairs that it holds; so no task holds the model, which grows with the
corpus, and a frequent pair is one entry a block. Counts of single tokens are as many as the
vocabulary, a bound that the tokenizer's file sets, and go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daywright.llm.common import col, mixed, stored
from daywright.llm.packing import Tokenizer

#: Smoothing, ranges of pair keys, and tokens and texts of a block (a longer text is a block of its own).
D, K, RANGES, BLOCK_TOKENS, BLOCK_TEXTS = 0.5, 4.0, 512, 400_000, 2_000

BACKGROUND, TARGET = 0, 1


def _rows(batch, *names: str) -> Iterator[tuple]:
    """The rows of a batch one by one: a row may be a block, and a batch many of them."""
    columns = [batch.column(c) for c in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def vocabulary_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer as Model

    return Model.from_file(tokenizer).get_vocab_size(with_added_tokens=True)


def _blocks(batches: Iterator, tokenizer: str, ranks: str | None, side: int, id_type, wide: bool) -> Iterator:
    """A row a block: ids, token counts and tokens of its texts. The number is (task, block), by side."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    model, kind = Tokenizer(tokenizer, ranks), "<u4" if wide else "<u2"
    number = (TaskContext.get().partitionId() << 32) * 2 + side
    ids, sizes, tokens = [], [], []

    def row():
        nonlocal number, ids, sizes, tokens
        cols = [[number], [side], [ids], [np.array(sizes, "<i4").tobytes()], [np.concatenate(tokens).tobytes() if tokens else b""]]
        types = [pa.int64(), pa.int32(), pa.list_(id_type), pa.binary(), pa.binary()]
        number, ids, sizes, tokens = number + 2, [], [], []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["block", "side", "ids", "sizes", "tokens"])

    total = 0
    for batch in batches:
        names = batch.column("id").to_pylist()
        for k in range(0, batch.num_rows, 500):
            texts = [t or "" for t in batch.column("text").slice(k, 500).to_pylist()]
            for name, e in zip(names[k : k + 500], model.encoded(texts), strict=True):
                n = len(e) // 4
                if ids and (total + n > BLOCK_TOKENS or len(ids) >= BLOCK_TEXTS):
                    yield row()
                    total = 0
                ids.append(name)
                sizes.append(n)
                tokens.append(np.frombuffer(e, "<u4").astype(kind))
                total += n
    if ids:
        yield row()


def _pairs(sizes: bytes, tokens: bytes, vocabulary: int, wide: bool):
    """(first tokens, tokens, pair keys, sizes) of a block; a text's first token follows the start mark `vocabulary`."""
    import numpy as np

    n, b = np.frombuffer(sizes, "<i4"), np.frombuffer(tokens, "<u4" if wide else "<u2").astype(np.int64)
    a = np.empty_like(b)
    a[1:] = b[:-1]
    starts = np.cumsum(n) - n
    a[starts[n > 0]] = vocabulary
    return a, b, a * vocabulary + b, n


def _split(keys):
    """Order of the keys by (range, key), and where each range begins."""
    import numpy as np

    part = (mixed(keys.astype(np.uint64)) % np.uint64(RANGES)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(RANGES + 1))


def _counted(batches: Iterator, vocabulary: int, wide: bool) -> Iterator:
    """(range, block, side, keys, counts) of each block."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for block, side, sizes, tokens in _rows(batch, "block", "side", "sizes", "tokens"):
            keys, counts = np.unique(_pairs(sizes, tokens, vocabulary, wide)[2], return_counts=True)
            order, at = _split(keys)
            keys, counts = keys[order].astype("<i8" if wide else "<u4"), counts[order].astype("<u4")
            full = [r for r in range(RANGES) if at[r + 1] > at[r]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array([block] * len(full), pa.int64()),
                    pa.array([side] * len(full), pa.int32()),
                    pa.array([keys[at[r] : at[r + 1]].tobytes() for r in full], pa.binary()),
                    pa.array([counts[at[r] : at[r + 1]].tobytes() for r in full], pa.binary()),
                ],
                ["range", "block", "side", "keys", "counts"],
            )


def _singles(batches: Iterator, vocabulary: int, wide: bool) -> Iterator:
    """(side, token, as first, as second) over the task's blocks."""
    import numpy as np
    import pyarrow as pa

    first, second = np.zeros((2, vocabulary + 1), np.int64), np.zeros((2, vocabulary + 1), np.int64)
    for batch in batches:
        for side, sizes, tokens in _rows(batch, "side", "sizes", "tokens"):
            a, b, _, _ = _pairs(sizes, tokens, vocabulary, wide)
            first[side] += np.bincount(a, minlength=vocabulary + 1)
            second[side] += np.bincount(b, minlength=vocabulary + 1)
    side, token = np.nonzero(first + second)
    cols = [pa.array(x, pa.int64()) for x in (side, token, first[side, token], second[side, token])]
    yield pa.RecordBatch.from_arrays(cols, ["side", "token", "first", "second"])


def _totals(batches: Iterator, wide: bool) -> Iterator:
    """Rows in order of range in; a row a range out: its keys and their counts on both sides."""
    import numpy as np
    import pyarrow as pa

    kind = "<i8" if wide else "<u4"
    schema = pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    at, waiting, held = None, [], 0

    def merged(parts):
        keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.stack([np.bincount(back, np.concatenate([p[1][s] for p in parts]), len(keys)) for s in (0, 1)])
        return keys, counts

    def row():
        keys, counts = merged(waiting)
        return pa.RecordBatch.from_pylist([{"range": at, "keys": keys.tobytes(), "counts": counts.astype("<f8").tobytes()}], schema)

    for batch in batches:
        for r, side, keys, counts in _rows(batch, "range", "side", "keys", "counts"):
            if r != at:
                if waiting:
                    yield row()
                at, waiting, held = r, [], 0
            keys, counts = np.frombuffer(keys, kind), np.frombuffer(counts, "<u4").astype(float)
            zero = np.zeros_like(counts)
            waiting.append((keys, np.stack([counts, zero] if side == BACKGROUND else [zero, counts])))
            held += len(keys)
            if held > 4 * len(waiting[0][0]) + 500_000:
                waiting = [merged(waiting)]
                held = len(waiting[0][0])
    if waiting:
        yield row()


def _answers(batches: Iterator, wide: bool) -> Iterator:
    """Rows by range, the totals before the blocks' keys; the totals of each block's keys out."""
    import numpy as np
    import pyarrow as pa

    kind = "<i8" if wide else "<u4"
    known = None
    for batch in batches:
        out = [[], [], []]
        for r, block, keys, counts in _rows(batch, "range", "block", "keys", "counts"):
            if block is None:
                known = np.frombuffer(keys, kind), np.frombuffer(counts, "<f8").reshape(2, -1)
                continue
            found = known[1][:, np.searchsorted(known[0], np.frombuffer(keys, kind))]
            out[0].append(block)
            out[1].append(r)
            # Whole numbers below 2**53: doubles hold them exactly, 32 bits most of them.
            out[2].append(found.astype("<u8").tobytes() if found.max(initial=0) >= 2**32 else found.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["block", "range", "counts"])


def losses(a, b, pair_target, pair_background, first, second, vocabulary: int):
    """Loss of each token under (background, target), in nats."""
    import numpy as np

    out = []
    for side, pair in ((BACKGROUND, pair_background), (TARGET, pair_target)):
        single = (second[side][b] + D) / (second[side].sum() + D * vocabulary)
        out.append(-np.log((pair + K * single) / (first[side][a] + K)))
    return out


def _scored(batches: Iterator, vocabulary: int, wide: bool, first, second, id_type) -> Iterator:
    """Rows by block, its texts before the ranges' totals; (id, tokens, mean losses) out."""
    import numpy as np
    import pyarrow as pa

    block = None

    def rows():
        ids, n, a, b, back, totals, _, _ = block
        background, target = losses(a, b, totals[0][back], totals[1][back], first, second, vocabulary)
        ends = np.cumsum(n)
        sums = []
        for x in (target, background):
            whole = np.concatenate([[0.0], np.cumsum(x)])
            with np.errstate(invalid="ignore", divide="ignore"):
                sums.append((whole[ends] - whole[ends - n]) / n)
        empty = n == 0
        cols = [pa.array(ids, id_type), pa.array(n.astype(np.int64)), *[pa.array(x, pa.float64(), mask=empty) for x in sums]]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "target_loss", "background_loss"])

    for batch in batches:
        for r, ids, sizes, tokens, counts in _rows(batch, "range", "ids", "sizes", "tokens", "counts"):
            if r < 0:
                if block:
                    yield rows()
                a, b, keys, n = _pairs(sizes, tokens, vocabulary, wide)
                keys, back = np.unique(keys, return_inverse=True)
                order, at = _split(keys)
                # Totals in the order of the keys: target first, background second.
                block = ids, n, a, b, back, np.zeros((2, len(keys))), order, at
            else:
                order, at = block[6][block[7][r] : block[7][r + 1]], block[5]
                got = np.frombuffer(counts, "<u4" if len(counts) == 8 * len(order) else "<u8").reshape(2, -1)
                at[0][order], at[1][order] = got[TARGET], got[BACKGROUND]
    if block:
        yield rows()


def cross_entropy_difference(docs: DataFrame, target: DataFrame, tokenizer: str, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of each row of `docs` (doc_id, text).

    The background model counts all of `docs`, the target model all of `target` (text). Null texts count
    as empty; a document without tokens has null losses and a null score; repeated rows count and are
    scored one by one; an empty target leaves the smoothed uniform model.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    vocabulary = vocabulary_size(tokenizer)
    wide = (vocabulary + 1) * vocabulary >= 2**32 or vocabulary >= 2**16
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"block bigint, side int, ids array<{kind}>, sizes binary, tokens binary"
    sides = (
        (docs.select(col("doc_id").alias("id"), col("text")), BACKGROUND),
        (target.select(F.lit(None).cast(kind).alias("id"), col("text")), TARGET),
    )
    parts = [d.mapInArrow(lambda x, side=side: _blocks(x, tokenizer, ranks, side, id_type, wide), schema) for d, side in sides]
    blocks = stored(parts[0].union(parts[1]), "blocks")

    import numpy as np

    first, second = np.zeros((2, vocabulary + 1)), np.zeros((2, vocabulary + 1))
    singles = blocks.mapInArrow(lambda x: _singles(x, vocabulary, wide), "side bigint, token bigint, first bigint, second bigint")
    for r in singles.groupBy("side", "token").agg(F.sum("first").alias("first"), F.sum("second").alias("second")).collect():  # 2 (V + 1) rows at most
        first[r["side"], r["token"]], second[r["side"], r["token"]] = r["first"], r["second"]

    counted = stored(blocks.mapInArrow(lambda x: _counted(x, vocabulary, wide), "range int, block bigint, side int, keys binary, counts binary"), "counted")
    totals = counted.repartition("range").sortWithinPartitions("range").mapInArrow(lambda x: _totals(x, wide), "range int, keys binary, counts binary")
    asked = counted.where(F.col("side") == BACKGROUND).select("range", "block", "keys", F.lit(None).cast("binary").alias("counts"))
    told = totals.select("range", F.lit(None).cast("bigint").alias("block"), "keys", "counts")
    answers = asked.union(told).repartition("range").sortWithinPartitions("range", F.col("block").asc_nulls_first())
    answers = answers.mapInArrow(lambda x: _answers(x, wide), "block bigint, range int, counts binary")

    texts = blocks.where(F.col("side") == BACKGROUND).select("block", F.lit(-1).alias("range"), "ids", "sizes", "tokens", F.lit(None).cast("binary").alias("counts"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ids", f"array<{kind}>"), ("sizes", "binary"), ("tokens", "binary"))]
    both = texts.union(answers.select("block", "range", *none, "counts")).repartition("block").sortWithinPartitions("block", "range")
    out = both.mapInArrow(
        lambda x: _scored(x, vocabulary, wide, first, second, id_type), f"doc_id {kind}, n_tokens bigint, target_loss double, background_loss double"
    )
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))

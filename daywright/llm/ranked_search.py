"""Ranked lexical search over K2-treaps of the term-document grid.

Documents are dealt into blocks as they are read. A block is a square grid of terms (rows, most
frequent first) and documents (columns), in which a point is a term's impact on a document.
The grid is a compressed quadtree: each cell that holds points keeps the greatest impact in it
together with the place of that point, which is then left out of the cells below; a cell without
points has no node. So a block has one node a point, stored level by level as four-bit branch masks,
falls of the maxima from cell to subcell, and places inside the cell.

A search follows, for each term of an item, the path of the term's row, all paths at once, over
ranges of documents. The maxima of the cells that the paths are in bound the score of every document
of a range; ranges of the greatest bounds are opened first, a few at a time, down to single documents, whose bounds
are their scores. A range is left when its bound can't enter the item's best documents, ties
included. Nothing is cut off otherwise.

Score, in 64-bit integers: N documents hold a term, L terms in all, n in one document; m is
75 + (25 n N) div L; a term of weight w adds w * ((10^9 tf) div (1000 tf + 12 m)) for each time it
occurs in the item, w = floor(1000 ln((2N + 2) / (2 df + 1))).

Nulls and odd rows: a null text has no terms; a document or item without terms is in no result. Ids
of documents are integers; a null id comes after all others where scores tie. Repeated rows of
documents are documents of their own. Of items with one id, the smallest text counts. Very long texts are read
in pieces cut between terms. Empty tables give no rows. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daywright.llm.common import col, stored

#: A block is closed once it has so many points or as many tokens waiting to be counted.
BLOCK_POINTS = 600_000

#: Items are searched together until they have so many terms; each such set reads the index once.
QUERY_TERMS = 200_000

#: Terms lie 2^STRETCH rows apart: a cell over so many documents or fewer is of one term, its maximum not blurred by others.
STRETCH = 8

#: Ranges of documents opened at a time.
OPENED = 32

#: Bytes of a text read at a time.
PIECE = 1 << 20

_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

_INDEX = "terms binary, lengths binary, dfs binary, ids binary, nulls binary, levels binary, branches binary, falls binary, rows binary, columns binary"

#: A block is packed, so it is neither compressed again nor put in a dictionary; a file's writer and its readers hold two or three blocks.
_FILES = {
    "compression": "uncompressed",
    "parquet.enable.dictionary": "false",
    "parquet.block.size": str(4 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}


def _packed(x) -> bytes:
    """Numbers with the first bytes of all before the second ones, compressed, behind their size."""
    import numpy as np

    data = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return data.nbytes.to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _unpacked(batch: pa.RecordBatch, i: int, name: str, kind):
    import numpy as np

    held, kind = batch.column(name)[i].as_buffer(), np.dtype(kind)
    data = pa.Codec("zstd").decompress(held[8:], decompressed_size=int.from_bytes(held[:8], "little"))
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _names(batch: pa.RecordBatch, i: int) -> pa.Array:
    """The terms of a block."""
    import numpy as np

    ends = np.cumsum(_unpacked(batch, i, "lengths", "<u4"), dtype=np.int64)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(_unpacked(batch, i, "terms", np.uint8))])


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, a piece at a time: runs of letters, digits and all beyond ASCII; A-Z in lower case."""
    import re

    gap = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE:
            cut = gap.search(data, at + PIECE)
            end = cut.start() if cut else end
        yield data[at:end].translate(_BYTES).split()
        at = end


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    for text in batch.column(name).cast(pa.binary()):
        yield text.as_py() or b""


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and their terms."""
    docs = terms = 0
    for batch in batches:
        for data in _texts(batch, "text"):
            n = sum(map(len, _pieces(data)))
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})


class _Numbers(dict):
    """A number for each new term."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Points:
    """Documents and their terms until they make a block."""

    def __init__(self):
        self.numbers, self.ids, self.sizes = _Numbers(), [], []
        self.keys, self.counts, self.waiting, self.n_waiting, self.n_points = [], [], [], 0, 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        import numpy as np

        doc, n = len(self.ids), 0
        for terms in _pieces(data):
            if terms:
                numbers = np.fromiter(map(self.numbers.__getitem__, terms), np.int64, len(terms))
                self.waiting.append(numbers | (doc << 32))
                self.n_waiting += len(terms)
                n += len(terms)
                if self.n_waiting >= BLOCK_POINTS:
                    self.count()
        if n:
            self.ids.append(doc_id)
            self.sizes.append(n)

    def count(self) -> None:
        import numpy as np

        if self.waiting:
            keys = np.concatenate(self.waiting)
            self.waiting, self.n_waiting = [], 0
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.counts.append(np.diff(first, append=len(keys)).astype(np.uint32))
            self.keys.append(keys[first])
            self.n_points += len(first)

    @property
    def full(self) -> bool:
        if self.n_points + self.n_waiting >= BLOCK_POINTS:
            self.count()
        return self.n_points >= BLOCK_POINTS

    def points(self):
        """Terms, documents and frequencies of the points, by document and then term."""
        import numpy as np

        self.count()
        keys, tf = (np.concatenate(x) if len(x) > 1 else x[0] for x in (self.keys, self.counts))
        self.keys, self.counts = [], []
        if not (keys[1:] > keys[:-1]).all():  # a document was counted in parts
            order = np.argsort(keys, kind="stable")
            keys, tf = keys[order], tf[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, tf = keys[first], np.add.reduceat(tf, first)
        return (keys & 0xFFFFFFFF).astype(np.uint32), (keys >> 32).astype(np.uint32), tf

    def block(self, docs: int, terms: int) -> pa.RecordBatch:
        """The block of these points, which are given away."""
        import numpy as np

        row, column, tf = self.points()
        df = np.bincount(row, minlength=len(self.numbers))
        by_df = np.argsort(-df, kind="stable")
        names = list(self.numbers)
        self.numbers = None
        names = [names[i] for i in by_df]
        lengths = np.fromiter(map(len, names), np.uint32, len(names))
        packed = {"terms": _packed(np.frombuffer(b"".join(names), np.uint8)), "lengths": _packed(lengths), "dfs": _packed(df[by_df].astype(np.uint32))}
        place = np.empty(len(by_df), np.uint32)
        place[by_df] = np.arange(len(by_df))
        n_rows, names, lengths, df, by_df = len(df), None, None, None, None
        row = place[row]

        # documents of one language and length lie together: their most frequent term, then their size
        frequent = np.maximum.reduceat((tf.astype(np.int64) << 32) | (0xFFFFFFFF - row), np.searchsorted(column, np.arange(len(self.ids))))
        main = 0xFFFFFFFF - (frequent & 0xFFFFFFFF)
        alike = np.lexsort((np.array(self.sizes), main))
        rank = np.empty(len(alike), np.uint32)
        rank[alike] = np.arange(len(alike))

        m = np.array([75 + 25 * n * docs // terms for n in self.sizes], np.int64)
        impact = tf * np.int64(1_000_000_000)
        impact //= 1000 * tf.astype(np.int64) + 12 * m[column]
        impact, column, tf = impact.astype(np.uint32), rank[column], None
        row <<= np.uint32(STRETCH)
        levels, *nodes = _treap(row, column, impact, n_rows, len(self.ids))
        ids, null = np.array([d or 0 for d in self.ids], np.int64)[alike], np.array([d is None for d in self.ids], np.uint8)[alike]
        packed |= {"ids": _packed(ids), "nulls": _packed(null), "levels": _packed(np.array(levels, np.int64))}
        for name in ("branches", "falls", "rows", "columns"):
            packed[name] = _packed(nodes.pop(0))
        return pa.RecordBatch.from_pydict({name: pa.array([x], pa.binary()) for name, x in packed.items()})


def _spread(x):
    """The bits of numbers below 2^32 at the even places of 64."""
    import numpy as np

    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x |= x << np.uint64(shift)
        x &= np.uint64(mask)
    return x


def _height(n_rows: int, n_columns: int) -> int:
    return max((n_rows << STRETCH) - 1, n_columns - 1, 1).bit_length()


def _treap(row, column, value, n_rows: int, n_columns: int):
    """Nodes of each level, and for all nodes in that order: branches (bit 2 r + c: subcell r, c has points), the
    fall of the maximum from the cell above, and the row and column of its point within the cell."""
    import numpy as np

    height = _height(n_rows, n_columns)
    place = _spread(row)
    place <<= np.uint64(1)
    place |= _spread(column)
    order = np.argsort(place)
    place, row, column, value = place[order], row[order], column[order], value[order]
    levels, branches, falls, rows, columns = [], [], [], [], []
    above, above_value = None, None
    for level in range(height + 1):
        if not len(place):
            break
        size = height - level
        cell = place >> np.uint64(2 * size)
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        cells = cell[starts]
        ahead = value.astype(np.int64) << 32
        ahead |= np.arange(0xFFFFFFFF, 0xFFFFFFFF - len(value), -1)
        best = 0xFFFFFFFF - (np.maximum.reduceat(ahead, starts) & 0xFFFFFFFF)
        if level:
            parent = np.searchsorted(above, cells >> np.uint64(2))
            bits = (np.uint64(1) << (cells & np.uint64(3))).astype(np.uint8)
            np.bitwise_or.at(branches[-1], parent, bits)
            falls.append((above_value[parent] - value[best]).astype("<u4"))
        else:
            falls.append(value[best].astype("<u4"))
        inside = (1 << size) - 1
        levels.append(len(cells))
        branches.append(np.zeros(len(cells), np.uint8))
        rows.append((row[best] & inside).astype("<u4"))
        columns.append((column[best] & inside).astype("<u4"))
        above, above_value = cells, value[best]
        rest = np.ones(len(place), bool)
        rest[best] = False
        place, row, column, value = place[rest], row[rest], column[rest], value[rest]
    return levels, *[np.concatenate(x) for x in (branches, falls, rows, columns)]


class _Treap:
    """A block as read back. Per node: its maximum, `spot` (row and column of that point) and `link` (first subcell and branches)."""

    _ONES = bytes(bin(b).count("1") for b in range(16))

    def __init__(self, batch: pa.RecordBatch, i: int):
        import numpy as np

        ids = _unpacked(batch, i, "ids", np.int64)
        self.null = _unpacked(batch, i, "nulls", np.uint8).astype(bool)
        self.order = np.where(self.null, (1 << 63) - 1, ids)
        self.terms = _names(batch, i)
        self.height = _height(len(self.terms), len(self.order))
        least = [self.order]  # the least id of each range of 1, 2, 4, ... documents
        while len(least[-1]) > 1:
            last = least[-1] if len(least[-1]) % 2 == 0 else np.append(least[-1], least[-1][-1])
            least.append(np.minimum(last[::2], last[1::2]))
        self.least, self.least_at = np.concatenate(least), np.cumsum([0, *map(len, least[:-1])])
        self.ones = np.frombuffer(self._ONES, np.uint8)
        branches = _unpacked(batch, i, "branches", np.uint8)
        n_below = self.ones[branches]
        self.link = (1 + np.cumsum(n_below, dtype=np.int64) - n_below) << 4 | branches
        self.value, row, column = (_unpacked(batch, i, c, "<u4").astype(np.int64) for c in ("falls", "rows", "columns"))
        counts, at = _unpacked(batch, i, "levels", np.int64).tolist(), 0
        cell_row = cell_column = np.zeros(1, np.int64)
        for level, (count, below) in enumerate(zip(counts, counts[1:])):
            size = self.height - level - 1
            mask = branches[at : at + count]
            child = np.flatnonzero(np.unpackbits(mask[:, None], axis=1, count=4, bitorder="little").ravel())
            up, which = child >> 2, child & 3
            below_at = slice(at + count, at + count + below)
            self.value[below_at] = self.value[at : at + count][up] - self.value[below_at]
            cell_row, cell_column = 2 * cell_row[up] + (which >> 1), 2 * cell_column[up] + (which & 1)
            row[below_at] += cell_row << size
            column[below_at] += cell_column << size
            at += count
        self.spot = row << 32 | column

    def first_ids(self, low, level):
        """The least id in each range of documents."""
        return self.least[self.range_number(low, self.height - level)]

    def range_number(self, low, size):
        """Numbers of the ranges of 2^size documents from `low` on, over all sizes; all that hold every document are one."""
        import numpy as np

        size = np.minimum(size, len(self.least_at) - 1)
        return self.least_at[size] + (low >> size)


class _Best:
    """The best documents of an item so far: scores falling, then ids rising (a null id is last).

    `floor` is the score and id of a document that `k` known ones are not worse than.
    """

    def __init__(self, k: int, floor: tuple[int, int] = (1, (1 << 63) - 1)):
        import numpy as np

        self.k, self.floor = k, floor
        self.scores, self.order, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores, order, null) -> None:
        import numpy as np

        scores, order, null = (np.concatenate(x) for x in ((self.scores, scores), (self.order, order), (self.null, null)))
        at = np.lexsort((null, order, -scores))
        at = at[scores[at] > 0][: self.k]
        self.scores, self.order, self.null = scores[at], order[at], null[at]
        if len(at) == self.k:
            last = int(self.scores[-1]), int(self.order[-1])
            self.floor = max(self.floor, last, key=lambda f: (f[0], -f[1]))

    def may_enter(self, bounds, order):
        score, last = self.floor
        return (bounds > score) | ((bounds == score) & (order <= last))


def _descend(treap: _Treap, rows, weights, best: _Best) -> None:
    """Puts the best documents of a block into `best`, opening ranges of documents by their bounds.

    A point that was met on its own row is no longer in the cells below; `met` keeps, for each range of
    documents and term, the greatest of these. So a range's bound is the weighted sum, over the terms,
    of the greater of its cell's maximum and the met one; that of a single document is its score.
    """
    import numpy as np

    met = np.zeros((len(treap.least), len(rows)), np.int32)
    sizes = np.arange(len(treap.least_at))
    low, level = np.zeros(1, np.int64), np.zeros(1, np.int64)
    nodes = np.zeros((1, len(rows)), np.int64)  # -1: the path has ended
    bounds = np.array([treap.value[0] * weights.sum()])
    while True:
        live = best.may_enter(bounds, treap.first_ids(low, level))
        low, level, nodes, bounds = low[live], level[live], nodes[live], bounds[live]
        if not len(low):
            return
        order = np.lexsort((low, -bounds))
        now, later = order[:OPENED], order[OPENED:]
        single = now[level[now] == treap.height]
        if len(single):
            best.add(bounds[single], treap.order[low[single]], treap.null[low[single]])
        now = now[level[now] < treap.height]
        have = nodes[now] >= 0
        node = np.where(have, nodes[now], 0)
        link, spot = treap.link[node], treap.spot[node]
        which, term = np.nonzero(have & (spot >> 32 == rows))
        doc = spot[which, term] & 0xFFFFFFFF
        held = treap.least_at[:, None] + (doc >> sizes[:, None])
        np.maximum.at(met, (held, term), treap.value[node[which, term]].astype(np.int32))

        size = treap.height - level[now] - 1
        mask, side = link & 15, 2 * (rows >> size[:, None] & 1)
        halves = []
        for half in (0, 1):
            child = side + half
            there = have & (mask >> child & 1 > 0)
            below = np.where(there, (link >> 4) + treap.ones[mask & (1 << child) - 1], 0)
            start = low[now] + (half << size)
            some = start < len(treap.order)
            at = treap.range_number(np.where(some, start, 0), size)
            top = (np.maximum(np.where(there, treap.value[below], 0), met[at]) * weights).sum(axis=1)
            some &= top > 0
            halves.append((start[some], level[now][some] + 1, np.where(there, below, -1)[some], top[some]))
        low, level, nodes, bounds = (
            np.concatenate([kept[later], *new]) for kept, new in zip((low, level, nodes, bounds), zip(*halves))
        )


def _searched(items: list, terms: list[bytes], weights: list[int], k: int):
    """The best documents of each item in a task's blocks. `items`: numbers of the item's terms, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        wanted, weight = pa.array(terms, pa.large_binary()), np.array(weights, np.int64)
        best = [_Best(k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                treap = _Treap(batch, i)
                number = pc.index_in(treap.terms, value_set=wanted)
                row_of = np.full(len(terms), -1, np.int64)
                rows = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False)) << STRETCH
                row_of[number.drop_null().to_numpy()] = rows
                for n, (numbers, times) in enumerate(items):
                    factor = weight[numbers] * times
                    use = (row_of[numbers] >= 0) & (factor > 0)
                    if use.any():
                        _descend(treap, row_of[numbers][use], factor[use], best[n])
        out = [(n, None if null else int(doc), int(score)) for n, b in enumerate(best) for doc, score, null in zip(b.order, b.scores, b.null)]
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "doc", "score"])

    return run


def _frequencies(terms: list[bytes]):
    """In how many of a task's documents the terms occur: (term's number, df)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        wanted, total = pa.array(terms, pa.large_binary()), np.zeros(len(terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                number = pc.index_in(_names(batch, i), value_set=wanted)
                there = number.is_valid().to_numpy(zero_copy_only=False)
                total[number.drop_null().to_numpy()] += _unpacked(batch, i, "dfs", "<u4")[there]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "df"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    for batch in batches:
        counts = []
        for data in _texts(batch, "text"):
            counts.append(Counter())
            for terms in _pieces(data):
                counts[-1].update(terms)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("item"),
                pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
            ],
            ["item", "terms", "times"],
        )


class Index:
    """A stored index: a table with a row a block, the documents that hold a term, and their terms."""

    def __init__(self, blocks: DataFrame, docs: int, terms: int):
        self.blocks, self.docs, self.terms = blocks, docs, terms


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Indexes every document; reads the texts twice, first for the mean length that impacts need."""
    shown = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    sums = shown.select("text").mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = (int(s or 0) for s in sums)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = _Points()
        for batch in batches:
            for doc_id, data in zip(batch.column("id").to_pylist(), _texts(batch, "text")):
                points.add(doc_id, data)
                if points.full:
                    yield points.block(n_docs, n_terms)
                    points = _Points()
        if points.ids:
            yield points.block(n_docs, n_terms)

    return Index(stored(shown.mapInArrow(blocks, _INDEX), "search-index", **_FILES), n_docs, n_terms)


def _query_sets(items: DataFrame, item_col: str, text_col: str) -> Iterator[list]:
    """The items with their terms, in sets bounded by `QUERY_TERMS`."""
    one = items.groupBy(col(item_col).alias("item")).agg(F.min(col(text_col)).alias("text"))
    kind = one.schema["item"].dataType.simpleString()
    counted = stored(one.mapInArrow(_item_terms, f"item {kind}, terms array<binary>, times array<bigint>"), "search-items")
    held, size = [], 0
    for row in counted.where("size(terms) > 0").toLocalIterator():
        if held and size + len(row.terms) > QUERY_TERMS:
            yield held
            held, size = [], 0
        held.append((row.item, [bytes(t) for t in row.terms], row.times))
        size += len(row.terms)
    if held:
        yield held


def _of_set(index: Index, queries: list, k: int, item_col: str, item_type) -> DataFrame:
    import math

    numbers: dict[bytes, int] = {}
    items = [([numbers.setdefault(t, len(numbers)) for t in terms], times) for _, terms, times in queries]
    terms = list(numbers)
    df = index.blocks.select("terms", "lengths", "dfs").mapInArrow(_frequencies(terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = [0] * len(terms)
    for term, n in df.collect():
        weights[term] = math.floor(1000 * math.log((2 * index.docs + 2) / (2 * n + 1)))

    found = index.blocks.mapInArrow(_searched(items, terms, weights, k), "item long, doc long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    some = Window.partitionBy("item", F.pmod(F.xxhash64("doc"), F.lit(32))).orderBy(*order)
    ranked = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = index.blocks.sparkSession.createDataFrame([(n, q[0]) for n, q in enumerate(queries)], f"item long, name {item_type}")
    return ranked.join(names, "item").select(F.col("name").alias(item_col), "rank", F.col("doc").alias("doc_id"), "score")


def search(index: Index, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The `k` best documents of each item, of all indexed ones: (item, rank, doc_id, score)."""
    spark, item_type = items.sparkSession, items.schema[item_col].dataType.simpleString()
    results = [_of_set(index, queries, k, item_col, item_type) for queries in _query_sets(items, item_col, text_col)]
    if not results:
        return spark.createDataFrame([], f"`{item_col}` {item_type}, rank int, doc_id long, score long")
    out = results[0] if len(results) == 1 else stored(results[0], "search-results")
    for more in results[1:]:
        out = out.unionByName(stored(more, "search-results"))
    return out


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """`search` over a new index of `docs`."""
    return search(build(docs), items, k)

"""Spelling variants by blocked Gram matrices of letter counts.

Two words are near if one inserted, deleted or replaced letter makes one of the other. Such words
have nearly the same letters: the squared distance of their letter counts is 1 (a letter more) or 2
(a letter for another). A NumPy product of a block of count vectors with itself gives all its squared
distances; pairs at most two apart are verified letter by letter.

Blocks. Let m be the length of the shorter word, h = m div 2. The one edit lies either behind the first h
letters, which then agree, or before the last m - h, which then agree. So words of the adjacent lengths
m and m + 1 meet in a block for each beginning of h letters and one for each end of m - h; a
pair that would meet in both counts in the first. A block of more than `TILE` words is cut into
tiles of two parts each, so that no task holds more, and small blocks share a product.

Words are the runs of `[A-Za-z\\u00C0-\\u00FF]` with A-Z in lower case; of a document's run whose hash h
(CRC-32 of `<id>:<run>`) 31 divides, the letter h mod length is left out. Words of at least `MIN_LENGTH`
letters that occur at least `MIN_COUNT` times take part.

Nulls and odd rows: a null text has no words; a null id is written as nothing in the hash. Repeated
rows count again. Long texts are read in pieces cut between runs, and a run of any length is one
word. Forms of equal counts: the first in code-point order. No documents, no rows. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daywright.llm.common import col, stored

MIN_LENGTH, MIN_COUNT = 7, 2

#: A word's form occurs at least so many times as often as the word.
FORM_RATIO = 10

#: A run loses a letter if this divides its hash.
SLIP = 31

#: Most words in a part of a block (a product has at most two parts), and words of small blocks that share a product.
TILE, SHARED = 1024, 256

#: Distinct words that a task counts before it hands them on, and letters of a text read at a time.
HELD_WORDS, PIECE = 300_000, 1 << 20

#: Latin-1 bytes: letters, A-Z in lower case; anything else is a gap.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))

#: The column of each letter in the count vectors: a-z, then U+00C0 to U+00FF.
_COLUMN = bytes(c - 97 if 97 <= c <= 122 else c - 0xC0 + 26 if c >= 0xC0 else 0 for c in range(256))
_COLUMNS = 26 + 64


def _runs(text: str) -> Iterator[list[bytes]]:
    """The runs of letters of a text as Latin-1, a piece at a time."""
    import re

    gap = re.compile("[^A-Za-zÀ-ÿ]")
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            cut = gap.search(text, at + PIECE)
            end = cut.start() if cut else end
        yield text[at:end].encode("latin-1", "replace").translate(_LETTERS).split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter
    from zlib import crc32

    def out(counts):
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    total = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("id"), batch.column("text")):
            text = text.as_py()
            if not text:
                continue
            start = crc32(f"{doc_id.as_py()}:".encode() if doc_id.is_valid else b":")
            for runs in _runs(text):
                for run, n in Counter(r for r in runs if len(r) >= MIN_LENGTH).items():
                    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % SLIP == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < MIN_LENGTH:
                            continue
                    total[run] += n
            if len(total) > HELD_WORDS:
                yield out(total)
                total = Counter()
    yield out(total)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words that take part."""
    shown = docs.select(col(id_col).cast("string").alias("id"), col(text_col).alias("text"))
    counts = shown.mapInArrow(_counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _blocks(words: DataFrame) -> DataFrame:
    """Each word in its blocks (m, at_end, key), large blocks in tiles: (m, at_end, key, a, b, part, word, n)."""

    def keys(m):
        h = F.floor(m / 2).cast("int")
        head = F.struct(m.alias("m"), F.lit(False).alias("at_end"), F.substring(F.col("word"), F.lit(1), h).alias("key"))
        tail = F.struct(m.alias("m"), F.lit(True).alias("at_end"), F.expr("right(word, m - floor(m / 2))").alias("key"))
        return head, tail

    length = F.length("word")
    each = words.withColumn("m", F.explode(F.array(length, length - 1))).where(F.col("m") >= MIN_LENGTH)
    placed = each.select("word", "n", F.explode(F.array(*keys(F.col("m")))).alias("block")).select("word", "n", "block.*")
    sizes = placed.groupBy("m", "at_end", "key").agg(F.count("*").alias("size"))
    large = sizes.where(F.col("size") > TILE).withColumn("parts", F.ceil(F.col("size") / (TILE * 0.8)).cast("int")).drop("size")
    parted = placed.join(large, ["m", "at_end", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = parted.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    met = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("m", "at_end", "key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "word", "n")


def _near_in(block, at_end, m, part, words: list[bytes], n):
    """Near words among rows of whole tiles: (row, near words, n of its best one, that one's row)."""
    import numpy as np

    rows = len(words)
    length = np.array([len(w) for w in words], np.int64)
    width = int(length.max())
    flat = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(rows), length)
    letters = np.zeros((rows, width + 1), np.uint8)  # ends in a column without a letter
    letters[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    column = np.frombuffer(_COLUMN, np.uint8)[flat]
    counts = np.bincount(row * _COLUMNS + column, minlength=rows * _COLUMNS).reshape(rows, _COLUMNS)
    counts = counts.astype(np.float32 if width < 2000 else np.float64)  # exact either way

    squares = (counts * counts).sum(axis=1)
    first, second = [], []
    for at in range(0, rows, SHARED):
        end = min(at + SHARED, rows)
        distance = squares[at:end, None] + squares[None, at:] - 2 * (counts[at:end] @ counts[at:].T)
        i, j = np.nonzero(distance <= 2)
        i, j = i + at, j + at
        keep = (i < j) & (block[i] == block[j])
        first.append(i[keep])
        second.append(j[keep])
    i, j = np.concatenate(first), np.concatenate(second)
    # pairs of two longer words belong to another m, pairs within a part to that part's own tile
    i, j = np.where(length[i] <= length[j], (i, j), (j, i))
    keep = (length[i] == m[i]) & ((part[i] != part[j]) | (part[i] < 0))
    i, j = i[keep], j[keep]

    good = np.zeros(len(i), bool)
    step = max(1, (8 << 20) // (width + 1))
    for at in range(0, len(i), step):
        a, b = letters[i[at : at + step]], letters[j[at : at + step]]
        longer = length[j[at : at + step]] > length[i[at : at + step]]
        differ = a != b
        begin = differ.argmax(axis=1)  # letters before it agree
        shifted = ((a[:, :-1] == b[:, 1:]) | (np.arange(width) < begin[:, None])).all(axis=1)
        edit = np.where(longer, shifted, differ.sum(axis=1) == 1)
        good[at : at + step] = edit & ~(at_end[i[at : at + step]] & (begin >= m[i[at : at + step]] // 2))
    i, j = i[good], j[good]

    one, near = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(rows, np.int64)
    rank[sorted(range(rows), key=words.__getitem__)] = np.arange(rows)
    order = np.lexsort((rank[near], -n[near], one))
    one, near = one[order], near[order]
    lead = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.empty(0, np.int64)
    return one[lead], np.diff(np.append(lead, len(one))), n[near[lead]], near[lead]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their tiles in; for each word and product: its near words there and the best of them."""
    import numpy as np

    held, tiles, size, longest = [], 0, 0, 0

    def out():
        table = pa.concat_tables(held).combine_chunks()
        words = [w.encode("latin-1") for w in table["word"].to_pylist()]
        sizes = [t.num_rows for t in held]
        block = np.repeat(np.arange(len(held)), sizes)
        m, n, part = (table[c].to_numpy() for c in ("m", "n", "part"))
        part = np.where(table["a"].to_numpy() == table["b"].to_numpy(), -1, part)
        one, count, best_n, best = _near_in(block, table["at_end"].to_numpy(), m, part, words, n)
        name = table["word"].combine_chunks()
        cols = [name.take(pa.array(one)), pa.array(count, pa.int64()), pa.array(best_n, pa.int64()), name.take(pa.array(best))]
        return pa.RecordBatch.from_arrays(cols, ["word", "n_near", "form_n", "form"])

    waiting, waiting_key = [], None

    def closed():
        """The tile just read joins those of the next product, or makes them go first."""
        nonlocal held, size, longest
        tile = pa.concat_tables(waiting)
        if tile.num_rows == 1:
            return
        width = int(tile["m"][0].as_py()) + 1
        if held and (size + tile.num_rows > SHARED or (size + tile.num_rows) * max(longest, width) > 8 << 20):
            yield out()
            held, size, longest = [], 0, 0
        held.append(tile)
        size, longest = size + tile.num_rows, max(longest, width)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = list(zip(*[table[c].to_pylist() for c in ("m", "at_end", "key", "a", "b")]))
        cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
        for at, end in zip(cuts, cuts[1:]):
            if waiting and keys[at] != waiting_key:
                yield from closed()
                waiting = []
            waiting_key = keys[at]
            waiting.append(table.slice(at, end - at).drop(["key"]))
    if waiting:
        yield from closed()
    if held:
        yield out()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): the words that have near words, their number and the most frequent of them."""
    tile = ["m", "at_end", "key", "a", "b"]
    dealt = _blocks(words).repartition(*tile).sortWithinPartitions(*tile)
    partial = dealt.mapInArrow(_near, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best")
    whole = partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return whole.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where forms lead. Each step is from a word to one ten times as frequent, so few doublings reach the last."""
    reached = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        beyond = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = reached.join(beyond, "root", "left")
        reached = stored(
            longer.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots"
        )
        if reached.where("moved").isEmpty():
            return reached.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a word: its form and root, its count, how many words are near it, and its form's count."""
    words = stored(word_counts(docs, id_col, text_col), "spelling-words")
    near = words.join(near_words(words), "word", "left")
    formed = F.col("form_n") >= FORM_RATIO * F.col("n")
    one = stored(
        near.select(
            "word",
            F.when(formed, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("form_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(one.where("form IS NOT NULL"))
    return one.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

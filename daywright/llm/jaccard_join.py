"""Join of documents on the Jaccard similarity of their word shingles by a MinHash LSH forest.

Equal texts (the same words) are one class and take part once. Each class has a MinHash signature
cut into trees. A tree is a trie of its part of the signatures, held as a sorted table: a subtree is a run
of rows that begin alike, and the prefix that a row shares with its neighbours in the order is the
longest it shares with any row, so a class that stands alone at a depth is known before anything is
grouped there.

Classes match whose signatures share a prefix of some depth in a tree. The depth starts at the full
length and is shortened one value at a time until the recall, measured on verified pairs, reaches the
target: of pairs of similarity j a share of 1 - (1 - j^depth)^trees is found, so each pair found stands
for the inverse of that share (Horvitz-Thompson), and found pairs over what they stand for is the
recall. The pairs of all nodes measure it: each depth tried is the whole join at that depth.

A node's classes aren't paired. They name the node's least class as leader, and those that share a
leader in any tree are compared once, exactly, on their shingle sets, in blocks of bounded size
(two blocks a task), so a crowded node is spread over tasks. A pair that shares more leaders is
counted under the least of them. What leaves a block is a row a class, not a row a pair: its number
of links and the root of its group. Roots are joined into components by alternating star steps.

What moves is kept small: a tree's row is a 64-bit name and its part of the signature; the texts move
twice a depth, to their leaders and to their blocks, and are made into shingle sets, which are larger,
where they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daywright.llm.common import WordIds, col, each, fresh, mixed, shingle_hashes, stored

SHINGLE, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, TARGET_RECALL = 32, 8, 0.9999

#: Rows that share fewer values than this with their neighbours are stored only once a depth below it is tried.
STORED_DEPTH = 4

#: Classes of a block; two blocks are compared at a time.
BLOCK = 256

#: Bits of a bitmap of row hashes (4 MB), and of one of the maps it is cut into.
BITS, MAP = 1 << 25, 1 << 15

#: Bytes of a MinHash value in a signature. Values that differ but agree in these only add candidates.
VALUE = 2


def signatures(shingles, trees: int, depth: int) -> list[bytes]:
    """For each tree its number and the `depth` MinHash values of the shingle set, as bytes."""
    import numpy as np

    n = trees * depth
    seeds = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factor, shift = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1), seeds.astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(values), 1024):
        np.minimum(least, (values[k : k + 1024, None] * factor + shift).min(axis=0), out=least)
    # The least values have few bits of their own; stirred, any bytes of them will do.
    short = mixed(least.astype(np.uint64)).astype(f">u{VALUE}").reshape(trees, depth)
    return [bytes([t]) + short[t].tobytes() for t in range(trees)]


def _sketch(batches: Iterator, trees: int, depth: int, size: int) -> Iterator:
    """(row, doc_id, key, signature): key is a 128-bit hash of the words; no key without words."""
    import pyarrow as pa
    import xxhash

    ids = WordIds()
    for batch in batches:
        keys, found = [], []
        for text in each(batch, "text"):
            tokens = (text or "").split()
            keys.append(xxhash.xxh3_128_digest(" ".join(tokens).encode("utf-8", "surrogatepass")) if tokens else None)
            found.append(b"".join(signatures(shingle_hashes(ids.hashes(tokens), size), trees, depth)) if tokens else None)
            ids.trimmed()
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(found, pa.binary())],
            ["row", "doc_id", "key", "signature"],
        )


def _neighbours(batches: Iterator, depth: int) -> Iterator:
    """Sorted signatures in; `shared`, how many values the longest prefix has that a row shares with a neighbour.

    The neighbours across the edges of a range are elsewhere, so its first and last rows count as sharing all.
    """
    import numpy as np
    import pyarrow as pa

    def common(rows):
        at = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        differ = at[1:] != at[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), at.shape[1])
        return np.maximum(same - 1, 0) // VALUE  # the first byte is the tree's number

    held = None  # the last row waits for its neighbour
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column("signature").to_pylist()
        if held is None:
            before = np.array([depth])
        else:
            before = common([held[0], rows[0]])
            yield held[1].append_column("shared", pa.array([int(max(held[2], before[0]))], pa.int32()))
        inner = common(rows)
        up = np.concatenate([before, inner])
        shared = np.maximum(up[:-1], up[1:]).astype(np.int32)
        n = batch.num_rows
        if n > 1:
            yield batch.slice(0, n - 1).append_column("shared", pa.array(shared))
        held = rows[-1], batch.slice(n - 1, 1), int(up[-1])
    if held is not None:
        yield held[1].append_column("shared", pa.array([depth], pa.int32()))


def overlaps(sets: list):
    """Matrix of the intersection sizes of the sets, by products of 0/1 matrices over bounded spans of values."""
    import numpy as np

    m = len(sets)
    out = np.zeros((m, m), np.float32)
    values, where, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = n[where] > 1
    rank = np.cumsum(n > 1) - 1
    column, owner = rank[where[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [start, start + 4096])
        x = np.zeros((m, int(column[hi - 1]) - start + 1), np.float32)
        x[owner[lo:hi], column[lo:hi] - start] = 1
        out += x @ x.T
    return out


def _links(rows: list[tuple], leader: int, one_block: bool, threshold: float, trees: int, depth: int) -> list[tuple]:
    """(key, other texts linked, other documents linked, root, texts these stand for) of each class that has a link counted here."""
    import numpy as np

    m = len(rows)
    if m < 2:
        return []
    sets = [r[3] for r in rows]
    sizes = np.array([len(s) for s in sets], np.float64)
    common = overlaps(sets).astype(np.float64)
    linked = common * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
    np.fill_diagonal(linked, False)
    if not one_block:
        block = np.array([r[4] for r in rows])
        linked &= block[:, None] != block[None, :]
    smaller = {x for r in rows for x in r[2] if x < leader}
    if smaller and linked.any():
        place = {x: k for k, x in enumerate(smaller)}
        z = np.zeros((m, len(place)), np.float32)
        for k, r in enumerate(rows):
            z[k, [place[x] for x in r[2] if x < leader]] = 1
        linked &= (z @ z.T) == 0
    similarity = common / np.maximum(sizes[:, None] + sizes[None, :] - common, 1.0)
    stands_for = np.where(linked, 1 / (1 - (1 - np.minimum(similarity, 1.0) ** depth) ** trees), 0.0) if linked.any() else common
    copies = np.array([r[1] for r in rows], np.int64)
    root, out = np.arange(m), []
    keys = [r[0] for r in rows]
    for start in range(m):  # groups within the block, by walking the links
        if root[start] == start and linked[start].any():
            seen, todo = {start}, [start]
            while todo:
                for k in np.flatnonzero(linked[todo.pop()]).tolist():
                    if k not in seen:
                        seen.add(k)
                        todo.append(k)
            if len(seen) > 1:
                top = min(seen, key=lambda k: keys[k])
                for k in seen:
                    root[k] = -1
                    out.append((keys[k], int(linked[k].sum()), int(copies[linked[k]].sum()), keys[top], float(stands_for[k].sum())))
    return out


def _compare(batches: Iterator, threshold: float, size: int, trees: int, depth: int) -> Iterator:
    """Sorted rows of (leader, i, j) in; the shingle sets of one group are held at a time, at most two blocks."""
    import pyarrow as pa
    import xxhash

    schema = pa.schema([("key", pa.binary()), ("texts", pa.int64()), ("docs", pa.int64()), ("root", pa.binary()), ("stands_for", pa.float64())])

    def made(group, rows, out):
        out.extend(_links(list(rows.values()), group[0], group[1] == group[2], threshold, trees, depth))

    def packed(out):
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    ids = WordIds()
    at, rows, out = None, {}, []
    for batch in batches:
        cols = [each(batch, c) for c in ("leader", "i", "j", "key", "copies", "leaders", "text", "block")]
        for leader, i, j, key, copies, leaders, text, block in zip(*cols, strict=True):
            if (leader, i, j) != at:
                if at:
                    made(at, rows, out)
                at, rows = (leader, i, j), {}
            if key in rows:  # a repeated row stands for the same class
                continue
            tokens = (text or "").split()
            if xxhash.xxh3_128_digest(" ".join(tokens).encode("utf-8", "surrogatepass")) == key:  # not another text of the same row hash
                rows[key] = key, copies, leaders, shingle_hashes(ids.hashes(tokens), size), block
                ids.trimmed()
        if len(out) > 10_000:
            yield packed(out)
            out = []
    if at:
        made(at, rows, out)
    yield packed(out)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node that it is connected to.

    Alternating large-star and small-star steps, each written out; a logarithmic number of rounds.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, large["a"] == least["n"]).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        )
        edges = stored(small.select("e.*").where("a != b").distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b"), F.col("b")).distinct())


def _forest(sketch: DataFrame, trees: int, least: int) -> DataFrame:
    """(name, signature, shared): of the sorted trees the rows that share at least `least` values with a neighbour, stored."""
    classes = sketch.where("key is not null").groupBy("key").agg(F.first("signature").alias("signature"))
    width = 1 + VALUE * MAX_DEPTH
    part = F.expr(f"substring(signature, {width} * tree + 1, {width})")
    grown = classes.select(F.xxhash64("key").alias("name"), "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    grown = grown.select("name", part.alias("signature")).repartitionByRange("signature", "name").sortWithinPartitions("signature", "name")
    ranked = grown.mapInArrow(lambda b: _neighbours(b, MAX_DEPTH), "name bigint, signature binary, shared int")
    return stored(ranked.where(F.col("shared") >= least), "forest")


def _members(forest: DataFrame, depth: int) -> DataFrame:
    """(name, leaders): the least classes of the nodes at `depth` that a class shares with others, and the blocks of each."""
    node = F.substring("signature", 1, 1 + VALUE * depth).alias("node")
    rows = forest.where(F.col("shared") >= depth).select("name", node)
    crowded = rows.groupBy("node").agg(F.min("name").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    member = rows.join(crowded, "node").select("name", "leader").distinct()
    # Counted here, where no text has to come along.
    blocks = member.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return member.join(blocks, "leader").groupBy("name").agg(F.sort_array(F.collect_set(F.struct("leader", "blocks"))).alias("leaders"))


def row_bits(rows: DataFrame) -> DataFrame:
    """(map, bits): a bitmap of the hashes in `row`, cut into maps; of bounded size, whatever the rows."""
    bit = F.pmod("row", F.lit(BITS))
    return rows.groupBy(F.floor(bit / MAP).alias("map")).agg(F.bitmap_construct_agg(bit % MAP).alias("bits"))


def with_mark(rows: DataFrame, row: str, bits: DataFrame, mark: str) -> DataFrame:
    """The rows with `mark`, true where the bit of their hash is set: for all hashes put into `bits`, and a few others."""
    at, held = fresh(rows, "__map"), fresh(rows, "__bits")
    bit = F.pmod(F.col(row), F.lit(BITS))
    # At most BITS / MAP rows of MAP bits.
    joined = rows.join(F.broadcast(bits.select(F.col("map").alias(at), F.col("bits").alias(held))), F.floor(bit / MAP) == F.col(at), "left")
    byte = F.conv(F.hex(F.substring(F.col(held), (F.floor(bit % MAP / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(mark, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop(at, held)


def _found(rows: DataFrame, classes: DataFrame, member: DataFrame, threshold: float, size: int, trees: int, depth: int) -> DataFrame:
    """(key, texts, docs, root, stands_for) of the classes linked, under all leaders."""
    # Classes of one name, if ever, have each other's leaders too: more is compared, nothing else changes.
    taking_part = stored(member.join(classes, "name").drop("name"), "taking-part")
    # Most texts stand alone and needn't move: the bitmap leaves out what surely takes no part, the join decides.
    asked = with_mark(rows.select("row", "text"), "row", row_bits(taking_part), "asked").where("asked")
    texts = asked.join(taking_part, "row")
    placed = texts.select("text", "key", "copies", F.col("leaders.leader").alias("leaders"), F.explode("leaders").alias("at"))
    placed = placed.select("text", "key", "copies", "leaders", "at.leader", "at.blocks")
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "key"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "copies", "leaders", "text", "block"
    )
    grouped = placed.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    links = "key binary, texts bigint, docs bigint, root binary, stands_for double"
    return grouped.mapInArrow(lambda b: _compare(b, threshold, size, trees, depth), links)


def measured_recall(links: DataFrame) -> float:
    """Pairs found over the pairs that they stand for; 1 where none is found."""
    found, stood_for = links.agg(F.sum("texts"), F.sum("stands_for")).first()
    return found / stood_for if found else 1.0


def _joined(docs: DataFrame, threshold: float, size: int, trees: int, target: float) -> DataFrame:
    """(row, doc_id, key, copies, texts, others, root) of each document; row is a hash of doc_id and text."""
    rows = docs.select(F.xxhash64(col("doc_id"), col("text")).alias("row"), col("doc_id"), col("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = rows.mapInArrow(lambda b: _sketch(b, trees, MAX_DEPTH, size), f"row bigint, doc_id {kind}, key binary, signature binary")
    sketch = stored(sketched, "sketch")
    classes = sketch.where("key is not null").groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("name", F.xxhash64("key")), "classes")

    for depth in range(MAX_DEPTH, 0, -1):
        if depth in (MAX_DEPTH, STORED_DEPTH - 1):
            forest = _forest(sketch, trees, STORED_DEPTH if depth >= STORED_DEPTH else 1)
        member = stored(_members(forest, depth), "members")
        found = stored(_found(rows, classes, member, threshold, size, trees, depth), "links")
        if measured_recall(found) >= target:
            break
    counts = found.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("others"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    known = classes.select("key", "copies").join(counts, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    known = stored(known.withColumn("root", F.coalesce("root", "key")), "known")
    return sketch.drop("signature").join(known, "key", "left")


def jaccard_join(
    docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, target: float = TARGET_RECALL
) -> DataFrame:
    """One row a document: class_id, n_links, n_text_links, n_copies.

    Documents are linked if the Jaccard similarity of their sets of `size`-word shingles (words parted
    by white space; a shorter text is one shingle) is at least `threshold`. class_id is the least
    doc_id of those connected by links; n_links counts the other documents linked, copies included,
    n_text_links the different texts linked, n_copies the documents with the same words, itself
    included. Null and wordless texts have no shingle: no links, their own doc_id as class. Repeated
    rows are documents of their own. Prefixes are shortened until the measured recall is `target`.
    """
    rows = _joined(docs, threshold, size, trees, target)
    first = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = rows.join(first, "root", "left")
    copies = F.coalesce("copies", F.lit(1)).cast("long")
    return out.select(
        "doc_id",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("others", F.lit(0)) + copies - 1).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        copies.alias("n_copies"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, target: float = TARGET_RECALL) -> DataFrame:
    """The documents, all columns unchanged, but of each connected group only the one with the least doc_id.

    Among equal ids a hash of id and text decides; of fully equal rows one stays. Wordless texts have
    no n-gram, belong to no group and all stay.
    """
    rows = _joined(docs, threshold, size, trees, target).where("root is not null")
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    grouped = stored(rows.select("row", "doc_id", "root").join(first, "root").select("row", "doc_id", F.col("first.row").alias("first")), "grouped")
    row, nth, out, out_id, mark = (fresh(docs, x) for x in ("__row", "__nth", "__gone", "__gone_id", "__mark"))
    gone = grouped.where("row != first").select(F.col("row").alias(out), F.col("doc_id").alias(out_id)).distinct()
    worded = F.coalesce(col("text"), F.lit("")).rlike(r"(?U)\S")
    # Documents of no group of two or more stay where they are; the others, and a few that share a bit, are looked up.
    named = with_mark(docs.withColumn(row, F.xxhash64(col("doc_id"), col("text"))), row, row_bits(grouped), mark)
    # The id goes along, so that equal hashes of two documents can't take one of them away.
    left = named.where(F.col(mark)).join(gone, (F.col(row) == F.col(out)) & col("doc_id").eqNullSafe(F.col(out_id)), "left_anti")
    alike = Window.partitionBy(row).orderBy(row)
    left = left.withColumn(nth, F.row_number().over(alike)).where((F.col(nth) == 1) | ~worded)
    return named.where(~F.col(mark)).select(*map(col, docs.columns)).unionAll(left.select(*map(col, docs.columns)))

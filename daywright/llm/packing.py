"""Vector bin packing of tokenized examples into sequences.

A sequence has a capacity in three dimensions: tokens, segments (pieces of examples) and tokens that
bear loss. An example of more tokens than a sequence is cut; its full lengths are sequences of their
own if the limits let them. The rest of each example is placed by the dot-product heuristic: into the
open sequence goes, of the pieces that fit in every dimension, the one whose size vector, in shares
of the capacity, has the largest dot product with what is left of the capacity, so that pieces
which use what the sequence has most of come first. What no piece fits is filled by cutting one.

Each task packs its own rows from a pool of bounded size and closes a sequence before it begins the
next; there is no shuffle, and at most one sequence a task is left unfilled.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daywright.llm.common import col

LENGTH, MAX_SEGMENTS = 2048, 256

#: Pieces among which the heuristic chooses; tokens that a piece cut to fill a gap has at least.
POOL, LEAST_CUT = 512, 16

#: Sequences of a task are numbered from (task number) x this.
TASK_SPAN = 1 << 36


class Tokenizer(dict):
    """Ids of whole texts as little-endian 32-bit bytes, by a tokenizer file of the tokenizers library.

    Byte-level pre-tokens never cross a space before a character that isn't white space, so texts are
    taken apart there, and each distinct chunk is encoded once and remembered: of each `most` chunks those
    that the next `most` have again. `ranks`, if given, is the file of the same vocabulary as ranks, whose
    encoder makes the same ids faster for short chunks. A text with a special token's string goes to the
    first file's model whole.
    """

    #: How a text falls into pre-tokens: a fixed value that belongs to the vocabulary.
    PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str, ranks: str | None = None, most: int = 50_000, short: int = 1_000):
        from tokenizers import Tokenizer as Model

        super().__init__()
        self.before: dict[str, bytes] = {}
        self.model, self.fast, self.most, self.short = Model.from_file(path), None, most, short
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=self.PRE_TOKENS, mergeable_ranks=known, special_tokens={})

    @staticmethod
    def chunks(text: str) -> list[str]:
        out = []
        for p in text.split(" "):
            if p and not p[0].isspace():
                out.append(" " + p)
            elif out:
                out[-1] += " " + p
            else:
                out.append(" " + p)
        out[0] = out[0][1:]
        return out

    def __missing__(self, chunk: str) -> bytes:
        import struct

        out = self.before.pop(chunk, None)
        if out is None:
            ids = self.fast.encode_ordinary(chunk) if self.fast and len(chunk) <= self.short else self._ids(chunk)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[chunk] = out
        return out

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def encoded(self, texts: list[str]) -> list[bytes]:
        import struct

        out = []
        for t in texts:
            if any(s in t for s in self.special):
                ids = self._ids(t)
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                out.append(b"".join(map(self.__getitem__, self.chunks(t))))
        return out


class Packer:
    """Places pieces (example, start, tokens, loss) into sequences; closed sequences go to `out`."""

    def __init__(self, limits: tuple[int, int, int], first: int, pool: int = POOL):
        import numpy as np

        self.limits, self.next, self.pool = np.array(limits, float), first, pool
        self.size = np.zeros((2 * pool, 3))
        self.pieces: list = [None] * (2 * pool)
        self.n = 0
        self.out: list[tuple] = []

    def add(self, example, tokens: int, loss) -> None:
        """An example in pieces that fit; loss: the place from which its tokens bear loss, or None for all."""
        length, _, most_loss = self.limits.astype(int).tolist()
        at = 0
        while tokens - at >= min(length, most_loss):
            step = min(length, most_loss, tokens - at)
            self._close([(example, at, step)])
            at += step
        if at < tokens or not tokens:
            self._put((example, at, tokens - at, loss))
        if self.n >= 2 * self.pool - 1:
            self.pack(self.pool)

    def _loss(self, start: int, n: int, loss) -> int:
        return n if loss is None else max(0, min(n, start + n - loss))

    def _put(self, piece: tuple) -> None:
        example, start, n, loss = piece
        self.size[self.n] = (n, 1, self._loss(start, n, loss))
        self.pieces[self.n] = piece
        self.n += 1

    def _take(self, k: int) -> tuple:
        piece, last = self.pieces[k], self.n - 1
        self.pieces[k], self.size[k] = self.pieces[last], self.size[last]
        self.pieces[last] = None
        self.n = last
        return piece

    def _close(self, placed: list[tuple]) -> None:
        offset = 0
        for example, start, n in placed:
            self.out.append((example, start, n, self.next, offset))
            offset += n
        self.next += 1

    def pack(self, leave: int) -> None:
        """Closes sequences until no more than `leave` pieces wait."""
        import numpy as np

        while self.n > leave:
            left, placed = self.limits.copy(), []
            while self.n and left[1] >= 1:
                size = self.size[: self.n]
                score = size @ (left / self.limits**2)
                score[(size > left).any(axis=1)] = -1
                k = int(np.argmax(score))
                if score[k] < 0:
                    gap = int(min(left[0], left[2]))
                    if gap < LEAST_CUT:
                        break
                    k = int(np.argmax(size[:, 0]))
                    example, start, n, loss = self._take(k)
                    placed.append((example, start, gap))
                    left -= (gap, 1, self._loss(start, gap, loss))
                    self._put((example, start + gap, n - gap, loss))
                    continue
                left -= size[k]
                example, start, n, _ = self._take(k)
                placed.append((example, start, n))
            self._close(placed)


def _packed(batches: Iterator, path: str, ranks: str | None, end_id: int, length: int, segments: int, most_loss: int, id_type) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    tokenizer = Tokenizer(path, ranks)
    packer = Packer((length, segments, most_loss), TaskContext.get().partitionId() * TASK_SPAN)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def rows():
        # An example is (doc_id, its ids as bytes): a checksum is made once its pieces are known.
        cols = [[], [], [], [], [], [], []]
        for (doc_id, ids), start, n, sequence, offset in packer.out:
            values = (doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, sequence, offset)
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        packer.out = []
        return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names)

    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for k in range(0, batch.num_rows, 500):
            some = [t or "" for t in texts.slice(k, 500).to_pylist()]
            for doc_id, e in zip(ids[k : k + 500], tokenizer.encoded(some), strict=True):
                e += end
                packer.add((doc_id, e), len(e) // 4, None)
            yield rows()
    packer.pack(0)
    yield rows()


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    end_id: int = 1,
    length: int = LENGTH,
    segments: int = MAX_SEGMENTS,
    most_loss: int | None = None,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    A document's ids are those of its text (null: empty) and `end_id`, all bearing loss; each lies in
    exactly one piece. Pieces stand in their sequence one after another from offset 0. Repeated rows
    are packed one by one and null ids are carried along; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    rows = docs.select(col("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda x: _packed(x, tokenizer, ranks, end_id, length, segments, most_loss or length, id_type), schema)


def pack_examples(examples: DataFrame, length: int = LENGTH, segments: int = 16, most_loss: int = LENGTH) -> DataFrame:
    """Instruction data: (example_id, start, length, sequence_id, offset) for (example_id, tokens, loss_tokens).

    The last `loss_tokens` of an example bear loss (the answer follows the prompt); a sequence keeps all
    three limits. Null counts are 0; loss is at most the tokens; an example of no tokens has one empty piece.
    """
    kind = examples.schema["example_id"].dataType.simpleString()

    def packed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        packer, id_type = Packer((length, segments, most_loss), TaskContext.get().partitionId() * TASK_SPAN), None

        def rows():
            done, packer.out = packer.out, []
            values = [[x[0] for x in done], *[[x[k] for x in done] for k in range(1, 5)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(values[0], id_type), *[pa.array(v, pa.int64()) for v in values[1:]]], ["example_id", "start", "length", "sequence_id", "offset"]
            )

        for batch in batches:
            id_type = batch.column("example_id").type
            for example, n, loss in zip(*[batch.column(c).to_pylist() for c in ("example_id", "tokens", "loss_tokens")], strict=True):
                n = max(0, n or 0)
                packer.add(example, n, n - min(n, max(0, loss or 0)))
            yield rows()
        if id_type is not None:
            packer.pack(0)
            yield rows()

    schema = f"example_id {kind}, start bigint, length bigint, sequence_id bigint, offset bigint"
    return examples.select("example_id", F.col("tokens").cast("long"), F.col("loss_tokens").cast("long")).mapInArrow(packed, schema)

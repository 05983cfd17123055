"""Benchmark decontamination by latent semantic retrieval and a longest-common-subsequence check.

Corpus texts are read as passages of `HOP` words. TF-IDF runs over the words of the benchmark (no
other word can make a passage more like an item), with document frequencies over all passages. Its
latent space comes from a randomised SVD: the range is drawn from random mixtures of the benchmark's
own TF-IDF rows, every task projects all its passages into that range and adds up their Gram matrix,
and the sum's eigenvectors and singular values turn the range into right singular vectors scaled by
inverse singular values. That scaling makes what all passages share small and what few have large,
so common wording doesn't hide an item. Only sums of a fixed size leave the tasks.

Windows of whole passages, wide enough for an item at any offset, are compared with the items by
cosine. Each candidate is checked on its words: a leak has a common subsequence of `LCS_SURE` of the
item's words, or, as paraphrases do, of `LCS_LIKELY` and in it `ANSWER_SHARE` of the item's answer
(its last quarter). Words are compared in lower case without punctuation around them.

The benchmark is a query set: it is taken in blocks of `ITEMS` items, each against all rows, so what
a task holds is bounded by the block and not by the benchmark. Texts are taken from a batch one by one
and searched in runs of bounded size, so beside the batch itself a task holds one run.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daywright.llm.common import col, each, stored

#: Words of a passage, the most words of an item's part, items of a block.
HOP, PART, ITEMS = 32, 64, 1_000

#: Windows whose cosines are in memory at a time, candidates whose words are.
WINDOWS, CANDIDATES = 1_024, 2_000

#: Dimensions of the latent space at most, cosine of a candidate.
RANK, MIN_COSINE = 256, 0.35

LCS_SURE, LCS_LIKELY, ANSWER_SHARE = 0.8, 0.6, 0.8

_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&@~^_=+-/\\«»“”‘’„…¿¡"


def plain_words(text: str | None) -> list[str]:
    """Words in lower case, punctuation around them gone."""
    return [w for w in (x.strip(_EDGE).lower() for x in (text or "").split()) if w]


class Vocabulary(dict):
    """Written word -> number of its plain form: -1 outside the benchmark, -2 for no word. Remembers up to `most` forms."""

    def __init__(self, terms: dict[str, int], most: int = 50_000):
        super().__init__()
        self.terms, self.most = terms, most

    def __missing__(self, word: str) -> int:
        plain = word.strip(_EDGE).lower()
        if len(self) > self.most:
            self.clear()
        self[word] = n = self.terms.get(plain, -1) if plain else -2
        return n

    def encoded(self, text: str | None):
        """(number of words, places and numbers of the benchmark's words)."""
        import numpy as np

        tokens = (text or "").split()
        ids = np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))
        ids = ids[ids != -2]
        places = np.flatnonzero(ids >= 0).astype(np.int32)
        return len(ids), places, ids[places]


def item_parts(items: list[tuple]) -> list[tuple]:
    """(item_id, words) of each item; an item of over `PART` words in overlapping parts of that size."""
    out = []
    for item_id, text in items:
        tokens = plain_words(text)
        starts = range(0, len(tokens), PART // 2) if len(tokens) > PART else [0] if tokens else []
        out += [(item_id, tokens[min(s, max(0, len(tokens) - PART)) :][:PART]) for s in starts]
    return out


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bits of one integer a column."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        if u:
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Index:
    """Terms, projection and items of one block of the benchmark; shipped to the tasks.

    `project` is terms x rank; `items` holds (item_id, term numbers, latent unit vector, scale), scale
    being the number of passages that a window needs to hold the item at any offset.
    """

    def __init__(self, parts: list[tuple]):
        import numpy as np

        self.parts = parts
        self.terms = {w: k for k, w in enumerate(sorted({w for _, tokens in parts for w in tokens}))}
        self.numbered = [[self.terms[w] for w in tokens] for _, tokens in parts]
        self.project = None
        self.needs = np.array([max(1, math.ceil(LCS_LIKELY * len(ids) - 1e-9)) for ids in self.numbered], np.int64)
        self.counts = np.zeros((len(parts), len(self.terms)), np.uint8)
        for k, ids in enumerate(self.numbered):
            np.add.at(self.counts[k], ids, 1)

    def tfidf(self, idf):
        import numpy as np

        x = np.zeros((len(self.parts), len(self.terms)))
        for k, ids in enumerate(self.numbered):
            np.add.at(x[k], ids, 1)
        return x * idf

    def range_from(self, df, passages: int, seed: int = 11) -> Index:
        """Sets `project` to an orthonormal basis of random mixtures of the items' rows, weighted by idf."""
        import numpy as np

        idf = np.log((1.0 + passages) / (1.0 + df))
        idf = np.maximum(idf, 0.01)
        self.weight = idf
        rows = self.tfidf(idf)
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        rank = min(RANK, *rows.shape)
        mixed = np.random.default_rng(seed).standard_normal((rank, len(rows))) @ rows
        self.basis = np.linalg.qr(mixed.T)[0]
        self.project = (idf[:, None] * self.basis).astype(np.float32)
        return self

    def scaled_by(self, gram, passages: int) -> Index:
        """From the passages' Gram matrix in the range: right singular vectors over singular values."""
        import numpy as np

        value, vector = np.linalg.eigh(gram / max(1, passages))
        value = np.maximum(value, value.max(initial=0) * 1e-9 + 1e-12)
        turn = vector / np.sqrt(value)
        self.project = (self.weight[:, None] * (self.basis @ turn)).astype(np.float32)
        latent = self.tfidf(np.ones(len(self.terms))) @ self.project
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        scale = [-(-len(ids) // HOP) + 1 for ids in self.numbered]
        self.scales = {s: ([k for k in range(len(scale)) if scale[k] == s], latent[[k for k in range(len(scale)) if scale[k] == s]].T.astype(np.float32)) for s in set(scale)}
        del self.basis
        return self

    def passage_vectors(self, texts: list[tuple], gap: int):
        """Latent vectors of the passages of all texts, one after another with `gap` empty ones between; each text's first."""
        import numpy as np

        firsts, at = [], 0
        for n, _, _ in texts:
            firsts.append(at)
            at += -(-n // HOP) + gap
        out = np.zeros((at, self.project.shape[1]), np.float32)
        passage = np.concatenate([f + places // HOP for f, (_, places, _) in zip(firsts, texts, strict=True)])
        ids = np.concatenate([x for _, _, x in texts])
        # Passages with most words first: the k-th words of all that have one are added at a time.
        start = np.flatnonzero(np.diff(passage, prepend=-1))
        n = np.diff(start, append=len(ids))
        for k in range(0, len(start), 4_096):
            some = k + np.argsort(-n[k : k + 4_096], kind="stable")
            total = np.zeros((len(some), out.shape[1]), np.float32)
            having = np.searchsorted(-n[some], -np.arange(n[some[0]]), "left")
            for j, m in enumerate(having.tolist()):
                total[:m] += self.project[ids[start[some[:m]] + j]]
            out[passage[start[some]]] = total
        return out, firsts

    def shared_words(self, ids, lo, hi, part):
        """For each candidate, how many of the words ids[lo:hi] the part has at most: never less than their common subsequence."""
        import numpy as np

        out = np.zeros(len(lo), np.int64)
        long = np.flatnonzero(hi - lo >= self.needs[part])
        for k in range(0, len(long), CANDIDATES):
            some = long[k : k + CANDIDATES]
            n = hi[some] - lo[some]
            row = np.repeat(np.arange(len(some)), n)
            word = ids[np.arange(len(row)) + np.repeat(lo[some] - (np.cumsum(n) - n), n)].astype(np.int64)
            known = self.counts[part[some][row], word]
            row, word, known = row[known > 0], word[known > 0], known[known > 0]
            out[some] = np.bincount(row, minlength=len(some))
            # Of the few left, a word counts as often as both have it.
            left = (out[some] >= self.needs[part[some]])[row]
            pair, first, times = np.unique(row[left] * len(self.terms) + word[left], return_index=True, return_counts=True)
            exact = np.bincount(pair // len(self.terms), np.minimum(times, known[left][first]), len(some)).astype(np.int64)
            out[some] = np.minimum(out[some], np.where(out[some] >= self.needs[part[some]], exact, out[some]))
        return out

    def leaks(self, texts: list[tuple]) -> list[tuple]:
        """(text number, item_id, share of the item's words in order, of its answer's, cosine) of every leak."""
        import numpy as np

        gap = max(self.scales, default=1)
        vectors, firsts = self.passage_vectors(texts, gap)
        best: dict[tuple, tuple] = {}
        done: set[tuple] = set()
        # All texts' places in one row of passages, so that windows are cut from it by number.
        firsts_at, ids = np.array(firsts), np.concatenate([x for _, _, x in texts])
        places = np.concatenate([f * HOP + p.astype(np.int64) for f, (_, p, _) in zip(firsts, texts, strict=True)])
        before = np.cumsum([0] + [len(p) for _, p, _ in texts])
        for scale, (parts, items) in self.scales.items():
            hits = []
            for v in range(0, len(vectors) - scale + 1, WINDOWS):
                m = min(WINDOWS, len(vectors) - scale + 1 - v)
                window = vectors[v : v + m].copy()
                for k in range(1, scale):
                    window += vectors[v + k : v + k + m]
                cosine = window @ items
                cosine /= np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-30)[:, None]
                w, p = np.nonzero(cosine >= MIN_COSINE)
                hits.append((v + w, p, cosine[w, p]))
            w, p, near = (np.concatenate(x) for x in zip(*hits, strict=True))
            part = np.array(parts)[p]
            lo, hi = np.searchsorted(places, w * HOP), np.searchsorted(places, (w + scale) * HOP)
            enough = self.shared_words(ids, lo, hi, part) >= self.needs[part]
            for w, part, lo, hi, cosine in zip(*[x[enough].tolist() for x in (w, part, lo, hi, near)], strict=True):
                t = int(np.searchsorted(firsts_at, w, "right")) - 1
                lo, hi = max(lo, int(before[t])), min(hi, int(before[t + 1]))
                if hi <= lo or (part, lo, hi) in done:
                    continue
                done.add((part, lo, hi))
                item = self.numbered[part]
                inside = ids[lo:hi].tolist()
                found = lcs(item, inside)
                if found < self.needs[part]:
                    continue
                answer = item[-max(1, len(item) // 4) :]
                share, told = found / len(item), lcs(answer, inside) / len(answer)
                if share >= LCS_SURE or told >= ANSWER_SHARE:
                    key = (t, self.parts[part][0])
                    best[key] = max(best.get(key, (0.0,)), (share, told, cosine))
        return [(*key, *value) for key, value in sorted(best.items(), key=lambda x: (x[0][0], str(x[0][1])))]


def _groups(texts: Iterable[tuple], most: int = 60_000) -> Iterator[list[tuple]]:
    """Texts in runs of some `most` words, so that matrices stay small; a longer text is a run of its own."""
    run, n = [], 0
    for t in texts:
        if run and n + t[0] > most:
            yield run
            run, n = [], 0
        run.append(t)
        n += t[0]
    if run:
        yield run


def _encode(batches: Iterator, terms: dict[str, int]) -> Iterator:
    import pyarrow as pa

    vocabulary = Vocabulary(terms)
    for batch in batches:
        before = 0
        for rows in _groups(map(vocabulary.encoded, each(batch, "text"))):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(before, len(rows)),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1].tobytes() for r in rows], pa.binary()),
                    pa.array([r[2].tobytes() for r in rows], pa.binary()),
                ],
                ["doc_id", "n", "places", "ids"],
            )
            before += len(rows)


def _decoded(batch) -> Iterator[tuple]:
    import numpy as np

    for n, p, i in zip(*(each(batch, c) for c in ("n", "places", "ids")), strict=True):
        yield n, np.frombuffer(p, np.int32), np.frombuffer(i, np.int32)


def _frequencies(batches: Iterator, terms: int) -> Iterator:
    """(term, passages with it); the number of passages under term -1."""
    import numpy as np
    import pyarrow as pa

    df, passages = np.zeros(terms, np.int64), 0
    for batch in batches:
        for n, places, ids in _decoded(batch):
            df += np.bincount(np.unique((places // HOP).astype(np.int64) * terms + ids) % terms, minlength=terms) if len(ids) else 0
            passages += -(-n // HOP)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], passages))], ["term", "n"])


def _gram(batches: Iterator, index: Index) -> Iterator:
    """Rows of the Gram matrix of the task's passages in the range."""
    import numpy as np
    import pyarrow as pa

    rank = index.project.shape[1]
    total = np.zeros((rank, rank))
    for batch in batches:
        for run in _groups(_decoded(batch)):
            x, _ = index.passage_vectors(run, 0)
            total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(rank)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])


def _leaks(batches: Iterator, index: Index, item_type) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        out, before = [], 0
        for run in _groups(_decoded(batch)):
            out += [(before + t, *rest) for t, *rest in index.leaks(run)]
            before += len(run)
        rows = pa.array([x[0] for x in out], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), pa.array([x[1] for x in out], item_type), *[pa.array([x[k] for x in out], pa.float64()) for k in (2, 3, 4)]],
            ["doc_id", "item_id", "lcs_share", "answer_share", "cosine"],
        )


def _clean(batches: Iterator, index: Index, read: str) -> Iterator:
    import pyarrow as pa

    vocabulary = Vocabulary(index.terms)
    for batch in batches:
        before = 0
        for run in _groups(map(vocabulary.encoded, each(batch, read))):
            bad = {x[0] for x in index.leaks(run)}
            yield batch.slice(before, len(run)).filter(pa.array([n not in bad for n in range(len(run))], pa.bool_()))
            before += len(run)


def _summed(batches: Iterator) -> Iterator:
    """Sums of matrix rows, one row number after another in sorted batches."""
    import numpy as np
    import pyarrow as pa

    total: dict[int, object] = {}
    for batch in batches:
        for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist(), strict=True):
            total[i] = total.get(i, 0) + np.array(row)
    yield pa.RecordBatch.from_pylist([{"i": i, "row": r.tolist()} for i, r in total.items()], pa.schema([("i", pa.int64()), ("row", pa.list_(pa.float64()))]))


def _indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Index, DataFrame]]:
    """For each block of the benchmark its index, fitted on all passages, and the encoded documents."""
    import numpy as np

    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    blocks = max(1, -(-items.count() // ITEMS))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        parts = item_parts([tuple(r) for r in block.distinct().collect()])
        if not parts:
            continue
        index = Index(parts)
        terms, n = index.terms, len(index.terms)
        kind = docs.schema["doc_id"].dataType.simpleString()
        coded = docs.select(col("doc_id"), col("text")).mapInArrow(lambda x, terms=terms: _encode(x, terms), f"doc_id {kind}, n bigint, places binary, ids binary")
        coded = stored(coded, "coded")
        df, passages = np.zeros(n), 0
        counts = coded.mapInArrow(lambda x, n=n: _frequencies(x, n), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        for term, k in counts.collect():  # at most a row a term of the block
            if term < 0:
                passages = k
            else:
                df[term] = k
        index.range_from(df, passages)
        rank = index.project.shape[1]
        rows = coded.mapInArrow(lambda x, index=index: _gram(x, index), "i bigint, row array<double>")
        gram = np.zeros((rank, rank))
        for i, row in rows.repartition(64, "i").mapInArrow(_summed, "i bigint, row array<double>").collect():  # rank rows
            gram[i] = row
        yield index.scaled_by(gram, passages), coded


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, lcs_share, answer_share, cosine) of every leak of a benchmark item into a document.

    Null and empty texts have no leaks and an empty benchmark finds none; repeated rows of documents
    are searched one by one; repeated items count once (by id and text); an item with a null id is
    searched like any other.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, lcs_share double, answer_share double, cosine double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index, coded in _indexes(docs, benchmark):
        item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
        out = out.union(coded.mapInArrow(lambda x, index=index, item_type=item_type: _leaks(x, index, item_type), schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with no leak, all columns unchanged."""
    # Arrow functions can't name columns with dots: columns go by number meanwhile.
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    out, text = plain, f"c{docs.columns.index('text')}"
    for index, _ in _indexes(docs, benchmark):
        out = out.mapInArrow(lambda x, index=index: _clean(x, index, text), plain.schema)
    return out.toDF(*docs.columns)

"""Quality classifier: n-gram indicators scaled by class log-count ratios under a linear hinge-loss model.

A document's features are the set of its words, the three-character n-grams of its words (with marks
of where a word begins and ends), and its word pairs, a word that repeats the one before being written as a mark of its own; each is hashed to
one of `BUCKETS`. The log-count ratio of a feature is its smoothed share among documents of label 1
over that of label 0; a document is the vector of its features' ratios, scaled to length one. The
support vector machine is fitted by dual coordinate descent on at most `SAMPLE` labelled documents
(those with the least hashes of their ids), one part of which is held back to turn margins into
probabilities (Platt's sigmoid). The fit is one bounded task; every document is scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daywright.llm.common import col, mixed

#: Labelled documents that the model is fitted on at most.
SAMPLE = 20_000

BUCKETS, SMOOTHING, COST, PASSES = 1 << 18, 1.0, 1.0, 12

#: Characters of a text hashed at a time.
PIECE = 1 << 20

#: A document is predicted to be good from this score on.
PREDICTED = 0.3


class Features:
    """Sets of bucket numbers, in no order. A text is hashed as one array of code points, a piece at a time."""

    def __init__(self):
        import numpy as np

        self.last = np.zeros(BUCKETS, np.int32)

    def _distinct(self, buckets):
        """Each number once: the place that is its last one. Linear, and nothing to be cleared."""
        import numpy as np

        places = np.arange(len(buckets), dtype=np.int32)
        self.last[buckets] = places
        return buckets[self.last[buckets] == places]

    def of(self, text: str | None):
        import numpy as np

        parts, before = [], None
        for words in _pieces(text or ""):
            # Every word between a mark of its begin and one of its end.
            points = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
            starts = np.cumsum(sizes) - sizes
            first, second, third = points[:-2], points[1:-1], points[2:]
            inside = (first != 3) & (second != 3)  # not from one word into the next
            grams = mixed((first[inside] << np.uint64(42)) + (second[inside] << np.uint64(21)) + third[inside])
            place = np.arange(len(points), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), sizes)
            word = mixed(np.add.reduceat(mixed(points + (place << np.uint64(21))), starts))
            chain = word if before is None else np.concatenate([before, word])
            same = chain[1:] == chain[:-1]
            pairs = mixed(np.where(same, np.uint64(7), chain[:-1]) * np.uint64(3) + np.where(same, np.uint64(7), chain[1:]))
            before = word[-1:]
            # Words, grams and pairs differ by where they start from.
            hashes = np.concatenate([word, grams + np.uint64(1), pairs + np.uint64(2)])
            parts.append(self._distinct((hashes % np.uint64(BUCKETS)).astype(np.int32)))
        if not parts:
            return np.empty(0, np.int32)
        return parts[0] if len(parts) == 1 else self._distinct(np.concatenate(parts))


def _pieces(text: str) -> Iterator[list[str]]:
    """The words of a text, a piece at a time; pieces are cut at white space."""
    import re

    gap = re.compile(r"\s")
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            cut = gap.search(text, at + PIECE)
            end = cut.start() if cut else end
        words = text[at:end].split()
        if words:
            yield words
        at = end


def log_count_ratios(rows: list, good):
    """log of (share of a feature among good documents / among the others), smoothed."""
    import numpy as np

    def shares(some):
        n = np.full(BUCKETS, SMOOTHING)
        for x in some:
            n[x] += 1
        return np.log(n / n.sum())

    return shares([x for x, y in zip(rows, good, strict=True) if y]) - shares([x for x, y in zip(rows, good, strict=True) if not y])


def dual_coordinate_descent(vectors: list[tuple], y, size: int, cost: float = COST, passes: int = PASSES, seed: int = 5):
    """Weights (the last is the bias) of the L1-loss linear support vector machine over sparse vectors (places, values)."""
    import numpy as np

    w, bias = np.zeros(size), 0.0
    alpha, rng = np.zeros(len(y)), np.random.default_rng(seed)
    norms = np.array([float(v @ v) + 1.0 for _, v in vectors])
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(y)):
            at, v = vectors[i]
            gradient = y[i] * (float(w[at] @ v) + bias) - 1.0
            a = alpha[i]
            new = min(max(a - gradient / norms[i], 0.0), cost)
            if new != a:
                step = (new - a) * y[i]
                w[at] += step * v
                bias += step
                alpha[i] = new
                worst = max(worst, abs(new - a))
        if worst < 1e-3:
            break
    return w, bias


def sigmoid_fit(margin, good, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))) by Newton steps with Platt's smoothed targets."""
    import numpy as np

    m, y = np.asarray(margin, float), np.asarray(good, bool)
    n1, n0 = int(y.sum()), int((~y).sum())
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = target - p, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[h @ (m * m) + 1e-6, h @ m], [h @ m, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([g @ m, g.sum()]))
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def _scaled(at, ratio):
    import numpy as np

    v = ratio[at]
    return v / max(float(np.sqrt(v @ v)), 1e-9)


def fit(texts: list[str | None], good: list[int], part: list[int]):
    """(weights by feature, ratios, bias, a, b); rows of part 0 are held back for the sigmoid.

    With one label only, weights are 0 and the sigmoid gives that label's smoothed share; without any, 0.5.
    """
    import numpy as np

    features, y, held = Features(), np.array(good, bool), np.array(part) == 0
    rows = [features.of(t) for t in texts]
    if not len(y) or y.all() or not y.any():
        p = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(p / (1 - p)))
    if y[held].all() or not y[held].any() or y[~held].all() or not y[~held].any():
        held[:] = False
    learnt = np.flatnonzero(~held)
    ratio = log_count_ratios([rows[i] for i in learnt], y[learnt])
    w, bias = dual_coordinate_descent([(rows[i], _scaled(rows[i], ratio)) for i in learnt], np.where(y[learnt], 1.0, -1.0), BUCKETS)
    judged = np.flatnonzero(held) if held.any() else learnt
    a, b = sigmoid_fit([float(w[rows[i]] @ _scaled(rows[i], ratio)) + bias for i in judged], y[judged])
    return w.astype(np.float32), ratio.astype(np.float32), bias, a, b


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)).cast("int")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The model from labelled documents outside the held-out fold."""
    import numpy as np

    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(col("doc_id"), col("text")).join(F.broadcast(known), "doc_id")  # at most `sample` rows are broadcast
    # Of repeated rows of an id the least text is learnt from, a null one before all.
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.select("doc_id", "text", "quality", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)).cast("int").alias("part"), F.lit(0).alias("all"))

    def fitted(pdf):
        import pandas as pd

        pdf = pdf.sort_values("doc_id", ignore_index=True)  # the solver's steps follow the order of the rows
        w, ratio, bias, a, b = fit(pdf["text"].tolist(), (pdf["quality"] > 0).astype(int).tolist(), pdf["part"].tolist())
        return pd.DataFrame({"w": [w.tobytes()], "ratio": [ratio.tobytes()], "bias": [bias], "a": [a], "b": [b]})

    found = rows.groupBy("all").applyInPandas(fitted, "w binary, ratio binary, bias double, a double, b double").collect()
    if not found:
        return fit([], [], [])
    r = found[0]
    return np.frombuffer(r["w"], np.float32), np.frombuffer(r["ratio"], np.float32), r["bias"], r["a"], r["b"]


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted, for every document by its whole text.

    Null and empty texts have no feature and the score of the bias alone. Of repeated labels of an id
    the highest counts; of repeated rows of a labelled id the least text is learnt from, all are scored. Ids that
    are null are never held out.
    """
    model = train(docs, labels, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        w, ratio, bias, a, b = model
        weighted, squared = (w.astype(float) * ratio).astype(np.float64), ratio.astype(np.float64) ** 2
        features = Features()
        for batch in batches:
            margins = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column("text")):
                at = features.of(text.as_py())
                margins[k] = bias + (weighted[at].sum() / max(float(np.sqrt(squared[at].sum())), 1e-9) if len(at) else 0.0)
            p = 1 / (1 + np.exp(-np.clip(a * margins + b, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p)], ["doc_id", "held_out", "score"])

    rows = docs.select(col("doc_id"), F.coalesce(fold(col("doc_id")) == 0, F.lit(False)).alias("held_out"), col("text"))
    out = rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= PREDICTED).cast("int"))

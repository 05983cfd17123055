"""The classifier against a plain version of its steps, and its independence of the order of rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daywright.llm import quality_classifier as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")


def test_scores_do_not_depend_on_the_order_of_the_rows(spark, tables):
    docs, labels = tables
    docs = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" second row of the id"))))
    one = {(r.doc_id, round(r.score, 15)) for r in Q.score(docs, labels).collect()}
    mixed_up = docs.orderBy(F.xxhash64("text", F.lit(9))).repartition(5)
    assert {(r.doc_id, round(r.score, 15)) for r in Q.score(mixed_up, labels.orderBy(F.desc("doc_id"))).collect()} == one


def test_scores_equal_a_plain_version(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r.score for r in Q.score(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    features = Q.Features()
    sets = {d: set(features.of(t).tolist()) for d, t in texts.items()}
    learn = docs.select("doc_id").join(labels, "doc_id").where("quality is not null").where(Q.fold(F.col("doc_id")) != 0)
    learn = learn.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5))).orderBy("doc_id").collect()
    fitted, judged = [r for r in learn if r.part != 0], [r for r in learn if r.part == 0]

    def log_share(good):
        n = {}
        for r in fitted:
            if (r.quality > 0) == good:
                for f in sets[r.doc_id]:
                    n[f] = n.get(f, 0) + 1
        total = sum(n.values()) + Q.BUCKETS
        return lambda f: math.log((n.get(f, 0) + 1) / total)

    good, bad = log_share(True), log_share(False)

    def vector(doc_id):
        v = {f: good(f) - bad(f) for f in sets[doc_id]}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / size for f, x in v.items()} if size else {}

    vectors = [vector(r.doc_id) for r in fitted]
    y = [1 if r.quality > 0 else -1 for r in fitted]
    w, bias, alpha, rng = {}, 0.0, [0.0] * len(y), np.random.default_rng(5)
    for _ in range(Q.PASSES):
        worst = 0.0
        for i in rng.permutation(len(y)):
            margin = sum(w.get(f, 0.0) * x for f, x in vectors[i].items()) + bias
            norm = sum(x * x for x in vectors[i].values()) + 1
            new = min(max(alpha[i] - (y[i] * margin - 1) / norm, 0.0), Q.COST)
            for f, x in vectors[i].items():
                w[f] = w.get(f, 0.0) + (new - alpha[i]) * y[i] * x
            bias += (new - alpha[i]) * y[i]
            worst, alpha[i] = max(worst, abs(new - alpha[i])), new
        if worst < 1e-3:
            break

    def margin(doc_id):
        return sum(w.get(f, 0.0) * x for f, x in vector(doc_id).items()) + bias

    a, b = Q.sigmoid_fit([margin(r.doc_id) for r in judged], [r.quality > 0 for r in judged])
    for doc_id, text in texts.items():
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-(a * margin(doc_id) + b))), abs=1e-4), text[:40]


def test_features_are_distinct_and_the_same_in_pieces(monkeypatch):
    text = "one two two three  one two\nNaïve 漢字 😀 word\x00 " + " ".join(f"w{k % 50}" for k in range(300))
    whole = Q.Features().of(text)
    assert len(set(whole.tolist())) == len(whole) and 0 <= whole.min() and whole.max() < Q.BUCKETS
    monkeypatch.setattr(Q, "PIECE", 10)
    assert set(Q.Features().of(text).tolist()) == set(whole.tolist())
    assert len(Q.Features().of(" \n")) == len(Q.Features().of(None)) == 0
    assert set(Q.Features().of("a b").tolist()) != set(Q.Features().of("b a").tolist())

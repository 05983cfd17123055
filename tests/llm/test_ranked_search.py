"""Ranked search against plain scoring of every document, over many small blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pytest

from daywright.llm import ranked_search

from .conftest import documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain(docs, items, k=20):
    counted = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out, one = [], {}
    for item, text in items:
        one[item] = min((t for t in (one.get(item), text) if t is not None), default=None)
    for item, text in one.items():
        scores = []
        for doc_id, c, n in counted:
            m, score = 100 - 25 + (25 * n * n_docs) // n_terms, 0
            for t in terms_of(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, n):
    random.seed(seed)
    words = [f"{a}{b}" for a in ("ba", "Zo", "né", "漢", "k9") for b in range(30)]
    rows = [(k, " ".join(random.choices(words, weights=range(1, 151), k=random.randint(0, 60)))) for k in range(n)]
    rows += [(1000 + k, "ba1 Zo2, né3; the same copy") for k in range(80)]  # ties that a third of the rows share
    random.shuffle(rows)
    return rows


ITEMS = [
    (1, "ba1 zo2 NÉ3 né3 copy"), (2, "the same"), (3, "unseen words"), (4, ""), (5, None), (6, "漢3 漢29 k929 ba0 ba0 ba0"),
    (7, " ".join(f"Zo{k}" for k in range(30))), (8, "z"), (8, "k91"), (None, "copy"),
]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("points, opened", [(40, 1), (700, 24), (1_500_000, 3)])
def test_equals_plain_scoring(spark, items, monkeypatch, points, opened):
    monkeypatch.setattr(ranked_search, "BLOCK_POINTS", points)
    monkeypatch.setattr(ranked_search, "OPENED", opened)
    rows = corpus(points, 200)
    docs = documents(spark, rows).repartition(3)
    index = ranked_search.build(docs)
    assert found(ranked_search.search(index, items)) == plain(rows, ITEMS)
    assert found(ranked_search.search(index, items, k=3)) == plain(rows, ITEMS, 3)


def test_sets_of_items(spark, items, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERY_TERMS", 12)
    rows = corpus(5, 60)
    assert found(ranked_search.rank(documents(spark, rows), items)) == plain(rows, ITEMS)


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE", 7)
    text = "A bc,defghijklmnop  q-é漢字é9 ZZZ."
    assert [t.decode() for p in ranked_search._pieces(text.encode()) for t in p] == terms_of(text)


def test_a_treap_holds_each_point_once():
    rng = np.random.default_rng(3)
    row, column = np.divmod(np.sort(rng.choice(37 * 90, 600, replace=False)), 90)
    value = rng.integers(1, 50, 600)
    levels, branches, falls, rows, columns = ranked_search._treap(row, column, value, 37, 90)
    assert sum(levels) == len(branches) == len(falls) == len(rows) == len(columns) == 600
    assert levels[0] == 1 and falls[0] == value.max()


def test_blocks_are_packed():
    random.seed(7)
    points = ranked_search._Points()
    docs = [(None if k == 3 else -k if k % 2 else k, " ".join(f"w{int(random.paretovariate(0.3)) % 9973}" for _ in range(300))) for k in range(100)]
    for doc_id, text in docs:
        points.add(doc_id, text.encode())
    n_points = sum(len(set(terms_of(text))) for _, text in docs)
    block = points.block(100, 30_000)
    assert block.nbytes < 8 * n_points  # 13 bytes a point and the terms as they are made JVM and workers hold several times a block
    treap = ranked_search._Treap(block, 0)
    assert len(treap.value) == n_points
    assert sorted(treap.terms.to_pylist()) == sorted({t.encode() for _, text in docs for t in terms_of(text)})
    assert sorted(np.where(treap.null, 10**6, treap.order)) == sorted(10**6 if d is None else d for d, _ in docs)


def test_a_stored_block_is_read_without_the_others(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_POINTS", 400)
    monkeypatch.setitem(ranked_search._FILES, "parquet.block.size", "1024")
    index = ranked_search.build(documents(spark, corpus(2, 150)).coalesce(1))
    files = [f.removeprefix("file://") for f in index.blocks.inputFiles()]
    groups = [g for f in ds.dataset(files).get_fragments() for g in f.row_groups]
    assert sum(g.num_rows for g in groups) == index.blocks.count() >= 8
    assert max(g.num_rows for g in groups) <= 2


def test_odd_clashing_and_no_rows(spark, odd, clashing, no_docs, items):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    asked = [(1, "tok7 end word5x5 naïve 漢字"), (2, "one TWO two")]
    few = spark.createDataFrame(asked, "item_id long, text string")
    assert found(ranked_search.rank(odd, few)) == plain(rows, asked)
    assert found(ranked_search.rank(clashing, few)) == plain(rows, asked)
    assert ranked_search.rank(no_docs, few).collect() == []
    none = ranked_search.rank(odd, few.limit(0))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]

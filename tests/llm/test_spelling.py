"""Spelling variants against a plain comparison of all words."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from daywright.llm import spelling

from .conftest import documents

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    form, n_near = {}, {}
    for w in words:
        others = [o for o in words if abs(len(o) - len(w)) <= 1 and near(w, o)]
        n_near[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], n_near[w], words.get(form[w])))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, n_docs=250):
    random.seed(seed)
    stems = ["".join(random.choices("abceé", k=random.randint(6, 9))) for _ in range(40)] + ["zzzzzzz", "Ünchanged", "aaaaaaa", "a" * 40]
    rows = []
    for k in range(n_docs):
        words = []
        for _ in range(60):
            w = random.choices(stems, weights=[1000 // (s + 1) for s in range(len(stems))])[0]
            for _ in range(random.choices((0, 1, 2), weights=(16, 3, 1))[0]):
                at = random.randrange(len(w))
                w = random.choice((w[:at] + w[at + 1 :], w[:at] + random.choice("abcdeé") + w[at:], w[:at] + random.choice("abcd") + w[at + 1 :]))
            words.append(w.upper() if random.random() < 0.05 else w)
        rows.append((k, random.choice((" ", "-", "漢 ", "9")).join(words)))
    return rows


@pytest.mark.parametrize("tile, shared", [(1024, 256), (12, 5)])
def test_equals_all_pairs(spark, monkeypatch, tile, shared):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "SHARED", shared)
    rows = corpus(tile)
    expected = plain(rows)
    assert sum(r[4] for r in expected) > 500 and any(r[1] for r in expected)
    assert found(spelling.variants(documents(spark, rows))) == expected


def test_forms_are_followed_to_the_last(spark):
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate([("wordabcd", 2), ("wordabce", 20), ("wordabde", 200), ("wordbbde", 2000)], 50)]
    rows = [(k, t) for k, t in rows if crc32(f"{k}:{t.split()[0]}".encode()) % 31]
    assert len(rows) == 4
    got = found(spelling.variants(documents(spark, rows)))
    assert got == plain(rows) and {r[2] for r in got} == {"wordbbde"}


def test_odd_clashing_and_no_rows(odd, clashing, no_docs, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    monkeypatch.setattr(spelling, "MIN_LENGTH", 3)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    expected = sorted((w, n) for w, n in counts.items() if len(w) >= 3 and n >= 2)
    assert found(spelling.word_counts(odd)) == expected
    assert [r[0] for r in found(spelling.variants(clashing))] == [w for w, _ in expected]
    assert spelling.variants(no_docs).collect() == []

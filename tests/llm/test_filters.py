"""Quality rules, line de-duplication, Jaccard join and decontamination on small tables."""

import collections
import itertools
import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from daywright.llm import decontaminate, jaccard_join, line_dedup, quality_rules
from tests.llm.conftest import CLASHES, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def random_text(rng, words=("a", "bb", "c#", "|", "é", "X"), most=60):
    return "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  ", "\x0b", " "]) for _ in range(rng.randrange(most)))


def test_rule_counts_against_plain_python(spark, odd):
    rng = random.Random(1)
    rows = [(k, random_text(rng)) for k in range(200)] + [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None]
    out = quality_rules.judge(documents(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    want = collections.Counter()
    for doc_id, text in rows:
        n, chars, symbols, dup, repeat = brute_counts(text)
        failed = n < 50 or 100 * repeat > 50 * n
        want[(doc_id, n, chars, symbols, dup, repeat, failed, not failed)] += 1
    assert collections.Counter(tuple(r) for r in out) == want


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, p) for n in (1, 7, 300, 3000) for k in (0, 1, 2, 10) if k <= n for p in (0.005, 0.02)]
    for p in (0.005, 0.02):
        rows = spark.createDataFrame([(k, n) for k, n, q in cases if q == p], "k long, n long")
        for k, n, got in rows.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), p)).collect():
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert got == (1.0 if k >= n * p else pytest.approx(want, rel=1e-9)), (k, n, p)


def test_cutoffs_hold_the_limit_and_follow_the_labels(spark):
    """Symbols mark the bad documents of one language; in another they are common in good ones; a third has few labels."""
    plain = " ".join(f"w{k}" for k in range(60))
    rows, labels = [], []
    for k in range(4000):
        lang, bad = ("en", "de")[k % 2], k % 10 == 0
        text = plain + (" ## ## ##" if bad or (lang == "de" and k % 4 == 1) else "")
        rows.append((k, text, lang, "s", 1))
        labels.append((k, 0 if bad else 1))
    rows += [(9000 + k, plain + " ## ## ##", "fr", "s", 1) for k in range(5)]
    labels += [(9000 + k, 1) for k in range(3)]
    labels += labels[:50]
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    assert all(not kept[k] for k in range(0, 4000, 10) if k % 2 == 0)
    assert all(kept[k] for k in range(4000) if k % 2 == 1) and all(kept[9000 + k] for k in range(5))
    assert all(kept[k] for k in range(2, 4000, 2) if k % 10)


def test_keep_good_keeps_columns_and_takes_empty_tables(spark, clashing, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_rules.keep_good(clashing, none)
    assert out.columns == clashing.columns and sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, 4, 5, 5, 6]
    assert quality_rules.keep_good(no_docs, none).count() == 0 and quality_rules.judge(no_docs, none).count() == 0


def test_rules_use_functions_only(spark, odd):
    plan = quality_rules.judge(odd, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))._jdf.queryExecution().toString()
    plan += line_dedup.drop_boilerplate(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lines_are_boilerplate_by_share_of_their_host(spark):
    rows = [(k, f"menu \nown {k}\n\nshared\n menu", "en", "a", 1) for k in range(30)]
    rows += [(100 + k, f"own b{k}" + "\nshared" * (k < 3), "en", "b", 1) for k in range(80)]
    rows += [(200 + k, "left\nalone" if k < 2 else None, "en", None, 1) for k in range(6)]
    out = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(documents(spark, rows), dropped="gone").collect()}
    assert all(out[k]["text"] == f"own {k}\n" and out[k]["gone"] == 3 and out[k]["n_chars"] == len(f"own {k}\n") for k in range(30))
    assert out[100]["text"] == "own b0\nshared" and out[200]["text"] == "left\nalone" and out[205]["text"] is None and out[205]["n_chars"] == 0


def test_line_dedup_on_odd_rows(odd, clashing, no_docs):
    out = line_dedup.drop_boilerplate(clashing)
    assert out.columns == clashing.columns and out.count() == odd.count()
    assert out.schema["n_chars"].dataType == clashing.schema["n_chars"].dataType
    assert line_dedup.drop_boilerplate(no_docs).count() == 0


def shingles(text, n=5):
    w = (text or "").split()
    n = min(n, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def brute_join(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9 and sets[b]:
            links[a] += 1
            links[b] += 1
            old, new = root[b], root[a]
            root = [new if x == old else x for x in root]
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None]
        out.append((doc_id, min(ids) if sets[k] and ids else doc_id, links[k]))
    return out


def near_copies(rng, n, words=120):
    """Documents around a few bases, from untouched to far off, some of them in chains."""
    out, doc_id = [], 0
    for base in range(n // 30):
        tokens = [f"b{base}w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(30):
            copy = [f"x{rng.randrange(10**6)}" if rng.random() < rng.choice((0, 0.01, 0.02, 0.05)) else w for w in tokens]
            tokens = copy if rng.random() < 0.2 else tokens
            out.append((doc_id, " ".join(copy)))
            doc_id += 1
    return out


def test_join_against_all_pairs(spark, monkeypatch):
    """Groups of copies, near copies and chains, over blocks small enough for many block pairs."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(3)
    rows = near_copies(rng, 150) + [(1000 + k, t) for k, t in enumerate(["a b c", "a b c", "a b", "", None, " a  b c ", "a b c d"])]
    rows += [(0, rows[0][1]), (None, rows[0][1])]
    got = collections.Counter(tuple(r)[:3] for r in jaccard_join.jaccard_join(documents(spark, rows)).collect())
    assert got == collections.Counter(brute_join(rows))


def test_one_of_each_keeps_the_least_of_every_group(spark, clashing, no_docs):
    rows = near_copies(random.Random(4), 90)
    want = {c for _, c, _ in brute_join(rows)}
    got = [r["doc_id"] for r in jaccard_join.one_of_each(documents(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    out = jaccard_join.one_of_each(clashing)
    # doc 5 comes twice and equals 6; the null id, one word longer, is of the same group and the least.
    assert out.columns == clashing.columns
    assert sorted((r["doc_id"] or -1, r["text"] is None) for r in out.collect()) == [(-1, False), (-1, True), (1, True), (2, False), (3, False), (4, False), (7, False), (8, False)]
    assert jaccard_join.one_of_each(no_docs).count() == 0 and jaccard_join.jaccard_join(no_docs).count() == 0


def test_neighbours_in_the_order_share_the_longest_prefix():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = sorted(bytes([t]) + rng.integers(0, 3, 8).astype(">u2").tobytes() for t in range(3) for _ in range(60))
    batches = [pa.RecordBatch.from_pydict({"signature": pa.array(rows[k : k + 7], pa.binary())}) for k in range(0, len(rows), 7)]
    out = [x for b in jaccard_join._neighbours(iter(batches), 8) for x in b.to_pylist()]
    assert [x["signature"] for x in out] == rows

    def longest(k):
        prefix = lambda a, b: max(d for d in range(9) if a[: 1 + 2 * d] == b[: 1 + 2 * d]) if a[0] == b[0] else 0
        return max(prefix(rows[k], r) for i, r in enumerate(rows) if i != k)

    assert [x["shared"] for x in out[1:-1]] == [longest(k) for k in range(1, len(rows) - 1)]
    assert out[0]["shared"] == out[-1]["shared"] == 8  # what lies beyond a range is not known


def test_prefixes_are_shortened_until_the_recall_is_reached(spark, monkeypatch):
    """Few trees: at the full depth most pairs near the threshold are missed, and the measure says so."""
    depths = []
    found = jaccard_join._found
    monkeypatch.setattr(jaccard_join, "_found", lambda *a: depths.append(a[6]) or found(*a))
    rows = [(k, t) for k, t in near_copies(random.Random(8), 300)]
    docs = documents(spark, rows)
    want = collections.Counter(brute_join(rows))

    def links(**kw):
        return collections.Counter(tuple(r)[:3] for r in jaccard_join.jaccard_join(docs, **kw).collect())

    total = sum(n * c for (_, _, n), c in want.items())
    few = sum(n * c for (_, _, n), c in links(trees=6, target=0.0).items())
    assert few < 0.9 * total and depths == [8]
    depths.clear()
    most = sum(n * c for (_, _, n), c in links(trees=6, target=0.97).items())
    assert most >= 0.95 * total and depths == list(range(8, depths[-1] - 1, -1)) and depths[-1] < 8
    assert links() == want


def test_the_depth_is_measured_on_all_nodes(spark, monkeypatch):
    """What a depth is judged by counts every link of the result, however few nodes an older bound allowed."""
    monkeypatch.setattr(jaccard_join, "MEASURED", 5, raising=False)
    judged = []
    measure = jaccard_join.measured_recall
    monkeypatch.setattr(jaccard_join, "measured_recall", lambda x: judged.append(x.agg(F.sum("texts")).first()[0]) or measure(x))
    got = jaccard_join.jaccard_join(documents(spark, near_copies(random.Random(8), 300))).agg(F.sum(F.col("n_text_links") / F.col("n_copies"))).first()[0]
    assert judged[-1] == round(got) > 0


def test_recall_against_all_pairs_of_a_few_thousand_documents(spark):
    rows = near_copies(random.Random(11), 2400, words=40)
    want = brute_join(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(documents(spark, rows)).collect()}
    total, found = sum(n for _, _, n in want), sum(n for _, n in got.values())
    assert total > 3000 and found >= 0.999 * total
    assert sum(got[d] == (c, n) for d, c, n in want) >= 0.995 * len(want)


def test_a_bitmap_marks_every_row_put_in(spark, monkeypatch):
    rows = spark.range(-3000, 3000).select((F.xxhash64("id")).alias("row"), F.col("id").alias("__map"))
    put = rows.where("__map % 7 = 0").select("row")
    got = jaccard_join.with_mark(rows, "row", jaccard_join.row_bits(put), "m").collect()
    marked = {r["__map"] for r in got if r["m"]}
    assert len(got) == 6000 and {k for k in range(-3000, 3000) if k % 7 == 0} <= marked and len(marked) < 900
    monkeypatch.setattr(jaccard_join, "BITS", 64)  # every row shares its bit: a mark decides nothing
    monkeypatch.setattr(jaccard_join, "MAP", 16)
    docs = near_copies(random.Random(4), 90)
    assert {r["doc_id"] for r in jaccard_join.one_of_each(documents(spark, docs)).collect()} == {c for _, c, _ in brute_join(docs)}


def test_texts_that_stand_alone_are_not_shuffled(spark):
    docs = documents(spark, [(k, " ".join(f"a{k}w{j}" for j in range(30))) for k in range(40)] + [(90, "x y z"), (91, "x y z")])
    kept = jaccard_join.one_of_each(docs)
    assert kept.count() == 41
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") + plan.count("LogicalRDD") == 2 and "Union" in plan.splitlines()[0]


def test_what_moves_and_is_stored_is_small(spark, monkeypatch):
    """To the blocks go texts, not shingle sets; signatures are stored once, and of the trees only rows of long prefixes."""
    kept = collections.defaultdict(list)
    stored = jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name: kept[name].append((df, stored(df, name))) or kept[name][-1][1])
    rng = random.Random(6)
    rows = near_copies(rng, 60) + [(1000 + k, " ".join(f"a{k}w{j}" for j in range(30))) for k in range(400)]
    got = collections.Counter(tuple(r)[:3] for r in jaccard_join.jaccard_join(documents(spark, rows)).collect())
    assert got == collections.Counter(brute_join(rows))
    for df, _ in kept["links"]:
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        dealt = plan[next(k for k, line in enumerate(plan) if "RepartitionByExpression [leader" in line) + 1]
        assert " text#" in dealt and "shingles" not in dealt
        assert sum("Join Inner" in line for line in plan) == 1  # no second join that texts go through
    classes = {"row", "key", "copies", "name"}
    assert [set(out.columns) for _, out in kept["classes"]] == [classes]
    ((_, forest),) = kept["forest"]
    assert forest.columns == ["name", "signature", "shared"]
    # 400 documents of nothing but their own words have 32 rows each; only those at the edge of a range can be there.
    assert 0 < forest.count() < 32 * 100


def test_short_prefixes_come_from_trees_made_anew(spark, monkeypatch):
    """Whatever part of the trees is stored at first, every depth sees all rows that it needs."""
    rows = near_copies(random.Random(8), 300)
    docs = documents(spark, rows)
    made, depths = [], []
    forest, found = jaccard_join._forest, jaccard_join._found
    monkeypatch.setattr(jaccard_join, "_forest", lambda *a: made.append(a[2]) or forest(*a))
    monkeypatch.setattr(jaccard_join, "_found", lambda *a: depths.append(a[6]) or found(*a))

    def links(**kw):
        made.clear(), depths.clear()
        return collections.Counter(tuple(r)[:3] for r in jaccard_join.jaccard_join(docs, trees=6, target=0.97, **kw).collect())

    monkeypatch.setattr(jaccard_join, "STORED_DEPTH", 1)
    want, steps = links(), [*depths]
    assert made == [1] and steps[-1] < 8
    monkeypatch.setattr(jaccard_join, "STORED_DEPTH", 8)
    assert links() == want and made == [8, 1] and depths == steps


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(60)] + [("x", "y"), ("z", "z")], "a string, b string")
    got = {r["node"]: r["root"] for r in jaccard_join.components(edges).collect()}
    assert got == {**{f"n{k:03}": "n000" for k in range(61)}, "x": "x", "y": "x"}


def leak_tables(spark):
    rng = random.Random(7)
    common = [f"the{k}" for k in range(20)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.choice((15, 30, 55, 150))))) for k in range(40)]
    rows, want = [], set()
    for k in range(150):
        tokens = [word() for _ in range(rng.choice((20, 200, 900)))]
        if k % 5 == 0:
            item_id, text = items[rng.randrange(len(items))]
            leak = text.split()
            if k % 10 == 0:  # a paraphrase: words left out and put in, not in the last quarter
                cut = len(leak) - len(leak) // 4
                leak = [w for w in leak[:cut] if rng.random() > 0.3] + leak[cut:]
            at = rng.randrange(len(tokens))
            tokens[at:at] = [w.upper() + "!" for w in leak] if k % 15 == 0 else leak
            want.add((k, item_id))
        rows.append((k, " ".join(tokens)))
    return documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), want, rows, items


def test_leaks_are_found_and_clean_documents_left(spark):
    docs, items, want, rows, _ = leak_tables(spark)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert got == want
    kept = {r["doc_id"] for r in decontaminate.without_leaks(docs, items).collect()}
    assert kept == {k for k, _ in rows} - {k for k, _ in want}


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs, items, want, *_ = leak_tables(spark)
    monkeypatch.setattr(decontaminate, "ITEMS", 15)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} == want


@pytest.fixture(scope="module")
def wide_batch():
    """1,000 texts of 500 words, no word twice."""
    import pyarrow as pa

    texts = [" ".join(f"w{k:07d}" for k in range(500 * t, 500 * t + 500)) for t in range(1_000)]
    return pa.RecordBatch.from_pydict({"row": list(range(1_000)), "doc_id": list(range(1_000)), "text": texts})


def small_index():
    index = decontaminate.Index(decontaminate.item_parts([(1, " ".join(f"w{k:07d}" for k in range(100, 140))), (2, "w0001000 other words")]))
    rank = index.range_from(np.ones(len(index.terms)), 10_000).project.shape[1]
    return index.scaled_by(np.eye(rank), 1)


@pytest.mark.parametrize("step", ["encode", "clean", "sketch"])
def test_a_worker_holds_little_beside_its_batch(wide_batch, monkeypatch, step):
    read = []
    encoded = decontaminate.Vocabulary.encoded
    monkeypatch.setattr(decontaminate.Vocabulary, "encoded", lambda self, text: read.append(1) or encoded(self, text))
    index = small_index()
    steps = {
        "encode": lambda: decontaminate._encode(iter([wide_batch]), index.terms),
        "clean": lambda: decontaminate._clean(iter([wide_batch]), index, "text"),
        "sketch": lambda: jaccard_join._sketch(iter([wide_batch]), 4, 8, 5),
    }
    tracemalloc.start()
    try:
        rows = steps[step]()
        n = next(rows).num_rows
        assert len(read) <= 200, "the whole batch was read before its first rows came out"
        n += sum(b.num_rows for b in rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == (999 if step == "clean" else 1_000)
    assert peak < 32e6


def test_a_text_goes_once_to_the_search(spark):
    docs, items, *_ = leak_tables(spark)
    assert "coalesce" not in decontaminate.without_leaks(docs, items)._jdf.queryExecution().analyzed().toString()


def test_lcs_against_the_table_method():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_decontamination_on_odd_rows(spark, clashing, no_docs):
    prose = " ".join(f"tok{k}" for k in range(20, 50))
    items = spark.createDataFrame([(1, prose), (1, prose), (None, "naïve 漢字 😀 nothing else here at all"), (2, None), (3, "")], "item_id long, text string")
    out = decontaminate.without_leaks(clashing, items)
    assert out.columns == clashing.columns and sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, 1, 2, 3, 4, 7, 8]
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in decontaminate.leaks(clashing, items).collect()) == [(-1, 1), (5, 1), (5, 1), (6, 1)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.without_leaks(clashing, none).count() == clashing.count() and decontaminate.leaks(clashing, none).count() == 0
    assert decontaminate.without_leaks(no_docs, items).count() == 0 and decontaminate.leaks(no_docs, items).count() == 0


def test_names_clash():
    assert len(set(CLASHES)) == len(CLASHES)

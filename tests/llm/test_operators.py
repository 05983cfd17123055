"""Packing, scoring, classification, personal data, chats, shards and the pipeline against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from daywright.llm.common import byte_bpe
from daywright.llm import chat_format, decontaminate, lm_scoring, packing, pii, quality_classifier, quality_rules, queries, resharding
from tests.conftest import SF_SMALL
from tests.llm.conftest import documents
from tests.llm.test_filters import brute_join

TOKENIZER, RANKS = byte_bpe()


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encode(model, text):
    return model.encode(text or "", add_special_tokens=False).ids


def test_remembered_chunks_make_the_same_ids(model):
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "é", "1", "!", "<|endoftext|>", "'s", " \n", "漢", "​", "😀", "y" * 3000, " " * 3000]
    for fast in (None, RANKS):
        mine = packing.Tokenizer(TOKENIZER, fast, most=50)
        for _ in range(1500):
            text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
            assert mine.encoded([text])[0] == np.array(encode(model, text), "<u4").tobytes(), repr(text)


def test_remembered_chunks_are_few_and_those_in_use_stay(model):
    mine = packing.Tokenizer(TOKENIZER, RANKS)
    for k in range(0, 150_000, 1_000):
        mine.encoded(["often " + " ".join(f"q{n}" for n in range(k, k + 1_000))])
        assert len(mine) + len(mine.before) <= 100_000
    assert "often" in {**mine, **mine.before}


def check_packing(rows, length, segments):
    """Pieces in place; no limit broken. Returns the sequences' sizes."""
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length and len(pieces) <= segments
    return [sum(n for _, n in p) for p in by_sequence.values()]


def test_every_id_is_packed_once(spark, odd, no_docs, model):
    rows = packing.pack(odd, TOKENIZER, RANKS).collect()
    check_packing(rows, packing.LENGTH, packing.MAX_SEGMENTS)
    want, got = collections.Counter(), collections.Counter()
    for r in odd.collect():
        ids = [*encode(model, r["text"]), 1]
        want[(r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    by_doc = collections.defaultdict(list)
    texts = {(r["doc_id"], len(encode(model, r["text"])) + 1): [*encode(model, r["text"]), 1] for r in odd.collect()}
    for r in rows:
        ids = texts[r["doc_id"], r["doc_tokens"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
    for (doc_id, n), pieces in by_doc.items():
        copies = sum(c for (d, m, _), c in want.items() if (d, m) == (doc_id, n))
        assert sum(k for _, k in pieces) == copies * n
        got[doc_id, n] = copies
    assert sum(got.values()) == odd.count() and packing.pack(no_docs, TOKENIZER).count() == 0


def test_little_is_padded(spark):
    rows = packing.pack(spark.read.parquet(f"{SF_SMALL}/documents.parquet").coalesce(1), TOKENIZER, RANKS).collect()
    sizes = check_packing(rows, packing.LENGTH, packing.MAX_SEGMENTS)
    assert sum(sizes) >= 0.98 * packing.LENGTH * len(sizes)


def test_instruction_examples_keep_three_limits(spark):
    rng = random.Random(6)
    rows = [(k, n := rng.randrange(1, 900), rng.randrange(n + 1)) for k in range(800)] + [(900, None, None), (901, 5000, 4000), (902, 3, 99)]
    out = packing.pack_examples(spark.createDataFrame(rows, "example_id long, tokens int, loss_tokens int").coalesce(1), 2048, 6, 900).collect()
    check_packing(out, 2048, 6)
    tokens = {k: (n or 0, n - min(n, lo) if n else 0) for k, n, lo in rows}
    loss, placed = collections.Counter(), collections.defaultdict(list)
    for r in out:
        begins = tokens[r["example_id"]][1]
        loss[r["sequence_id"]] += max(0, r["start"] + r["length"] - max(begins, r["start"]))
        placed[r["example_id"]].append((r["start"], r["length"]))
    assert max(loss.values()) <= 900 and set(placed) == set(tokens)
    for k, pieces in placed.items():
        assert sum(n for _, n in pieces) == tokens[k][0] and [s for s, _ in sorted(pieces)] == [0, *itertools.accumulate(n for _, n in sorted(pieces)[:-1])]


def test_losses_against_counters(spark, model, odd, no_docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_TEXTS", 3)
    rng = random.Random(8)
    said = [" ".join(rng.choice("the cat sat on a mat".split()) for _ in range(20)) for _ in range(10)] + [None, ""]
    docs = odd.union(documents(spark, [(100 + k, t) for k, t in enumerate(said[:7])]).repartition(3))
    out = lm_scoring.cross_entropy_difference(docs, spark.createDataFrame([(t,) for t in said], "text string"), TOKENIZER, RANKS)
    size, counts = lm_scoring.vocabulary_size(TOKENIZER), []
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for side in (said, [t for _, t in texts]):
        pair, first, second = collections.Counter(), collections.Counter(), collections.Counter()
        for t in side:
            e = [size, *encode(model, t)]
            pair.update(itertools.pairwise(e))
            first.update(e[:-1])
            second.update(e[1:])
        counts.append((pair, first, second, sum(second.values())))
    want = []
    for doc_id, t in texts:
        e, means = [size, *encode(model, t)], []
        for pair, first, second, total in counts:
            p1 = lambda b, s=second, n=total: (s[b] + lm_scoring.D) / (n + lm_scoring.D * size)
            ls = [-math.log((pair[a, b] + lm_scoring.K * p1(b)) / (first[a] + lm_scoring.K)) for a, b in itertools.pairwise(e)]
            means.append(round(sum(ls) / len(ls), 8) if ls else None)
        want.append((doc_id, len(e) - 1, *means))
    r8 = lambda x: None if x is None else round(x, 8)
    got = [(r["doc_id"], r["n_tokens"], r8(r["target_loss"]), r8(r["background_loss"])) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    none = spark.createDataFrame([], "text string")
    assert lm_scoring.cross_entropy_difference(no_docs, none, TOKENIZER).count() == 0
    assert lm_scoring.cross_entropy_difference(odd, none, TOKENIZER).where("n_tokens > 0 and score is null").count() == 0


def test_dual_coordinate_descent_finds_the_margin():
    rng = np.random.default_rng(1)
    y = np.where(rng.random(300) < 0.5, 1.0, -1.0)
    x = rng.normal(size=(300, 5)) + np.outer(y, [2, -1, 0, 0, 0])
    w, bias = quality_classifier.dual_coordinate_descent([(np.arange(5), r) for r in x], y, 5, passes=200)
    objective = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = objective(w, bias)
    assert all(objective(w + d[:5], bias + d[5]) >= best - 1e-2 for d in rng.normal(scale=0.05, size=(200, 6)))


def test_held_out_labels_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.score(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_classifier_on_odd_rows(spark, odd, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.score(odd, none).collect()} == {0.5}
    some = spark.createDataFrame([(2, 0), (4, 1), (4, 0), (5, 1), (7, 0), (8, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = quality_classifier.score(odd, some).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality_classifier.score(no_docs, some).count() == 0


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        luhn = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and luhn % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(9)
    parts = ["a", "b@", "@", ".", "1", "2", "+", "-", " ", "1.2.3.4", "55", "_", "%", "a@b.c", "(", ")", "@c.d", "4111 1111 1111 1111", "0", "+1 (222) 555-1234", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        assert pii.base_spans(text) == plain_spans(text), repr(text)
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + "." * 1000) == []


def test_contexts_of_seeds_give_away_other_identifiers(spark, no_docs):
    """Phones after `call me on` teach the context; a badly written number there is found, one elsewhere isn't."""
    rows = [(k, f"hello number {k} please call me on +1 ({200 + k}) 555-12{k:02} today") for k in range(30)]
    rows += [(100, "then call me on 0049-30x77 today or not"), (101, "part number 0049-30x77 is sold out"), (102, None), (103, "")]
    rows += [(104, "mixed call me on 555-CALL-12 today"), (105, "4 5 6")]
    out = {r["doc_id"]: r for r in pii.find(documents(spark, rows)).collect()}
    assert out[100]["spans"] == "phone:16:26" and out[104]["n_added"] == 1 and out[101]["spans"] == "" == out[102]["spans"] == out[103]["spans"]
    for k in range(30):
        base = ",".join(f"{pii.KINDS[kind]}:{s}:{e}" for s, kind, e in plain_spans(rows[k][1]))
        assert out[k]["n_phone"] == 1 and out[k]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and out[k]["spans"] == base
    assert pii.find(no_docs).count() == 0


def test_pii_on_odd_rows(odd, clashing):
    assert pii.find(clashing).count() == odd.count()


def test_chats_read_back_exactly(spark):
    rng = random.Random(10)
    parts = ["<|", "|>", "<|end|>", "<|turn|>", "\\", "</s>", "[INST]", "[/INST]", "<s>", "x", "\n", "", "😀", "<", "[", "/"]
    rows, want = [], {}
    for conv in [*range(60), None]:
        turns = [(rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "assistant", None, "a<|text|>b"]), rng.choice([None, "".join(rng.choices(parts, k=6))])) for _ in range(rng.randrange(1, 7))]
        rows += [(conv, *t) for t in turns]
        clean = sorted(((-1 if t is None else t), r or "", x or "") for t, r, x in turns)
        loss = "".join(x for _, r, x in clean if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, r, x in clean)
        want[conv] = (len(clean), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("t", F.lit(2))
    chats = chat_format.formatted(table)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.digests(chats).collect()}
    assert got == want
    for r in chats.collect():
        marks = [r["formatted"].count(m) for m in (chat_format.ROLE, chat_format.TEXT, chat_format.END)]
        assert len(set(marks)) == 1 and not re.search(r"\[/?INST\]|</?s>", r["formatted"])
    assert chat_format.digests(chat_format.formatted(table.where("conv_id = 77"))).count() == 0


def test_flow_moves_the_least():
    rng = random.Random(11)
    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        supply = [rng.randrange(9) for _ in range(n)]
        capacity = [rng.randrange(9) for _ in range(m)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        flow = resharding.min_cost_flow(supply, capacity, [[int(i != j) for j in range(m)] for i in range(n)])
        assert [sum(f) for f in flow] == supply and all(sum(f[j] for f in flow) <= capacity[j] for j in range(m))
        assert sum(flow[k][k] for k in range(min(n, m))) == sum(min(supply[k], capacity[k]) for k in range(min(n, m)))
    # A dear direct way: the flow goes around through another source's sink.
    assert resharding.min_cost_flow([4, 4], [4, 4], [[1, 2], [5, 9]]) == [[0, 4], [4, 0]]
    with pytest.raises(ValueError):
        resharding.min_cost_flow([3], [2], [[0]])


def test_shards_are_even_and_slots_gapless(spark, odd, no_docs, monkeypatch):
    monkeypatch.setattr(resharding, "NUMBERED", 100)
    rng = random.Random(12)
    rows = [(k, "w" * rng.randrange(400)) for k in range(1500)] + [(2000 + k, "copy " * 100) for k in range(800)] + [(5000 + k, "few " * 60) for k in range(60)]
    out = resharding.reshard(documents(spark, rows), 8, 6).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() <= 1.01 * sizes.min() and len(out) == len(rows)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    texts = dict(rows)
    assert all(r.size == 0 or (r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())) for _, r in out.iterrows())
    assert out[out.doc_id >= 5000]["shard"].nunique() == 1
    moved, old = out[out.old_shard != out.shard]["size"].sum(), out.groupby("old_shard")["size"].sum()
    assert moved <= 1.02 * sum(max(0, x - out["size"].sum() / 8) for x in old) + 5000
    assert resharding.reshard(odd, 8, 6).count() == odd.count() and resharding.reshard(no_docs, 8, 6).count() == 0


def test_documents_move_with_all_their_columns(spark, odd, clashing, no_docs):
    for docs in (odd, clashing):
        out = resharding.resharded(docs, 8, 6)
        plain = lambda rows: collections.Counter(map(repr, rows))
        assert plain(r["whole"] for r in out.collect()) == plain(docs.collect())
        laid = collections.Counter(tuple(r) for r in resharding.reshard(docs, 8, 6).select("doc_id", "old_shard", "shard", "slot").collect())
        assert collections.Counter(tuple(r) for r in out.select("whole.doc_id", "old_shard", "shard", "slot").collect()) == laid
        assert out.inputFiles() and all("shard=" in f for f in out.inputFiles() if "/shards-" in f)
    assert resharding.resharded(no_docs, 8, 6).count() == 0


def test_op9_rows_come_from_the_files_of_the_new_shards(spark):
    out = queries.op9_resharding(spark, SF_SMALL)
    assert any("/shards-" in f for f in out.inputFiles())
    assert out.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_equal_texts_that_a_shard_can_hold_stay_together(spark):
    rows = [(k, f"{k:04}" + "w" * 95) for k in range(800)] + [(5000 + k, "same " * 20) for k in range(106)]
    out = resharding.reshard(documents(spark, rows), 8, 6).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert out[out.doc_id >= 5000]["size"].sum() > 0.9 * out["size"].sum() / 8
    assert out[out.doc_id >= 5000]["shard"].nunique() == 1 and sizes.max() <= 1.02 * sizes.min()


def test_only_changed_shards_are_written(spark, tmp_path):
    docs = documents(spark, [(k, "t" * (k % 50)) for k in range(400)])
    placed = resharding.reshard(docs, 8, 6).cache()
    changed = resharding.rewrite(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    want = placed.where(F.col("shard").isin(changed))
    assert changed and sorted(map(tuple, back.select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, want.select("doc_id", "shard", "slot").collect()))


def test_pipeline_stage_by_stage(spark):
    """Each stage on what the one before kept, against plain Python on the smallest tables."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL).cache()
        steps.append(docs)
    ruled, lined, single, clean, packed = steps
    kept = {r["doc_id"] for r in quality_rules.judge(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), labels).collect() if r["kept"]}
    rows = {r["doc_id"]: r for r in ruled.collect()}
    assert set(rows) == kept and ruled.columns == clean.columns
    pages, with_line = collections.Counter(), collections.Counter()
    for r in rows.values():
        pages[r["source"]] += 1
        with_line.update({(r["source"], x.strip(" ")) for x in r["text"].split("\n") if x.strip()})
    bad = {k for k, n in with_line.items() if n >= 3 and n > 0.05 * pages[k[0]]}
    want = {d: "\n".join(x for x in r["text"].split("\n") if not x.strip() or (r["source"], x.strip(" ")) not in bad) for d, r in rows.items()}
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == want
    classes = {d: c for d, c, _ in brute_join(sorted(want.items()))}
    assert {r["doc_id"] for r in single.collect()} == {d for d in want if classes[d] == d}
    items = [(r["item_id"], decontaminate.plain_words(r["text"])) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    leaky = set()
    for r in single.collect():
        w = decontaminate.plain_words(r["text"])
        leaky |= {r["doc_id"] for _, i in items if any(w[k : k + len(i)] == i for k in range(len(w) - len(i) + 1))}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - leaky
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}
    assert corpus_pipeline.run(spark, SF_SMALL).agg(F.sum("length")).first() == packed.agg(F.sum("length")).first()


def test_every_operator_has_a_query():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES] == list(range(1, 14))

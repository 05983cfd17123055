"""Exact de-duplication against plain grouping, with runs that span ranges and batches."""

import hashlib
import re
from collections import defaultdict

import pytest

from daywright.llm import exact_dedup

from .conftest import documents


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for n, member in enumerate(members):
            out.append((member[3], members[0][3], len(members), n == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def few_rows_a_range(spark):
    settings = {
        "spark.sql.shuffle.partitions": "7",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "5",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_with_a_hot_text():
    rows = [(k, "hot text" + " " * (k % 3)) for k in range(120)]
    rows += [(200 + k, f"t{k % 40}\n" + "x" * (k % 2)) for k in range(100)]
    rows += [(400 + k, "a" * 40 + f"{k % 5}") for k in range(30)]  # equal in all bytes of a splitter
    return rows + [(900, None), (901, ""), (902, " \t"), (None, "hot text"), (5, "hot text  ")]


def test_classes_equal_plain_grouping(spark, few_rows_a_range):
    rows = rows_with_a_hot_text()
    assert found(exact_dedup.classes(documents(spark, rows))) == plain(rows)


def test_one_text_in_every_range(spark, few_rows_a_range):
    rows = [(k, "same") for k in range(150)]
    assert found(exact_dedup.classes(documents(spark, rows))) == plain(rows)
    assert [r.doc_id for r in exact_dedup.one_of_each(documents(spark, rows)).collect()] == [0]


def test_rows_that_stay_keep_their_columns(spark, few_rows_a_range):
    rows = rows_with_a_hot_text()
    docs = documents(spark, rows)
    stay = exact_dedup.one_of_each(docs)
    assert stay.columns == docs.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(r[0]) for r in plain(rows) if r[3])
    assert {r.text for r in stay.collect() if r.doc_id == 2} == {"hot text  "}


def test_odd_clashing_and_no_rows(odd, clashing, no_docs):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(exact_dedup.classes(odd)) == plain(rows)
    assert found(exact_dedup.classes(clashing)) == plain(rows)
    assert exact_dedup.one_of_each(clashing).columns == clashing.columns
    assert exact_dedup.one_of_each(clashing).count() == sum(r[3] for r in plain(rows))
    assert exact_dedup.classes(no_docs).collect() == [] and exact_dedup.one_of_each(no_docs).collect() == []

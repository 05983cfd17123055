"""The registered queries and the whole pipeline, on the smallest tables and on odd ones."""

import pytest

import corpus_pipeline
from daywright.llm import lm_scoring, packing, pii, quality_classifier, resharding
from daywright.llm.common import byte_bpe
from daywright.llm.oracle import ORACLE
from daywright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

#: Queries with a row a document.
PER_DOCUMENT = {"op3_lm_scoring", "op4_quality_classifier", "op5_quality_rules", "op6_pii", "op9_resharding", "op10_jaccard_join"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_a_query_without_sql_runs_over_its_whole_table(spark, name):
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    found = [r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()]
    if name in PER_DOCUMENT:
        assert sorted(found) == sorted(ids)
    else:
        assert found and set(found) <= set(ids)


@pytest.mark.parametrize("kind", ["odd", "clashing", "no_docs"])
def test_the_pipeline_takes_odd_tables(spark, request, tmp_path, kind):
    docs = request.getfixturevalue(kind)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "length", "doc_tokens").collect()
    assert {p.doc_id for p in pieces} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(0 < p.length <= 2048 for p in pieces) and (pieces or kind == "no_docs")


@pytest.mark.parametrize("operator", ["lm_scoring", "quality_classifier", "pii", "resharding", "packing"])
def test_other_columns_change_nothing(spark, odd, clashing, operator):
    labels = spark.createDataFrame([(2, 0), (4, 1), (5, 1), (7, 0)], "doc_id long, quality int")
    said = spark.createDataFrame([("tok1 tok2 tok3",), (None,)], "text string")
    apply = {
        "lm_scoring": lambda d: lm_scoring.cross_entropy_difference(d, said, *byte_bpe()),
        "quality_classifier": lambda d: quality_classifier.score(d, labels),
        "pii": pii.find,
        "resharding": lambda d: resharding.reshard(d, 8, 6),
        "packing": lambda d: packing.pack(d, *byte_bpe()),
    }[operator]
    plain, crowded = apply(odd.coalesce(1)), apply(clashing.coalesce(1))
    kept = [c for c in plain.columns if c in crowded.columns]
    assert "doc_id" in kept

    def rows(df):
        return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.select(*kept).collect())

    assert rows(plain) == rows(crowded)

"""The pipeline stage by stage, and the queries against their SQL."""

import os

import pytest
from llm_cases import edge_docs, empty_docs

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import compare, connect
from tidemark.llm import decontaminate, line_dedup, lsh_forest, quality_gam
from tidemark.llm.common import stored, table
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_contract_has_every_operator():
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, key):
    ok, note = compare(spark, connect(SMALL), SMALL, key, QUERIES[key], ORACLES[key])
    assert ok, note


def test_stages_take_effect_on_what_the_last_one_kept(spark):
    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, SMALL), name)
        assert after.columns == docs.columns
        old, new = ({r.doc_id: r for r in x.collect()} for x in (docs, after))
        assert set(new) <= set(old)
        if name == "quality":
            scores = {r.doc_id: r.predicted for r in quality_gam.score_documents(docs, table(spark, SMALL, "labels")).collect()}
            assert set(new) == {i for i, p in scores.items() if p} and new == {i: old[i] for i in new}
        elif name == "line_dedup":
            texts = {r.doc_id: r.text for r in line_dedup.drop_shared_lines(docs).collect()}
            assert {i: r.text for i, r in new.items()} == texts and all(r.n_chars == len(r.text) for r in new.values())
        elif name == "near_duplicates":
            assert set(new) == {r.doc_id for r in lsh_forest.near_duplicates(docs).collect() if r.kept}
        else:
            assert set(new) == {r.doc_id for r in decontaminate.find_items(docs, table(spark, SMALL, "benchmark")).collect() if not r.n_hit}
        docs = after
    packed = corpus_pipeline.pack(spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_stages_bear_odd_rows(spark):
    for docs, n in ((edge_docs(spark), 10), (empty_docs(spark), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stored(stage(spark, docs, SMALL), f"odd-{name}")
            assert after.columns == docs.columns and after.count() <= n
            if "row" in docs.columns and not after.isEmpty():
                assert after.first()["row"] == "extra row"
            docs = after
        assert corpus_pipeline.pack(spark, docs, SMALL).count() >= docs.count()

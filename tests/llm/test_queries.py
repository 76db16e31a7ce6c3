"""Queries with SQL against DuckDB; the pipeline's stages on a whole small table."""
from __future__ import annotations

import pytest

import corpus_pipeline
from archlens.llm import registry
from tests import oracle
from tests.llm.common import brute_classes

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.mark.parametrize("key", sorted(registry.ORACLES))
def test_sql(spark, key):
    found = registry.QUERIES[key](spark, SF)
    names = sorted(found.columns)
    got = sorted(repr([r[n] for n in names]) for r in found.collect())
    con = oracle.connect(SF)
    con.execute(registry.ORACLES[key])
    given = [d[0] for d in con.description]
    assert sorted(given) == names
    assert got == sorted(repr([r[given.index(n)] for n in names]) for r in con.fetchall())


def test_pipeline(spark):
    from archlens.session import cut_lineage
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(cut_lineage(stage(spark, steps[-1], SF)))
    rules, good, single, mixed, ids = steps[1:]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not any(labels.get(r.doc_id) == 0 for r in rules.collect())
    assert {r.doc_id for r in good.collect()} >= {r.doc_id for r in rules.collect() if labels.get(r.doc_id) == 1}
    classes = brute_classes([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))
    assert {r.doc_id for r in mixed.collect()} <= set(classes.values())
    assert ids.count() == mixed.count()
    assert all(len(r.ids) == r.n_tokens for r in ids.collect())

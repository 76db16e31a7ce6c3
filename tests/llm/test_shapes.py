"""Every operator on awkward rows, an empty table and extra columns."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from archlens.llm import (bpe, licences, line_rules, mixing, near_dups, packing, rule_ensemble, separator_scan,
                          sharding, vector_dups)
from archlens.session import scratch_path
from tests.llm.common import SCHEMA, awkward_rows


def _shards(docs):
    rows = docs.withColumn("size", sharding.text_bytes(F.col("text")))
    return sharding.shard_by_bytes(rows, order=[F.col("doc_id").asc_nulls_last()], size="size", shards=4)


def _counts(docs):
    path = scratch_path(docs.sparkSession)
    separator_scan.write_token_files(docs, path)
    return separator_scan.document_counts(docs.sparkSession, path)


def _scored(docs):
    labels = docs.sparkSession.createDataFrame([(1, 1), (3, 0), (9, None)], "doc_id long, quality int")
    stats = rule_ensemble.with_statistics(docs)
    return rule_ensemble.scored(stats, rule_ensemble.learn_quality(stats, labels))


# operator, rows that come back for the awkward table (None: not one per row)
CASES = {
    "mix": (lambda d: mixing.mix(d, weights=[1, 2]), 15),
    "emit": (lambda d: mixing.emit(mixing.mix(d, weights=[1, 2])), None),
    "shards": (_shards, 15),
    "rules": (line_rules.apply_rules, 15),
    "keep_clean": (line_rules.keep_clean, None),
    "scores": (_scored, 15),
    "classes": (near_dups.duplicate_classes, 15),
    "keep_one": (near_dups.keep_one, None),
    "bpe": (lambda d: bpe.round_trip(d, with_ids=True), 15),
    "pack": (lambda d: packing.pack(d, length=64), None),
    "counts": (_counts, 15),
    "licences": (licences.find_licences, 15),
}


@pytest.mark.parametrize("case", CASES)
def test_awkward_rows(spark, case):
    run, n = CASES[case]
    rows = run(spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)).collect()
    assert rows and (n is None or len(rows) == n)


@pytest.mark.parametrize("case", CASES)
def test_empty_table(spark, case):
    assert CASES[case][0](spark.createDataFrame([], SCHEMA)).count() == 0


CLASHES = ["size", "rules", "stats", "mix", "bpe", "copy", "bag", "node", "key", "root", "doc", "score", "rank",
           "label", "s", "class_id", "kept", "shard", "slot", "part"]


@pytest.mark.parametrize("case", [c for c in CASES if c != "shards"])
def test_extra_columns(spark, case):
    docs = spark.createDataFrame(awkward_rows(), SCHEMA)
    clashing = docs.withColumns({c: F.lit(f"mine {c}") for c in CLASHES})
    run, _ = CASES[case]
    assert run(clashing).count() == run(docs).count()


def test_pipeline_stages_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame(awkward_rows(), SCHEMA)
    spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.limit(0), docs.withColumn("rules", F.lit(1)).withColumn("copy", F.lit(2))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, str(tmp_path)).columns == rows.columns
            stage(spark, rows, str(tmp_path)).count()


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None),
            (6, [0.0, 0.0], 1), (7, None, 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [], 1),
            (12, [1e300, 1e299], 3), (13, [1e-300, 1e-301], 3), (14, [1.0, 0.0, 0.0], 1), (None, [0.5, 0.0], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dups.vector_classes(docs).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False)
    assert got[12] == (1, 12, True) and got[13] == (1, 12, False)
    assert got[None] == (3, 1, False)
    for k in (4, 5, 6, 7, 8, 9, 10, 11, 14):
        assert got[k] == (0, k, True)
    assert vector_dups.vector_classes(docs.limit(0)).count() == 0
    assert vector_dups.vector_classes(docs.withColumn("node", F.lit(1)).withColumn("name", F.lit(2))).count() == 15

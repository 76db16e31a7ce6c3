"""Sparse rule ensemble for text quality.

Shallow trees over text statistics give conjunctive rules; a lasso logistic fit
keeps few of them; the kept rules and weights become one column expression.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from archlens.llm import words as W
from archlens.llm.batches import bounded
from archlens.llm.mixing import uniform
from archlens.llm.registry import query, table
from archlens.session import cut_lineage

SURE = 6.0  # log odds where all labels are one class
UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
DIGITS = bytes(range(0x30, 0x3A))
STATS = ["words", "word_length", "symbols", "shouts", "bars", "upper", "digits", "distinct_words",
         "repeat_words", "dup_lines", "line_words", "ended_lines", "short_words", "commas"]


def statistics(text: bytes | None) -> list[float]:
    """``STATS`` of one text: shares and means, no count that grows with length but ``words``."""
    text = text or b""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip(W.BLANKS)]
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    size = W.code_points(text) - W.count_of(text, W.BLANKS)
    upper, lower = W.count_of(text, UPPER), W.count_of(text, LOWER)
    return [float(n), size / n, W.count_of(text, W.SYMBOLS) / size, text.count(b"!!") / n,
            text.count(b"|") / n, upper / max(1, upper + lower), W.count_of(text, DIGITS) / size,
            len(set(words)) / n, W.repeated_window_words(words) / n, W.repeated_lines(lines) / len(lines),
            n / len(lines), sum(x.rstrip(W.BLANKS)[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
            sum(len(w) <= 3 for w in words) / n, text.count(b",") / n]


@F.arrow_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def _statistics(texts: pa.Array) -> pa.Array:
    rows = [statistics(t) for t in W.utf8(texts)]
    columns = zip(*rows) if rows else [[]] * len(STATS)
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], STATS)


def with_statistics(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` plus the struct column ``stats``; one pass, no shuffle. Null and empty texts give zeros."""
    return bounded(docs).withColumn("stats", _statistics.asNondeterministic()(F.col(text)))


@dataclass(frozen=True)
class Rule:
    """``low < stat <= high`` for every bound; ``bounds``: (stat, low or None, high or None)."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        terms = []
        for stat, low, high in self.bounds:
            if low is not None:
                terms.append(F.col(f"stats.{stat}") > F.lit(low))
            if high is not None:
                terms.append(F.col(f"stats.{stat}") <= F.lit(high))
        whole = terms[0]
        for term in terms[1:]:
            whole = whole & term
        return F.coalesce(whole.cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class RuleEnsemble:
    """A logistic score over weighted rules."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The chance of label 1 as an expression over ``stats``."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.lit(weight) * rule.column()
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(node, bounds: dict) -> list[dict]:
    """Bounds of every node below ``node``, the tightest per statistic."""
    if not node.getClass().getSimpleName().startswith("Internal"):
        return []
    split = node.split()
    stat, cut = STATS[split.featureIndex()], float(split.threshold())
    low, high = bounds.get(stat, (None, None))
    left = bounds | {stat: (low, cut if high is None else min(cut, high))}
    right = bounds | {stat: (cut if low is None else max(cut, low), high)}
    return [left, right, *_paths(node.leftChild(), left), *_paths(node.rightChild(), right)]


def fit(rows: DataFrame, *, label: str = "label", key: str = "doc_id", max_rows: int = 20_000, trees: int = 20,
        depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """Learn from ``rows`` (``stats`` and a 0/1 ``label``; other labels and nulls are left out).

    ``max_rows`` bounds the labelled rows used: of more, each stays by a hash of
    ``key`` with the probability that leaves about so many, whatever the total.
    No rows give the constant score 0.5; one class only gives a constant near that class.
    """
    labelled = rows.where(F.col(label).isin(0, 1)).select(key, "stats", F.col(label).cast("double").alias("label"))
    seen = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
    n, ones = seen["n"], seen["ones"] or 0.0
    if not n:
        return RuleEnsemble(0.0, ())
    if ones in (0.0, float(n)):
        return RuleEnsemble(SURE if ones else -SURE, ())
    sample = labelled.where(uniform(F.col(key), seed) < F.lit(max_rows / n)).drop(key)
    sample = cut_lineage(sample.repartition(4))  # at most about max_rows short rows
    vector = array_to_vector(F.array(*[F.col(f"stats.{s}") for s in STATS]))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird",
                                    minInstancesPerNode=5).fit(sample.select(vector.alias("features"), "label"))
    found = [p for tree in forest.trees for p in _paths(tree._call_java("rootNode"), {})]
    rules = list(dict.fromkeys(Rule(tuple((s, *p[s]) for s in sorted(p))) for p in found))
    if not rules:
        return RuleEnsemble(math.log(ones / (n - ones)), ())
    hits = array_to_vector(F.array(*[r.column() for r in rules]))
    linear = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(
        sample.select(hits.alias("features"), "label"))
    kept = [(r, float(w)) for r, w in zip(rules, linear.coefficients) if w]
    return RuleEnsemble(float(linear.intercept), tuple(kept))


def held_out(doc_id: Column) -> Column:
    """The fold never learnt from: crc32 of the id as text leaves 1 by 3; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_quality(docs: DataFrame, labels: DataFrame) -> RuleEnsemble:
    """Fit on the labelled rows of ``docs`` (doc_id, stats) outside the held-out fold.

    A document id that has several labels counts once for each distinct one.
    """
    known = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label")).distinct()
    return fit(docs.select("doc_id", "stats").join(known, "doc_id"))


def scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``docs`` (with ``stats``) plus score (0 to 1) and predicted (1 from a score of 0.5)."""
    return (docs.withColumn("score", model.score())
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted good, columns as given."""
    whole = docs.select(F.struct("*").alias("doc"), "doc_id", F.col(text).alias("text"))
    stats = cut_lineage(with_statistics(docs.select("doc_id", F.col(text).alias("text"))).drop("text"))
    model = learn_quality(stats, labels)
    # statistics are cheaper to count again than to join back on the ids
    return scored(with_statistics(whole), model).where("predicted = 1").select("doc.*")


@query("op4_quality_rules_ensemble")
def op4_quality_rules_ensemble(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = cut_lineage(with_statistics(docs).drop("text"))
    model = learn_quality(stats, table(spark, sf_dir, "labels"))
    return scored(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

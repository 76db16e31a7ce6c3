"""Hard negatives by cover trees over blocks of candidates.

Rows are dealt to blocks of bounded size, each the points of one cover tree,
stored as one row. Anchors visit every block of their vectors' length in
chunks: first for their positives, then, one window of scores per positive,
for the negatives. What leaves a task is a few rows per anchor and block.
"""
from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from archlens.llm.batches import bounded
from archlens.llm.cover_tree import CoverTree, Search
from archlens.llm.prefix import running
from archlens.llm.registry import query, table
from archlens.session import cut_lineage

BLOCK = 8192            # candidates in a tree, on average
CHUNK = 4096            # anchors that a task takes through a tree, on average
POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = 30, 90  # percent of the positive's score that a negative may have


def quantised(vector: Column) -> Column:
    """Each component x as floor(256 * x), a whole number already from 2^53 on."""
    def whole(x: Column) -> Column:
        y = 256 * x.cast("double")
        return F.when(F.abs(y) < 2.0 ** 53, F.floor(y).cast("double")).otherwise(y)
    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    double = lambda x: x.cast("double")
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(double(x))
                               & (F.abs(double(x)) < float("inf"))), F.lit(False))


def _long(scores: np.ndarray) -> list[int]:
    """Scores as long numbers, held at the ends of their range."""
    return [max(-1 << 63, min((1 << 63) - 1, int(x))) if np.isfinite(x) else ((1 << 63) - 1 if x > 0 else -1 << 63)
            for x in scores]


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].to_numpy(zero_copy_only=False)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def _plant(rows: pa.Table) -> pa.Table:
    """One row (block, tree) of the candidates of a block: tree, rows, ids with their ranks, labels."""
    rows = rows.sort_by([("row", "ascending")])
    tree = CoverTree(_matrix(rows["vector"]))
    ids = [None if x is None else x for x in rows["vec_id"].to_pylist()]
    label = rows["label"].to_pylist()
    names = {x: k for k, x in enumerate(dict.fromkeys(label))}
    row = _column(rows, "row")[tree.order]
    placed = [ids[k] for k in tree.order]
    by_id = sorted(range(len(placed)), key=lambda k: (placed[k] is None, placed[k] or 0, row[k]))
    rank = np.empty(len(placed), dtype=np.int64)
    rank[by_id] = np.arange(len(placed))
    said = np.array([names[label[k]] for k in tree.order], dtype=np.int64)
    return pa.table({"block": rows["block"].slice(0, 1), "tree": pa.array(
        [pickle.dumps((tree, row, rank, said, names), protocol=pickle.HIGHEST_PROTOCOL)], pa.binary())})


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(contents of a tree, anchors that visit it); rows come sorted, the tree ahead of its visitors."""
    tree, block = None, None
    for batch in batches:
        blocks, trees = batch.column("block").to_pylist(), batch.column("tree")
        start = 0
        for k in [*[k for k in range(batch.num_rows) if trees[k].is_valid], batch.num_rows]:
            if k > start:
                assert blocks[start] == blocks[k - 1] == block
                yield tree, batch.slice(start, k - start)
            if k < batch.num_rows:
                tree, block = pickle.loads(trees[k].as_py()), blocks[k]
            start = k + 1


def _find_positives(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    for (tree, row, rank, said, names), visitors in _visits(batches):
        out: list[list] = [[], [], []]
        vectors = _matrix(pa.Table.from_batches([visitors])["vector"])
        for vector, anchor, label in zip(vectors, visitors.column("anchor").to_pylist(),
                                         visitors.column("label").to_pylist()):
            name = names.get(label)
            if name is not None:
                places, scores = Search(tree, vector).best(count, (said == name) & (row != anchor), rank)
                out[0] += [anchor] * len(places)
                out[1] += row[places].tolist()
                out[2] += _long(scores)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["anchor", "row", "score"])


def _find_negatives(batches: Iterator[pa.RecordBatch], count: int, lowest: int, highest: int) -> Iterator[pa.RecordBatch]:
    for (tree, row, rank, said, names), visitors in _visits(batches):
        out: list[list] = [[], [], [], []]
        vectors = _matrix(pa.Table.from_batches([visitors])["vector"])
        for vector, anchor, label, scores in zip(vectors, *(visitors.column(c).to_pylist()
                                                            for c in ("anchor", "label", "scores"))):
            search, other = Search(tree, vector), said != names.get(label, -1)
            for place, score in enumerate(scores):
                low, high = -(-lowest * score // 100), highest * score // 100
                if low <= high:
                    places, found = search.best(count, other, rank, low, high)
                    out[0] += [anchor] * len(places)
                    out[1] += [place] * len(places)
                    out[2] += row[places].tolist()
                    out[3] += _long(found)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["anchor", "place", "row", "score"])


def _visiting(trees: DataFrame, anchors: DataFrame, blocks: DataFrame, carried: list[str]) -> DataFrame:
    """Trees and their visitors (``anchors`` with ``dims``, in chunks), sorted for one pass."""
    chunks = -(-anchors.count() // CHUNK)
    chunk = F.pmod(F.xxhash64("anchor"), F.lit(max(1, chunks)))
    guests = (anchors.withColumn("chunk", chunk).join(blocks.select("dims", "base", "blocks"), "dims")
              .withColumn("block", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("blocks") - 1)))
              .select("block", "chunk", "anchor", *carried))
    homes = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, chunks - 1)).cast("long"))))
    rows = homes.select("block", "chunk", "tree").unionByName(guests, allowMissingColumns=True)
    return (bounded(rows).repartition("block", "chunk")
            .sortWithinPartitions("block", "chunk", F.col("anchor").asc_nulls_first()))


def _best(found: DataFrame, rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The ``count`` best of ``found`` per ``keys``, numbered from 1 as ``rank``, with their ids."""
    named = found.join(rows.select("row", "vec_id"), "row")
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(vectors: DataFrame, anchors: Column, *, vec_id: str = "vec_id", vector: str = "embedding",
                   label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
                   lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows where ``anchors`` holds.

    A score is the inner product with the anchor. An anchor's positives are its
    ``positives`` best other rows of its label; for each, the ``negatives`` best rows of
    other labels are returned whose score is ``lowest`` to ``highest`` percent of the
    positive's. Ties go to the smaller id, a null id last. Rows with a null label, a null
    vector, or a null or non-finite component take no part; vectors of different lengths
    never meet. Rows that repeat an id are rows of their own. Scores are exact for
    integer components while they stay below 2^53; beyond, they are rounded doubles, held at
    the ends of the long range, and a score that is no number counts as none. ``vec_id`` is an
    integer column.
    """
    rows = cut_lineage(
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"),
                       F.col(label).alias("label"), anchors.alias("asked"))
        .where(F.col("label").isNotNull() & usable(F.col("vector")))
        .withColumns({"dims": F.size("vector"), "row": F.monotonically_increasing_id()}))
    sizes = (rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")))
    blocks = cut_lineage(running(sizes, [F.col("dims").asc()], {"base": "blocks"}))
    dealt = (rows.join(blocks.select("dims", "base", "blocks"), "dims")
             .withColumn("block", F.col("base") + F.pmod(F.xxhash64("row"), F.col("blocks")))
             .select("block", "row", "vec_id", "vector", "label"))
    trees = cut_lineage(bounded(dealt).groupBy("block").applyInArrow(_plant, "block long, tree binary"))
    asked = cut_lineage(rows.where("coalesce(asked, false)").select(
        F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vector", "dims"))

    near = _visiting(trees, asked, blocks, ["label", "vector"]).mapInArrow(
        functools.partial(_find_positives, count=positives), "anchor long, row long, score long")
    mates = cut_lineage(_best(near, rows, ["anchor"], positives).select(
        "anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")))
    scored = F.array_sort(F.collect_list(F.struct("place", "positive_score")))
    windows = mates.groupBy("anchor").agg(F.transform(scored, lambda x: x["positive_score"]).alias("scores"))
    far = _visiting(trees, asked.join(windows, "anchor"), blocks, ["label", "vector", "scores"]).mapInArrow(
        functools.partial(_find_negatives, count=negatives, lowest=lowest, highest=highest),
        "anchor long, place long, row long, score long")
    best = _best(far, rows, ["anchor", "place"], negatives).select(
        "anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (best.join(mates, ["anchor", "place"]).join(asked.select("anchor", "anchor_id"), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_inner_product(a.vector, b.vector)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score,
  score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOWEST} * positive_score <= 100 * score AND 100 * score <= {HIGHEST} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""


@query("op13_hard_negatives", ORACLE)
def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, every seventh one under the next label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = rows.select("vec_id", F.when(usable(F.col("embedding")), quantised(F.col("embedding"))).alias("embedding"),
                        label.alias("label"))
    return hard_negatives(whole, F.col("vec_id") % 100 == 0)

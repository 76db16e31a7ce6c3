"""Merkle manifest of a dataset that stores every fourth level and regenerates the others.

Leaves are hashed where the rows are read; only digests are shuffled. Nodes of
``STEP`` levels form aligned subtrees of at most ``SPAN`` stored descendants. Building
keeps each subtree's root alone; extracting proofs goes down from the roots,
regenerates a subtree's inner nodes from its stored descendants inside one
task, hands every descendant its siblings, and forgets the inner nodes.
"""
from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from archlens.llm.grouped import sorted_groups
from archlens.llm.prefix import running
from archlens.llm.registry import query, table
from archlens.session import cut_lineage

FANOUT = 3
STEP = 4                # levels between two stored ones
SPAN = FANOUT ** STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Manifest:
    """``leaves`` and every ``STEP``-th level (tree, idx, digest, n; n nodes in the tree's level), and the root.

    ``levels`` has one tree per source, ``top`` one tree over the sources' roots; both are
    written tables. ``root`` is None for an empty dataset.
    """
    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _parents(digests: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(b"".join(digests[k:k + FANOUT])).hexdigest().encode()
            for k in range(0, len(digests), FANOUT)]


def _subtree(digests: list[bytes], n: int) -> list[list[bytes]]:
    """All levels of a subtree, its root's last; ``n``: nodes of the whole tree at the level of ``digests``."""
    levels = [digests]
    while len(levels) <= STEP if n > SPAN else len(levels[-1]) > 1:
        levels.append(_parents(levels[-1]))
    return levels


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, bounds in sorted_groups(batches, ["tree", "block"]):
        digests = rows["digest"].cast(pa.binary()).to_pylist()
        tree, block, n = (rows[c].to_pylist() for c in ("tree", "block", "n"))
        starts = bounds[:-1].tolist()
        roots = [_subtree(digests[a:b], n[a])[-1][0].decode() for a, b in zip(starts, bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([tree[a] for a in starts], pa.int64()), pa.array([block[a] for a in starts], pa.int64()),
             pa.array(roots, pa.string()), pa.array([-(-n[a] // SPAN) for a in starts], pa.int64())],
            ["tree", "idx", "digest", "n"])


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.where("n > 1").withColumn("block", F.expr(f"idx div {SPAN}"))


def build_levels(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (tree, idx, digest, n) and every ``STEP``-th level above, until every tree is one node."""
    levels = [nodes]
    widest = nodes.agg(F.max("n")).first()[0] or 0
    while widest > 1:
        rows = _blocks(levels[-1].select("tree", "idx", "digest", "n"))
        levels.append(cut_lineage(rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
                                  .mapInArrow(_climb, "tree long, idx long, digest string, n long")))
        widest = -(-widest // SPAN)
    return levels


def tree_roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): the root of every tree."""
    return functools.reduce(DataFrame.union, [x.where("n = 1").select("tree", "digest") for x in levels])


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs of the nodes of each subtree, whose first row brings the proof of its root."""
    for rows, bounds in sorted_groups(batches, ["tree", "block"]):
        digests = rows["digest"].cast(pa.binary()).to_pylist()
        path, siblings, root = (rows[c].to_pylist() for c in ("path", "siblings", "root"))
        n = rows["n"].to_pylist()
        kept, paths, proofs, roots = [], [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            ways, others = [path[a]], [siblings[a]]
            for level in reversed(_subtree(digests[a + 1:b], n[a + 1])[:-1]):
                said = [x.decode() for x in level]
                runs = [said[k:k + FANOUT] for k in range(0, len(said), FANOUT)]
                others = ["".join(run[:p] + run[p + 1:]) + above for run, above in zip(runs, others)
                          for p in range(len(run))]
                ways = [f"{p}{len(run)}{above}" for run, above in zip(runs, ways) for p in range(len(run))]
            kept += range(a + 1, b)
            paths += ways
            proofs += others
            roots += [root[a]] * (b - a - 1)
        own = rows.take(pa.array(kept, pa.int64())).combine_chunks()
        columns = {c: own[c] for c in ("tree", "idx", "digest", "n", "carry")} | {
            "path": pa.array(paths, pa.string()), "siblings": pa.array(proofs, pa.string()),
            "root": pa.array(roots, pa.string())}
        yield from pa.table(columns).to_batches()


def extract(levels: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """(tree, idx, digest, n, carry, path, siblings, root): the proof of every node of the lowest level.

    ``above`` (tree, path, siblings) is what follows a tree's root, by default nothing. ``path`` has two
    digits a level, from the leaf up: the node's place in its run and the run's
    length; ``siblings`` are the hex digests of the runs' others, joined. The lowest
    level may have a column ``carry``, handed on. Only levels above it are written.
    """
    found = None
    carry = dict(levels[0].dtypes).get("carry", "string")
    for number in range(len(levels) - 1, -1, -1):
        nodes = levels[number]
        if "carry" not in nodes.columns:
            nodes = nodes.withColumn("carry", F.lit(None).cast(carry))
        ends = nodes.where("n = 1")
        ends = (ends.join(above, "tree") if above is not None
                else ends.withColumns({"path": F.lit(""), "siblings": F.lit("")}))
        whole = ends.select(
            "tree", "idx", "digest", "n", "carry", "path", "siblings", F.col("digest").alias("root"))
        if found is not None:
            heads = found.select("tree", F.lit(-1).cast("long").alias("idx"), F.lit("").alias("digest"), "n",
                                 F.lit(None).cast(carry).alias("carry"), F.col("idx").alias("block"), "path",
                                 "siblings", "root")
            empty = F.lit(None).cast("string")
            rows = _blocks(nodes).withColumns({"path": empty, "siblings": empty, "root": empty}).unionByName(heads)
            # a root of one node alone has nothing below it
            rows = (rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
                    .mapInArrow(_descend, whole.select("tree", "idx", "digest", "n", "carry", "path", "siblings",
                                                       "root").schema))
            whole = whole.unionByName(rows)
        found = cut_lineage(whole) if number else whole
    return found


def manifest(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves`` (source, doc_id, digest, carry), one tree per source.

    Leaves of a source ascend by ``doc_id`` (null first), equal ids by digest. A run is
    three consecutive nodes, the last of a level perhaps fewer. Sources follow in
    byte order, null first.
    """
    leaves = cut_lineage(leaves)
    sizes = leaves.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1).cast("long"))
    sources = cut_lineage(running(sizes, [F.col("source").asc_nulls_first()], {"tree": "one", "base": "n"})
                          .select(F.col("source").alias("__source"), "tree", "base", "n"))
    placed = running(leaves.withColumn("one", F.lit(1).cast("long")),
                     [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest").asc()],
                     {"place": "one"})
    nodes = cut_lineage(placed.join(sources, placed["source"].eqNullSafe(sources["__source"]))
                        .select("tree", (F.col("place") - F.col("base")).alias("idx"), "digest", "n", "carry"))
    levels = build_levels(nodes)
    roots = cut_lineage(tree_roots(levels))
    count = roots.count()
    top = build_levels(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest",
                                    F.lit(count).cast("long").alias("n")))
    root = tree_roots(top).first()
    return Manifest(levels, top, root and root["digest"])


def proofs(made: Manifest) -> DataFrame:
    """(leaf, carry, subroot, path, siblings): one row per leaf, up to the dataset's root."""
    above = extract(made.top).select(F.col("idx").alias("tree"), "path", "siblings")
    return extract(made.levels, cut_lineage(above)).select(
        F.col("digest").alias("leaf"), "carry", F.col("root").alias("subroot"), "path", "siblings")


def folded(leaf: Column, path: Column, siblings: Column) -> Column:
    """The root that a leaf digest and its proof lead to."""
    levels = F.length(path) / 2
    steps = F.when(levels > 0, F.sequence(F.lit(0), (levels - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def digit(at: Column) -> Column:
        return F.substring(path, at, F.lit(1)).cast("int")

    def step(state: Column, k: Column) -> Column:
        place, others = digit(2 * k + 1), digit(2 * k + 2) - 1
        left = F.substring(siblings, state["at"], 64 * place)
        right = F.substring(siblings, state["at"] + 64 * place, 64 * (others - place))
        return F.struct(F.sha2(F.concat(left, state["digest"], right), 256).alias("digest"),
                        (state["at"] + 64 * others).alias("at"))

    start = F.struct(leaf.alias("digest"), F.lit(1).alias("at"))
    return F.aggregate(steps, start, step, lambda state: state["digest"])


def document_leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, digest, carry): the leaf of every row, and beside the id the leaf of its altered text.

    Where 2 divides the CRC-32 of the decimal id, the altered text lacks its line
    feeds; a null text, and the text of a row without an id, stay as they are.
    """
    rows = docs.select(*FIELDS)
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0,
                   F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    first = [F.col(c) for c in FIELDS[:-1]]
    return rows.select(
        "source", "doc_id", leaf_digest(*first, F.col("text")).alias("digest"),
        F.struct("doc_id", leaf_digest(*first, other).alias("altered")).alias("carry"))


def verified_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs``.

    Any field may be null (``-`` in its leaf) or empty. Rows without an id come first in
    their source; rows that repeat an id follow by digest, each a leaf of its own. An empty
    table gives no rows. Columns beside the five fields are not looked at.
    """
    made = manifest(document_leaves(docs))
    back = folded(F.col("carry.altered"), F.col("path"), F.col("siblings"))
    root = F.lit(made.root).cast("string")
    return proofs(made).select(
        "carry.doc_id", "leaf", "subroot", root.alias("root"),
        F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"), back.alias("folded_root"),
        (back == root).alias("verified"))


def _crc_steps() -> list[int]:
    """Remainders of the reflected CRC-32 polynomial for every byte."""
    steps = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        steps.append(byte)
    return steps


def _said(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


_FIRST = " || ".join(_said(c) for c in FIELDS[:-1])
ORACLE = f"""
WITH RECURSIVE t AS (SELECT {_crc_steps()}::BIGINT[] AS steps),
c AS (SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT,
    [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..')]),
    lambda a, x: xor(a >> 8, steps[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) % 2 = 0
    THEN replace(text, chr(10), '') ELSE text END AS other FROM documents, t),
h AS (SELECT doc_id, source, sha256({_FIRST} || {_said('text')}) AS leaf,
  sha256({_FIRST} || {_said('other')}) AS altered FROM c),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
  count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM h),
low AS (SELECT tree, 0 AS lvl, idx, leaf AS digest, n FROM l
  UNION ALL SELECT tree, lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3
  FROM low WHERE n > 1 GROUP BY tree, lvl, idx // 3, n),
subs AS (SELECT tree, digest FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, tree AS idx, digest, (SELECT count(*) FROM subs) AS n FROM subs
  UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3
  FROM high WHERE n > 1 GROUP BY lvl, idx // 3, n),
ways AS (
  SELECT l.tree, l.idx, x.lvl, x.idx AS place, x.digest, x.idx < l.idx // (3 ** x.lvl)::BIGINT AS is_left
  FROM l JOIN low x ON x.tree = l.tree AND x.n > 1 AND x.idx // 3 = l.idx // (3 ** (x.lvl + 1))::BIGINT
    AND x.idx <> l.idx // (3 ** x.lvl)::BIGINT
  UNION ALL
  SELECT l.tree, l.idx, 100 + x.lvl, x.idx, x.digest, x.idx < l.tree // (3 ** x.lvl)::BIGINT
  FROM l JOIN high x ON x.n > 1 AND x.idx // 3 = l.tree // (3 ** (x.lvl + 1))::BIGINT
    AND x.idx <> l.tree // (3 ** x.lvl)::BIGINT),
runs AS (SELECT tree, lvl, coalesce(max(n), 0) AS n FROM low WHERE n > 1 GROUP BY tree, lvl
  UNION ALL SELECT s.tree, 100 + lvl, max(n) FROM high, subs s WHERE n > 1 GROUP BY s.tree, lvl),
numbered AS (SELECT tree, lvl, row_number() OVER (PARTITION BY tree ORDER BY lvl) AS k FROM runs),
sides AS (SELECT l.tree, l.idx, r.k, coalesce(string_agg(w.digest, '' ORDER BY place) FILTER (is_left), '') AS lo,
    coalesce(string_agg(w.digest, '' ORDER BY place) FILTER (NOT is_left), '') AS hi
  FROM l JOIN numbered r ON r.tree = l.tree
  LEFT JOIN ways w ON w.tree = l.tree AND w.idx = l.idx AND w.lvl = r.lvl GROUP BY l.tree, l.idx, r.k),
proof AS (SELECT tree, idx, sha256(string_agg(lo || hi, '' ORDER BY k)) AS proof_sha256 FROM sides GROUP BY tree, idx),
fold AS (SELECT tree, idx, 0 AS k, altered AS digest FROM l
  UNION ALL SELECT f.tree, f.idx, f.k + 1, sha256(s.lo || f.digest || s.hi)
  FROM fold f JOIN sides s ON s.tree = f.tree AND s.idx = f.idx AND s.k = f.k + 1),
done AS (SELECT tree, idx, arg_max(digest, k) AS folded_root FROM fold GROUP BY tree, idx)
SELECT l.doc_id, l.leaf, subs.digest AS subroot, high.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  folded_root, folded_root = high.digest AS verified
FROM l JOIN subs USING (tree) JOIN high ON high.n = 1 JOIN done ON done.tree = l.tree AND done.idx = l.idx
LEFT JOIN proof ON proof.tree = l.tree AND proof.idx = l.idx
"""


@query("op11_merkle_manifest", ORACLE)
def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document, after the tampering of every other one."""
    return verified_leaves(table(spark, sf_dir, "documents"))

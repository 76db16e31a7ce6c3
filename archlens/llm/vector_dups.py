"""Near-duplicate vectors by random-hyperplane signs in several tables.

Equal vectors are one node with a multiplicity. Vectors of one label whose
signs agree in a table share a bucket; a bucket is cut into blocks, and pairs of
blocks are compared as matrices in double precision. What leaves a task is one
count and one local root per vector, never the pairs.
"""
from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from archlens.llm.batches import bounded
from archlens.llm.components import components
from archlens.llm.grouped import sorted_groups
from archlens.llm.registry import query, table
from archlens.session import cut_lineage

BITS, TABLES = 16, 40    # at cosine 0.98 a table keeps a pair together with 0.348; all miss it 4 times in 10^8
BLOCK = 256              # vectors of a bucket compared together

SIGNED = T.StructType([T.StructField("name", T.BinaryType()), T.StructField("unit", T.BinaryType()),
                       T.StructField("signs", T.BinaryType())])


@functools.cache
def planes(size: int) -> np.ndarray:
    """Fixed normal vectors of all tables for vectors of ``size`` numbers."""
    return np.random.default_rng(size).standard_normal((size, TABLES * BITS))


@F.arrow_udf(SIGNED)
def _signed(vectors: pa.Array, labels: pa.Array) -> pa.Array:
    rows = vectors.to_pylist()
    units: list[np.ndarray | None] = []
    for row, label in zip(rows, labels.to_pylist()):
        unit = None
        if row and label is not None and None not in row:
            vector = np.array(row, dtype=np.float64)
            top = np.abs(vector).max()
            if np.isfinite(top) and top > 0:
                vector = vector / top
                unit = vector / np.sqrt(vector @ vector)
        units.append(unit)
    names: list[bytes | None] = [None] * len(rows)
    data: list[bytes | None] = [None] * len(rows)
    signs: list[bytes | None] = [None] * len(rows)
    by_size: dict[int, list[int]] = {}
    for k, unit in enumerate(units):
        if unit is not None:
            by_size.setdefault(len(unit), []).append(k)
    for size, places in by_size.items():
        side = np.stack([units[k] for k in places]) @ planes(size) > 0
        codes = np.packbits(side.reshape(len(places), TABLES, BITS), axis=2).tobytes()
        width = TABLES * BITS // 8
        for at, k in enumerate(places):
            raw = np.array(rows[k], dtype=np.float64).tobytes()
            label = str(labels[k]).encode()
            names[k] = hashlib.blake2b(len(label).to_bytes(8, "little") + label + raw, digest_size=16).digest()
            data[k] = units[k].tobytes()
            signs[k] = codes[at * width:(at + 1) * width]
    return pa.StructArray.from_arrays([pa.array(x, pa.binary()) for x in (names, data, signs)], SIGNED.names)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _keys(signs: pa.Array, units: pa.Array, labels: pa.Array) -> pa.Array:
    """One 64-bit bucket key per table, of the table, label, size and signs; the table number is its low byte."""
    out = []
    width = BITS // 8
    for code, unit, label in zip(signs.to_pylist(), units.to_pylist(), labels.to_pylist()):
        head = f"{label}/{len(unit)}/".encode()
        out.append([int.from_bytes(hashlib.blake2b(head + bytes([t]) + code[t * width:(t + 1) * width],
                                                   digest_size=8).digest(), "little", signed=True) & ~0xFF | t
                    for t in range(TABLES)])
    return pa.array(out, pa.list_(pa.int64()))


def _block_links(cosine: np.ndarray, codes: np.ndarray, here: int, least: float) -> np.ndarray:
    """Which pairs are linked and first meet in table ``here``."""
    linked = cosine >= least
    np.fill_diagonal(linked, False)
    a, b = np.nonzero(np.triu(linked))
    earlier = (codes[a, :here] == codes[b, :here]).any(axis=1)
    linked[a[earlier], b[earlier]] = linked[b[earlier], a[earlier]] = False
    return linked


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Counts and local roots of sorted rows (key, one, two, block, node, copies, unit, signs)."""
    for rows, bounds in sorted_groups(batches, ["key", "one", "two"]):
        yield from _compare_rows(rows, bounds, least)


def _compare_rows(rows: pa.Table, bounds: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    node, copies, block = (rows[c].to_numpy() for c in ("node", "copies", "block"))
    table_number = rows["key"].to_numpy() & 0xFF
    one, two = rows["one"].to_numpy(), rows["two"].to_numpy()
    units, signs = rows["unit"].to_pylist(), rows["signs"].to_pylist()
    out: list[list] = [[], [], []]
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a < 2:
            continue
        vectors = np.frombuffer(b"".join(units[a:b])).reshape(b - a, -1)
        codes = np.frombuffer(b"".join(signs[a:b]), dtype=f"V{BITS // 8}").reshape(b - a, TABLES)
        linked = _block_links(vectors @ vectors.T, codes, int(table_number[a]), least)
        if one[a] != two[a]:  # inside each block is the business of (block, block)
            linked &= block[a:b, None] != block[None, a:b]
        touched = np.flatnonzero(linked.any(axis=1))
        if not len(touched):
            continue
        root = np.arange(b - a)
        while True:
            near = np.where(linked, root[None, :], b - a).min(axis=1)
            nearer = np.minimum(root, near)
            nearer = nearer[nearer]
            if (nearer == root).all():
                break
            root = nearer
        out[0] += node[a:b][touched].tolist()
        out[1] += (linked @ copies[a:b])[touched].tolist()
        out[2] += node[a:b][root[touched]].tolist()
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "links", "near"])


def vector_classes(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                   least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row.

    Rows link when their labels are equal and not null and their cosine is
    ``least`` or more. Vectors that are null, empty, zero, or hold a null or a
    non-finite number link with nothing; nor do vectors of different lengths.
    ``component_id`` is the smallest id reachable by links; a null id counts
    as the largest. Equal rows all link with each other.
    """
    signed = cut_lineage(
        bounded(vectors).select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
        .withColumn("s", _signed.asNondeterministic()("vector", "label"))
        .select("vec_id", "label", "s.*"))
    nodes = cut_lineage(signed.where("name IS NOT NULL").groupBy("name").agg(
        F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
        F.first("unit").alias("unit"), F.first("signs").alias("signs"))
        .withColumn("node", F.monotonically_increasing_id()))
    keyed = cut_lineage(nodes.withColumn("keys", _keys.asNondeterministic()("signs", "unit", "label"))
                        .select("node", F.explode("keys").alias("key")))
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK)
    members = (keyed.join(full, "key")
               .withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
               .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
               .select("node", "key", "block", F.least("block", "other").alias("one"),
                       F.greatest("block", "other").alias("two")))
    placed = (members.join(nodes.select("node", "copies", "unit", "signs"), "node")
              .select("key", "one", "two", "block", "node", "copies", "unit", "signs")
              .repartition("key", "one", "two").sortWithinPartitions("key", "one", "two"))
    found = cut_lineage(placed.mapInArrow(functools.partial(_compare, least=least),
                                          "node long, links long, near long"))
    roots = components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = nodes.select("name", "head", "copies", "node").join(counts, "node", "left").join(roots, "node", "left")
    least_id = linked.where("root IS NOT NULL").groupBy("root").agg(F.min("head").alias("first"))
    classed = linked.join(least_id, "root", "left").select(
        "name", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("first", "head").alias("component_id"))
    out = signed.select("vec_id", "name").join(classed, "name", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


@query("op9_vector_duplicates")
def op9_vector_duplicates(spark, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return vector_classes(table(spark, sf_dir, "embeddings"))

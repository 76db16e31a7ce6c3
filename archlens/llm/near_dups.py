"""Near-duplicate documents by BagMinHash, banding and exact multiset overlap.

Texts with equal bags are one node. Nodes that share a band meet at the
bucket's first node; the pairs are verified on the whole bags, links become
components. Buckets that still hold several components are cut into blocks and
compared inside tasks; no bucket is written out as its pairs.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from archlens.llm import bags as B, words as W
from archlens.llm.batches import bounded
from archlens.llm.components import components
from archlens.llm.grouped import sorted_groups
from archlens.llm.registry import query, table
from archlens.session import cut_lineage

BANDS, ROWS = 40, 6      # a pair of similarity 0.8 shares no band once in 190,000 times
BLOCK = 128              # texts of an unsettled bucket compared together

SIGNED = T.StructType([T.StructField("bag", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
BAG = T.StructType([T.StructField("bag", T.BinaryType()), T.StructField("elements", T.ArrayType(T.LongType())),
                    T.StructField("bands", T.BinaryType())])


def _lists(owner_counts: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(owner_counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


@F.arrow_udf(SIGNED)
def _signed(texts: pa.Array) -> pa.Array:
    names, keys, counts = [], [], []
    for part in B.slices(W.utf8(texts)):
        bag = B.bags(part)
        name = B.digests(len(part), *bag)
        band = B.band_keys(B.signatures(len(part), *bag, BANDS * ROWS), BANDS)
        full = np.array([x is not None for x in name], dtype=bool)
        names += name
        keys.append(band[full].ravel())
        counts.append(np.where(full, BANDS, 0))
    flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
    count = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
    return pa.StructArray.from_arrays([pa.array(names, pa.binary()), _lists(count, flat)], ["bag", "bands"])


@F.arrow_udf(BAG)
def _bag(texts: pa.Array) -> pa.Array:
    names, values, counts, bands = [], [], [], []
    for part in B.slices(W.utf8(texts)):
        bag = B.bags(part)
        names += B.digests(len(part), *bag)
        owner, element = B.elements(*bag)
        values.append(element)
        counts.append(np.bincount(owner, minlength=len(part)))
        table = B.signatures(len(part), *bag, BANDS * ROWS)
        bands += [x.tobytes() for x in B.band_keys(table, BANDS)]
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)
    count = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
    return pa.StructArray.from_arrays([pa.array(names, pa.binary()), _lists(count, flat),
                                       pa.array(bands, pa.binary())], BAG.names)


def _verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bags overlap by ``percent`` of their union or more."""
    left = held.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    right = held.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    return (pairs.join(right, "b").join(left, "a")
            .where(100 * both >= percent * (F.size("ea") + F.size("eb") - both)).select("a", "b"))


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, one, two, block, node, root): block pairs of buckets that hold more than one component.

    Members in the component of the bucket's first node ("main") are compared
    with the others only, so a large component costs as many rows as it has
    members for each block of others.
    """
    leads = roots.select(F.col("node").alias("a"), F.col("root").alias("lead"))
    known = (members.where("node <> a").join(roots, "node", "left").join(leads, "a", "left")
             .select("key", "node", F.coalesce("root", "node").alias("root"),
                     (F.coalesce("root", "node") == F.coalesce("lead", "a")).alias("main")))
    mixed = (known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                      F.count_if("main").alias("mains"), F.count_if(~F.col("main")).alias("others"))
             .where("lo <> hi")
             .select("key", F.ceil(F.col("mains") / BLOCK).alias("mains"), F.ceil(F.col("others") / BLOCK).alias("others")))
    placed = known.join(mixed, "key").withColumn("hash", F.xxhash64("node"))
    own = F.when(F.col("main"), F.col("others") + F.pmod("hash", F.greatest("mains", F.lit(1)))).otherwise(
        F.pmod("hash", "others"))
    last = F.when(F.col("main"), F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    return (placed.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
                    "block", "node", "root"))


def _link_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join components of a block pair, from sorted rows with bands and elements."""
    for rows, bounds in sorted_groups(batches, ["key", "one", "two"]):
        found: list[list[int]] = [[], []]
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if end - start > 1:
                for a, b in _block_links(rows.slice(start, end - start), percent):
                    found[0].append(a)
                    found[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])


def _block_links(rows: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links that join the roots of a block pair; every pair of two roots is counted in full, none by signatures."""
    key, node, root, block = (rows[c].to_numpy() for c in ("key", "node", "root", "block"))
    bands = np.frombuffer(b"".join(rows["bands"].to_pylist()), dtype=np.int64).reshape(len(node), -1)
    elements = rows["elements"].combine_chunks()
    ends = elements.offsets.to_numpy()
    sizes = np.diff(ends)
    every, number = np.unique(elements.values.to_numpy()[ends[0]:ends[-1]], return_inverse=True)
    bag = np.split(number, ends[1:-1] - ends[0])
    within = rows["one"][0] == rows["two"][0]
    parent = {int(r): int(r) for r in root}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    links = []
    mine = np.zeros(len(every), dtype=bool)
    for k in range(len(node)):  # the parts that a smaller and a larger bag can share bound their similarity
        rest = np.arange(k + 1, len(node))
        fits = ((root[rest] != root[k]) & ((block[rest] != block[k]) | within)
                & (100 * np.minimum(sizes[rest], sizes[k]) >= percent * np.maximum(sizes[rest], sizes[k])))
        rest = rest[fits]
        same = bands[rest] == bands[k]  # a pair belongs to the first bucket that it shares
        rest = rest[bands[k][same.argmax(axis=1)] == key[0]]
        mine[bag[k]] = True
        for b in rest.tolist():
            x, y = find(int(root[k])), find(int(root[b]))
            if x != y:  # one component needs no further link
                both = np.count_nonzero(mine[bag[b]])
                if 100 * both >= percent * (sizes[k] + sizes[b] - both):
                    parent[x] = y
                    links.append((int(node[k]), int(node[b])))
        mine[bag[k]] = False
    return links


def duplicate_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                      percent: int = 80) -> DataFrame:
    """(doc_id, class_id, kept) per row: rows linked by similarity of ``percent`` or more share a class.

    The similarity is that of the multisets of five-word shingles of the whole
    texts. ``class_id`` is the smallest id of the class; ``kept`` marks that row.
    Null texts and texts without words are classes of their own. A row with a
    null id is a class of its own with a null ``class_id``, and is kept. Rows
    that repeat an id with equal texts are all in its class.
    """
    source = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = cut_lineage(source.withColumn("s", _signed.asNondeterministic()("text"))
                         .select("doc_id", "s.bag", "s.bands"))
    named = signed.where("doc_id IS NOT NULL AND bag IS NOT NULL")
    nodes = cut_lineage(named.groupBy("bag").agg(F.min("doc_id").alias("head"), F.first("bands").alias("bands"))
                        .withColumn("node", F.monotonically_increasing_id()))
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = cut_lineage(banded.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"),
                                                    F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = cut_lineage(banded.join(buckets.where("n > 2").select("key", "a"), "key"))
    pairs = cut_lineage(buckets.where("n = 2").select("a", "b")
                        .union(members.where("node <> a").select("a", F.col("node").alias("b"))).distinct())

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    heads = nodes.select("node", "head", F.col("bag").alias("own")).join(wanted, "node")
    # an id with several texts brings them all; only the node's own bag stays (a node twice is harmless)
    held = cut_lineage(source.join(heads, source["doc_id"] == heads["head"])
                       .withColumn("mark", F.xxhash64("text")).dropDuplicates(["doc_id", "node", "mark"])
                       .withColumn("s", _bag.asNondeterministic()("text"))
                       .where("s.bag = own").select("node", "s.elements", "s.bands"))

    links = cut_lineage(_verified(pairs, held, percent))
    roots = components(links)
    # every further pair of a bucket is inside one component, or looked at in a block
    placed = (_unsettled(members, roots).join(held, "node")
              .select("key", "one", "two", "block", "node", "root", "elements", "bands")
              .repartition("key", "one", "two").sortWithinPartitions("key", "one", "two"))
    more = cut_lineage(placed.mapInArrow(functools.partial(_link_blocks, percent=percent), "a long, b long"))
    if not more.isEmpty():
        roots = components(links.union(more))
    return _classes(signed, nodes, roots)


def _classes(signed: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    placed = nodes.select("bag", "node", "head").join(roots, "node", "left")
    least = (placed.where("root IS NOT NULL").groupBy("root").agg(F.min("head").alias("class")))
    classed = placed.join(least, "root", "left").select("bag", F.coalesce("class", "head").alias("class_id"))
    out = signed.select("doc_id", "bag").join(classed, "bag", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", class_id.alias("class_id"),
                      F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def _one_of_each(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    # rows of one id and text are the same document; any other row is one of its own
    digest = F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit(b""))
    keyed = docs.withColumn("__key", F.struct(F.col(doc_id).alias("id"), digest.alias("text")))
    stay = duplicate_classes(keyed, doc_id="__key", text=text).where("kept").select(F.col("doc_id").alias("__stay")).distinct()
    return keyed.join(stay, F.col("__key") == F.col("__stay"), "left_semi").dropDuplicates(["__key"]).drop("__key")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near duplicates, columns as given; the smallest id of a class stays.

    Rows are told apart by id and text, so of an id with several texts each row stays or
    goes by its own text. Of rows that repeat an id and a text one stays. Rows without an
    id are compared with each other, and one of each class stays, also if a row with an id
    equals it. Columns named ``__key`` or ``__stay`` are reserved.
    """
    named = _one_of_each(docs.where(F.col(doc_id).isNotNull()), doc_id, text)
    nameless = docs.where(F.col(doc_id).isNull())
    if nameless.isEmpty():
        return named
    return named.unionByName(_one_of_each(nameless, doc_id, text))


@query("op3_near_duplicates")
def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return duplicate_classes(table(spark, sf_dir, "documents"))

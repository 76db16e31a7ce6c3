"""Merkle manifest against plain hashing, sum-of-squares packing and hard negatives against brute force."""
from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from archlens.llm import hard_negatives, merkle, registry, squares
from archlens.llm.cover_tree import CoverTree, Search
from tests.llm.common import SCHEMA, awkward_rows

CLASHES = ["tree", "idx", "digest", "carry", "path", "row", "group", "room", "block", "anchor", "score", "vector", "n"]


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: tuple) -> str:
    said = (row[0], row[3], row[2], row[4], row[1])
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in said])


def climb(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def proof(levels: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
    sides = []
    for level in levels[:-1]:
        low = at - at % 3
        sides.append((level[low:at], level[at + 1:low + 3]))
        at //= 3
    return sides


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    sources: dict = {}
    for row in rows:
        sources.setdefault(row[3], []).append((row[0], leaf_of(row), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(sources[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in order}
    top = climb([trees[s][-1][0] for s in order]) if order else []
    out = []
    for number, s in enumerate(order):
        for at, (doc_id, leaf, row) in enumerate(sorted(sources[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            sides = proof(trees[s], at) + proof(top, number)
            even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
            back = leaf_of((row[0], row[1].replace("\n", ""), *row[2:])) if even and row[1] is not None else leaf
            for left, right in sides:
                back = h(*left, back, *right)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], h(*[x for a, b in sides for x in a + b]), back,
                        back == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(df) -> list[tuple]:
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted([tuple(r[n] for n in names) for r in merkle.verified_leaves(df).collect()], key=str)


def test_manifest_of_awkward_rows(spark):
    rows = [*awkward_rows(), (12, "a\nb", "en", "", 3), (13, "a\nb", "en", "", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = manifest_rows(docs.repartition(3))
    assert found == plain_manifest(rows)
    assert manifest_rows(docs.withColumns({c: F.lit(1) for c in CLASHES})) == found
    assert merkle.verified_leaves(docs.limit(0)).count() == 0


def test_manifest_over_stored_levels(spark):
    sizes = {"hot": 6600, "x": 82, "y": 81, "z": 28, "one": 1, "four": 4, None: 5} | {f"s{k}": 1 for k in range(90)}
    rows = [(k * 1000 + j if s != "x" else 7, f"{s} {j}\n", "en", s, j) for k, (s, n) in enumerate(sizes.items())
            for j in range(n)]
    found = manifest_rows(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert found == plain_manifest(rows)
    assert 0 < sum(r[-1] for r in found) < len(found)


def test_manifest_stores_every_fourth_level(spark):
    rows = [(k, "t", "en", "hot", 1) for k in range(7000)]
    made = merkle.manifest(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA)))
    assert [x.count() for x in made.levels] == [7000, 87, 2, 1]
    assert [x.count() for x in made.top] == [1]


def test_squares_take_the_least_sum():
    rng = random.Random(4)
    for length, n in ((10, 60), (37, 120), (100, 150)):
        sizes = [rng.randint(1, length) for _ in range(n)]
        sequence, offset, rooms = squares.sum_of_squares(np.array(sizes), length)
        left: list[int] = []
        for k, size in enumerate(sizes):
            def total(at):
                after = [*left, length]
                after[at] -= size
                return sum(c * c for room, c in Counter(after[:-1] if at < len(left) else after).items()
                           if 0 < room < length)
            fits = [at for at in range(len(left)) if left[at] >= size] + [len(left)]
            assert total(sequence[k]) == min(map(total, fits))
            if sequence[k] == len(left):
                left.append(length)
            assert offset[k] == length - left[sequence[k]]
            left[sequence[k]] -= size
        assert left == rooms.tolist()


def _check_packed(rows: list, docs: list[tuple], length: int) -> int:
    encode = Tokenizer.from_file(squares.VOCABULARY).encode
    expected = Counter()
    for doc_id, text in docs:
        ids = [*encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), length)):
            part = np.array(ids[at:at + length], dtype="<u4").tobytes()
            expected[(doc_id, k, at, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    placed: dict = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(placed)


def test_packs_awkward_rows(spark):
    rows = [*awkward_rows(), (20, "<|endoftext|> İstanbul’s ﬁne ＡＢ it's I'LL\x85\xa0\x1cz", "tr", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for length in (64, 4096):
        _check_packed(squares.pack(squares.pieces(docs, length=length), length=length).collect(),
                      [r[:2] for r in rows], length)
    clashing = squares.pieces(docs.withColumns({c: F.lit(1) for c in CLASHES}))
    assert squares.pack(clashing.withColumns({c: F.lit(1) for c in ("row", "group", "room")})).count() == clashing.count()
    assert squares.pack(squares.pieces(docs.limit(0))).count() == 0


def test_packs_few_sequences_over_several_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = squares.pack(squares.pieces(docs), group=16).collect()
    count = _check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()], 4096)
    assert count <= -(-sum(r.length for r in rows) // 4096) + 5


def test_query_packs_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = registry.QUERIES["op12_pack_sequences"](spark, "/root/testdata/sf0.001").collect()
    assert _check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()], 4096) <= -(
        -sum(r.length for r in rows) // 4096) + 3


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame(awkward_rows(), SCHEMA)
    packed = squares.pack(squares.pieces(docs, length=64, with_ids=True), length=64)
    for r in squares.sequences(packed).collect():
        assert len(r.ids) == 4 * r.n_tokens == 4 * r.cu_seqlens[-1] and len(r.doc_ids) == len(r.cu_seqlens) - 1
    whole = b"".join(bytes(r.ids) for r in packed.where("doc_id = 9 AND piece = 0").select("ids").distinct().collect())
    assert whole == squares.document_ids(awkward_rows()[8][1])[:256]


@pytest.mark.parametrize("kind", ["clusters", "same", "noise"])
def test_cover_tree(kind):
    rng = np.random.default_rng(2)
    points = {"clusters": rng.integers(-40, 40, (30, 6)).repeat(200, axis=0) + rng.integers(-2, 3, (6000, 6)),
              "same": np.ones((500, 6)), "noise": rng.integers(-90, 90, (2000, 6))}[kind].astype(float)
    tree = CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(len(points))) and (tree.points == points[tree.order]).all()
    for k in range(len(tree.low)):
        inside = tree.points[tree.low[k]:tree.high[k]]
        assert np.sqrt(((inside - inside[0]) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-9
        kids = range(tree.first[k], tree.last[k])
        assert tree.loose[k] > tree.low[k] and (len(kids) or tree.loose[k] == tree.high[k])
        if len(kids):
            assert tree.low[kids[0]] == tree.loose[k] and tree.high[kids[-1]] == tree.high[k]
            assert all(tree.high[a] == tree.low[a + 1] for a in kids[:-1])
    assert kind == "same" or len(tree.low) > 5
    rank = rng.permutation(len(points))
    for trial in range(40):
        query = rng.integers(-50, 50, 6).astype(float)
        allowed = rng.random(len(points)) < 0.7
        score = tree.points @ query
        low, high = sorted(rng.choice(score, 2))
        search = Search(tree, query)
        for lo, hi, n in ((-np.inf, np.inf, 5), (low, high, 10), (high, low, 3)):
            fits = np.flatnonzero(allowed & (score >= lo) & (score <= hi))
            want = fits[np.lexsort((rank[fits], -score[fits]))][:n]
            places, found = search.best(n, allowed, rank, lo, hi)
            assert places.tolist() == want.tolist() and found.tolist() == score[want].tolist()


def plain_negatives(rows: list[tuple], asked) -> list[tuple]:
    usable = [(k, r) for k, r in enumerate(rows) if r[2] is not None and r[1] is not None
              and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    for k, (anchor, vector, label) in usable:
        if anchor is None or not asked(anchor):
            continue
        others = sorted((-sum(int(a) * int(b) for a, b in zip(vector, r[1])), r[0] is None, r[0] or 0, j, r[2])
                        for j, r in usable if j != k and len(r[1]) == len(vector))
        for mate in [x for x in others if x[4] == label][:5]:
            p = -mate[0]
            fits = [x for x in others if x[4] != label and 30 * p <= -100 * x[0] <= 90 * p][:10]
            out += [(anchor, None if mate[1] else mate[2], n, None if x[1] else x[2], p, -x[0])
                    for n, x in enumerate(fits, 1)]
    return sorted(out, key=str)


def negative_rows(df) -> list[tuple]:
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=str)


def test_hard_negatives_of_awkward_rows(spark):
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    rows = [(k, rng.integers(0, 6, 4).astype(float).tolist(), int(rng.integers(0, 3)) if k % 3 else 0) for k in range(300)]
    rows += [(100, rows[100][1], rows[100][2]), (None, [3.0, 3.0, 3.0, 3.0], 1), (None, [5.0] * 4, 2),
             (400, None, 1), (401, [1.0, None, 1.0, 1.0], 1), (500, [nan, 1.0, 1.0, 1.0], 1), (600, [inf, 1.0, 1.0, 1.0], 1),
             (700, [1.0] * 4, None), (800, [4.0, 4.0], 1), (801, [3.0, 5.0], 1), (802, [2.0, 2.0], 2), (900, [], 1),
             (1000, [0.0] * 4, 1), (1100, [-1.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    found = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)
    # rows of one id and label are told apart by their vectors alone
    assert negative_rows(found) == plain_negatives(rows, lambda i: i % 100 == 0)
    clash = df.withColumns({c: F.lit(1) for c in CLASHES if c != "vector"})
    assert negative_rows(hard_negatives.hard_negatives(clash, F.col("vec_id") % 100 == 0)) == negative_rows(found)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 1.0], 1), (1, [1e300, 2.0], 1), (2, [1e200, 1.0], 2)],
                                 "vec_id long, embedding array<double>, label int")
    hard_negatives.hard_negatives(huge, F.lit(True)).collect()


def test_hard_negatives_over_many_blocks(spark):
    """More candidates than a block holds, one label on a third of the rows."""
    table = spark.read.parquet("/root/testdata/check_s/embeddings.parquet")
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding, dtype=float)).tolist(), 0 if r.vec_id % 3 == 0 else r.label)
            for r in table.collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = hard_negatives.hard_negatives(df, F.col("vec_id") % 5000 == 0)
    assert negative_rows(found) == plain_negatives(rows, lambda i: i % 5000 == 0) and found.count()

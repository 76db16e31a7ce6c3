"""Packed token rows by best-fit decreasing.

Tasks tokenise their own documents and pack them window by window: pieces of
full length are rows at once, the rest go, longest first, to the row with the
least room that still fits, found in a segment tree over capacities.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from archlens.llm import token_stream as S
from archlens.llm.batches import bounded
from archlens.llm.registry import query, table

LENGTH = 2048
WINDOW_TOKENS = 4_000_000  # ids that a task holds and packs together

COLUMNS = ("doc_ids array<long>, chunks array<int>, ids binary, n_tokens int, cu_seqlens array<int>, "
           "position_ids binary")
SCHEMA = pa.schema([("doc_ids", pa.list_(pa.int64())), ("chunks", pa.list_(pa.int32())), ("ids", pa.binary()),
                    ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary())])


class Capacities:
    """Open rows by room left; the least room that fits is found by walking a segment tree."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of ``need`` or more."""
        at = self.leaves + need
        while not self.count[at]:  # climb to a right-hand neighbour that holds rows
            while at > 1 and at & 1:
                at >>= 1
            if at <= 1:
                return None
            at += 1
        while at < self.leaves:
            at <<= 1
            if not self.count[at]:
                at += 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()

    def _add(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of item numbers, longest items first, each to the fullest row with room; ties in given order."""
    rooms, rows = Capacities(length), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = rooms.take(sizes[k])
        if found is None:
            rows.append([])
            found = (length, len(rows) - 1)
        room, row = found
        rows[row].append(k)
        if room > sizes[k]:
            rooms.put(room - sizes[k], row)
    return rows


def _rows(parts: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of (doc_id, chunk, ids) parts of at most ``length`` ids."""
    sizes = [len(p[2]) // 2 for p in parts]
    padding = np.array([S.END], dtype="<u2").tobytes()
    steps = np.arange(length, dtype="<u2").tobytes()
    packed = best_fit(sizes, length)
    for a in range(0, len(packed), 512):
        columns: list[list] = [[] for _ in SCHEMA]
        for row in packed[a:a + 512]:
            ends = np.cumsum([0, *[sizes[k] for k in row]])
            n = int(ends[-1])
            place = b"".join(steps[:2 * sizes[k]] for k in row) + steps[:2 * (length - n)]
            ids = b"".join(parts[k][2] for k in row) + padding * (length - n)
            for column, value in zip(columns, ([parts[k][0] for k in row], [parts[k][1] for k in row], ids, n,
                                               ends.tolist(), place)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def _pack(batches: Iterator[pa.RecordBatch], length: int, window: int) -> Iterator[pa.RecordBatch]:
    parts: list[tuple] = []
    held = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = S.document_ids(text)
            for chunk, at in enumerate(range(0, len(ids), 2 * length)):
                parts.append((doc_id, chunk, ids[at:at + 2 * length]))
            held += len(ids) // 2
            if held >= window:
                yield from _rows(parts, length)
                parts, held = [], 0
    if parts:
        yield from _rows(parts, length)


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
         window: int = WINDOW_TOKENS) -> DataFrame:
    """Rows of ``length`` token ids that hold every id of every document once.

    ``ids`` and ``position_ids`` are little-endian 16-bit rows of the matrices
    (``position_ids`` restarts at each part and over the padding), ``n_tokens``
    counts ids before the padding, ``cu_seqlens`` are the parts' bounds, and
    ``doc_ids`` / ``chunks`` name the parts: chunk k of a document starts at its
    id k * ``length``. Every document ends with the end id, so a null or empty
    text is that id alone, and an id given twice is packed twice. No shuffle; a
    task holds ``window`` ids and the longest document. Reruns over the same
    input splits give the same rows.
    """
    assert 1 < length <= 65_536
    rows = bounded(docs).select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    return rows.mapInArrow(functools.partial(_pack, length=length, window=window), COLUMNS)


def write_matrices(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet files; rows of ``ids`` joined are a matrix of 16-bit ids."""
    packed.write.parquet(path)


@query("op2_packed_rows")
def op2_packed_rows(spark, sf_dir: str) -> DataFrame:
    """All documents packed to rows of 2,048 ids."""
    return pack(table(spark, sf_dir, "documents"))

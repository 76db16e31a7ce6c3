"""Packing documents into sequences by the sum of squares.

Documents are tokenised where they are read and cut only where they are longer
than a sequence. Pieces are packed by length alone, in groups of bounded size: a
piece goes where the squared counts of open sequences per room left become
smallest. Sequences that a group leaves with room are opened again and packed
together with those of other groups.
"""
from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer, pre_tokenizers

from archlens.llm.batches import bounded
from archlens.llm.registry import query, table
from archlens.session import cut_lineage

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END = 1                 # follows every document
LENGTH = 4096
GROUP = 8192            # pieces that a task packs together, on average
ROOM = 16               # sequences with more room are opened again
CACHE = 400_000
LIMIT = 64              # longer parts are not remembered
PART = 256              # pieces to a batch when ids are handed out

# the vocabulary drops blanks and joins nothing across them
CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
# what its tokenizer cuts lower-cased Latin-1 text into; White_Space is left out
LATIN_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|"
                         r"[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")

PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")


class _Known(dict):
    """Text to its ids, little-endian 32-bit; emptied when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, text: str) -> bytes:
        value = array("I", self.encode(text)).tobytes()
        if len(text) <= LIMIT:
            if len(self) >= CACHE:
                self.clear()
            self[text] = value
        return value


class Vocabulary:
    """Ids of texts as the tokenizers library gives them, with a memory of parts that it treats alone."""

    def __init__(self, path: str = VOCABULARY):
        tokenizer = Tokenizer.from_file(path)
        byte_level, model = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), tokenizer.model

        def chunk(text: str) -> list[int]:
            return tokenizer.encode(text, add_special_tokens=False).ids

        def piece(text: str) -> list[int]:
            # lower-cased already, and one piece: what is left is its bytes' spelling and the merges
            spelt = text if text.isascii() and text.isalnum() else byte_level.pre_tokenize_str(text)[0][0]
            return [token.id for token in model.tokenize(spelt)]

        self.special = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        self.chunks, self.pieces = _Known(chunk), _Known(piece)

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, LATIN_PIECE.findall(text.lower()))) if self.plain(text) else (
            b"".join(self.ids(x) if self.plain(x) else self.chunks[x] for x in CHUNK.findall(text)))

    def plain(self, text: str) -> bool:
        """Latin-1 text, which is its own NFC, without a special token's name."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(name in text for name in self.special)


@functools.cache
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(path)


def document_ids(text: str | None, path: str = VOCABULARY) -> bytes:
    """The text's ids and the end id as little-endian 32-bit numbers; a null text is empty."""
    return vocabulary(path).ids(text or "") + END.to_bytes(4, "little")


def _pieces(batches: Iterator[pa.RecordBatch], length: int, path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: list[list] = [[], [], [], [], [], []]

        def out() -> pa.RecordBatch:
            place, piece, start, size, crc, ids = held
            columns = {"doc_id": batch.column(0).take(pa.array(place, pa.int64())), "piece": pa.array(piece, pa.int32()),
                       "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()),
                       "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.binary())
            return pa.RecordBatch.from_pydict(columns)

        texts = batch.column(1).cast(pa.binary())
        for k in range(len(texts)):
            text = texts[k].as_py()
            ids = document_ids(text and text.decode("utf-8", "replace"), path)
            for number, at in enumerate(range(0, len(ids), 4 * length)):
                part = ids[at:at + 4 * length]
                for column, value in zip(held, (k, number, at // 4, len(part) // 4, zlib.crc32(part),
                                                part if with_ids else None)):
                    column.append(value)
            if with_ids and len(held[0]) >= PART:
                yield out()
                held = [[], [], [], [], [], []]
        if held[0]:
            yield out()


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
           path: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, at least one piece each.

    Only documents of more than ``length`` ids (the end id included) are cut, after
    every ``length`` ids. A null or empty text is the end id alone; rows that repeat an
    id have pieces of their own. Bytes that are not UTF-8 read as U+FFFD. ``ids`` are
    little-endian unsigned 32-bit numbers, ``ids_crc32`` is the CRC-32 of those bytes.
    """
    rows = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.BinaryType())
    return rows.mapInArrow(functools.partial(_pieces, length=length, path=path, with_ids=with_ids), schema)


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of every size and the room that each sequence keeps.

    A size goes, in given order, to the open sequence, or to a new one, after which
    the sum over all rooms of (open sequences with that room) squared is least; full
    sequences are not open. Ties go to the least room, a new sequence last.
    """
    far = np.int64(1) << 40
    leaving = np.full(length + 1, far)              # what the sum changes by when a sequence of this room goes
    entering = np.ones(length + 1, dtype=np.int64)  # and when one of this room comes
    entering[0] = 0
    count = [0] * (length + 1)
    open_rows: list[list[int]] = [[] for _ in range(length + 1)]
    rooms: list[int] = []
    sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)

    def counted(room: int, by: int) -> None:
        if room:
            count[room] += by
            leaving[room] = 1 - 2 * count[room] if count[room] else far
            entering[room] = 1 + 2 * count[room]

    for k, size in enumerate(sizes.tolist()):
        change = leaving[size:length] + entering[:length - size]
        at = int(change.argmin()) if size < length else 0
        if size < length and change[at] <= entering[length - size]:
            room = size + at
            row = open_rows[room].pop()
            counted(room, -1)
        else:
            room, row = length, len(rooms)
            rooms.append(length)
        left = room - size
        sequence[k], offset[k], rooms[row] = row, length - room, left
        if left:
            open_rows[left].append(row)
            counted(left, 1)
    return sequence, offset, np.array(rooms, dtype=np.int64)


def _pack_group(rows: pa.Table, length: int, base: int) -> pa.Table:
    order = rows.sort_by([("length", "descending"), ("row", "ascending")])
    sequence, offset, rooms = sum_of_squares(order["length"].to_numpy(), length)
    first = base + (int(rows["group"][0].as_py()) << 32)
    return order.append_column("sequence_id", pa.array(sequence + first)).append_column(
        "offset", pa.array(offset)).append_column("room", pa.array(rooms[sequence]))


def _group_packer(length: int, base: int):
    return lambda rows: _pack_group(rows, length, base)


def pack(pieces: DataFrame, *, length: int = LENGTH, group: int = GROUP, room: int = ROOM) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``: every piece once, no sequence above ``length``.

    ``length`` of a piece must be 1 to ``length``. Pieces are dealt by hash to groups of
    about ``group`` and packed there, longest first. Pieces of sequences with more than
    ``room`` places left are packed again with each other, in fewer groups each time,
    while that leaves a tenth fewer of them. Reruns over the same written pieces agree.
    Columns named row, group, room, sequence_id or offset are replaced.
    """
    kept = [c for c in pieces.columns if c not in ("row", "group", "room", "sequence_id", "offset")]
    waiting = cut_lineage(pieces.select(*kept).withColumn("row", F.monotonically_increasing_id()))
    schema = waiting.schema.add("group", T.LongType()).add("sequence_id", T.LongType()).add(
        "offset", T.LongType()).add("room", T.LongType())
    done, count, number = [], waiting.count(), 0
    while True:
        groups = -(-count // group)
        dealt = waiting.withColumn("group", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(max(1, groups))))
        packed = cut_lineage(dealt.groupBy("group").applyInArrow(_group_packer(length, number << 56), schema))
        again = packed.where(F.col("room") > room)
        left = again.count()
        if left == 0 or 10 * left > 9 * count:
            done.append(packed)
            break
        done.append(packed.where(F.col("room") <= room))
        waiting, count, number = again.select(*kept, "row"), left, number + 1
    return functools.reduce(DataFrame.union, done).select(*kept, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_tokens, cu_seqlens, doc_ids): one row per sequence, from pieces packed with their ids.

    ``ids`` joins the pieces' ids; ``cu_seqlens`` are their bounds, from 0. At most
    ``length`` pieces make a sequence, so no row grows with the data.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ends = F.transform("parts", lambda p: (p["offset"] + p["length"]).cast("int"))
    return rows.select(
        "sequence_id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"),
        F.element_at(ends, -1).alias("n_tokens"), F.concat(F.array(F.lit(0)), ends).alias("cu_seqlens"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))


@query("op12_pack_sequences")
def op12_pack_sequences(spark, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4,096 ids."""
    return pack(pieces(table(spark, sf_dir, "documents")))

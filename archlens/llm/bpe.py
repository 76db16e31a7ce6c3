"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its
encoding. The table of these last tokens is the encoding of all prefixes at
once: bytes are appended by extending it, an encoding is read by walking back.
"""
from __future__ import annotations

import base64
import functools
import hashlib
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from archlens.llm.batches import bounded
from archlens.llm.registry import query, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_CACHE = 300_000
PAIR_CACHE = 2_000_000

# White_Space of Unicode; Python's \s has four control characters more
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@functools.cache
def splitter(last: int = 0x10FFFF) -> re.Pattern:
    """``public_tokenizers.PATTERN`` with its classes spelt out as ranges of code points up to ``last``."""
    def ranges(kind: str) -> str:
        inside = [c for c in range(last + 1) if unicodedata.category(chr(c))[0] == kind]
        out, start = [], None
        for c, after in zip(inside, [*inside[1:], None]):
            start = c if start is None else start
            if after != c + 1:
                out.append(f"\\U{start:08x}-\\U{c:08x}")
                start = None
        return "".join(out)
    pattern = public_tokenizers.PATTERN
    letters, numbers = ranges("L"), ranges("N")
    spelt = (pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}{letters}{numbers}]")
             .replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
             .replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
    return re.compile(spelt)


def split(text: str) -> list[str]:
    """The pieces of ``text``. Classes up to U+FFFF are one table lookup; more are searched range by range."""
    plain = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
    return splitter(0xFFFF if plain else 0x10FFFF).findall(text)


class PrefixBPE:
    """Exact byte-pair encoding of single pieces from a table of ranked tokens."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        # texts that start a token are the states of a matcher, numbered as they come up; 0 is the empty one
        self._starts = {t[:k] for t in self.ranks for k in range(len(t) + 1)}
        self._states, self._numbers, self._ends = [b""], {b"": 0}, [[]]
        self._moves: dict[int, int] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; none for a single byte."""
        if token in self._halves:
            return self._halves[token]
        text = self.tokens[token]
        found = None
        if len(text) > 1:
            # its bytes encoded with the earlier merges only leave two tokens
            parts = [text[k:k + 1] for k in range(len(text))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 62), k) for k in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                found = (self.ranks[parts[0]], self.ranks[parts[1]])
        self._halves[token] = found
        return found

    def meets(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens ends in just these two tokens.

        Undo the later of the two merges, step by step, along the border: a
        merge across the border would have come first if its rank is below that
        of the merges that are still to be made on either side.
        """
        key = (left, right)
        known = self._pairs.get(key)
        if known is not None:
            return known
        known, barrier = True, 1 << 62
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < barrier:
                known = False
                break
            if left > right:  # the left token was merged later (or both are the same: the right one)
                barrier, parts = left, self.halves(left)
                if parts is not None:
                    left = parts[1]
                    continue
                barrier, parts = right + 1, self.halves(right)
                if parts is None:
                    break
                right = parts[0]
            else:
                barrier, parts = right + 1, self.halves(right)
                if parts is not None:
                    right = parts[0]
                    continue
                barrier, parts = left, self.halves(left)
                if parts is None:
                    break
                left = parts[1]
        if len(self._pairs) >= PAIR_CACHE:
            self._pairs.clear()
        self._pairs[key] = known
        return known

    def _step(self, state: int, byte: int) -> int:
        """The state after ``byte``: the longest end of the text that starts some token."""
        text = self._states[state] + bytes([byte])
        while text not in self._starts:
            text = text[1:]
        found = self._numbers.get(text)
        if found is None:
            found = self._numbers[text] = len(self._states)
            self._states.append(text)
            self._ends.append([(len(text) - k, self.ranks[text[k:]]) for k in range(len(text))
                               if text[k:] in self.ranks])
        self._moves[state << 8 | byte] = found
        return found

    def extend(self, piece: bytes, last: list[int], start: int) -> None:
        """Fill ``last`` (its entries up to ``start`` are right already) for every longer prefix."""
        moves, ends, pairs = self._moves, self._ends, self._pairs
        del last[start + 1:]
        state = 0
        for byte in piece[max(0, start - self.longest):start]:
            state = moves.get(state << 8 | byte) or self._step(state, byte)
        end = start
        for byte in piece[start:]:
            state = moves.get(state << 8 | byte) or self._step(state, byte)
            end += 1
            for size, token in ends[state]:  # the tokens that end here, longest first
                if size < end:
                    before = last[end - size]
                    fits = pairs.get((before, token))
                    if not (self.meets(before, token) if fits is None else fits):
                        continue
                last.append(token)
                break
            else:
                raise ValueError(f"no token ends byte {end} of {piece!r}")

    def table(self, piece: bytes) -> list[int]:
        """The last token of every prefix; entry 0 is unused."""
        last = [-1]
        self.extend(piece, last, 0)
        return last

    def walk(self, piece: bytes, last: list[int]) -> list[int]:
        """The tokens of the whole piece."""
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(piece, self.table(piece))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class EditableText:
    """A text with its pieces and their prefix tables; appends and edits re-encode near the change only."""

    REACH = 3  # characters past a piece's end that its match may have looked at

    def __init__(self, text: str, model: PrefixBPE):
        self.text, self.model = "", model
        self.pieces: list[tuple[int, bytes, list[int]]] = []
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters ``start`` to ``end``; returns how many bytes were encoded anew."""
        old = self.pieces
        keep = len(old)
        while keep and old[keep - 1][0] + len(old[keep - 1][1].decode()) + self.REACH > start:
            keep -= 1
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        at = old[keep][0] if keep < len(old) else (old[-1][0] + len(old[-1][1].decode()) if old else 0)
        later = {p[0] + shift: k for k, p in enumerate(old) if k >= keep and p[0] >= end}
        fresh, spent = [], 0
        tail: list = []
        while at < len(self.text):
            if at in later and at >= start + len(new):  # matches depend on what follows only
                tail = [(p + shift, b, t) for p, b, t in old[later[at]:]]
                break
            match = splitter().match(self.text, at)
            piece = match.group().encode()
            before = old[keep + len(fresh)] if keep + len(fresh) < len(old) else None
            same = 0
            table = [-1]
            if before is not None:  # the common prefix of the piece that stood here stays encoded
                while same < min(len(piece), len(before[1])) and piece[same] == before[1][same]:
                    same += 1
                table = before[2][:same + 1]
            self.model.extend(piece, table, same)
            spent += len(piece) - same
            fresh.append((at, piece, table))
            at = match.end()
        self.pieces = old[:keep] + fresh + tail
        return spent

    def ids(self) -> list[int]:
        return [t for _, piece, table in self.pieces for t in
                ([self.model.ranks[piece]] if piece in self.model.ranks else self.model.walk(piece, table))]


@functools.cache
def model(path: str) -> PrefixBPE:
    return PrefixBPE(path)


class _Encoded(dict):
    """Piece to its ids as decimal text; emptied when full."""

    def __init__(self, path: str):
        self.model = model(path)

    def __missing__(self, piece: str) -> str:
        if len(self) >= PIECE_CACHE:
            self.clear()
        value = self[piece] = " ".join(map(str, self.model.encode(piece.encode())))
        return value


class _Decoded(dict):
    """Decimal ids of a piece to its bytes; emptied when full."""

    def __init__(self, path: str):
        self.model = model(path)

    def __missing__(self, ids: str) -> bytes:
        if len(self) >= PIECE_CACHE:
            self.clear()
        value = self[ids] = self.model.decode(map(int, ids.split()))
        return value


@functools.cache
def _caches(path: str) -> tuple[_Encoded, _Decoded]:
    return _Encoded(path), _Decoded(path)


def encode_text(text: str, path: str = VOCABULARY) -> list[str]:
    """Decimal ids of every piece of ``text``."""
    return list(map(_caches(path)[0].__getitem__, split(text)))


def encode_ids(text: Column, path: str = VOCABULARY) -> Column:
    """The token ids of a text as array<int>; a null text has none."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([np.fromstring(" ".join(encode_text(t or "", path)), dtype=np.int32, sep=" ")
                         for t in texts.to_pylist()], pa.list_(pa.int32()))
    return ids.asNondeterministic()(text)


def decode_ids(ids: Column, path: str = VOCABULARY) -> Column:
    """The bytes that token ids stand for; null stays null."""
    @F.arrow_udf(T.BinaryType())
    def text(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else model(path).decode(r) for r in rows.to_pylist()], pa.binary())
    return text.asNondeterministic()(ids)


ROUND_TRIP = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])


def round_trip(docs: DataFrame, *, text: str = "text", path: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """``docs`` plus the struct ``bpe``: number of ids, digest of the ids, digest of the bytes they decode
    to, and the ids themselves if asked.

    One pass without a shuffle over whole texts. A null text counts as empty:
    no ids, and digests of nothing. A column already named ``bpe`` is replaced.
    """
    kind = T.StructType([*ROUND_TRIP, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        decoded = _caches(path)[1]
        counts, ids, back, numbers = [], [], [], [np.zeros(0, dtype=np.int32)]
        for t in texts.to_pylist():
            pieces = encode_text(t or "", path)
            line = " ".join(pieces)
            counts.append(line.count(" ") + 1 if line else 0)
            ids.append(hashlib.sha256(line.encode()).hexdigest())
            back.append(hashlib.sha256(b"".join(map(decoded.__getitem__, pieces))).hexdigest())
            if with_ids and line:
                numbers.append(np.fromstring(line, dtype=np.int32, sep=" "))
        columns = [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(numbers))))
        return pa.StructArray.from_arrays(columns, kind.names)
    return bounded(docs).withColumn("bpe", run.asNondeterministic()(F.col(text)))


@query("op10_byte_bpe")
def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode every whole text and decode the ids again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")

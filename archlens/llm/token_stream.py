"""Tokenising whole texts to packed 16-bit ids with an end-of-document id."""
from __future__ import annotations

import base64
import functools
import sys
from array import array

import public_tokenizers
import tiktoken

from archlens.llm.bpe import VOCABULARY, split

END = 50256              # the id that the vocabulary leaves free
END_BYTES = END.to_bytes(2, "little")
PIECE_CACHE = 500_000
assert sys.byteorder == "little"  # arrays are the bytes of the ids as they are


class _Packed(dict):
    """Piece to its little-endian ids; emptied when full."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECE_CACHE:
            self.clear()
        value = self[piece] = array("H", self.encoding.encode_ordinary(piece)).tobytes()
        return value


@functools.cache
def _packed(path: str) -> _Packed:
    return _Packed(path)


def document_ids(text: str | None, path: str = VOCABULARY) -> bytes:
    """The text's ids and the end id as little-endian 16-bit numbers; a null text is empty."""
    pieces = _packed(path)
    return b"".join(map(pieces.__getitem__, split(text or ""))) + END_BYTES

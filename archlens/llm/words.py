"""Word-level counts of whole texts, batched by Arrow.

A word is a run of characters other than the six ASCII blanks, which is what
``bytes.split()`` yields on UTF-8.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"


def utf8(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


def count_of(text: bytes, chars: bytes) -> int:
    """How many bytes of ``text`` are among ``chars``."""
    return len(text) - len(text.translate(None, chars))


def code_points(text: bytes) -> int:
    return len(text) - count_of(text, bytes(range(0x80, 0xC0)))


def repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    if len(words) < width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    span, size = len(ids) - width + 1, len(known)
    code, distinct = ids[:span], size
    for k in range(1, width):
        # numbers stay exact: a code is below windows * words before it is renumbered
        if distinct * size >= 2 ** 62:
            names, code = np.unique(code, return_inverse=True)
            distinct = len(names)
        code, distinct = code * size + ids[k:k + span], distinct * size
    _, place, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[place] > 1
    hit = np.zeros(len(ids), dtype=bool)
    for k in range(width):
        hit[k:k + span] |= again
    return int(hit.sum())


def repeated_lines(lines: list[bytes]) -> int:
    """Lines with a word that equal an earlier line."""
    worded = [x for x in lines if x.strip(BLANKS)]
    return len(worded) - len(set(worded))

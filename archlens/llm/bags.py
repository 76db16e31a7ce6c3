"""Bags of word shingles and their BagMinHash signatures, for slices of texts at once.

A bag holds every shingle of five words as often as it occurs; a text of one to
four words is one shingle, a text without words an empty bag.
"""
from __future__ import annotations

import hashlib

import numpy as np
import xxhash

SHINGLE = 5
SLICE_WORDS = 400_000     # words hashed together; a longer text is a slice of its own
SLICE_TEXTS = 2_000
WORD_CACHE = 500_000

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_PLACES = [_U(int.from_bytes(hashlib.sha256(b"shingle place %d" % k).digest()[:8], "little") | 1)
           for k in range(SHINGLE)]
_PAD = 0x5DEECE66D


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def slices(texts: list[bytes | None]):
    """(texts as word lists) in runs of bounded size."""
    part, size = [], 0
    for text in texts:
        words = text.split() if text else []
        part.append(words)
        size += len(words)
        if size >= SLICE_WORDS or len(part) >= SLICE_TEXTS:
            yield part
            part, size = [], 0
    if part:
        yield part


def bags(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, times) of every distinct shingle, by text, then shingle."""
    flat: list[int] = []
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    spans = np.zeros(len(texts), dtype=np.int64)
    for k, words in enumerate(texts):
        if words:
            flat.extend(map(_HASHES.__getitem__, words))
            if len(words) < SHINGLE:
                flat.extend([_PAD] * (SHINGLE - len(words)))
            spans[k] = max(len(words), SHINGLE) - SHINGLE + 1
        starts[k + 1] = len(flat)
    if not flat:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(_U), none
    words = np.array(flat, dtype=_U)
    size = len(words) - SHINGLE + 1
    code = np.zeros(size, dtype=_U)
    for k, place in enumerate(_PLACES):
        code += mix(words[k:k + size] * place + place)
    code = mix(code)
    shingles = np.empty(int(spans.sum()), dtype=_U)
    at = 0
    for k, n in enumerate(spans):
        if n:
            shingles[at:at + n] = np.sort(code[starts[k]:starts[k] + n])
            at += n
    owner = np.repeat(np.arange(len(texts)), spans)
    first = np.ones(len(shingles), dtype=bool)
    first[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    places = np.flatnonzero(first)
    times = np.diff(np.append(places, len(shingles)))
    return owner[places], shingles[places], times


def signatures(n_texts: int, owner: np.ndarray, shingles: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
    """BagMinHash: (n_texts, size) first arrival times; infinite for an empty bag.

    Weights are discretised at whole counts. The counts (0, 1], (1, 2], (2, 4],
    (4, 8], ... are blocks, each with a Poisson process of its own whose rate is
    the block's width; an arrival falls on one component and, by halving the
    block, on one count level. A shingle that occurs w times sees the arrivals on
    levels up to w, so two bags share an arrival on min(w1, w2) of max(w1, w2)
    levels, and a component agrees with probability sum min / sum max, the
    weighted Jaccard similarity. Arrivals come in order; a process ends when
    it is past every component of its text.
    """
    best = np.full(n_texts * size, np.inf)
    if not len(owner):
        return best.reshape(n_texts, size)
    parts = []
    block, low = 0, 0
    while True:
        inside = times > low
        if not inside.any():
            break
        width = max(1, low)
        parts.append((owner[inside], mix(shingles[inside] + _U(block * int(_GOLDEN) % 2 ** 64)), np.full(inside.sum(), width),
                      np.minimum(times[inside] - low, width)))
        block, low = block + 1, low + width
    text, state, width, open_ = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(text, kind="stable")
    text, state, width, open_ = text[order], state[order], width[order], open_[order]
    now = np.zeros(len(text))
    limit = np.full(n_texts, np.inf)
    table = best.reshape(n_texts, size)
    turn, check = 0, 1
    while len(text):
        turn += 1
        state = state + _GOLDEN
        gap = mix(state)
        now = now - np.log1p(-(gap >> _U(11)).astype(np.float64) * 2.0 ** -53) / width
        place = mix(gap ^ _GOLDEN)
        part = (place % _U(size)).astype(np.int64)
        hit = now <= limit[text]
        # the level inside the block, by its leading bits: halves, quarters, ...
        hit &= (((place >> _U(32)) * width.astype(_U)) >> _U(32)).astype(np.int64) < open_
        np.minimum.at(best, text[hit] * size + part[hit], now[hit])
        if turn >= check:  # pruning only; looked at ever more rarely
            check = turn + 1 + turn // 4
            active = text[np.flatnonzero(np.diff(text, prepend=-1))]
            limit[active] = table[active].max(axis=1)
            live = now <= limit[text]
            text, state, width, open_, now = text[live], state[live], width[live], open_[live], now[live]
    return table


def band_keys(table: np.ndarray, bands: int) -> np.ndarray:
    """(texts, bands) 64-bit keys of the signature's equal parts; a key tells its band too."""
    rows = table.shape[1] // bands
    cells = table[:, :rows * bands].copy().view(_U).reshape(len(table), bands, rows)
    keys = np.broadcast_to(mix(np.arange(1, bands + 1).astype(_U) * _GOLDEN), cells.shape[:2]).copy()
    for k in range(rows):
        keys = mix(keys * _U(0x9FB21C651E98DF25) + cells[:, :, k])
    return keys.view(np.int64)


def digests(n_texts: int, owner: np.ndarray, shingles: np.ndarray, times: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each bag; null for an empty one."""
    ends = np.searchsorted(owner, np.arange(n_texts + 1))
    out: list[bytes | None] = []
    for k in range(n_texts):
        a, b = ends[k], ends[k + 1]
        out.append(hashlib.blake2b(shingles[a:b].tobytes() + times[a:b].tobytes(), digest_size=16).digest()
                   if b > a else None)
    return out


def elements(owner: np.ndarray, shingles: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, element): each occurrence of a shingle as an element of its own.

    The k-th occurrence has the same name in every text, so the overlap of two
    multisets is the overlap of two sets.
    """
    total = int(times.sum())
    begin = np.repeat(np.cumsum(times) - times, times)
    turn = (np.arange(total) - begin).astype(_U)
    return np.repeat(owner, times), mix(np.repeat(shingles, times) + turn * _GOLDEN)

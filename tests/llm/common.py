"""Small tables with every awkward case, and brute-force helpers."""
from __future__ import annotations

from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = ("the old river runs slowly past the mill and the children watch it turn while evening light falls over "
         "fields of barley that wait for rain and for the long harvest days to come again in early autumn, when all "
         "hands are needed and nobody sleeps much before the first frost lies white on the roofs of the village.")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def awkward_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows, ids used twice."""
    long_text = " ".join(f"{w}{k % 997}" for k in range(4000) for w in ("alpha", "beta", "gamma"))
    return [
        (1, PROSE, "en", "a", 9), (2, PROSE, "en", "a", 9), (3, PROSE.replace("barley", "rye"), "en", "b", 9),
        (4, None, "en", "b", None), (5, "", "en", None, 0), (6, " \n\t ", None, "c", 3), (7, "one two", "en", "c", 7),
        (8, "one two", "en", "a", 7), (9, long_text, "en", "a", 1), (9, long_text, "en", "a", 1),
        (None, PROSE, "en", "a", 9), (None, "nobody knows this id\nat all", None, None, None),
        (10, "ÀÉ ñandú dos tres 😀 #tag | | | »\r\n" * 30, "es", "d", 5),
        (11, "same id, first text of two with several words in it", "en", "a", 1),
        (11, "same id, second text that is quite another one than before", "en", "a", 1),
    ]


def brute_classes(rows: list[tuple], percent: int = 80) -> dict[int, int]:
    """Smallest id of the near-duplicate class of every id; ids must be unique and not null."""
    bags = {}
    for row in rows:
        w = words(row[1])
        bags[row[0]] = Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    root = {k: k for k in bags}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(bags)
    for at, a in enumerate(ids):
        for b in ids[at + 1:]:
            x, y = bags[a], bags[b]
            if x and y and 100 * (x & y).total() >= percent * (x | y).total():
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in ids}

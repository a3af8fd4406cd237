"""Whole batches of texts as arrays: code points, character classes, words and their counts."""

from __future__ import annotations

import unicodedata

import numpy as np

SYMBOLS = "#*$%&|<>!?.,:;\"'=/_-@+"
#: character classes: letters by case (a-f apart, as hexadecimal digits), caseless letters, digits, each symbol, others
LOW_HEX, LOW, UPPER, CASELESS, DIGIT, OTHER, SPACE = range(7)
SYMBOL = {c: 7 + i for i, c in enumerate(SYMBOLS)}
N_CLASSES = 7 + len(SYMBOLS)


def _class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            table[cp] = {"Ll": LOW, "Lu": UPPER}.get(kind, CASELESS)
        elif kind == "Nd":
            table[cp] = DIGIT
    for cp in [c for c in range(0x3001) if chr(c).isspace()]:
        table[cp] = SPACE
    table[ord("a") : ord("g")] = LOW_HEX
    for c, k in SYMBOL.items():
        table[ord(c)] = k
    return table


_TABLE: list[np.ndarray] = []
_POWERS: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_class_table())
    return _TABLE[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        _POWERS[:] = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


class Words:
    """The words (runs without white space) of several texts.

    ``start`` and ``end``: their places in the joined texts; ``doc``: the text of each;
    ``cls``: every character's class; ``edges``: where texts begin (and the end).
    """

    def __init__(self, texts: list[str]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.edges = np.concatenate([[0], np.cumsum(sizes)])
        self.cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.cls = class_table()[self.cp]
        inside = np.zeros(len(self.cp) + 2, bool)
        inside[1:-1] = self.cls != SPACE
        first = np.zeros(len(self.cp) + 1, bool)
        first[self.edges] = True
        turn = inside[1:] != inside[:-1]
        self.start = np.flatnonzero(inside[1:] & (turn | first))
        self.end = np.flatnonzero(inside[:-1] & (turn | first))
        self.doc = np.searchsorted(self.edges, self.start, side="right") - 1
        self.size = self.end - self.start

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many characters of each word are in ``mask``."""
        total = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[self.end] - total[self.start]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, A-Z lower-cased, of its letters and digits alone."""
        if not len(self.cp):
            return np.zeros(0, np.uint64)
        p, inverse = _powers(max(1 << 16, len(self.cp) + 1))
        low = self.cp + np.uint32(32) * ((self.cp >= 65) & (self.cp <= 90))
        solid = (self.cls < OTHER).astype(np.int64)
        rank = np.zeros(len(self.cp) + 1, np.int64)
        np.cumsum(solid, out=rank[1:])
        total = np.zeros(len(self.cp) + 1, np.uint64)
        np.cumsum((low * solid.astype(np.uint32)).astype(np.uint64) * p[rank[:-1]], out=total[1:])
        h = (total[self.end] - total[self.start]) * inverse[rank[self.start]]
        h ^= h >> np.uint64(31)
        return h * np.uint64(0x7FB5D329728EA185)

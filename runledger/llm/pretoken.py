"""Where the matches of the byte-level splitting pattern begin, for whole batches of texts.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.  Its matches
cover a text without gaps, so their starts describe them.  The code points of each
class are asked from the regular expression engine that the reference tokenizer uses, so that both agree
on every code point whatever versions of Unicode they know.
"""

from __future__ import annotations

import numpy as np

SPACE, LETTER, NUMBER, OTHER = range(4)
_CLASSES: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of each code point (surrogates, which no text holds, are OTHER)."""
    if not _CLASSES:
        import tiktoken

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        ranks = {bytes([b]): b for b in range(256)}
        for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
            engine = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            found = bytes(engine.encode_ordinary(every)).decode()  # only matches come back
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def piece_starts(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Sorted places, among the joined texts' code points, where a match begins.

    ``text_starts``: where the texts that are not empty begin; no match crosses those places.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    cls = char_classes()[cp]
    border = np.zeros(n + 1, bool)
    border[text_starts] = True
    border[n] = True
    start = border.copy()
    start[1:n] |= cls[1:] != cls[:-1]
    # the last white space before a run stands alone, or opens the run if it is U+0020
    run = np.flatnonzero(start[:n] & ~border[:n] & (cls != SPACE))
    run = run[cls[run - 1] == SPACE]
    start[run - 1] = True
    start[run[cp[run - 1] == 0x20]] = False
    # contractions, where the apostrophe opens a match
    quote = np.flatnonzero((cp == 0x27) & start[:n] & ~border[1:])
    if len(quote):
        one = cp[quote + 1]
        inside = ~border[np.minimum(quote + 2, n)]
        two = np.where(inside, cp[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, np.array([*map(ord, "stmd")], np.uint32))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[short | long] + 1] = False
        after = np.concatenate([quote[short] + 2, quote[long] + 3])
        start[after[after < n]] = True
        # a U+0020 right after a contraction still opens the run behind it: its own start is kept
    return np.flatnonzero(start[:n])


def byte_places(cp: np.ndarray) -> np.ndarray:
    """Byte offset of every code point in UTF-8, and the total."""
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000), out=at[1:])
    return at

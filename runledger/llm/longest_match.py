"""Token counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of
pieces that greedy longest-match would have popped before it goes on there.  A
word is read once, byte by byte; following a failure link adds its precomputed
count, so the number of pieces comes out in time linear in the word, whatever
its length, and no piece is ever built.

Words are counted through a bounded cache, since most repeat.  Work is per
row: no shuffle.

A vocabulary has pieces that may begin a word and pieces that may go on; in a
byte-level vocabulary the first kind begins with the space before the word.

Defined cases: null and empty texts and texts of white space have no words
and no tokens; a word that the vocabulary cannot spell counts as one unknown
token; a word may have any length; repeated rows are counted each.  Only the text column is read; other
columns pass through.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from runledger.llm.forced_bpe import byte_alphabet, small_batches, tokenizer_path
from runledger.llm.workers import send_package

CACHE_WORDS = 300_000


class LongestMatch:
    """Greedy longest-match piece counts over byte strings."""

    def __init__(self, begin: Iterable[bytes], go_on: Iterable[bytes], lead: bytes = b""):
        self.lead = lead
        # node 0 begins a word, node 1 goes on; child[node << 8 | byte] -> node
        self.child: dict[int, int] = {}
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        whole = [False, False]
        for root, pieces in ((0, begin), (1, go_on)):
            for piece in pieces:
                at = root
                for b in piece:
                    key = at << 8 | b
                    at = self.child.get(key, -1)
                    if at < 0:
                        at = self.child[key] = len(whole)
                        whole.append(False)
                        self.fail.append(-1)
                        self.popped.append(0)
                whole[at] = whole[at] or bool(piece)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.child.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        queue = deque([0, 1])
        while queue:
            up = queue.popleft()
            for b, node in below.get(up, ()):
                if whole[node]:
                    self.fail[node], self.popped[node] = 1, 1
                else:
                    z, count = self.fail[up], self.popped[up]
                    while z >= 0 and (z << 8 | b) not in self.child:
                        count += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[node], self.popped[node] = self.child[z << 8 | b], count
                queue.append(node)

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 (the unknown token) where it cannot be spelled."""
        child, fail, popped = self.child, self.fail, self.popped
        at = n = 0
        for b in self.lead + word:
            while (nxt := child.get(at << 8 | b, -1)) < 0:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = nxt
        while at > 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


class WordCounts(dict):
    """word -> pieces, filled on demand and emptied at a bound."""

    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n


def byte_level_automaton(path: str) -> LongestMatch:
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back = {c: b for b, c in enumerate(byte_alphabet())}
    pieces = [bytes(back[c] for c in token) for token in vocab]
    return LongestMatch([p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "], b" ")


_LOADED: dict[str, WordCounts] = {}


def loaded(path: str) -> WordCounts:
    if path not in _LOADED:
        _LOADED[path] = WordCounts(byte_level_automaton(path))
    return _LOADED[path]


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The documents with ``n_words`` and ``n_tokens`` added (or replaced)."""
    send_package(docs.sparkSession)
    path = path or tokenizer_path()
    kept = [f for f in docs.schema.fields if f.name not in ("n_words", "n_tokens")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = loaded(path)
        for batch in small_batches(batches):
            n_words, n_tokens = [], []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                words = t.encode().split() if t else []  # cuts at ASCII white space
                n_words.append(len(words))
                n_tokens.append(sum(map(counts.__getitem__, words)))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                [*[f.name for f in kept], "n_words", "n_tokens"],
            )

    return docs.mapInArrow(run, f"{schema}, n_words bigint, n_tokens bigint")

"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A merge can only ever build a vocabulary token.  A pair of neighbouring bytes
that stands inside no token is therefore never merged across: it is a certain
cut.  Texts are cut at the pre-tokenizer's word borders and, inside words, at
every such pair.  The fragments are encoded independently (each distinct one
once, through a bounded table) and their ids are concatenated.  Cutting,
looking fragments up and concatenating are vectorised over batches of whole
texts, so a text of any length costs the same per byte, and an endless word
falls apart into short fragments.

Work is per row: no shuffle.  Defined cases: null and empty texts have no ids
and decode to ''; repeated rows are encoded each; a special token's string inside a text gets the special id,
as the library does by default; code points that this Python does not know
yet take the class that the tokenizer itself gives them.  Only the text
column is read; other columns are passed through unchanged.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.workers import send_package

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
BATCH_BYTES = 600_000
CACHE_FRAGMENTS = 300_000
SHORT = 15
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in set(shown) else next(hidden)) for b in range(256)]


def _char_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            table[cp] = LETTER
        elif kind[0] == "N":
            table[cp] = NUMBER
        elif kind == "Cn":
            table[cp] = UNKNOWN
    for cp in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[cp] = SPACE
    return table


class FragmentTable:
    """Fragments of at most ``SHORT`` bytes -> numbers, looked up many at a time.

    A fragment is two words: its first eight bytes, and the others with its
    length in the top byte, so that different fragments never compare equal.
    Open addressing with linear probing.
    """

    BITS = 20

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        n = 1 << self.BITS
        self.low, self.high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.value = np.full(n, -1, np.int32)
        self.size = 0

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of the fragments, -1 where unknown."""
        at = self._slot(low, high)
        out = self.value[at]
        wrong = (out >= 0) & ((self.low[at] != low) | (self.high[at] != high))
        rest = np.flatnonzero(wrong)
        at = at[rest]
        while len(rest):
            at = (at + 1) & ((1 << self.BITS) - 1)
            got = self.value[at]
            out[rest] = got
            wrong = (got >= 0) & ((self.low[at] != low[rest]) | (self.high[at] != high[rest]))
            rest, at = rest[wrong], at[wrong]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        """Distinct fragments that are not in the table yet."""
        self.size += len(low)
        at = self._slot(low, high)
        rest = np.arange(len(low))
        while len(rest):
            free = self.value[at] < 0
            _, first = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.low[at[take]], self.high[at[take]] = low[rest[take]], high[rest[take]]
            self.value[at[take]] = value[rest[take]]
            left = np.ones(len(rest), bool)
            left[take] = False
            rest, at = rest[left], (at[left] + 1) & ((1 << self.BITS) - 1)


class FragmentBpe:
    """Splits texts into fragments and encodes them; holds no reference to Spark."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.alphabet = alphabet
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        self.inside = np.zeros(1 << 16, bool)
        for token, i in vocab.items():
            raw = bytes(back[c] for c in token)
            self.token_bytes[i] = raw
            for a, b in zip(raw, raw[1:], strict=False):
                self.inside[a << 8 | b] = True
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self._special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._library = Tokenizer.from_file(path)
        self._merger = Tokenizer(self._library.model)  # the same merges, without words and special tokens
        self._classes = _char_classes()
        self._shown = {b: alphabet[b] for b in range(256)}
        self._keep = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
        self._flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self._token_len = np.array([len(t) for t in self.token_bytes], np.int64)
        self._token_at = np.cumsum(self._token_len) - self._token_len
        self.table, self.long = FragmentTable(), {}
        self._forget()

    def _forget(self) -> None:
        """Empties the fragment table; fragment k has the ids ids[start[k]:start[k] + count[k]]."""
        self.table.clear()
        self.long.clear()
        self.ids, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _class_of(self, cp: np.ndarray) -> np.ndarray:
        cls = self._classes[cp]
        for odd in np.unique(cp[cls == UNKNOWN]):
            pieces = self._library.pre_tokenizer.pre_tokenize_str("a" + chr(odd) + "1" + chr(odd) + "!")
            first = pieces[0][1]
            found = LETTER if first == (0, 2) else NUMBER if (1, 4) in [p[1] for p in pieces] else OTHER
            self._classes[odd] = found
        return self._classes[cp]

    def _starts(self, cp: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Where words begin, by the rule of the byte-level pre-tokenizer; ``opens``: where a text begins."""
        cls = self._class_of(cp)
        n = len(cp)
        begin = np.zeros(n + 1, bool)  # one more, so that i + 1 and i + 2 exist
        begin[opens] = True
        first = begin.copy()
        first[n] = True
        begin[1:n] |= cls[1:] != cls[:-1]
        runs = np.flatnonzero(begin[:n] & (cls != SPACE))
        runs = runs[~first[runs] & (runs > 0)]
        after_space = runs[cls[runs - 1] == SPACE]
        begin[after_space - 1] = True
        begin[after_space[cp[after_space - 1] == 0x20]] = False
        # 's 't 'm 'd 're 've 'll, where the apostrophe itself begins a word
        quote = np.flatnonzero((cp == 0x27) & begin[:n])
        quote = quote[~first[quote + 1]]
        if len(quote):
            a = cp[quote + 1]
            b = np.where(first[np.minimum(quote + 2, n)], 0, cp[np.minimum(quote + 2, n - 1)])
            one = np.isin(a, [0x73, 0x74, 0x6D, 0x64])
            two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
            begin[quote[one | two] + 1] = False
            ends = np.concatenate([quote[one] + 2, quote[two] + 3])
            ends = ends[ends < n]
            same = ends[(cls[ends] == LETTER)]
            begin[same] = True
        return begin[:n]

    def cuts(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All texts' bytes, where fragments begin in them, and where texts begin (and the end)."""
        joined = "".join(texts)
        n_chars = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.concatenate([[0], np.cumsum(n_chars)])
        if not joined:
            return b"", np.zeros(0, np.int64), edges
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = self._starts(cp, edges[:-1][n_chars > 0])
        data = joined.encode()
        raw = np.frombuffer(data, np.uint8)
        cut = starts.copy()
        if len(raw) != len(cp):
            at = np.zeros(len(cp) + 1, np.int64)
            np.cumsum(1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000), out=at[1:])
            cut = np.zeros(len(raw), bool)
            cut[at[:-1][starts]] = True
            edges = at[edges]
        pair = raw[:-1].astype(np.uint16) << 8 | raw[1:]
        cut[1:] |= ~self.inside[pair]
        return data, np.flatnonzero(cut), edges

    def fragments(self, texts: list[str]) -> list[bytes]:
        data, places, _ = self.cuts(texts)
        ends = [*places.tolist()[1:], len(data)]
        return [data[a:b] for a, b in zip(places.tolist(), ends, strict=True)]

    def _learn(self, frags: list[bytes]) -> np.ndarray:
        """Encodes distinct fragments; their numbers."""
        first = len(self.start)
        ids, counts = [], []
        for i in range(0, len(frags), 20_000):
            shown = [f.decode("latin-1").translate(self._shown) for f in frags[i : i + 20_000]]
            for e in self._merger.encode_batch_fast(shown, add_special_tokens=False):
                ids.extend(e.ids)
                counts.append(len(e.ids))
        new = np.array(counts, np.int64)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(new) - new])
        self.count = np.concatenate([self.count, new])
        self.ids = np.concatenate([self.ids, np.array(ids, np.int32)])
        return np.arange(first, len(self.start), dtype=np.int32)

    def _numbers(self, data: bytes, places: np.ndarray) -> np.ndarray:
        """The number of every fragment; unknown ones are learned."""
        if len(self.start) > CACHE_FRAGMENTS:
            self._forget()
        size = np.diff(np.append(places, len(data)))
        padded = data + bytes(24)
        words = np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))
        low = words[places] & self._keep[np.minimum(size, 8)]
        high = words[places + 8] & self._keep[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
        out = self.table.find(low, high)
        out[size > SHORT] = -1
        missing = np.flatnonzero((out < 0) & (size <= SHORT))
        if len(missing):
            order = missing[np.lexsort((high[missing], low[missing]))]
            a, b = low[order], high[order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            one = order[new]
            got = self._learn([data[p : p + n] for p, n in zip(places[one].tolist(), size[one].tolist(), strict=True)])
            self.table.add(low[one], high[one], got)
            out[order] = got[np.cumsum(new) - 1]
        large = np.flatnonzero(size > SHORT)
        if len(large):
            frags = [data[p : p + n] for p, n in zip(places[large].tolist(), size[large].tolist(), strict=True)]
            unknown = [f for f in dict.fromkeys(frags) if f not in self.long]
            self.long.update(zip(unknown, self._learn(unknown).tolist(), strict=True))
            out[large] = list(map(self.long.__getitem__, frags))
        return out

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, places, edges = self.cuts(texts)
        if not len(places):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        number = self._numbers(data, places)
        count = self.count[number]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.start[number] - (ends - count), count) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(places, edges)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and where each text's begin among them (and the end)."""
        if not any(s in t for s in self.special for t in texts):
            return self._encode_plain(texts)
        pieces = [self._special_re.split(t) for t in texts]  # every second piece is a special token
        ids, at = self._encode_plain([p for parts in pieces for p in parts[::2]])
        out, edges, k = [], [0], 0
        for parts in pieces:
            n = 0
            for i, part in enumerate(parts):
                got = np.array([self.special[part]], np.int32) if i % 2 else ids[at[k] : at[k + 1]]
                k += 1 - i % 2
                out.append(got)
                n += len(got)
            edges.append(edges[-1] + n)
        return np.concatenate(out), np.array(edges)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, edges = self.encode(texts)
        raw, at = ids.astype("<i4").tobytes(), (4 * edges).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """The texts of runs of ids."""
        size = self._token_len[ids]
        ends = np.cumsum(size)
        if not len(ids) or not ends[-1]:
            return [""] * (len(edges) - 1)
        data = self._flat[np.repeat(self._token_at[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()
        at = np.concatenate([[0], ends])[edges].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


_LOADED: dict[str, FragmentBpe] = {}


def loaded(path: str) -> FragmentBpe:
    """One encoder per Python worker and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = FragmentBpe(path)
    return _LOADED[path]


def text_groups(texts: list[str], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts a batch of texts into runs of about ``most`` characters (a longer text stands alone)."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def encode_decode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The documents, with ``ids`` array<int> and ``decoded`` string added (or replaced)."""
    send_package(docs.sparkSession)
    path = path or tokenizer_path()
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in small_batches(batches):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for a, b in text_groups(texts):
                ids, edges = bpe.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids, pa.int32()))
                back = pa.array(bpe.decode(ids, edges), pa.string())
                part = batch.slice(a, b - a)
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, lists, back], [*[f.name for f in kept], "ids", "decoded"])

    return docs.mapInArrow(run, f"{schema}, ids array<int>, decoded string")


def digest(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.concat_ws(",", F.col("ids").cast("array<string>")), "utf-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )

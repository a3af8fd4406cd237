"""Byte-level BPE through a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the encoding of its bytes exactly if every two
neighbours are: no merge crosses their border before both are complete.  So a
nondeterministic transducer over bytes can guess tokens along the vocabulary's
trie and accept a token only next to one that it may follow.  Every prefix of
a piece has exactly one encoding, hence at each byte one guess completes a
token and the others stay inside longer ones.

* A state of the determinised machine is the set of live guesses, each a trie
  node and the tokens that are not emitted yet.  Tokens that all live guesses
  share are emitted on the transition.  A guess lives while its bytes are
  inside the trie, so the lookahead is bounded by the longest token.
* States and transitions are made when a text first needs them and kept in a
  bounded table per Python worker (``MOST_TRANSITIONS``; beyond it the table starts
  anew, which changes no result).  Whether two tokens may stand side by side is decided on
  the right edge of the first one's merges and the left edge of the second one's,
  walked in the order of their ranks.
* All pieces of a batch of texts walk in lockstep, one byte a step, so that the
  work per byte is array lookups.

Decoding streams: ids become bytes in blocks, and an incremental UTF-8 state
machine turns them into text, holding back a character that a block leaves
unfinished.

Work is per row: no shuffle.  Memory follows the batch and the longest single text.  Defined
cases: null and empty texts have no ids and decode to ''; strings of special tokens are
ordinary text; repeated rows are encoded each; an empty table gives an empty
result.  Only the text column is read; other columns pass through unchanged
(``ids`` and ``decoded`` are replaced).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runledger.llm.pretoken import byte_places, piece_starts
from runledger.llm.workers import send_package

RANKS = "byte_bpe_50k.tiktoken"
BATCH_CHARS = 600_000
BATCH_ROWS = 500
DECODE_IDS = 1 << 16
MOST_TRANSITIONS = 800_000
_NEVER = 1 << 40
_START = (-1, ((0, ()),))


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """What the rank file says about tokens: their trie and which two may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        self.child: dict[int, int] = {}
        self.ends, self.inner = [-1], [False]
        for raw, rank in ranks.items():
            self.token[rank] = raw
            node = 0
            for byte in raw:
                down = self.child.get(node << 8 | byte)
                if down is None:
                    down = self.child[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = down
            self.ends[node] = rank
        self._halves: dict[int, tuple[int, int]] = {}
        self._edges: dict[tuple[int, int], tuple[list[bytes], list[int]]] = {}
        self._follows: dict[int, bool] = {}

    def merge(self, raw: bytes, down_to: int = 1) -> list[bytes]:
        """The plain merge loop, stopped at ``down_to`` parts; used on single tokens only."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > down_to:
            rank, at = min(((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of a token joins."""
        got = self._halves.get(token)
        if got is None:
            a, b = self.merge(self.token[token], 2)
            got = self._halves[token] = (self.ranks[a], self.ranks[b])
        return got

    def edge(self, token: int, side: int) -> tuple[list[bytes], list[int]]:
        """Tokens that stand at one edge (0 left, 1 right) while a token grows, and the rank that ends each."""
        got = self._edges.get((token, side))
        if got is None:
            grown = [token]
            while len(self.token[grown[-1]]) > 1:
                grown.append(self.halves(grown[-1])[side])
            grown.reverse()
            got = self._edges[token, side] = ([self.token[t] for t in grown], [*grown[1:], _NEVER])
        return got

    def follows(self, first: int, second: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens."""
        key = first << 24 | second
        got = self._follows.get(key)
        if got is None:
            if len(self._follows) > MOST_TRANSITIONS:
                self._follows.clear()
            got = self._follows[key] = self._untouched(first, second)
        return got

    def _untouched(self, first: int, second: int) -> bool:
        lefts, left_end = self.edge(first, 1)
        rights, right_end = self.edge(second, 0)
        i = j = 0
        while True:
            across = self.ranks.get(lefts[i] + rights[j], _NEVER)
            if across < left_end[i] and across <= right_end[j] and across != _NEVER:
                return False  # of equal ranks the leftmost merges first
            if left_end[i] == right_end[j] == _NEVER:
                return True
            if left_end[i] <= right_end[j]:
                i += 1
            else:
                j += 1

    def improper(self) -> list[int]:
        """Tokens that their own bytes do not merge to."""
        return [r for raw, r in self.ranks.items() if len(raw) > 1 and self.merge(raw) != [raw]]


class TransitionTable:
    """(state, byte) -> number of a transition; open addressing, many lookups at a time."""

    BITS = 21

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.bits, self.used = self.BITS, 0
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.zeros(1 << self.bits, np.int32)

    def _grow(self) -> None:
        full = self.key >= 0
        keys, values = self.key[full].tolist(), self.value[full].tolist()
        self.bits, self.used = self.bits + 1, 0
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.zeros(1 << self.bits, np.int32)
        self.add(keys, values)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the transitions, -1 where there is none yet."""
        at = self._slot(keys)
        seen = self.key[at]
        out = np.where(seen == keys, self.value[at], np.int32(-1))
        rest = np.flatnonzero((seen != keys) & (seen >= 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) & ((1 << self.bits) - 1)
            seen = self.key[at]
            same = seen == keys[rest]
            out[rest[same]] = self.value[at[same]]
            open_ = ~same & (seen >= 0)
            rest, at = rest[open_], at[open_]
        return out

    def add(self, keys: list[int], numbers: Sequence[int]) -> None:
        """Distinct new keys and their numbers; the table stays at most two thirds full."""
        while 3 * (self.used + len(keys)) > 2 << self.bits:
            self._grow()
        self.used += len(keys)
        mask = (1 << self.bits) - 1
        for k, at, number in zip(keys, self._slot(np.array(keys, np.int64)).tolist(), numbers, strict=True):
            while self.key[at] >= 0:
                at = (at + 1) & mask
            self.key[at], self.value[at] = k, number


class _Grown:
    """A numpy array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1024, dtype), 0

    def extend(self, values: list[int]) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(need, 2 * len(self.data)) - len(self.data), self.data.dtype)])
        self.data[self.n : need] = values
        self.n = need


class Transducer:
    """Encodes texts; holds no reference to Spark."""

    def __init__(self, path: str, most_transitions: int = MOST_TRANSITIONS):
        self.merges = Merges(load_ranks(path))
        self.most = most_transitions
        token = self.merges.token
        self._size = np.array([len(t) for t in token], np.int64)
        self._at = np.cumsum(self._size) - self._size
        self._flat = np.frombuffer(b"".join(token), np.uint8)
        self.whole = set(self.merges.improper())  # the library gives these only for a whole piece
        self.table = TransitionTable()
        self._forget()

    def _forget(self) -> None:
        self.table.clear()
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.ids = _Grown(np.int32)
        self.target, self.out_at, self.out_n = _Grown(np.int32), _Grown(np.int32), _Grown(np.int32)
        self.final_at, self.final_n = _Grown(np.int32), _Grown(np.int32)
        self._state(_START)

    def _state(self, state: tuple) -> int:
        k = self.number.get(state)
        if k is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
            rest = self._rest(state)
            self.final_at.extend([self.ids.n])
            self.final_n.extend([len(rest)])
            self.ids.extend(rest)
        return k

    def _rest(self, state: tuple) -> list[int]:
        """Tokens still to emit if the piece ends here."""
        base, guesses = state
        if self.whole and base < 0:
            for node, waiting in guesses:
                if not waiting and self.merges.ends[node] in self.whole:
                    return [self.merges.ends[node]]
        return list(guesses[-1][1])  # the guess that has just completed a token

    def step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """One transition of the determinised machine: the next state, and what it emits."""
        m = self.merges
        base, guesses = state
        live, done = [], None
        for node, waiting in guesses:
            down = m.child.get(node << 8 | byte)
            if down is None:
                continue
            token = m.ends[down]
            if m.inner[down] or token in self.whole:
                live.append((down, waiting))
            if done is None and token >= 0 and token not in self.whole:
                last = waiting[-1] if waiting else base
                if last < 0 or m.follows(last, token):
                    done = (*waiting, token)
        live.append((0, done))
        shared, shortest = live[0][1], min(len(w) for _, w in live)
        n = 0
        while n < shortest and all(w[n] == shared[n] for _, w in live):
            n += 1
        emitted = shared[:n]
        if n:
            base = emitted[-1]
            live = [(node, w[n:]) for node, w in live]
        if base >= 0 and all(w for _, w in live):
            base = -2  # no guess looks back beyond its own tokens
        return (base, tuple(live)), emitted

    def _learn(self, keys: np.ndarray) -> np.ndarray:
        """Makes the transitions of distinct keys; their numbers."""
        first = self.target.n
        todo = keys.tolist()
        made = [self.step(self.states[k >> 8], k & 0xFF) for k in todo]
        targets = [self._state(state) for state, _ in made]
        for _, emitted in made:
            self.out_at.extend([self.ids.n])
            self.out_n.extend([len(emitted)])
            self.ids.extend(emitted)
        self.target.extend(targets)
        self.table.add(todo, range(first, self.target.n))
        return np.arange(first, self.target.n, dtype=np.int32)

    def _transitions(self, keys: np.ndarray) -> np.ndarray:
        out = self.table.find(keys)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new, which = np.unique(keys[missing], return_inverse=True)
            out[missing] = self._learn(new)[which]
        return out

    def walk(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces raw[start:start + size], in the order given, and how many each has."""
        if self.target.n > self.most:
            self._forget()
        order = np.argsort(-size, kind="stable")
        begin, n_bytes = start[order], size[order]
        state = np.zeros(len(order), np.int64)
        count = np.zeros(len(order), np.int64)
        longer = len(order) - np.searchsorted(n_bytes[::-1], np.arange(n_bytes[0] + 1), side="right")
        events: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(int(n_bytes[0])):
            m = int(longer[k])  # the first m pieces have more than k bytes
            t = self._transitions(state[:m] << 8 | raw[begin[:m] + k])
            state[:m] = self.target.data[t]
            n = self.out_n.data[t]
            some = np.flatnonzero(n)
            if len(some):
                events.append((some, self.out_at.data[t[some]], n[some], count[some]))
                count[some] += n[some]
        n = self.final_n.data[state]
        events.append((np.arange(len(order)), self.final_at.data[state], n, count.copy()))
        count += n
        total = np.zeros(len(order), np.int64)
        total[order] = count
        first = (np.cumsum(total) - total)[order]
        ids = np.empty(int(total.sum()), np.int32)
        for piece, at, n, before in events:
            place = first[piece] + before
            for j in range(int(n.max(initial=0))):
                has = n > j
                ids[place[has] + j] = self.ids.data[at[has] + j]
        return ids, total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and where each text's begin among them (and the end)."""
        n_chars = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.concatenate([[0], np.cumsum(n_chars)])
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(joined.encode(), np.uint8)
        at = byte_places(cp)
        piece = piece_starts(cp, edges[:-1][n_chars > 0])
        start = at[piece]
        ids, count = self.walk(raw, start, np.diff(np.append(start, len(raw))))
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, ends[np.searchsorted(piece, edges)]

    def token_bytes(self, ids: np.ndarray) -> bytes:
        size = self._size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        return self._flat[np.repeat(self._at[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()

    def decode_stream(self, ids: np.ndarray, block: int = DECODE_IDS) -> Iterator[str]:
        """The text of a run of ids, a block at a time."""
        machine = Utf8Stream()
        for a in range(0, len(ids), block):
            yield machine.feed(self.token_bytes(ids[a : a + block]))
        yield machine.end()

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        return ["".join(self.decode_stream(ids[a:b])) for a, b in zip(edges.tolist(), edges.tolist()[1:], strict=False)]


def _utf8_table() -> np.ndarray:
    """Next state by state and byte.  0: between characters; 1 to 3: so many bytes to come;
    4 to 7: after E0, ED, F0 and F4, whose second bytes are restricted; 8: ill-formed."""
    table = np.full((9, 256), 8, np.uint8)
    table[0, :0x80] = 0
    table[0, 0xC2:0xE0] = 1
    table[0, 0xE1:0xF0] = 2
    table[0, 0xF1:0xF4] = 3
    table[0, [0xE0, 0xED, 0xF0, 0xF4]] = [4, 5, 6, 7]
    for state in (1, 2, 3):
        table[state, 0x80:0xC0] = state - 1
    table[4, 0xA0:0xC0] = 1
    table[5, 0x80:0xA0] = 1
    table[6, 0x90:0xC0] = 2
    table[7, 0x80:0x90] = 2
    return table


_UTF8 = _utf8_table()
_BAD = 8


class Utf8Stream:
    """Bytes in any cuts -> text; each ill-formed part (the longest start of a character) gives U+FFFD."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        if not self.held and data.isascii():
            return data.decode("ascii")
        data = self.held + data
        raw = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        state = _UTF8[0, raw[lead]]
        at, where = lead + 1, np.arange(len(lead))
        open_ = where[(state > 0) & (state < _BAD) & (at < len(raw))]
        while len(open_):  # all characters in lockstep, at most three further bytes
            state[open_] = _UTF8[state[open_], raw[at[open_]]]
            at[open_] += 1
            open_ = open_[(state[open_] > 0) & (state[open_] < _BAD) & (at[open_] < len(raw))]
        held = len(raw)
        if len(lead) and 0 < state[-1] < _BAD:
            held = int(lead[-1])  # only the last character can be unfinished
        good = len(lead) > 0 and lead[0] == 0 and not (state[:-1] != 0).any() and state[-1] != _BAD
        if good and (at == np.append(lead[1:], len(raw))).all():
            self.held = data[held:]
            return data[:held].decode()
        return self._mended(data)

    def _mended(self, data: bytes) -> str:
        out, good, state, i = [], 0, 0, 0  # data[good:i] is the character that is being read
        while i < len(data):
            then = int(_UTF8[state, data[i]])
            if then == _BAD:
                out.append("�")
                i += state == 0  # the byte that breaks a character off may begin another
                good, state = i, 0
                continue
            i, state = i + 1, then
            if state == 0:
                out.append(data[good:i].decode())
                good = i
        self.held = data[good:]
        return "".join(out)

    def end(self) -> str:
        out, self.held = "�" if self.held else "", b""
        return out


_LOADED: dict[str, Transducer] = {}


def loaded(path: str) -> Transducer:
    """One transducer per Python worker and rank file."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``BATCH_CHARS`` characters (a longer text stands alone)."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and (size + len(t) > BATCH_CHARS or i - first >= BATCH_ROWS):
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def _coded(batches: Iterator[pa.RecordBatch], text: str, path: str):
    """Parts of the batches with their ids, the ids' edges and the decoded texts."""
    machine = loaded(path)
    for batch in batches:
        for top in range(0, batch.num_rows, 4 * BATCH_ROWS):
            some = batch.slice(top, 4 * BATCH_ROWS)
            texts = [t or "" for t in some.column(some.schema.get_field_index(text)).to_pylist()]
            for a, b in _groups(texts):
                ids, edges = machine.encode(texts[a:b])
                yield some.slice(a, b - a), ids, edges, machine.decode(ids, edges)


def encode_decode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The documents, with ``ids`` array<int> and ``decoded`` string added (or replaced)."""
    send_package(docs.sparkSession)
    path = path or ranks_path()
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, edges, back in _coded(batches, text, path):
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids, pa.int32()))
            columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(back, pa.string())], [*[f.name for f in kept], "ids", "decoded"])

    return docs.mapInArrow(run, f"{schema}, ids array<int>, decoded string")


def digest(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Per document the number of ids and hashes of what ``encode_decode`` gives, hashed where it is made."""
    send_package(docs.sparkSession)
    path = path or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, edges, back in _coded(batches, text, path):
            raw, at = ids.astype("<u4").tobytes(), (4 * edges).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()),
                    pa.array(np.diff(edges), pa.int64()),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", text).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

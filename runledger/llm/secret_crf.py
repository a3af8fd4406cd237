"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens (runs without white space) are tagged B (a secret begins), I (inside)
or O (outside).  Scores come from the token's shape and make-up, the same of
two neighbours on either side and their words, and features of the file; label
pairs have transition scores; Viterbi finds the best tagging.  The model is
trained here, by gradient steps on the exact log-likelihood (forward-backward),
on a bounded sample: at most ``SAMPLE_DOCS`` documents with a pattern hit and as
many without, each of at most ``SAMPLE_CHARS`` characters, in the order of their
ids' hashes.  The weights (a few hundred kB) go to the tasks in the closure.

The patterns alone would only teach the patterns.  So the labels are the hits'
values, not their keywords, and every sampled text also gives stretches of its
own words with a value put in: hits re-cased or with another prefix, random
keys of other alphabets, with a cue before them or none (tagged B), and cues
with plain words, numbers, dates, addresses, links and names (tagged O).  No
value stands twice, so values are known by shape only.

Decoding is exact and linear: where O beats both other labels by more than any
change of transitions could repay, every best path passes through O, so the
chain falls into independent runs there, and only those runs (a small part of
the tokens) are decoded step by step.  Features and scores of all tokens are
computed as arrays over batches of whole texts.

Work is per row: no shuffle.  Defined cases: null and empty texts have no
spans; a sample without hits trains a model that tags everything O; a token
of any length is one token; repeated rows are scanned each, with equal spans; decoded spans that touch a pattern span are not
added.  Only ``doc_id`` and ``text`` are read; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.chars import DIGIT, LOW, LOW_HEX, N_CLASSES, OTHER, SPACE, SYMBOL, UPPER, Words
from runledger.llm.forced_bpe import small_batches, text_groups
from runledger.llm.text import bounded_sample
from runledger.llm.workers import send_package

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
#: the same three as one Java pattern, to find documents with a hit on the JVM side
ANY_HIT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
HINTS = ("passw", "secret", "token", "api")
SAMPLE_DOCS = 250
SAMPLE_CHARS = 20_000
VOCABULARY = 5000
SPAN = 12
#: tokens on either side whose features count
REACH = 2
#: texts made of each sampled text: with a value put in, with a plain token put in
PLANTS, DECOYS = 3, 3
CUES = ("password", "passwd", "pwd", "passphrase", "secret", "token", "key", "api key", "access key", "credential", "credentials", "auth", "login")
LINKS = (" is", ":", " =", "=", " ->", " was", " set to", " =>", "")
#: marks that are no part of a decoded span at its ends
AROUND = "\"'`.,;:()[]{}<>"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
O, B, I = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping per kind, sorted."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if LONG_HEX.search(text):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


ROLES = 2 * REACH + 1
#: a role's distance: the token itself, then the tokens before it, then those behind it
SHIFTS = (0, *range(-1, -REACH - 1, -1), *range(1, REACH + 1))


class Coder:
    """Token and file features as numbers of weight rows.

    ``vocabulary``: sorted hashes of the words that have a feature of their own.
    """

    SIZES = (12, 25, 50, 25, 6, N_CLASSES, N_CLASSES, 8, 5, 96)
    FILE = 3 * 6

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.base = np.cumsum([0, *self.SIZES])
        self.width = int(self.base[-1]) + len(vocabulary) + 1  # rows of one role
        self.rows = ROLES * self.width + self.FILE

    def tokens(self, w: Words) -> np.ndarray:
        """One column per feature: length, digits, hexadecimal digits, capitals, changes between
        letters and digits, first and last character, separators and quotes, symbols, kinds of
        characters by length, the word."""
        size, cls = w.size, w.cls
        eighth = np.minimum(size // 8, 4)
        is_digit, solid = cls == DIGIT, cls < OTHER
        digit = w.count(is_digit)
        hexes = w.count(cls == LOW_HEX) + digit
        upper = w.count(cls == UPPER)
        swap = np.zeros(len(cls), bool)
        swap[1:] = (is_digit[1:] != is_digit[:-1]) & solid[1:] & solid[:-1]
        swap[w.start] = False
        marks = [w.count(np.isin(cls, [SYMBOL[c] for c in some])) > 0 for some in ("=", ":", "\"'")]
        known = np.searchsorted(self.vocabulary, h := w.hashes())
        hit = known < len(self.vocabulary)
        hit[hit] = self.vocabulary[known[hit]] == h[hit]
        columns = [
            np.minimum(size, 47) // 4,
            4 * digit // size * 5 + eighth,
            (4 * hexes // size * 2 + (digit > 0)) * 5 + eighth,
            4 * upper // size * 5 + eighth,
            np.minimum(w.count(swap) // 3, 5),
            cls[w.start],
            cls[w.end - 1],
            marks[0] + 2 * marks[1] + 4 * marks[2],
            4 * w.count(cls > SPACE) // size,
            ((w.count(cls <= LOW) > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (w.count(cls > SPACE) > 0)) * 6 + np.minimum(size // 6, 5),
            np.where(hit, known + 1, 0),
        ]
        return np.stack([c + b for c, b in zip(columns, self.base, strict=True)], 1)

    def file(self, text: str, n_tokens: int) -> list[int]:
        """What is looked at in a whole text: assignments, line ends, quotes per token."""
        n, at = max(1, n_tokens), ROLES * self.width
        counts = (50 * text.count("=") // n, 20 * text.count("\n") // n, 50 * text.count('"') // n)
        return [at + 6 * k + min(5, c) for k, c in enumerate(counts)]


class Crf:
    """Weights (features x labels), transitions and the features' coder; decoding."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, vocabulary: np.ndarray):
        self.coder, self.transitions = Coder(vocabulary), transitions
        self.weights = weights.astype(np.float32)
        n, t = self.coder.width, transitions
        # one row per token feature: what it gives to its own label and to those of the tokens in reach
        self.table = np.concatenate([self.weights[k * n : (k + 1) * n] for k in range(ROLES)], axis=1)
        # What a label other than O can win through its two transitions, at most.
        self.gain = np.array(
            [max(t[a, y] + t[y, c] - t[a, O] - t[O, c] for a in range(3) for c in range(3)) for y in (B, I)]
        )

    def emissions(self, texts: list[str], w: Words) -> np.ndarray:
        codes = self.coder.tokens(w)
        got = np.zeros((len(codes), 3 * ROLES), np.float32)
        for column in codes.T:
            got += self.table[column]
        e = got[:, :3].copy()
        for role, shift in enumerate(SHIFTS[1:], 1):
            part, k = got[:, 3 * role : 3 * role + 3], abs(shift)
            inner = (w.doc[k:] == w.doc[:-k])[:, None]
            if shift < 0:
                e[k:] += part[:-k] * inner
            else:
                e[:-k] += part[k:] * inner
        counts = np.bincount(w.doc, minlength=len(texts))
        whole = [self.weights[self.coder.file(t, n)].sum(0) for t, n in zip(texts, counts.tolist(), strict=True)]
        return e + np.array(whole, np.float32).reshape(-1, 3)[w.doc]

    def tag(self, texts: list[str], w: Words) -> list[tuple[int, int]]:
        """Decoded spans of all texts as [first, last] token numbers."""
        if not len(w.start):
            return []
        return self.decode(self.emissions(texts, w), w.doc)

    def decode(self, e: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        open_ = np.flatnonzero((e[:, B] - e[:, O] + self.gain[0] >= 0) | (e[:, I] - e[:, O] + self.gain[1] >= 0))
        spans: list[tuple[int, int]] = []
        if not len(open_):
            return spans
        for run in np.split(open_, np.flatnonzero((np.diff(open_) > 1) | (np.diff(doc[open_]) > 0)) + 1):
            a, b = int(run[0]), int(run[-1])
            labels = self._viterbi(e[a : b + 1], a > 0 and doc[a - 1] == doc[a], b + 1 < len(doc) and doc[b + 1] == doc[b])
            for k, y in enumerate(labels):
                if y == B or y == I and (k == 0 or labels[k - 1] == O):
                    spans.append((a + k, a + k))
                elif y == I:
                    spans[-1] = (spans[-1][0], a + k)
        return spans

    def _viterbi(self, e: np.ndarray, before: bool, after: bool) -> list[int]:
        """Best labels of a run whose neighbours, where there are any, are O."""
        t, best = self.transitions, e[0] + (self.transitions[O] if before else 0)
        back = []
        for row in e[1:]:
            step = best[:, None] + t
            back.append(step.argmax(0))
            best = step.max(0) + row
        y = int((best + (t[:, O] if after else 0)).argmax())
        labels = [y]
        for b in reversed(back):
            y = int(b[y])
            labels.append(y)
        return labels[::-1]


def _values(text: str) -> list[tuple[int, int]]:
    """Where the pattern hits' values stand."""
    spans = [(s, e) for s, e, kind in base_spans(text) if kind != "assign"]
    spans += [m.span(1) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    return sorted(spans)


def _labels(w: Words, spans: list[tuple[int, int]]) -> np.ndarray:
    labels = np.zeros(len(w.start), np.int64)
    for s, e in spans:
        inside = np.flatnonzero((w.start < e) & (w.end > s))
        for k in inside:
            if labels[k] == O:
                labels[k] = I if k != inside[0] else B
    return labels


def _random_text(rng, alphabet: str, n: int) -> str:
    return "".join(rng.choice(list(alphabet), n))


def _value(rng, hits: list[str]) -> tuple[str, bool]:
    """A value, and whether it is one without a cue."""
    kind = int(rng.integers(0 if hits else 1, 4))
    if kind == 3:  # chosen by a person
        word = _random_text(rng, LETTERS, int(rng.integers(4, 9)))
        word = word.capitalize() if rng.random() < 0.5 else word
        return word + str(rng.integers(1, 10_000)) + str(rng.choice(["", "!", "#", "$"])), False
    if kind == 0:
        value = "".join(rng.permutation(list(hits[int(rng.integers(len(hits)))])))
        value = (value, value.upper(), value.swapcase())[int(rng.integers(3))]
    else:
        digits, mixed = "0123456789", LETTERS + LETTERS.upper() + "0123456789"
        alphabets = (digits + "ABCDEF", digits + "abcdef-") if kind == 1 else (mixed, mixed + "+/", mixed + "_-", LETTERS + digits)
        value = _random_text(rng, alphabets[int(rng.integers(len(alphabets)))], int(rng.integers(18, 56)))
    if rng.random() < 0.5:
        mark = str(rng.choice(["_", "-"]))
        parts = [_random_text(rng, LETTERS, int(rng.integers(2, 6))) for _ in range(int(rng.integers(1, 3)))]
        value = mark.join([*parts, value])
    return value, len(value) >= 16


def _decoy(rng, words: list[str]) -> str:
    """A token that is no secret."""
    some = lambda: str(rng.choice(words))
    return (
        lambda: some(),
        lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}",
        lambda: f"{rng.integers(0, 10**9)}",
        lambda: f"{rng.integers(1, 999)},{rng.integers(100, 999)},{rng.integers(100, 999)}.{rng.integers(10, 99)}",
        lambda: f"https://www.{some()}.com/{some()}/{some()}-{rng.integers(1, 999)}.html",
        lambda: f"{some()}.{some()}{rng.integers(1, 99)}@{some()}.org",
        lambda: f"v{rng.integers(0, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 99)}",
        lambda: some() + some().capitalize() + some().capitalize(),
        lambda: "-".join(some() for _ in range(int(rng.integers(2, 6)))),
        lambda: "".join(some() for _ in range(int(rng.integers(2, 6)))),
        lambda: "_".join(some().upper() for _ in range(int(rng.integers(2, 5)))),
        lambda: "/" + "/".join(some() for _ in range(int(rng.integers(2, 5)))),
        lambda: some().capitalize() + "(" + some() + ")",
    )[int(rng.integers(13))]()


def _made(texts: list[str]) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with values or plain tokens put in, and where the values stand."""
    rng = np.random.default_rng(0)
    hits = [t[s:e] for t in texts for s, e in _values(t)]
    out = []
    for text in texts:
        words = text.split()
        if not words:
            continue
        plain = [c for c in ("".join(filter(str.isalpha, x)) for x in words[:200]) if c] or ["word"]
        for k in range(PLANTS + DECOYS):
            at = int(rng.integers(len(words)))
            left, right = " ".join(words[max(0, at - SPAN) : at]), " ".join(words[at : at + SPAN])
            value, alone = _value(rng, hits) if k < PLANTS else (_decoy(rng, plain), True)
            cued = rng.random() < 0.5 or not alone
            cue = str(rng.choice(CUES)) + str(rng.choice(LINKS)) if cued else ""
            cue = (cue, cue.capitalize(), cue.upper())[int(rng.integers(3))] if cue else ""
            mark = str(rng.choice(["", "", '"', "'"]))
            lead = " ".join(x for x in (left, cue) if x)
            lead += "" if cue.endswith("=") and " " not in cue or not lead else " "
            begin = len(lead) + len(mark)
            spans = [(begin, begin + len(value))] if k < PLANTS else []
            # hits of the words around it stay labelled as they are
            made = f"{lead}{mark}{value}{mark}{rng.choice(['', '', '.', ','])} {right}"
            out.append((made, sorted(set(spans) | {(s, e) for s, e in _values(made) if k < PLANTS or not s <= begin < e})))
    return out


def _examples(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(weight rows, labels) of windows, and the vocabulary: the words that stand in two windows or more."""
    read = []
    for text, spans in [*[(t, _values(t)) for t in texts], *_made(texts)]:
        w = Words([text])
        if not len(w.start):
            continue
        labels = _labels(w, spans)
        # the first hits, the middle, and the longest token (a hard case where it is plain)
        mids = {len(labels) // 2, int(w.size.argmax()), *np.flatnonzero(labels == B)[:2].tolist()}
        windows = _stretches(mids, len(labels)) if len(labels) > 3 * SPAN else [(0, len(labels))]
        read.append((text, w, labels, windows))
    seen = [np.unique(np.concatenate([w.hashes()[a:b] for a, b in windows])) for _, w, _, windows in read]
    words, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0))
    often = np.argsort(-counts, kind="stable")[:VOCABULARY]
    coder = Coder(np.sort(words[often[counts[often] > 1]]))
    out = []
    for text, w, labels, windows in read:
        codes = coder.tokens(w)
        rows = [np.tile(coder.file(text, len(labels)), (len(labels), 1))]
        for role, shift in enumerate(SHIFTS):
            moved = np.full_like(codes, coder.rows)
            k = min(abs(shift), len(codes))
            own = codes + role * coder.width
            moved[max(0, -shift) : len(codes) - max(0, shift)] = own[max(0, shift) : len(codes) - max(0, -shift)] if k < len(codes) else own[:0]
            rows.append(moved)
        rows = np.concatenate(rows, axis=1).astype(np.int32)
        out += [(rows[a:b], labels[a:b]) for a, b in windows]
    return out, coder.vocabulary


def _stretches(mids: set[int], n: int) -> list[tuple[int, int]]:
    """Windows around the given tokens, each token in at most one."""
    out: list[tuple[int, int]] = []
    for m in sorted(mids):
        a, b = max(0, m - SPAN, out[-1][1] if out else 0), min(n, m + SPAN + 1)
        if a < b:
            out.append((a, b))
    return out


def fit(texts: list[str], steps: int = 200, rate: float = 0.1, decay: float = 1e-3, batch: int = 400):
    """Weights, transitions and vocabulary from texts: pattern hits and values put in are the labels.
    Each step takes ``batch`` windows in turn, from a fixed shuffle."""
    examples, vocabulary = _examples(texts)
    dims = Coder(vocabulary).rows
    weights, trans = np.zeros((dims + 1, 3)), np.zeros((3, 3))
    if not any((y > 0).any() for _, y in examples):
        trans[:, O] = 4.0
        return weights[:dims], trans, vocabulary
    total, length, k = len(examples), max(len(y) for _, y in examples), examples[0][0].shape[1]
    all_slots = np.full((total, length, k), dims, np.int32)
    all_gold, all_real = np.zeros((total, length), int), np.zeros((total, length), bool)
    for j, (x, y) in enumerate(examples):
        all_slots[j, : len(y)], all_gold[j, : len(y)], all_real[j, : len(y)] = x, y, True
    order = np.random.default_rng(1).permutation(total)
    n = min(batch, total)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)]
    for step in range(1, steps + 1):
        mine = order[np.arange((step - 1) * n, step * n) % total]
        slots, real = all_slots[mine], all_real[mine]
        hot = np.eye(3)[all_gold[mine]] * real[..., None]
        pairs = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
        e = np.zeros((n, length, 3))
        for j in range(k):
            e += weights[slots[:, :, j]]
        e[~real] = 0
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, length):
            nxt = np.logaddexp.reduce(alpha[:, t - 1, :, None] + trans, axis=1) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], nxt, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            prv = np.logaddexp.reduce(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(real[:, t + 1, None], prv, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        both = np.exp(
            alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        ) * real[:, 1:, None, None]
        grad = np.zeros_like(weights)
        diff = (hot - p) / n
        for j in range(k):
            some = slots[:, :, j].ravel()
            for y in range(3):
                grad[:, y] += np.bincount(some, diff[..., y].ravel(), dims + 1)
        grad -= decay * weights / total
        grad[dims] = 0
        grad_t = (pairs - both.sum((0, 1))) / n - decay * trans / total
        speed = rate * min(1.0, 2 * (1 - (step - 1) / steps))  # falls in the second half
        for x, g, m, v in ((weights, grad, *moments[:2]), (trans, grad_t, *moments[2:])):
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            x += speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights[:dims], trans, vocabulary


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS):
    """The model from a bounded sample of the documents."""
    short = docs.select("doc_id", "text").filter(F.length("text") <= sample_chars)
    hits = bounded_sample(short.filter(F.col("text").rlike(ANY_HIT)), ["doc_id", "text"], sample_docs)
    plain = bounded_sample(short, ["doc_id", "text"], sample_docs)
    return fit([t for some in (hits, plain) for t in sorted(r["text"] for r in some.collect())])


def spans_of(texts: list[str], model: Crf) -> list[list[tuple[int, int, str]]]:
    """All spans of each text: the patterns', then decoded ones, without marks around them, that touch none of them."""
    w = Words(texts)
    out = [base_spans(t) for t in texts]
    for a, b in model.tag(texts, w):
        doc = int(w.doc[a])
        s, e = int(w.start[a] - w.edges[doc]), int(w.end[b] - w.edges[doc])
        token = texts[doc][s:e]
        if core := token.strip(AROUND):
            s += len(token) - len(token.lstrip(AROUND))
            e = s + len(core)
        if not any(s < y and x < e for x, y, k in out[doc] if k != "crf"):
            out[doc].append((s, e, "crf"))
    return [sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))) for spans in out]


def scan(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """The documents with ``secrets`` (array of start, end, kind) and ``redacted`` (text with
    each stretch of overlapping spans replaced by [SECRET]) added."""
    send_package(docs.sparkSession)
    weights, trans, vocabulary = model or train(docs)
    kept = [f for f in docs.schema.fields if f.name not in ("secrets", "redacted")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(weights, trans, vocabulary)
        for batch in small_batches(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            filled = [t or "" for t in texts]
            for a, b in text_groups(filled):
                spans = spans_of(filled[a:b], crf)
                clean = [redact(t, found) if found else t for t, found in zip(texts[a:b], spans, strict=True)]
                lists = [[{"start": s, "end": e, "kind": k} for s, e, k in found] for found in spans]
                part = batch.slice(a, b - a)
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(lists, pa.list_(kind)), pa.array(clean, pa.string())],
                    [*[f.name for f in kept], "secrets", "redacted"],
                )

    return docs.mapInArrow(run, f"{schema}, secrets array<struct<start:int,end:int,kind:string>>, redacted string")


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    merged: list[list[int]] = []
    for s, e, _ in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def digest(scanned: DataFrame) -> DataFrame:
    def joined(some):
        return F.concat_ws(",", F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))

    def count(kind):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("secrets", lambda x: x["kind"] != "crf")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.encode(joined(base), "utf-8"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        count("crf").alias("n_crf"),
    )


def redacted_documents(docs: DataFrame) -> DataFrame:
    """All documents, their columns as they were, with secrets replaced in ``text`` (and ``n_chars``)."""
    out = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.coalesce(F.length("redacted").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return scan(docs).select(*[(out[c].alias(c) if c in out else F.col(f"`{c}`")) for c in docs.columns])


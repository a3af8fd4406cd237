"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE`` words).  Every passage is
described by the make-up of its words (letters, digits, capitals, each kind of
symbol, lengths, repeated words, line ends) and encoded by a learned layer h = tanh(W x + b).  Gated attention weighs the passages,
a = softmax(w . (tanh(V h) * sigmoid(U h))), and the document's score is the
logistic of its weighted passage representation.  Only document labels are
used: encoder, attention and output are learned together by gradient steps.

Training takes a bounded sample: at most ``SAMPLE_DOCS`` labelled documents, in the
order of their ids' hashes, never one whose crc32(doc_id) is 0 modulo 5; those
of more than ``SAMPLE_CHARS`` characters are left out.  The passages of the sample are described in the
tasks; only their numbers come to the driver.  Scoring runs over whole texts,
every passage counts; it is per row, without a shuffle.

Defined cases: null and empty texts are one empty passage; repeated or
contradicting labels of a document are averaged (ties count as good); labels
without a document and null labels are left out; without labels of both
kinds every score is the share of good labels (0.5 without any); repeated
document rows are scored each.  Only ``doc_id``, ``text`` and ``quality`` are
read, and neither doc_id nor any other column enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.chars import LOW, LOW_HEX, N_CLASSES, SPACE, UPPER, Words
from runledger.llm.forced_bpe import small_batches, text_groups
from runledger.llm.text import bounded_sample
from runledger.llm.workers import send_package

PASSAGE = 48
SAMPLE_DOCS = 4000
SAMPLE_CHARS = 30_000
#: per passage: share of each character class, and of words that are long, begin with a capital,
#: are all capitals, end in a symbol, are distinct; mean length, passage length, line ends of the text
N_PASSAGE = N_CLASSES + 8
HIDDEN, GATE = 16, 8
THRESHOLD = 0.3


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of every passage of the texts, and where each text's begin (a text has one at least)."""
    w = Words(texts)
    n_words = np.bincount(w.doc, minlength=len(texts))
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    starts = np.concatenate([[0], np.cumsum(n_passages)])[:-1]
    total = int(n_passages.sum())
    x = np.zeros((total, N_PASSAGE))
    if not len(w.start):
        return x, starts
    rank = np.arange(len(w.doc)) - (np.cumsum(n_words) - n_words)[w.doc]
    owner = starts[w.doc] + rank // PASSAGE
    inside = w.cls != SPACE
    chars = np.bincount(np.repeat(owner, w.size) * N_CLASSES + w.cls[inside], minlength=total * N_CLASSES)
    size = np.bincount(owner, minlength=total)
    some = size > 0
    share = 1 / np.maximum(size, 1)
    add = lambda v: np.bincount(owner, v, total) * share
    x[:, :N_CLASSES] = chars.reshape(total, N_CLASSES)
    x[:, :N_CLASSES] /= np.maximum(1, x[:, :N_CLASSES].sum(1, keepdims=True))
    key = np.sort(owner.astype(np.uint64) << np.uint64(40) | w.hashes() >> np.uint64(24))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    lines = np.array([t.count("\n") for t in texts]) / np.maximum(1, n_words)
    x[:, N_CLASSES:] = np.column_stack(
        [
            add(np.minimum(w.size, 60)) / 8,
            add(w.size > 20),
            add(w.cls[w.start] == UPPER),
            add((w.count(w.cls == UPPER) > 1) & (w.count((w.cls == LOW) | (w.cls == LOW_HEX)) == 0)),
            add(w.cls[w.end - 1] > SPACE),
            np.bincount((key[first] >> np.uint64(40)).astype(np.int64), minlength=total) * share,
            size / PASSAGE,
            np.repeat(lines, n_passages),
        ]
    )
    x[~some] = 0
    return x, starts


class GatedAttention:
    """The network; parameters are plain arrays."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {
            "W": scale(N_PASSAGE, HIDDEN), "b": np.zeros(HIDDEN), "V": scale(HIDDEN, GATE), "U": scale(HIDDEN, GATE),
            "w": scale(GATE), "c": scale(HIDDEN), "c0": np.zeros(1),
        }
        self.mean, self.std = np.zeros(N_PASSAGE), np.ones(N_PASSAGE)
        self.constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Scores of bags; ``starts``: the first passage of each bag."""
        p = self.p
        x = (x - self.mean) / self.std
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        top = np.repeat(np.maximum.reduceat(e, starts), sizes)
        raw = np.exp(e - top)
        a = raw / np.repeat(np.add.reduceat(raw, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-(z @ p["c"] + p["c0"][0])))
        return y, (x, h, t, s, a, z, sizes)

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        return self.forward(x, starts)[0]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-4):
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        x_all = np.concatenate(bags).astype(float)
        self.mean, self.std = x_all.mean(0), x_all.std(0) + 1e-3
        sizes_all = np.array([len(b) for b in bags])
        edges = np.concatenate([[0], np.cumsum(sizes_all)])
        share = labels.mean()
        weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
        rng = np.random.default_rng(11)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        for step in range(1, steps + 1):
            some = np.sort(rng.permutation(len(bags))[:512])
            rows = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in some])
            starts = np.concatenate([[0], np.cumsum(sizes_all[some])[:-1]])
            y, (x, h, t, s, a, z, sizes) = self.forward(x_all[rows], starts)
            p = self.p
            d = (y - labels[some]) * weight[some] / len(some)
            g = {"c": z.T @ d, "c0": np.array([d.sum()])}
            dz = np.repeat(d[:, None] * p["c"], sizes, axis=0)
            da = (dz * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
            g["w"] = (t * s).T @ de
            dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
            g["V"], g["U"] = h.T @ dt, h.T @ ds
            dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            g["W"], g["b"] = x.T @ dh, dh.sum(0)
            for k, v in self.p.items():
                grad = g[k] + decay * v
                first, second = m[k]
                first[:] = 0.9 * first + 0.1 * grad
                second[:] = 0.99 * second + 0.01 * grad * grad
                v -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> GatedAttention:
    """The network, fitted to a bounded sample of the labelled documents that are not held out."""
    send_package(docs.sparkSession)
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("good"))
    )
    known = bounded_sample(known, ["doc_id"], sample_docs)
    sample = docs.select("doc_id", "text").filter(F.length("text") <= sample_chars).join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(0).to_pylist()
            for a, b in text_groups(texts):
                x, starts = passages(texts[a:b])
                rows = [r.astype("<f8").tobytes() for r in np.split(x, starts[1:])]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(rows, pa.binary())], ["at", "good", "x"])

    at = F.xxhash64("doc_id", "text").alias("at")
    rows = sample.select("text", at, "good").mapInArrow(run, "at bigint, good double, x binary").collect()
    rows.sort(key=lambda r: (r["at"], r["good"]))
    bags = [np.frombuffer(r["x"], "<f8").reshape(-1, N_PASSAGE) for r in rows]
    return GatedAttention().fit(bags, np.array([r["good"] for r in rows]))


def score(docs: DataFrame, model: GatedAttention) -> DataFrame:
    """The documents with ``score`` (0 to 1, higher is better) added (or replaced)."""
    send_package(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            for a, b in text_groups(texts):
                y = model.scores(*passages(texts[a:b]))
                part = batch.slice(a, b - a)
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(y, pa.float64())], [*[f.name for f in kept], "score"])

    return docs.mapInArrow(run, f"{schema}, score double")


def digest(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

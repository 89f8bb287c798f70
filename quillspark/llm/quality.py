"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

Each word has a fixed sparse random vector.  On a bounded sample of labelled documents a word's
vector is that plus those of the words around it.  A document is the mean of its word vectors;
a small numpy network scores it, and a temperature fitted on rows that the network did not see
calibrates the probability.  Scoring covers every document and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import hold_batches, rested, stored
from .textbuf import buffers, mix, slices, word_hashes

#: Most labelled documents that are learnt from, and most bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 4000, 64 << 20

#: Rows and columns of the table of word vectors; words are filed by a hash.
SLOTS, DIM = 1 << 16, 96

#: Non-zero entries of a word's random vector; words to either side that count as its context.
NONZERO, CONTEXT = 8, 2

HIDDEN, EPOCHS, RATE, DECAY, SEED = 32, 60, 3e-3, 1e-4, 7

#: A document is predicted good from this score on.
THRESHOLD = 0.3

#: Words are runs of one class: letters, capitals, digits, signs; 0 separates.
_CLASS = np.array(
    [0 if b in (0x20, *range(0x09, 0x0E)) else 2 if 0x41 <= b <= 0x5A else 1 if 0x61 <= b <= 0x7A or b >= 0x80 else 3 if 0x30 <= b <= 0x39 else 4 for b in range(256)], np.uint8
)


def slots_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every word of the rows, and the first word of each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    new = np.empty(n, bool)
    new[0], new[1:] = True, kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, new[1:]
    starts, ends = np.flatnonzero(new & (kind > 0)), np.flatnonzero(last & (kind > 0)) + 1
    first = np.searchsorted(starts, offsets)
    slots = (word_hashes(data, starts, ends) % np.uint64(SLOTS)).astype(np.int64)
    # A word that repeats the one before it, or the one before that, is filed as a repetition.
    plain = slots.copy()
    for back in (2, 1):
        same = np.zeros(len(slots), bool)
        same[back:] = plain[back:] == plain[:-back]
        for k in range(back):
            at = first[:-1] + k
            same[at[at < len(same)]] = False
        slots[same] = SLOTS - back
    return slots, first


def index_vectors() -> np.ndarray:
    """The sparse random vector of every slot."""
    out = np.zeros((SLOTS, DIM), np.float32)
    slot = np.arange(SLOTS, dtype=np.uint64)
    for k in range(NONZERO):
        h = mix(slot * np.uint64(NONZERO) + np.uint64(k + 1))
        out[np.arange(SLOTS), (h % np.uint64(DIM)).astype(np.int64)] += np.where(h >> np.uint64(63), 1, -1)
    return out / np.float32(np.sqrt(NONZERO))


def word_vectors(rows: list[np.ndarray]) -> np.ndarray:
    """Random-indexing vectors from the slots of each training document."""
    own = index_vectors()
    around = np.zeros_like(own)
    for words in rows:
        for step in range(1, CONTEXT + 1):
            if len(words) > step:
                a, b = words[:-step], words[step:]
                for x, y in ((a, b), (b, a)):
                    order = np.argsort(x, kind="stable")
                    heads = np.flatnonzero(np.concatenate(([True], x[order][1:] != x[order][:-1])))
                    around[x[order][heads]] += np.add.reduceat(own[y[order]], heads, axis=0)
    size = np.linalg.norm(around, axis=1, keepdims=True)
    return own + np.divide(around, size, out=np.zeros_like(around), where=size > 0)


def pooled(vectors: np.ndarray, slots: np.ndarray, first: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Mean vector of each row's words; zero for a row without words."""
    out = np.zeros((len(first) - 1, vectors.shape[1]), np.float64)
    for a in range(0, len(slots), step):
        b = min(a + step, len(slots))
        lo, hi = int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first, b, "left"))
        cuts = np.maximum(first[lo:hi], a) - a
        size = np.diff(np.concatenate((cuts, [b - a])))
        has = size > 0
        out[lo:hi][has] += np.add.reduceat(vectors[slots[a:b]], cuts[has], axis=0)
    count = np.diff(first)
    return out / np.maximum(count, 1)[:, None]


@dataclass
class Network:
    """Logit of a mean word vector; ``temperature`` divides it before the sigmoid."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, before: np.ndarray) -> np.ndarray:
        return (np.tanh(before + self.b1) * self.w2).sum(1) + self.b2

    def scores(self, before: np.ndarray) -> np.ndarray:
        """Rounded, so that a score does not depend on which rows share a batch."""
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(before) / self.temperature, -50, 50))), 9)


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Train on four fifths, then choose the temperature with the least log loss on the rest."""
    rng = np.random.default_rng(SEED)
    mean, std = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / std
    order = rng.permutation(len(x))
    held, use = order[: len(x) // 5], order[len(x) // 5 :]
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(use), max(1, len(use) // 64)):
            hid = np.tanh(z[part] @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(hid @ w[2] + w[3], -50, 50)))
            d = (p - y[part]) / max(len(part), 1)
            back = np.outer(d, w[2]) * (1 - hid**2)
            grads = [z[part].T @ back + DECAY * w[0], back.sum(0), hid.T @ d + DECAY * w[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    # The scaling of the inputs goes into the first layer.
    net = Network(w[0] / std[:, None], w[1] - (mean / std) @ w[0], w[2], float(w[3][0]))
    if len(held):
        logit = net.logits(x[held] @ net.w1)
        loss = lambda t: np.mean(np.logaddexp(0, logit / t) - y[held] * logit / t)
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def held_out(id_col: Column) -> Column:
    """Whether a row's label is kept from training."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network


def _sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int, id_col: str, text: str) -> pa.Table:
    """doc_id, y and text that are learnt from."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    told = usable.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top")).filter("y = top").select("doc_id", "y")
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # ``rows`` rows
    own, _ = stored(own.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "quality-sample")
    # Ids and sizes of at most ``rows`` rows; their texts follow only as far as they fit.
    sizes = own.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total, fits = 0, []
    for r in sizes:
        total += r.n
        if total > size and fits:
            break
        fits.append((r.doc_id,))
    kept = own.join(F.broadcast(docs.sparkSession.createDataFrame(fits, own.select("doc_id").schema)), "doc_id", "left_semi")
    return kept.toArrow().sort_by([("doc_id", "ascending")])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, id_col: str = "doc_id", text: str = "text") -> Classifier:
    """Learn from at most ``rows`` labelled documents, of at most ``size`` bytes in all, that are not held out.

    The sample is that of the smallest hashes of the id, so it does not depend on the order or
    the number of files.  A label that is neither 0 nor 1, a null id and an id with different
    labels are not used; of an id with several texts the one with the smallest hash is.  A null
    text is empty.  Without any labelled row, or with one class only, every document scores as
    good as the share of label 1.
    """
    table = _sample(docs, labels, label, rows, size, id_col, text)
    y = table.column("y").to_numpy().astype(np.float64)
    listed, firsts = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    data, offs = buffers(table.column("text"))
    for a, b in slices(offs):
        own, cut = slots_of(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        listed.append(own)
        firsts.append(cut[1:] + firsts[-1][-1])
    slots, first = np.concatenate(listed), np.concatenate(firsts)
    vectors = word_vectors([slots[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
    if len(np.unique(y)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Classifier(np.zeros((SLOTS, 1), np.float32), Network(np.zeros((1, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share)))))
    net = fit(pooled(vectors, slots, first), y)
    # The first layer is linear in the mean, so it is applied to each word's vector once.
    return Classifier((vectors @ net.w1).astype(np.float32), net)


def _scores(m: Classifier, texts: pa.Array) -> np.ndarray:
    data, offs = buffers(texts)
    out = [np.zeros(0)]
    for a, b in slices(offs):
        slots, first = slots_of(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        out.append(m.network.scores(pooled(m.vectors, slots, first)))
    return np.concatenate(out)


def _score(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model.value, batch.column("text")))], ["doc_id", "score"])

    return run


def _good(model: Broadcast, text: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model.value, batch.column(text)) >= threshold))

    return run


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Only the text is read for the score.  Null and empty texts have no words and all get the
    same score.  Repeated rows each get a row; a null id is not held out.
    """
    hold_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rested(_score(sent)), f"doc_id {kind}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are predicted good, with all their columns; each by its own text."""
    hold_batches(docs.sparkSession)
    return docs.mapInArrow(rested(_good(docs.sparkSession.sparkContext.broadcast(model), text, THRESHOLD)), docs.schema)

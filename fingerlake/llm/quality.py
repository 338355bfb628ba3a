"""Quality classifier: a convolutional network over a document's bytes, in numpy.

Bytes are embedded; filters of ``WIDTH`` bytes move over the text in steps of
``STEP``. The text is cut into chunks whose windows overlap at the seams, so each
byte of the whole document is seen; a filter's responses are max-pooled over its
chunk, then over the document, and a logistic unit combines the pooled responses
into one probability of good quality.

Cases: a null or empty text has probability 0 and is rejected; texts are pooled chunk by
chunk, so besides the bytes of ``GROUP_BYTES`` of texts, or of one longer text, memory is
that of one block; repeated rows get equal probabilities; with labels of one class only,
or none, every text that is not empty has probability 1 (nothing is known against it);
further columns are carried through whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerlake.llm.training import labelled_sample

WIDTH, STEP, DIM, FILTERS = 8, 2, 8, 24
CHUNK = 256  # windows
BLOCK = 96  # chunks that are convolved at once
GROUP_BYTES = 4_000_000  # of texts that are laid out at once, if there are several
#: Bound of the labelled sample that the model is fitted on.
TRAIN_PER_CLASS = 1500
#: Share of good texts that are seen as a short piece: a piece of a good text is
#: good too, and without this short texts would lack evidence in their favour.
CROPPED = 0.3
EPOCHS, BATCH, RATE = 14, 32, 0.01
THRESHOLD = 0.5


@dataclass
class ByteCNN:
    """Weights; ``constant`` answers for all texts where nothing could be learned."""

    emb: np.ndarray
    conv: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float
    constant: float | None = None

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Max-pooled filter responses, one row for each text."""
        buf, first = layout(texts)
        best = np.zeros((len(first), FILTERS), np.float32)
        kernels = np.ascontiguousarray(self.conv.reshape(WIDTH // STEP, STEP * DIM, FILTERS).transpose(1, 0, 2).reshape(STEP * DIM, -1))
        n_chunks = len(buf) // (CHUNK * STEP) - 1
        top = np.empty((max(n_chunks, 0), FILTERS), np.float32)
        lead = WIDTH // STEP
        for at in range(0, n_chunks, BLOCK):
            k = min(BLOCK, n_chunks - at)
            part = buf[at * CHUNK * STEP : (at + k) * CHUNK * STEP + WIDTH - STEP]
            z = self.emb[part].reshape(-1, STEP * DIM) @ kernels
            n = k * CHUNK
            y = z[:n, :FILTERS].copy()
            for g in range(1, lead):
                y += z[g : g + n, g * FILTERS : (g + 1) * FILTERS]
            top[at : at + k] = y.reshape(k, CHUNK, FILTERS).max(axis=1)
        if n_chunks:
            best = np.maximum.reduceat(top, first, axis=0)
        return np.maximum(best + self.shift, 0)

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Probability of good quality; 0 for empty texts."""
        p = np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if t]
        if at and self.constant is not None:
            p[at] = self.constant
        elif at:
            s = self.pooled([texts[i] for i in at]) @ self.out + self.bias
            p[at] = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        return p


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in whole chunks, padded with byte 0, and each text's first chunk.

    At least one window of padding precedes and follows every text, so that no
    window sees two of them; one spare chunk follows the last.
    """
    size = CHUNK * STEP
    chunks = np.array([(len(t) + 2 * WIDTH) // size + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(chunks)])
    buf = np.zeros((int(first[-1]) + 1) * size, np.uint8)
    for t, c in zip(texts, first[:-1]):
        buf[c * size + WIDTH : c * size + WIDTH + len(t)] = np.frombuffer(t, np.uint8)
    return buf, first[:-1]


def gradients(m: ByteCNN, buf: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the mean weighted log loss of laid out texts: emb, conv, shift, out, bias.

    The padding byte's embedding stays zero.
    """
    n = len(buf) // STEP - CHUNK
    z = m.emb[buf].reshape(-1, STEP * DIM)
    resp = np.zeros((n, FILTERS), m.emb.dtype)
    for g in range(WIDTH // STEP):
        resp += z[g : g + n] @ m.conv[g * STEP * DIM : (g + 1) * STEP * DIM]
    bounds = [*(first * CHUNK), n]
    top = np.array([a + resp[a:b].argmax(axis=0) for a, b in zip(bounds[:-1], bounds[1:])])
    raw = resp[top, np.arange(FILTERS)] + m.shift
    h = np.maximum(raw, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.bias, -30, 30)))
    ds = ((p - y) * weight / len(y)).astype(m.emb.dtype)
    dh = ds[:, None] * m.out * (raw > 0)
    seen = buf[top[:, :, None] * STEP + np.arange(WIDTH)]  # docs, filters, WIDTH
    e = m.emb[seen].reshape(len(y), FILTERS, WIDTH * DIM)
    dconv = np.einsum("dfk,df->kf", e, dh)
    demb = np.zeros_like(m.emb)
    np.add.at(demb, seen.ravel(), (dh[:, :, None] * m.conv.T[None]).reshape(-1, DIM))
    demb[0] = 0
    return [demb, dconv, dh.sum(axis=0), h.T @ ds, np.array([ds.sum()], m.emb.dtype)]


def fit(rows: list[tuple[str, int]], seed: int = 5, epochs: int = EPOCHS) -> ByteCNN:
    """Train on (text, quality) rows with Adam; classes weigh the same."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
    emb[0] = 0
    m = ByteCNN(emb, rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32), np.full(FILTERS, -0.5, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    texts = [t.encode() for t, _ in rows]
    y = np.array([v for _, v in rows], np.float64)
    use = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if not len(use) or y[use].min() == y[use].max():
        m.constant = 1.0
        return m
    share = y[use].mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))

    def crop(t: bytes) -> bytes:
        size = int(rng.integers(40, 400))
        at = int(rng.integers(0, max(1, len(t) - size)))
        return t[at : at + size]

    params = [m.emb, m.conv, m.shift, m.out, np.zeros(1, np.float32)]
    mom = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(use)
        rate = RATE * (1 - epoch / epochs)
        for i in range(0, len(order), BATCH):
            ids = order[i : i + BATCH]
            buf, first = layout([crop(texts[k]) if y[k] == 1 and rng.random() < CROPPED else texts[k] for k in ids])
            grads = gradients(m, buf, first, y[ids], weight[ids])
            step += 1
            for q, g, (a, b) in zip(params, grads, mom):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            m.bias = float(params[4][0])
    return m


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> ByteCNN:
    """Fit on the labelled rows of ``docs``, at most ``per_class`` of each class."""
    return fit(labelled_sample(docs, labels, "quality", per_class))


def probability_udf(model: ByteCNN) -> Callable:
    """Column function: text -> probability."""

    @F.arrow_udf(T.DoubleType())
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            texts = pc.cast(pc.fill_null(values, ""), pa.binary())
            end = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            out, i = [], 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + GROUP_BYTES, side="right")))
                out.append(model.predict(texts[i:j].to_pylist()))
                i = j
            yield pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return probability


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, quality_probability, keep)`` for every row of ``docs``."""
    p = probability_udf(train(docs, labels))
    scored = docs.select("doc_id", p(F.col("text")).alias("quality_probability"))
    return scored.withColumn("keep", F.col("quality_probability") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; same columns."""
    p = probability_udf(train(docs, labels))
    return docs.where(p(docs["text"]) >= threshold)

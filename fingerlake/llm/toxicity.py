"""Toxic sentences, learned from document labels alone.

Multiple-instance learning: a document is a bag of sentences. A sentence has the
probability ``s = sigmoid(b + c log(n) + sum of its distinct words' weights)``,
where a word's weight is that of itself and of its openings and n is the number of
sentences in its document; the document's is the noisy-or ``1 - prod(1 - s)``. All
weights are fitted so that the noisy-or agrees with the document labels; ``c``, fitted
like the others, is what keeps thousands of harmless sentences from adding up. The
sentence scores then show where the offence is.

Cases: a null or empty text, or one without a word, has no sentences and
probability 0; the whole of a long text is scored, sentence by sentence; repeated
rows score alike; sentences that tie for the worst are all reported; where the labels
have one class only nothing is toxic. Columns besides doc_id and text play no part,
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerlake.llm.training import labelled_sample

#: Bound of the labelled sample that the model is fitted on.
TRAIN_PER_CLASS = 2000
MIN_DOCS = 8
PREFIXES = (4, 5)
EPOCHS, RATE, DECAY = 200, 0.15, 2e-4
#: Weights below this are left out of the model.
LEAST_WEIGHT = 0.05
THRESHOLD = 0.5
SENTENCE_THRESHOLD = 0.5

_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+(?=\s|$)|[.!?]+|\n|$)")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> list[str]:
    """Runs that end with . ! ? or a line break, stripped; blank ones are dropped."""
    return [s for m in _SENTENCE.finditer(text) if (s := m.group().strip())]


def words(sentence: str) -> set[str]:
    """Distinct lower-case words."""
    return set(_WORD.findall(sentence.lower()))


def features(word: str) -> list[str]:
    """The word itself and, for inflected forms, its openings of 4 and 5 letters."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class _Words(dict):
    """Word -> weight, filled on demand; texts repeat their words."""

    def __init__(self, weight: dict[str, float]):
        self.by_feature = weight

    def __missing__(self, w: str) -> float:
        if len(self) > 500_000:
            self.clear()
        x = self[w] = math.fsum(self.by_feature.get(f, 0.0) for f in features(w))
        return x


@dataclass
class NoisyOr:
    """``bias`` of None answers 0 for every sentence."""

    bias: float | None = None
    weight: dict[str, float] = field(default_factory=dict)
    #: What the logarithm of the number of sentences adds.
    crowd: float = 0.0

    def __post_init__(self):
        self._word = _Words(self.weight)

    def sentence(self, text: str, among: int = 1) -> float:
        """A sentence's probability in a document of ``among`` sentences."""
        if self.bias is None:
            return 0.0
        z = self.bias + self.crowd * math.log(max(1, among)) + math.fsum(map(self._word.__getitem__, set(_WORD.findall(text.lower()))))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))

    def document(self, text: str) -> tuple[float, list[tuple[int, str, float]]]:
        """The noisy-or, and (number, sentence, score) of each sentence."""
        every = sentences(text)
        scored = [(i, s, self.sentence(s, len(every))) for i, s in enumerate(every)]
        return 1 - math.exp(math.fsum([math.log1p(-min(x[2], 1 - 1e-12)) for x in scored])), scored


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> NoisyOr:
    """Maximum likelihood of the document labels under the noisy-or, by Adam."""
    y = np.array([v for _, v in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return NoisyOr()
    of: dict[str, list[str]] = {}
    bags = [[{f for w in words(s) for f in (of.get(w) or of.setdefault(w, features(w)))} for s in sentences(t)] for t, _ in rows]
    df = Counter(w for bag in bags for w in set().union(*bag))
    vocab = {w: i for i, w in enumerate(sorted(w for w, n in df.items() if n >= MIN_DOCS))}
    sent_doc, sent_ids, word_ids, n_sent = [], [], [], 0
    for d, bag in enumerate(bags):
        for ws in bag:
            ids = [vocab[w] for w in ws if w in vocab]
            sent_ids += [n_sent] * len(ids)
            word_ids += ids
            sent_doc.append(d)
            n_sent += 1
    if not n_sent:
        return NoisyOr()
    doc, s_of, w_of = np.array(sent_doc), np.array(sent_ids, np.int64), np.array(word_ids, np.int64)
    del bags, sent_ids, word_ids
    share = y.mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    crowd = np.log(np.bincount(doc, minlength=len(y)))[doc]
    w, b = np.zeros(len(vocab)), np.array([-5.0, 0.0])
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(2), np.zeros(2)
    for t in range(1, epochs + 1):
        z = b[0] + b[1] * crowd + np.bincount(s_of, weights=w[w_of], minlength=n_sent)
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        quiet = np.bincount(doc, weights=np.log1p(-np.clip(s, 0, 1 - 1e-9)), minlength=len(y))
        p = -np.expm1(quiet)
        # d(-log likelihood)/dz: (1 - s) cancels out of both classes.
        pull = np.where(y == 1, -np.exp(quiet) / np.maximum(p, 1e-9), 1.0) * cost
        g = pull[doc] * s
        gw = np.bincount(w_of, weights=g[s_of], minlength=len(vocab)) + DECAY * w
        gb = np.array([g.sum(), g @ crowd])
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w = w - RATE * (mw / c1) / (np.sqrt(vw / c2) + 1e-7)
        b = b - RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-7)
    return NoisyOr(float(b[0]), {k: float(w[i]) for k, i in vocab.items() if abs(w[i]) >= LEAST_WEIGHT}, float(b[1]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> NoisyOr:
    """Fit on the labelled rows of ``docs``, at most ``per_class`` of each class."""
    return fit(labelled_sample(docs, labels, "toxic", per_class))


_FOUND = T.StructType(
    [
        T.StructField("probability", T.DoubleType()),
        T.StructField("offending", T.ArrayType(T.StructType([T.StructField("sentence_index", T.IntegerType()), T.StructField("sentence", T.StringType()), T.StructField("score", T.DoubleType())]))),
    ]
)


def toxicity_udf(model: NoisyOr, threshold: float, sentence_threshold: float) -> Callable:
    """Column function: text -> (probability, offending sentences)."""
    kind = pa.struct([("probability", pa.float64()), ("offending", pa.list_(pa.struct([("sentence_index", pa.int32()), ("sentence", pa.string()), ("score", pa.float64())])))])

    @F.arrow_udf(_FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            out = []
            for v in values:
                p, scored = model.document(v.as_py() or "")
                hits = []
                if p >= threshold and scored:
                    best = max(x[2] for x in scored)
                    hits = [{"sentence_index": i, "sentence": s, "score": x} for i, s, x in scored if x >= sentence_threshold or x == best]
                out.append({"probability": p, "offending": hits})
            yield pa.array(out, kind)

    return find


def toxic_sentences(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sentence_threshold: float = SENTENCE_THRESHOLD) -> DataFrame:
    """The offending sentences of the documents found toxic.

    ``(doc_id, toxic_probability, sentence_index, sentence, sentence_score)``; a
    document whose noisy-or reaches ``threshold`` has at least one row: each sentence
    of ``sentence_threshold`` or more, and always its worst. Every document is scored.
    """
    find = toxicity_udf(train(docs, labels), threshold, sentence_threshold)
    scored = docs.select("doc_id", find(F.col("text")).alias("__r"))
    rows = scored.select("doc_id", F.col("__r.probability").alias("toxic_probability"), F.explode("__r.offending").alias("__s"))
    return rows.select("doc_id", "toxic_probability", F.col("__s.sentence_index").alias("sentence_index"), F.col("__s.sentence").alias("sentence"), F.col("__s.score").alias("sentence_score"))

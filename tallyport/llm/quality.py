"""Quality classifier: averaged hashed word and character n-gram vectors, softmax, numpy gradient descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyport.llm.common import fold

#: Buckets of the hashed features (2^BITS), their vectors' length, and the labelled rows that are learnt from at most.
BITS, DIM, SAMPLE = 18, 8, 4000
EPOCHS, BATCH, RATE = 5, 32, 0.3
#: Bytes of text that the driver learns from at most, and that a task works on together.
LEARNT, CHUNK = 1 << 26, 1 << 20


def feature_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every feature occurrence of UTF-8 texts, and the text that each belongs to: words, word pairs, and
    character 2- and 4-grams of the words joined by spaces.

    A word equal to the one before it reads as ``=``. Letter case and punctuation stay: they are what quality shows in.
    Each distinct word is hashed once, and n-grams are worked out for all texts together.
    """
    words = [t.split() for t in texts]
    owner = np.repeat(np.arange(len(texts)), list(map(len, words)))
    if not len(owner):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shift, many = np.uint64(64 - BITS), np.uint64(0x9E3779B97F4A7C15)
    coded = pa.array([w for part in words for w in part], pa.large_binary()).dictionary_encode()
    place = coded.indices.to_numpy()
    w = np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()], np.uint64)[place]
    same = owner[1:] == owner[:-1]
    again = np.append(False, same & (place[1:] == place[:-1]))
    w[again] = 61
    pairs = (w[1:] * np.uint64(3) + w[:-1])[same]
    out, whose = [w * many >> shift, pairs * many >> shift], [owner, owner[1:][same]]
    at, repeats = 0, again.tolist()
    lines = []
    for part in words:
        lines.append(b" ".join(b"=" if r else x for x, r in zip(part, repeats[at : at + len(part)])))
        at += len(part)
    # a line's end is no character of a text: words hold none
    c = np.frombuffer(b"\n".join(lines).decode(errors="replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = c == 10
    line = np.cumsum(ends) - ends
    for n in (2, 4):
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + c[i : len(c) - n + 1 + i]
            inside = (line[: len(h)] == line[n - 1 :]) & ~ends[n - 1 :]
            out.append(h[inside] * many >> shift)
            whose.append(line[: len(h)][inside])
    return np.concatenate(out).astype(np.int64), np.concatenate(whose)


def features(text: bytes) -> np.ndarray:
    """Bucket of every feature occurrence of one text."""
    return feature_rows([text])[0]


@dataclass
class Model:
    """The feature vectors and the softmax layer. A score needs only the difference of the two classes' logits,
    so ``weight`` holds each bucket's contribution to it."""

    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def __post_init__(self):
        self.weight = (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64)
        self.offset = float(self.bias[1] - self.bias[0])

    def score(self, text: bytes) -> float:
        return float(self.scores([text])[0])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Each text's probability of label 1; texts are taken together up to about CHUNK bytes."""
        out, at = np.empty(len(texts)), 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= CHUNK:
                size += len(texts[to])
                to += 1
            f, whose = feature_rows(texts[at:to])
            n = np.bincount(whose, minlength=to - at)
            z = self.offset + np.bincount(whose, self.weight[f], to - at) / np.maximum(n, 1)
            out[at:to] = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            at = to
        return out


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Stochastic gradient descent with per-bucket step sizes (AdaGrad) on the cross-entropy of the softmax.

    With one class only, or no rows, the model scores every text by the class frequencies.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.int64)
    share = (np.bincount(labels, minlength=2) + 1) / (len(labels) + 2)
    vectors = (rng.random((1 << BITS, DIM), np.float32) - 0.5) * np.float32(0.2)
    out, bias = np.zeros((DIM, 2), np.float32), np.log(share).astype(np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(vectors, out, bias)
    out = (rng.random((DIM, 2), np.float32) - 0.5) * np.float32(0.5)
    rows = []
    for t in texts:
        f, n = np.unique(features(t), return_counts=True)
        rows.append((f.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    seen_v, seen_o, seen_b = np.full(1 << BITS, 1e-8, np.float32), np.full_like(out, 1e-4), np.full_like(bias, 1e-4)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            f, w = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
            owner = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            doc = np.zeros((len(pick), DIM), np.float32)
            parts = vectors[f] * w[:, None]
            for d in range(DIM):
                doc[:, d] = np.bincount(owner, parts[:, d], len(pick))
            z = doc @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            g_out, g_bias, g_doc = doc.T @ p, p.sum(axis=0), p @ out.T
            uniq, inverse = np.unique(f, return_inverse=True)
            g = np.stack([np.bincount(inverse, g_doc[owner, d] * w, len(uniq)) for d in range(DIM)], axis=1).astype(np.float32)
            seen_v[uniq] += (g * g).mean(axis=1)
            vectors[uniq] -= RATE * g / np.sqrt(seen_v[uniq])[:, None]
            seen_o += g_out**2
            seen_b += g_bias**2
            out -= RATE * g_out / np.sqrt(seen_o)
            bias -= RATE * g_bias / np.sqrt(seen_b)
    return Model(vectors, out, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_col: str = "quality") -> Model:
    """Learns from at most ``sample`` labelled rows outside fold 0, the first in the order of a hash of the id, and of
    these from whole texts up to LEARNT bytes together.

    Only ids and labels are shuffled to find them; then their sizes, and last the texts that fit come to the driver. Rows with a null id, label or text, and ids with contradicting labels, are not learnt from.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 0))
    known = known.groupBy("doc_id").agg(F.min(label_col).alias("label"), F.max(label_col).alias("_hi")).where("label = _hi").drop("_hi")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null").join(known, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    sizes = rows.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    fit_in = [r.doc_id for r, upto in zip(sizes, np.cumsum([r.n for r in sizes])) if upto <= LEARNT]
    if len(fit_in) < len(sizes):
        rows = rows.where(F.col("doc_id").isin(fit_in))
    got = sorted(rows.toLocalIterator(), key=lambda r: r[0])
    return train([bytes(r[1]) for r in got], np.array([r[2] for r in got], np.int64))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted`` put in their place or behind.

    The score is the softmax probability of label 1 from the whole text (null counts as empty; a text without
    features gets the bias alone). The model is a broadcast of 2^BITS numbers, whatever the corpus. Repeated rows
    score alike; an empty table stays empty; other columns pass through, but columns named score or predicted are
    replaced.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model.weight, model.offset))

    @F.pandas_udf("double")
    def score(texts):
        weight, offset = shared.value
        m = Model.__new__(Model)
        m.weight, m.offset = weight, offset
        return pd.Series(m.scores([bytes(t) for t in texts]))

    out = docs.withColumn("score", score(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))

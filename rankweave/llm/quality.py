"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors: one per word (the mean of hashed word and character n-gram
vectors) and one per pair of neighbouring words (hashed; all pairs of a word with itself share one vector).
A softmax layer on the average gives the class. Vectors and layer are trained by numpy stochastic gradient
descent on a bounded sample of labelled documents.

The output layer is linear, so for two classes each word's share of the score is one number: scoring a text
sums kept numbers over its words, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BatchMemo, chunks, clean_text

_TWICE = 0  # bucket of a word followed by itself


@dataclass
class QualityModel:
    """buckets: a power of two; table: per bucket, its vector's share of the class-1 margin; bias: the margin of an empty text."""

    table: np.ndarray
    bias: float
    sizes: tuple[int, ...]

    @property
    def mask(self) -> int:
        return len(self.table) - 1


_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_buckets(words: list[str], mask: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word, with < and > at its ends: a row of buckets of the word and its character n-grams, how many
    of them count, and the word's hash. Rows are as wide as the longest word asks for."""
    chars = np.array([f"<{w}>" for w in words])
    chars = chars.view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    width = np.array([len(w) + 2 for w in words])
    power = np.cumprod(np.full(chars.shape[1], _BASE), dtype=np.uint64)
    word_hash = (chars * power).sum(1, dtype=np.uint64) * _MIX >> np.uint64(20)
    parts, counted = [word_hash[:, None]], [np.ones((len(words), 1), bool)]
    for n in sizes:
        if chars.shape[1] >= n:
            gram = sum(chars[:, k : chars.shape[1] - n + 1 + k] * power[k] for k in range(n)) + np.uint64(n)
            parts.append(gram * _MIX >> np.uint64(20))
            counted.append(np.arange(gram.shape[1])[None, :] + n <= width[:, None])
    buckets = np.maximum(np.hstack(parts) & np.uint64(mask), np.uint64(1)).astype(np.int64)
    return buckets, np.hstack(counted), word_hash


def pair_buckets(h: np.ndarray, mask: int) -> np.ndarray:
    """Buckets of neighbouring words, from the words' hashes."""
    a, b = h[:-1], h[1:]
    mixed = (a * _BASE ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))) >> np.uint64(40)
    return np.where(a == b, _TWICE, np.maximum(mixed & np.uint64(mask), np.uint64(1))).astype(np.int64)


def text_vectors(texts: list[str], mask: int, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each whole text: its buckets, each once, and their shares in the text's average. Texts without words have none.

    A few texts are taken together, so that little besides the result is held."""
    for part in chunks(texts, 300_000):
        split = [t.split() for t in part]
        number = {w: k for k, w in enumerate(sorted({w for ws in split for w in ws}))}
        buckets: list[np.ndarray] = [np.zeros(0, np.int64)] * len(number)
        hashes = np.zeros(len(number), np.uint64)
        words = list(number)
        short = [k for k, w in enumerate(words) if len(w) <= 40]
        for rows in [*(short[k : k + 4000] for k in range(0, len(short), 4000)), *([k] for k, w in enumerate(words) if len(w) > 40)]:
            grams, counted, hashed = word_buckets([words[k] for k in rows], mask, sizes)
            hashes[rows] = hashed
            for k, g, c in zip(rows, grams, counted, strict=True):
                buckets[k] = g[c]
        wide = np.array([len(b) for b in buckets], np.int64)
        begins, flat = np.cumsum(wide) - wide, np.concatenate([np.zeros(0, np.int64), *buckets])
        for ws in split:
            at = np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))
            pairs = pair_buckets(hashes[at], mask)
            words_, times = np.unique(at, return_counts=True)
            n = wide[words_]
            of_words = flat[np.repeat(begins[words_] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            which, inverse = np.unique(np.concatenate([of_words, pairs]), return_inverse=True)
            share = np.concatenate([np.repeat(times / np.maximum(n, 1), n), np.ones(len(pairs))]) / max(len(at) + len(pairs), 1)
            yield which.astype(np.int32), np.bincount(inverse, share, len(which)).astype(np.float32)


def train(texts: list[str], labels: list[int], buckets: int = 1 << 18, dim: int = 8, sizes: tuple[int, ...] = (3, 4), epochs: int = 4, rate: float = 2.0, batch: int = 32, seed: int = 7) -> QualityModel:
    """Train on whole texts with labels 0 or 1; those without words are left out. Each step takes `batch` documents.

    Memory: the different buckets of each text, eight bytes each."""
    rng, mask = np.random.default_rng(seed), buckets - 1
    vec = rng.uniform(-1, 1, (buckets, dim)).astype(np.float32) / dim
    out, bias = np.zeros(dim, np.float32), np.float32(0)
    docs = [(v, y) for v, y in zip(text_vectors(texts, mask, sizes), labels, strict=True) if len(v[0])]
    del texts
    a_round = -(-len(docs) // batch)
    for step in range(epochs * a_round):
        k = step % a_round
        if k == 0:
            order = rng.permutation(len(docs))
        chosen = [docs[d] for d in order[k * batch : (k + 1) * batch]]
        col, share = np.concatenate([v[0] for v, _ in chosen]), np.concatenate([v[1] for v, _ in chosen])
        n = np.array([len(v[0]) for v, _ in chosen])
        average = np.add.reduceat(vec[col] * share[:, None], np.cumsum(n) - n)
        g = np.array([y for _, y in chosen]) - _sigmoid(average @ out + bias)
        now = rate * (1 - step / (epochs * a_round))
        np.add.at(vec, col, ((now * 4) * (np.repeat(g, n) * share)[:, None] * out[None, :]).astype(np.float32))
        out += (now * (g @ average)).astype(np.float32)
        bias += np.float32(now * 0.1 * g.mean())
    return QualityModel((vec @ out).astype(np.float32), float(bias), tuple(sizes))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Scorer:
    """Scores of texts; what is new among their words is looked up together."""

    def __init__(self, model: QualityModel):
        self.model = model
        self.words = BatchMemo(self._learn, most=100_000)

    def _learn(self, words: list[str]) -> list[complex]:
        """A word's share as the real part, its hash as the imaginary one: one lookup gives both.

        Words of one length are taken together, some 50,000 characters at once: rows have no padding, so that memory is
        bounded and a share doesn't depend on what other words are new."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, same in by_length.items():
            most = max(1, 50_000 // length)
            for rows in (same[k : k + most] for k in range(0, len(same), most)):
                grams, counted, hashes = word_buckets([words[i] for i in rows], self.model.mask, self.model.sizes)
                share = (self.model.table[grams] * counted).sum(1) / counted.sum(1)
                for i, a, h in zip(rows, share.tolist(), hashes.tolist(), strict=True):
                    out[i] = complex(a, h)
        return out

    def __call__(self, texts: list[str]) -> Iterator[float]:
        for part in chunks(texts, 500_000):
            split = [t.split() for t in part]
            self.words.know({w for ws in split for w in ws})
            for words in split:
                margin = self.model.bias
                if words:
                    both = np.array(list(map(self.words.__getitem__, words)))
                    pairs = pair_buckets(both.imag.astype(np.uint64), self.model.mask)
                    margin += (both.real.sum() + self.model.table[pairs].sum(dtype=np.float64)) / (len(words) + len(pairs))
                yield float(_sigmoid(margin))


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """text and label (0 or 1) of at most `most` labelled documents of each class, those of the smallest id hash.

    A document with two different labels, or none, is left out; of repeated rows one is taken."""
    said = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo = hi").select("id", F.col("lo").alias("label"))
    order = F.xxhash64("id")
    chosen = said.filter("label = 0").orderBy(order, "id").limit(most).unionByName(said.filter("label = 1").orderBy(order, "id").limit(most))
    docs = df.select(F.col(id_col).alias("id"), clean_text(text_col).alias("text"))
    got = docs.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # chosen has 2 * most rows at most
    return got.orderBy("id").toPandas()


def fit_quality(df: DataFrame, labels: DataFrame, label: str = "quality", most: int = 2500, id_col: str = "doc_id", text_col: str = "text", **training) -> QualityModel:
    """A model from at most `most` labelled documents of each class; only texts and labels are used. The rare
    class is not weighted up: with fewer documents of a class, its prior is that of the sample.
    Without any labelled document the model gives every text 0.5."""
    got = labelled_sample(df, labels, label, most, id_col, text_col)
    return train(got["text"].tolist(), got["label"].tolist(), **training)


def score_quality(df: DataFrame, model: QualityModel, accept: float = 0.7, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1, higher: class 1 likelier) and predicted (1 if score >= accept, else 0). Columns
    of these names are replaced. Null and empty texts, and those of white space, get the model's prior."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 1 MB at 2**18 buckets, whatever the corpus

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(list(scorer(list(texts))), dtype="float64")

    made = F.pandas_udf(score, "double")(clean_text(text_col))
    return df.withColumn("score", made).withColumn("predicted", F.when(F.col("score") >= accept, 1).otherwise(0))

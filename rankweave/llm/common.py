"""Small helpers that the corpus operators share."""

from __future__ import annotations

import numpy as np
import xxhash

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.sources.shared import forget, shared_dir, small, written

#: ASCII white space, as a Java or RE2 character class: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
#: The same characters as a string, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_text(col: str = "text"):
    """The text, with null as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


class Memo(dict):
    """word -> fn(word), kept for at most `most` words; then it starts anew, which costs time only."""

    def __init__(self, fn, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.fn, self.most, self.longest = fn, most, longest

    def __missing__(self, word):
        value = self.fn(word)
        if not isinstance(word, str) or len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


class BatchMemo(dict):
    """Like Memo, but learns the new words of many texts together: learn(words) gives their values."""

    def __init__(self, learn, most: int = 500_000):
        super().__init__()
        self.learn, self.most = learn, most

    def __missing__(self, word):
        return self.learn([word])[0]

    def know(self, words: set[str]) -> None:
        if len(self) + len(words) > self.most:
            self.clear()
        new = [w for w in words if w not in self]
        if new:
            self.update(zip(new, self.learn(new), strict=True))


def chunks(texts: list[str], chars: int = 2_000_000):
    """Runs of texts of about so many characters."""
    at = 0
    while at < len(texts):
        begun, size = at, 0
        while at < len(texts) and size < chars:
            size += len(texts[at])
            at += 1
        yield texts[begun:at]


__all__ = ["SPACE", "SPACE_CHARS", "BatchMemo", "Memo", "chunks", "clean_text", "forget", "gram_hashes", "hash_words", "read", "shared_dir", "small", "written"]

_BASE = np.uint64(0x9E3779B97F4A7C15)


def hash_words(words: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w.encode()) for w in words]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + h[k : len(h) - n + 1 + k]
    return out ^ (out >> np.uint64(29))

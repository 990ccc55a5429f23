"""Benchmark decontamination: shared n-grams (seeds) find passages, Smith-Waterman alignment scores them.

Test items are taken in blocks of bounded size. For a block, every text is searched for the items' word n-grams
(seeds); around its seeds a text yields passages, of word hashes alone. Each passage is aligned locally, where it
is found, to every item that it shares a seed with, however common the seed, so that edited copies score too. Only
pairs that can't reach the least score, since too few of the item's words are in the passage, are not aligned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, clean_text, gram_hashes, written

_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Per code point: 0 white space, 1 a mark, 2 a letter, digit or _ (made once per process)."""
    if not _CLASSES:
        _CLASSES.append(np.fromiter((0 if (c := chr(i)).isspace() else 1 + (c.isalnum() or c == "_") for i in range(0x110000)), np.uint8, 0x110000))
    return _CLASSES[0]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, one text after the other, and the text that each word is of.

    Words are runs of other than white space, in lower case, with their letters, digits and _ only; those with nothing left are left out.
    All texts go through numpy together, a few operations per code point."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[codes]
    at = np.flatnonzero(kinds == 2)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.cumsum(kinds == 0, dtype=np.int32)[at]  # runs of one number have no white space between them
    begins = np.flatnonzero(np.diff(word, prepend=-1))
    place = np.arange(len(at), dtype=np.int64) - np.repeat(begins, np.diff(begins, append=len(at)))
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(place.max()), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)])
    letters = codes[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    letters ^= letters >> np.uint64(32)
    h = np.add.reduceat(letters * powers[place], begins)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    ends = np.cumsum([len(t) + 1 for t in low])
    return h ^ (h >> np.uint64(29)), np.searchsorted(ends, at[begins], side="right")


def hashes_of(text: str) -> np.ndarray:
    return words_of([text])[0]


def align(a: np.ndarray, b: np.ndarray, match: float = 1.0, mismatch: float = -1.0, gap: float = -1.0) -> float:
    """Best local alignment (Smith-Waterman, linear gaps) of two word sequences."""
    if not len(a) or not len(b):
        return 0.0
    best, row, ramp = 0.0, np.zeros(len(b) + 1), np.arange(len(b) + 1) * -gap
    for x in a:
        new = np.zeros(len(b) + 1)
        new[1:] = np.maximum(0.0, np.maximum(row[:-1] + np.where(b == x, match, mismatch), row[1:] + gap))
        row = np.maximum.accumulate(new + ramp) - ramp  # gaps within the row
        best = max(best, float(row.max()))
    return best


def contaminated(df: DataFrame, items: DataFrame, n: int = 4, share: float = 0.5, run: int = 30, block_items: int = 100_000, block_bytes: int = 64_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item that it has a copy of: doc_id, item_id, score (of the alignment, in words), share (of the item's length).

    A copy aligns with a score of at least `share` of the item's words, or of at least `run` words. Words are runs of other than
    white space, in lower case and without marks; those of marks alone don't count. Items of fewer than n words are found in no text, nor is anything in null or empty texts. Rows with one id
    are one document (the best score counts); those with a null id are one too, as are items with one id.
    Memory: a task holds the words and seeds of a block of items, and one text. Items are dealt by hash into as many blocks as block_items
    items and block_bytes of text allow on average; each block is searched for in all texts."""
    spark = df.sparkSession
    named = items.select(F.col(item_col).cast("long").alias("item_id"), clean_text(item_text_col).alias("text"))
    numbered = written(named, "items")
    held = numbered.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    blocks = max(1, -(-held["n"] // block_items), -(-(held["bytes"] or 0) // block_bytes))
    out = None
    for k in range(blocks):
        part = numbered if blocks == 1 else numbered.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        found = _block(spark, df.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text_col).alias("text")), part, n, share, run)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("share").alias("share"))


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each range, one range after the other."""
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Items:
    """The items of a block that have n words, and which of them have a seed."""

    def __init__(self, ids: list[int | None], words: list[np.ndarray], n: int):
        self.ids, self.sizes = ids, np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint64), *words])
        self.begins = np.cumsum(self.sizes) - self.sizes
        of = np.repeat(np.arange(len(words)), self.sizes)
        grams = gram_hashes(self.words, n)
        within = np.flatnonzero(of[: len(grams)] == of[n - 1 :][: len(grams)])
        within = within[np.argsort(grams[within], kind="stable")]
        self.seeds, self.of = grams[within], of[within].astype(np.int32)

    def matches(self, passage: np.ndarray, grams: np.ndarray, share: float, run: float) -> list[tuple[int, float]]:
        """The items with a seed among grams whose alignment with the passage has a share of the item or a score of so much."""
        lo, hi = (np.searchsorted(self.seeds, grams, side) for side in ("left", "right"))
        near = np.unique(self.of[_ranges(lo, hi - lo)])
        if not len(near):
            return []
        sizes = self.sizes[near]
        held = np.isin(self.words[_ranges(self.begins[near], sizes)], passage)
        most = np.add.reduceat(held.astype(np.int64), np.cumsum(sizes) - sizes)  # no alignment scores more
        out = []
        for k in near[(most >= share * sizes) | (most >= run)].tolist():
            s = align(self.words[self.begins[k] : self.begins[k] + self.sizes[k]], passage)
            if s >= share * self.sizes[k] or s >= run:
                out.append((k, s))
        return out


def _block(spark, docs: DataFrame, items: DataFrame, n: int, share: float, run: int) -> DataFrame:
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["item_id"], "words": [hashes_of(t).tobytes() for t in pdf["text"]]})

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInPandas(hashed, "item_id string, words binary").filter(F.octet_length("words") >= 8 * n).dropDuplicates().collect()  # those of one block of items
    block = Items([None if r["item_id"] is None else int(r["item_id"]) for r in rows], [np.frombuffer(r["words"], np.uint64) for r in rows], n)
    longest = int(block.sizes.max(initial=0))
    shared = spark.sparkContext.broadcast(block)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        table = np.unique(block.seeds)
        coarse = np.zeros(1 << 20, bool)  # most n-grams end here
        coarse[(table >> np.uint64(44)).astype(np.int64)] = True
        known: dict[bytes, list[tuple[int, float]]] = {}  # passages of equal words are aligned once
        for pdf in batches:
            ids, rows = pdf["doc_id"].tolist(), []
            begun = 0
            for texts in chunks(pdf["text"].tolist(), 1_000_000):
                h, of = words_of(texts)
                grams = gram_hashes(h, n)
                maybe = np.flatnonzero(coarse[(grams >> np.uint64(44)).astype(np.int64)])
                maybe = maybe[of[maybe] == of[maybe + n - 1]]  # within one text
                hits = maybe[np.isin(grams[maybe], table)]
                cuts = np.flatnonzero((np.diff(hits) > longest) | (np.diff(of[hits]) > 0)) + 1  # seeds far apart are passages of their own
                for run_ in np.split(hits, cuts) if len(hits) else ():
                    text = of[run_[0]]
                    first, end = np.searchsorted(of, [text, text + 1])
                    lo, hi = max(first, run_[0] - longest), min(end, run_[-1] + n + longest)
                    doc = ids[begun + text]
                    key = hashlib.blake2b(h[lo:hi].tobytes(), digest_size=16).digest()
                    if key not in known:
                        if len(known) >= 100_000:
                            known.clear()
                        known[key] = block.matches(h[lo:hi], np.unique(grams[run_]), share, run)
                    rows += [(None if doc != doc or doc is None else int(doc), block.ids[k], s, s / block.sizes[k]) for k, s in known[key]]
                begun += len(texts)
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "share"]).astype({"doc_id": "Int64", "item_id": "Int64", "score": float, "share": float})

    return docs.mapInPandas(search, "doc_id long, item_id long, score double, share double")

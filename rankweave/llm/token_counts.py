"""Token counts at every prefix of a text, by dynamic programming over the prefixes.

For a byte-pair vocabulary the encoding of a prefix ends in exactly one token t such that the
encoding of the prefix before t ends in a token s with encode(s + t) == [s, t]. So one left-to-right
pass that keeps the last token of each prefix gives the exact token count of *every* prefix. The
counts are kept as one signed byte per character (the step from one prefix to the next), from which
truncation and budget questions are answered by a running sum, without encoding again.

No piece of such a vocabulary goes on past a word boundary (checked when the model is loaded), so
the pass runs per word and its results are kept for words seen before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, chunks, clean_text

_BAR = "▁"  # stands for a space in the vocabulary
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_UNITS = re.compile(f"{_BAR}+[^{_BAR}]*")


class PrefixCounter:
    """Prefix dynamic program for one sentencepiece BPE model with byte fallback."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(re.search(f"[^{_BAR}]{_BAR}", p) for p in self.score):
            raise ValueError("the vocabulary has pieces that span words; prefixes can't be split at spaces")
        self.whole = {p for p in self.score if self._merged(p) == [p]}  # pieces that their own merges build
        self.ends = {p[k:] for p in self.whole for k in range(len(p))}
        self.joins = Memo(self._join)
        self.steps = Memo(self._word_steps, most=500_000)
        self.pieces = sorted(self.whole)
        self.piece_hash = np.array([self._hash(p) for p in self.pieces], dtype=np.uint64)
        if len(set(self.piece_hash.tolist())) < len(self.pieces):
            raise ValueError("two pieces share a hash; choose another base")
        self.slots = np.full(1 << 20, -1, dtype=np.int32)  # piece by the upper bits of its hash; the few that clash are in the sorted list alone
        self.slots[(self.piece_hash >> np.uint64(44)).astype(np.int64)] = np.arange(len(self.pieces), dtype=np.int32)
        won = self.slots[(self.piece_hash >> np.uint64(44)).astype(np.int64)] == np.arange(len(self.pieces))
        self.clash = {int(h): i for i, h in enumerate(self.piece_hash) if not won[i]}
        self.clash_hash = np.array(sorted(self.clash), dtype=np.uint64)
        self.pair_key, self.pair_fits = np.full(1 << 21, -1, dtype=np.int64), np.zeros(1 << 21, dtype=bool)
        self.runs = Memo(lambda n: len(self.sp.encode(" " * (n - 1))) if n > 1 else n)

    def _join(self, pair: str) -> bool:
        """Whether two pieces, given with a tab between, stay as they are side by side."""
        return self._merged(pair.replace("\t", "")) == pair.split("\t")

    def _merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short string: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _prefixes(self, word: str) -> tuple[list[int], list[str], list[int]]:
        """For the prefixes of bar + word with 0, 1, 2, ... characters: token count, last token, its start."""
        s, whole, ends, joins = _BAR + word, self.whole, self.ends, self.joins
        counts, last, begun = [0], [""], [0]
        for end in range(1, len(s) + 1):
            start = end - 1
            piece = s[start]
            if piece not in whole:  # an unknown character becomes its bytes and joins with nothing
                counts.append(counts[start] + len(piece.encode()))
            else:
                found = []
                while piece in ends:
                    if piece in whole:
                        found.append((start, piece))
                    start -= 1
                    if start < 0:
                        break
                    piece = s[start:end]
                for start, piece in reversed(found):  # the longest first; exactly one fits
                    if start == 0 or last[start] not in whole or joins[f"{last[start]}\t{piece}"]:
                        break
                else:
                    raise ValueError(f"no encoding ends a prefix of {s!r}")
                counts.append(counts[start] + 1)
            last.append(piece)
            begun.append(start)
        return counts, last, begun

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h * int(_MIX) & (2**64 - 1)

    def _piece_ids(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, -1 where there is none."""
        h = h * _MIX
        found = self.slots[(h >> np.uint64(44)).astype(np.int64)]
        found = np.where((found >= 0) & (self.piece_hash[found] == h), found, -1)
        if len(self.clash_hash):
            for i in np.nonzero(np.isin(h, self.clash_hash))[0]:
                found[i] = self.clash[int(h[i])]
        return found

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, by number, stay as they are side by side."""
        key = (a.astype(np.int64) << 20) | b
        slot = ((key.astype(np.uint64) * _MIX) >> np.uint64(43)).astype(np.int64)
        known, out = self.pair_key[slot] == key, self.pair_fits[slot]
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            fits = np.array([self._merged(x + y) == [x, y] for x, y in ((self.pieces[k >> 20], self.pieces[k & 0xFFFFF]) for k in new.tolist())])
            out[~known] = fits[back]
            self.pair_key[slot[~known]], self.pair_fits[slot[~known]] = key[~known], fits[back]
        return out

    def learn(self, words: list[str]) -> None:
        """Keep the steps of many words: the same program as _prefixes, a column of prefixes at a time."""
        words = sorted((w for w in words if 0 < len(w) <= 40 and "\0" not in w), key=len, reverse=True)
        if not words:
            return
        codes = np.array(words).view(np.uint32).reshape(len(words), -1)
        codes = np.hstack([np.full((len(words), 1), ord(_BAR), np.uint32), codes])
        width = np.array([len(w) + 1 for w in words])
        hashes, powers, longest = [np.zeros(len(words), np.uint64)], [np.uint64(1)], max(map(len, self.whole))
        counts, last = np.zeros((codes.shape[1] + 1, len(words)), np.int32), np.full((codes.shape[1] + 1, len(words)), -1, np.int32)
        for end in range(1, codes.shape[1] + 1):
            n = int(np.searchsorted(-width, -end, side="right"))  # the words that are so long
            char = codes[:n, end - 1]
            hashes.append(hashes[-1][:n] * _BASE + char.astype(np.uint64) + np.uint64(1))
            powers.append(np.uint64(int(powers[-1]) * int(_BASE) & (2**64 - 1)))
            open_ = np.arange(n)
            for size in range(min(longest, end), 0, -1):
                start = end - size
                piece = self._piece_ids(hashes[end][open_] - hashes[start][open_] * powers[size])
                is_piece = piece >= 0
                if start:
                    before = last[start][open_[is_piece]]
                    fits = before < 0
                    fits[~fits] = self._fit(before[~fits], piece[is_piece][~fits])
                    is_piece[is_piece] = fits
                at = open_[is_piece]
                counts[end][at], last[end][at] = counts[start][at] + 1, piece[is_piece]
                open_ = open_[~is_piece]
            c = codes[open_, end - 1]
            counts[end][open_] = counts[end - 1][open_] + 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        steps = np.ascontiguousarray(np.diff(counts, axis=0).astype(np.int8).T)
        self.steps.update((w, row[: len(w) + 1].tobytes()) for w, row in zip(words, steps, strict=True))

    def of_batch(self, texts: list[str]) -> Iterator[bytes]:
        """prefix_steps of each text; what is new among the words of some texts is learned together."""
        for part in chunks(texts):
            words = {w for t in part for w in t.replace(_BAR, " ").split(" ")}
            if len(self.steps) + len(words) > self.steps.most:
                self.steps.clear()
            self.learn([w for w in words if w not in self.steps])
            yield from map(self.prefix_steps, part)

    def _word_steps(self, word: str) -> bytes:
        counts = self._prefixes(word)[0]
        return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])

    def _spaced(self, unit: str) -> bytes:
        """Steps of a run of spaces and the word after it. Pieces of spaces alone merge after all others,
        so the word takes its one space or none, and the rest of the run is encoded by itself."""
        word = unit.lstrip(_BAR)
        k = len(unit) - len(word)
        if k == 1:
            return self.steps[word]
        counts, last, begun = self._prefixes(word)
        bare = [False, True]
        for end in range(2, len(counts)):
            bare.append(bare[begun[end]] if begun[end] else False)
        at = [self.runs[m] for m in range(k + 1)] + [self.runs[k] + c - 1 if b else self.runs[k - 1] + c for c, b in zip(counts[2:], bare[2:], strict=True)]
        return bytes([(b - a) & 255 for a, b in zip(at, at[1:])])

    def prefix_steps(self, text: str) -> bytes:
        """One signed byte for the dummy prefix and for each character: how much the count grows there."""
        if not text:
            return b""
        if "  " in text or _BAR in text or text[0] == " " or text[-1] == " ":
            return b"".join(map(self._spaced, _UNITS.findall(_BAR + text.replace(" ", _BAR))))
        return b"".join(map(self.steps.__getitem__, text.split(" ")))


def tokens_in_prefix(steps: bytes, n_chars: int) -> int:
    """Tokens of the first n_chars characters."""
    return int(np.frombuffer(steps, np.int8)[: n_chars + 1].sum(dtype=np.int64)) if n_chars else 0


def longest_prefix(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens."""
    fits = np.nonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)[0]
    return int(fits[-1]) if len(fits) else 0


_COUNTERS: dict[str, PrefixCounter] = {}


def prefix_token_counts(df: DataFrame, model_path: str, limit: int = 4096, text_col: str = "text", keep_steps: bool = False) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) and chars_within_limit (length of
    the longest prefix of at most `limit` tokens), and with keep_steps prefix_steps (binary, one signed
    byte a character). Columns of df with these names are replaced. Null texts count as empty: 0 tokens.
    Rows are independent: nothing is shuffled, repeated rows each get their counts.
    model_path: a sentencepiece BPE model that every executor can open."""

    out = "n_tokens long, chars_within_limit long" + (", prefix_steps binary" if keep_steps else "")

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _COUNTERS.get(model_path) or _COUNTERS.setdefault(model_path, PrefixCounter(model_path))
        for texts in batches:
            steps = list(counter.of_batch(list(texts)))
            n = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
            made = {"n_tokens": n, "chars_within_limit": [longest_prefix(s, limit) if k > limit else len(t) for s, k, t in zip(steps, n, texts, strict=True)]}
            yield pd.DataFrame(made | ({"prefix_steps": steps} if keep_steps else {}))

    made = F.pandas_udf(count, out)(clean_text(text_col))
    fields = ["n_tokens", "chars_within_limit"] + ["prefix_steps"] * keep_steps
    kept = [c for c in df.columns if c not in {"n_bytes", "over_limit", *fields}]
    counted = df.withColumn("__counts", made).withColumn("__bytes", F.octet_length(clean_text(text_col)).cast("long"))
    return counted.select(
        *(F.col(f"`{c}`") for c in kept),
        F.col("__bytes").alias("n_bytes"),
        *(F.col(f"__counts.{f}").alias(f) for f in fields),
        (F.col("__counts.n_tokens") > limit).alias("over_limit"),
    )

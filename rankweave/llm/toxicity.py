"""Toxicity scores: a learned lexicon, matched fuzzily by Levenshtein automata, weighed by its context.

1. Learn a lexicon from a bounded labelled sample: words, and word stems, that toxic documents have far
   more often than others.
2. Intersect the lexicon's trie with Levenshtein automata (one edit from 5 letters, two from 9): a state is
   a set of (trie node, edits); states and steps are made when first reached and kept, so that matching a
   word costs one step a letter until the state is dead.
3. Score each match by the window of words around it: quotation marks about it or a verb of saying before it
   lower its weight, other matches nearby raise it.
4. A logistic model over the sums of these scores gives the document's score.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BatchMemo, chunks, clean_text
from .quality import labelled_sample

# Marks and words by which a text shows that it quotes.
QUOTES = "\"“”„«»‹›"
SAYING = frozenset("said says say called calls wrote writes quoted quote term word dit disait appelé mot dijo llamó palabra sagte nannte wort".split())
_EDGE = re.compile(r"^\W+|\W+$")


def bare(word: str) -> str:
    """The word in lower case, without marks at its ends."""
    return word.lower() if word.isalpha() else _EDGE.sub("", word.lower())


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyTrie:
    """Finds the lexicon term within its allowed edits of a word, or the stem that begins it."""

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.most = [0]
        for names, into in ((words, self.term), (stems, self.stem)):
            for name in names:
                node, k = 0, allowed_edits(name) if into is self.term else 0
                self.most[0] = max(self.most[0], k)
                for c in name:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.term.append(None)
                        self.stem.append(None)
                        self.most.append(0)
                    node = self.children[node][c]
                    self.most[node] = max(self.most[node], k)
                into[node] = name
        self._forget()

    def _forget(self) -> None:
        """Start without states; they are made anew as they are reached."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.begun: list[str | None] = []
        self.reached = 0  # steps kept
        self.start = self._state({0: 0})

    def _state(self, at: dict[int, int]) -> int:
        """The number of the state with these nodes and edits; -1 for none. Letters of a term may be left out."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            if e > at[node]:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < at.get(child, 9):
                    at[child] = e + 1
                    todo.append((child, e + 1))
        if not at:
            return -1
        key = frozenset(at.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(at)
            self.steps.append({})
            ends = sorted((e, t) for n, e in at.items() if (t := self.term[n]) and e <= allowed_edits(t))
            self.found.append((ends[0][1], ends[0][0]) if ends else None)
            self.begun.append(max((self.stem[n] for n, e in at.items() if e == 0 and self.stem[n]), key=len, default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        to: dict[int, int] = {}
        for node, e in self.sets[state].items():
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < to.get(child, 9):
                    to[child] = cost
            if e + 1 <= self.most[node] and e + 1 < to.get(node, 9):
                to[node] = e + 1
        self.steps[state][c] = out = self._state(to)
        self.reached += 1
        return out

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits), or (stem with * after it, 0), or None."""
        if self.reached > 1_000_000:  # a bound of memory
            self._forget()
        state, stem = self.start, None
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return (stem + "*", 0) if stem else None
            stem = self.begun[state] or stem
        return self.found[state] or ((stem + "*", 0) if stem else None)


@dataclass
class ToxicityModel:
    """terms: term or stem* -> log-odds; innocent: near misses that are words of their own; the logistic layer."""

    terms: dict[str, float]
    innocent: frozenset
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float


def context_scores(words: list[str], at: list[int], weights: list[float], window: int = 5) -> tuple[list[float], int]:
    """The score of each match, from its weight and its window of words, and how many are quoted.

    A quoted match, or one after a verb of saying, counts a fifth; each other match in the window adds a quarter."""
    scores, quoted = [], 0
    for k, (i, w) in enumerate(zip(at, weights, strict=True)):
        lo = max(0, i - window)
        left, right = words[lo:i], words[i + 1 : i + 1 + window]
        own = words[i]
        open_ = sum(c in QUOTES for x in left for c in x) + (own[:1] in QUOTES and own != "")
        close = sum(c in QUOTES for x in right for c in x) + (len(own) > 1 and own.rstrip(".,;:!?")[-1:] in QUOTES)
        is_quoted = (open_ % 2 == 1 and close > 0) or any(bare(x) in SAYING for x in left[-3:])
        near = sum(1 for j in (at[k - 1] if k else -99, at[k + 1] if k + 1 < len(at) else -99) if abs(j - i) <= window)
        quoted += is_quoted
        scores.append(w * (0.2 if is_quoted else 1.0) * (1 + 0.25 * near))
    return scores, quoted


class ToxicityScorer:
    def __init__(self, terms: dict[str, float], innocent=frozenset()):
        self.weight, self.innocent = terms, innocent
        self.trie = FuzzyTrie([t for t in terms if not t.endswith("*")], [t[:-1] for t in terms if t.endswith("*")])
        self.hits = BatchMemo(lambda words: list(map(self._hit, words)), most=400_000)

    def _hit(self, word: str) -> tuple[float, int] | None:
        """Weight and kind (0: a term, 1: a term with edits, 2: a stem) of what a word matches."""
        b = bare(word)
        got = self.trie.match(b)
        if got is None or got[1] and b in self.innocent:
            return None
        return self.weight[got[0]] * (1 - 0.25 * got[1]), 2 if got[0].endswith("*") else int(got[1] > 0)

    def features(self, texts: list[str]) -> np.ndarray:
        rows = []
        for part in chunks(texts):
            split = [t.split() for t in part]
            self.hits.know({w for ws in split for w in ws})
            for words in split:
                hits = list(map(self.hits.__getitem__, words))
                row = np.zeros(9)
                if any(hits):
                    at = [i for i, h in enumerate(hits) if h]
                    scores, quoted = context_scores(words, at, [hits[i][0] for i in at])
                    kinds = np.array([hits[i][1] for i in at])
                    s = np.array(scores)
                    row[:] = [s.max(), np.log1p(s.sum()), *(np.log1p(s[kinds == k].sum()) for k in range(3)), (kinds == 0).any(), quoted / len(at), np.log1p(1000 * s[kinds > 0].sum() / len(words)), 1]
                rows.append(row)
        return np.array(rows).reshape(-1, 9)


def learn_lexicon(texts: list[str], labels: list[int], least_docs: int = 8, least_odds: float = 8.0, most_terms: int = 2000) -> tuple[dict[str, float], frozenset]:
    """Terms and stems with the log of how much more often toxic documents have them, and the innocent near misses.

    A term must be more than chance among so many words: Chernoff's bound on its documents being toxic so often,
    times the number of words, stays below a tenth."""
    docs = [({b for w in set(t.split()) if (b := bare(w))}, y) for t, y in zip(texts, labels, strict=True)]
    n = Counter(y for _, y in docs)
    if not n[0] or not n[1]:
        return {}, frozenset()
    word, stem, kinds = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(set)
    for ws, y in docs:
        for w in ws:
            word[w][y] += 1
        for s in {w[:k] for w in ws for k in range(4, min(len(w), 9))}:
            stem[s][y] += 1
    odds = lambda c: ((c[1] + 0.1) / (n[1] + 0.2)) / ((c[0] + 0.5) / (n[0] + 1))
    least_docs = max(3, min(least_docs, n[1] // 40))  # fewer where the sample is small
    share, tries = n[1] / (n[0] + n[1]), np.log(10 * len(word))

    def certain(c: list[int]) -> bool:
        kl = sum(k * np.log(k / (c[0] + c[1]) / p) for k, p in ((c[1], share), (c[0], 1 - share)) if k)
        return kl >= tries

    good = {w: odds(c) for w, c in word.items() if c[1] >= least_docs and len(w) >= 4 and odds(c) >= least_odds and certain(c)}
    for w in word:
        for k in range(4, min(len(w), 9)):
            if w[:k] in stem:
                kinds[w[:k]].add(w)
    stems: dict[str, float] = {}
    for s, c in sorted(stem.items(), key=lambda x: (len(x[0]), x[0])):
        # a stem stands for many endings; one word with its own endings (idiot, idiots) stays a word
        if c[1] >= 2 * least_docs and odds(c) >= least_odds and certain(c) and len(kinds[s]) >= 4 and not any(s[:k] in stems for k in range(4, len(s))):
            if max(word[w][1] for w in kinds[s]) < 0.7 * c[1]:
                stems[s] = odds(c)
    terms = {w: o for w, o in good.items() if not any(w[:k] in stems for k in range(4, len(w)))} | {s + "*": o for s, o in stems.items()}
    terms = {t: float(np.log(o)) for t, o in sorted(terms.items(), key=lambda x: (-x[1], x[0]))[:most_terms]}
    trie = FuzzyTrie([t for t in terms if not t.endswith("*")], [])
    innocent = frozenset(w for w, c in word.items() if c[0] and odds(c) < least_odds and trie.match(w))
    return terms, innocent


def fit_toxicity(df: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 2500, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from at most `most` labelled documents of each class (weighted to the classes' shares among all labels).
    Without labels of both classes nothing is learned and every text gets the share of toxic labels, or 0."""
    got = labelled_sample(df, labels, label, most, id_col, text_col)
    share = {r[label]: r["count"] for r in labels.filter(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    return train_toxicity(got["text"].tolist(), got["label"].tolist(), share)


def train_toxicity(texts: list[str], labels: list[int], share: dict[int, int]) -> ToxicityModel:
    terms, innocent = learn_lexicon(texts, labels)
    y = np.array(labels, dtype=float)
    x = ToxicityScorer(terms, innocent).features(texts)
    total = max(1, share.get(0, 0) + share.get(1, 0))
    if not terms:
        p = min(max(share.get(1, 0) / total, 1e-6), 1 - 1e-6)
        return ToxicityModel({}, innocent, np.zeros(9), np.ones(9), np.zeros(9), float(np.log(p / (1 - p))))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    weight = np.where(y == 1, share.get(1, 0) / max(1, (y == 1).sum()), share.get(0, 0) / max(1, (y == 0).sum()))
    weight = weight / weight.sum()
    w, b = np.zeros(9), 0.0
    for _ in range(3000):
        g = weight * (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y)
        w -= 2.0 * (z.T @ g + 1e-4 * w)
        b -= 2.0 * g.sum()
    return ToxicityModel(terms, innocent, mean, scale, w, float(b))


def model_scores(model: ToxicityModel, scorer: ToxicityScorer, texts: list[str]) -> np.ndarray:
    z = (scorer.features(texts) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(z @ model.weights + model.bias, -30, 30)))


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1, higher: toxic likelier) and predicted (1 if score >= 0.5, else 0); columns of these
    names are replaced. Null and empty texts get the score of a text without matches."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most most_terms terms and the sample's near misses

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        scorer = ToxicityScorer(m.terms, m.innocent)
        for texts in batches:
            yield pd.Series(model_scores(m, scorer, list(texts)), dtype="float64")

    made = F.pandas_udf(score, "double")(clean_text(text_col))
    return df.withColumn("score", made).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

"""Similarity self-join of documents on word n-grams, by chosen paths.

Texts become sets of word n-grams, and sets become minhash signatures. A run starts with all sets at the root;
at each node a set goes to the children of sampled signature entries, by a hash that all sets at the node share, so that
similar sets go the same ways. Nodes of few sets are leaves. A node whose sets agree in most signature entries, or that
hardly shrank from the node above, is dense: splitting it would only copy it, so it is a leaf too, compared in blocks if it is
large. Runs repeat until a pair at the threshold meets in
some leaf with the target recall.

Within a leaf, sketches pick pairs, and the n-gram sets themselves decide. A pair that meets in several leaves belongs to
the least of them, so every link counts once, without listing pairs: what leaves a leaf is, of each text, its number of links and
one edge of a spanning forest. Texts that are equal are one node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BatchMemo, chunks, clean_text, forget, gram_hashes, hash_words, written
from .components import connected_components

ENTRIES = 128  # of a signature
SKETCH = 64  # bytes of a sketch
#: Of SKETCH entries, so many agree at least for all but one in a million pairs of similarity 0.8 (mean 51, deviation 3.2).
LEAST_AGREE = 35
_A = np.random.default_rng(11).integers(1, 1 << 63, ENTRIES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LAST = np.iinfo(np.int64).max
BITS = 16  # of a signature, one of each of its first entries, by which a node's density is told


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def runs_for(target: float, boost: float) -> int:
    """Runs after which a pair at the threshold has met with the target recall, if paths are of any length: in one run it
    goes on with probability q, where q = 1 - exp(-boost * q)."""
    q = 1.0
    for _ in range(200):
        q = 1 - math.exp(-boost * q)
    return math.ceil(math.log(1 - target) / math.log(1 - q))


class Shingler:
    def __init__(self, n: int):
        self.n, self.memo = n, BatchMemo(hash_words, most=400_000)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The sorted set of n-gram hashes of each text; a text of fewer words has one, of all of them."""
        for part in chunks(texts):
            split = [t.split() for t in part]
            self.memo.know({w for ws in split for w in ws})
            for ws in split:
                h = np.fromiter(map(self.memo.__getitem__, ws), np.uint64, len(ws))
                yield np.unique(gram_hashes(h, min(self.n, len(h)))) if len(h) else h


def signature(grams: np.ndarray) -> np.ndarray:
    """Minhash entries, 32 bits each, so that unlike sets hardly ever agree by chance, however many there are."""
    least = np.full(ENTRIES, np.iinfo(np.uint64).max, np.uint64)
    mixed = _mixed(grams)
    for at in range(0, len(mixed), 2048):
        np.minimum(least, np.multiply.outer(_A, mixed[at : at + 2048]).min(1), out=least)
    return (_mixed(least) >> np.uint64(32)).astype(np.uint32)


def _children(paths: np.ndarray, signatures: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child nodes: each entry of a row's signature is chosen with this chance, by a hash of path, place and value."""
    entry = signatures.astype(np.uint64) + (np.arange(ENTRIES, dtype=np.uint64) << np.uint64(32))[None, :]
    h = _mixed(paths[:, None] * _MIX + entry)
    row, col = np.nonzero(h < np.uint64(int(chance * 2**64)))
    return row, _mixed(h[row, col] + np.uint64(1)).view(np.int64)


def _bits(signatures: np.ndarray) -> np.ndarray:
    """The lowest bit of each of the first BITS entries."""
    return ((signatures[:, :BITS] & 1).astype(np.int32) << np.arange(BITS, dtype=np.int32)).sum(1, dtype=np.int32)


def _agreement() -> Column:
    """How alike the sets of a node are, as an aggregate: the mean square of what one value of a bit is ahead of the other.

    It is about the share of pairs with equal entries: near 0 for unlike sets, and at least 0.6 where pairs are of similarity 0.8."""
    ahead = [2 * F.avg(F.shiftright("bits", k).bitwiseAND(1)) - 1 for k in range(BITS)]
    return sum((a * a for a in ahead[1:]), ahead[0] * ahead[0]) / BITS


def _whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of sorted batches, cut only between groups."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[by].to_numpy()
        last = np.nonzero((keys != keys[-1]).any(1))[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut == 0 and held and (held[-1][by].to_numpy()[-1] == keys[0]).all():
            held.append(pdf)
            continue
        if cut or held:
            if cut == 0:
                yield pd.concat(held)
            else:
                yield pd.concat([*held, pdf.iloc[:cut]])
            held = []
        held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held)


_GROUP = ["bucket", "p", "q"]


def _candidate_pairs(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group each whose sketches agree; with a column buckets (each row's leaves), only those whose least common leaf this is."""
    keys = pdf[_GROUP].to_numpy()
    begin = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1, [len(pdf)]])
    end = np.repeat(begin[1:], np.diff(begin))
    later = end - np.arange(len(pdf)) - 1
    sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), SKETCH)
    block, across = pdf["block"].to_numpy(), (pdf["p"] != pdf["q"]).to_numpy()
    owned = _Owned(pdf["bucket"].to_numpy(), pdf["buckets"].tolist(), begin) if "buckets" in pdf else None
    at = 0
    total = np.cumsum(later)
    while at < len(pdf):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 400_000)))
        n = later[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = to
        same_side = across[i] & (block[i] == block[j])
        i, j = i[~same_side], j[~same_side]
        if owned is not None:  # cheap for large groups, whose pairs have mostly met before
            first = owned.in_large(i, j)
            i, j = i[first], j[first]
        alike = np.zeros(len(i), np.int16)
        for a in range(0, len(i), 50_000):
            alike[a : a + 50_000] = (sketch[i[a : a + 50_000]] == sketch[j[a : a + 50_000]]).sum(1)
        i, j = i[alike >= LEAST_AGREE], j[alike >= LEAST_AGREE]
        if owned is not None:
            first = owned.in_small(i, j)
            i, j = i[first], j[first]
        if len(i):
            yield i, j


class _Owned:
    """Whether no earlier leaf holds both rows of a pair: by a matrix for groups of many rows, by their lists for the others."""

    LARGE = 64

    def __init__(self, own: np.ndarray, lists: list[np.ndarray], begin: np.ndarray):
        self.own, self.begin, self.sizes = own, np.repeat(begin[:-1], np.diff(begin)), np.repeat(np.diff(begin), np.diff(begin))
        self.leaves = np.full((len(lists), max(map(len, lists))), _LAST, np.int64)
        for r, x in enumerate(lists):
            self.leaves[r, : len(x)] = x
        self.step = max(1, 2_000_000 // self.leaves.shape[1] ** 2)
        self.met = {int(b): self._met(int(b), int(e)) for b, e in zip(begin[:-1], begin[1:], strict=True) if e - b > self.LARGE}

    def _met(self, begin: int, end: int) -> np.ndarray:
        """Of rows begin to end, which pairs share a leaf before this one."""
        rows = self.leaves[begin:end]
        row, col = np.nonzero(rows < self.own[begin])
        name, leaf, times = np.unique(rows[row, col], return_inverse=True, return_counts=True)
        row, leaf = row[times[leaf] > 1], leaf[times[leaf] > 1]
        met = np.zeros((end - begin, end - begin), bool)
        for a in range(0, len(name), 2048):
            here = (leaf >= a) & (leaf < a + 2048)
            if here.any():
                part = np.zeros((end - begin, 2048), np.float32)
                part[row[here], leaf[here] - a] = 1
                met |= part @ part.T > 0
        return met

    def in_large(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        first = np.ones(len(i), bool)
        for b, met in self.met.items():
            lo, hi = np.searchsorted(i, [b, b + len(met)])  # i ascends
            first[lo:hi] = ~met[i[lo:hi] - b, j[lo:hi] - b]
        return first

    def in_small(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        first = np.ones(len(i), bool)
        at = np.flatnonzero(self.sizes[i] <= self.LARGE)
        for a in range(0, len(at), self.step):
            k = at[a : a + self.step]
            x, y = self.leaves[i[k]], self.leaves[j[k]]
            earlier = (x[:, :, None] == y[:, None, :]) & (x < self.own[i[k]][:, None])[:, :, None]
            first[k] = ~earlier.any((1, 2))
        return first


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j."""
    if len(i) <= 4:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    place = {int(u): k for k, u in enumerate(used)}
    grams, col = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    twice = np.bincount(col) > 1  # only what two of them share counts
    new = np.cumsum(twice) - 1
    row, col = row[twice[col]], new[col[twice[col]]]
    both = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for a in range(0, int(twice.sum()), 4096):
        lo, hi = np.searchsorted(col, [a, a + 4096])
        part = np.zeros((len(used), 4096), np.float32)
        part[row[lo:hi], col[lo:hi] - a] = 1
        both += part @ part.T
    pi, pj = ([place[int(x)] for x in ii] for ii in (i, j))
    return both[pi, pj].astype(np.int64)


def _roots(root: np.ndarray) -> np.ndarray:
    while (root[root] != root).any():
        root = root[root]
    return root


def _join(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Make each pair one tree; pairs that are so already cost no step in Python."""
    for a in range(0, len(x), 4000):
        now = _roots(root)
        root[:] = now
        for u, v in zip(*(z[now[x[a : a + 4000]] != now[y[a : a + 4000]]].tolist() for z in (x[a : a + 4000], y[a : a + 4000])), strict=True):
            while root[u] != u:
                u = root[u]
            while root[v] != v:
                v = root[v]
            root[max(u, v)] = min(u, v)


def jaccard_classes(df: DataFrame, n: int = 5, similarity: tuple[int, int] = (4, 5), target: float = 0.9999, boost: float = 1.5, leaf: int = 48, block: int = 512, levels: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per different text: key (its md5), copies, first_id (its least id), n_links and class_id.

    Two texts link if the Jaccard similarity of their sets of n-grams of words (runs of other than white space) is at least
    similarity[0] / similarity[1]. n_links: documents that a document of this text links to, its own copies among them. class_id: the
    least id of all documents that links connect it with. A text without words links to nothing, not to its copies either (n_links 0),
    and its class_id is null. Null texts count as empty; null ids count in copies and links and are no class's id; rows with one id are documents
    of their own. A pair at the threshold is found with at least the target recall, a more similar one more surely.
    Bounds: a task holds groups of at most 2 * block sets; leaves that are larger are compared block by block."""
    spark = df.sparkSession
    least = similarity[0] / similarity[1]
    runs, chance = runs_for(target, boost), boost / (least * ENTRIES)
    text = clean_text(text_col)
    docs = df.select(F.unhex(F.md5(text.cast("binary"))).alias("key"), F.col(id_col).cast("long").alias("id"), text.alias("text"))

    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for texts in batches:
            rows = []
            for grams in shingle(list(texts)):
                rows.append((len(grams), (signature(grams) if len(grams) else np.zeros(ENTRIES, np.uint32)).tobytes()))
            yield pd.DataFrame(rows, columns=["n", "signature"])

    signed = docs.select("key", "id", F.pandas_udf(sign, "n long, signature binary")("text").alias("s"))
    nodes = signed.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.first("s").alias("s"))
    # Different texts are numbered as they are written; all later steps move these numbers instead of keys.
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("num"), "key", "copies", "first_id", "s.*"), "nodes")
    leaves = _leaves(nodes.filter("n > 0").select("num", "signature"), runs, chance, leaf, levels)

    # Each text in each of its leaves and, in a large leaf, in each pair of blocks that its own is of.
    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            entries = np.frombuffer(b"".join(pdf["signature"]), np.uint32).reshape(len(pdf), ENTRIES)
            yield pd.DataFrame({"num": pdf["num"], "copies": pdf["copies"], "sketch": [e.tobytes() for e in entries[:, :SKETCH].astype(np.uint8)]})

    blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    placed = leaves.select("num", "bucket", blocks.alias("blocks"), F.pmod(F.xxhash64("num"), blocks).cast("int").alias("block"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("num", "bucket", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    sketch = written(nodes.filter("n > 0").select("num", "copies", "signature").mapInPandas(sketches, "num long, copies long, sketch binary"), "sketches")

    def involved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches, _GROUP):
            some = np.zeros(len(pdf), bool)
            for i, j in _candidate_pairs(pdf):
                some[i] = some[j] = True
            yield pdf[some]

    def dealt(d: DataFrame) -> DataFrame:
        return d.repartition(*_GROUP).sortWithinPartitions(*_GROUP)

    # First the texts that have an alike one in a leaf; then, as these know all their leaves, those that have one whose least common leaf it is.
    # Alike texts are alike in every leaf that they meet in, so no leaf that counts is missed. Large leaves, of alike sets, count as they are.
    here = leaves.filter(F.col("m") <= block).select("num", "bucket", F.lit(0).alias("block"), F.lit(0).alias("p"), F.lit(0).alias("q")).join(sketch, "num")
    met = dealt(here).mapInPandas(involved, here.schema).select("num", "bucket").unionByName(leaves.filter(F.col("m") > block).select("num", "bucket"))
    met = written(met, "met")
    lists = met.groupBy("num").agg(F.sort_array(F.collect_set("bucket")).alias("buckets")).join(sketch, "num")
    here = placed.join(met, ["num", "bucket"]).join(lists, "num")
    candidates = written(dealt(here).mapInPandas(involved, here.schema), "candidates")
    forget(leaves, sketch, met)

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for pdf in batches:
            yield pd.DataFrame({"num": pdf["num"], "grams": [g.tobytes() for g in shingle(pdf["text"].tolist())]})

    # The text of each candidate is read from its first document, so that copies are not shuffled.
    wanted = candidates.select("num").distinct().join(nodes.select("num", "key", F.col("first_id").alias("id")), "num")
    wanted = written(wanted.select("num", F.col("key").alias("__key"), F.col("id").alias("__id")), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= 500_000 else wanted  # 32 bytes a row
    texts = docs.join(few, (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id"))).select("num", "text")
    sets = texts.mapInPandas(shingles, "num long, grams binary").dropDuplicates(["num"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches, _GROUP):
            group = np.concatenate([[0], np.cumsum((pdf[_GROUP].to_numpy()[1:] != pdf[_GROUP].to_numpy()[:-1]).any(1))])
            sets_ = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
            size = np.array([len(s) for s in sets_])
            copies, links, root = pdf["copies"].to_numpy(), np.zeros(len(pdf), np.int64), np.arange(len(pdf))
            for i, j in _candidate_pairs(pdf):
                for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate([[0], np.nonzero(np.diff(group[i]))[0] + 1, [len(i)]])), strict=True):
                    x, y = i[a:b], j[a:b]
                    shared = _overlaps(sets_, x, y)
                    linked = similarity[1] * shared >= similarity[0] * (size[x] + size[y] - shared)
                    x, y = x[linked], y[linked]
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    _join(root, x, y)
            some = np.nonzero(links)[0]
            nums = pdf["num"].to_numpy()
            yield pd.DataFrame({"num": nums[some], "links": links[some], "root": nums[_roots(root)[some]]})

    linked = written(dealt(candidates.join(sets, "num")).mapInPandas(verify, "num long, links long, root long"), "linked")
    forget(candidates, wanted)
    roots = connected_components(linked.select(F.col("num").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("num").agg(F.sum("links").alias("links"))
    named = nodes.select("num", "key", "copies", "first_id", "n").join(roots.withColumnRenamed("node", "num"), "num", "left").join(counts, "num", "left")
    named = written(named.withColumn("root", F.coalesce("root", "num")), "classes")
    forget(nodes, linked, roots)
    least_id = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    words = F.col("n") > 0
    return named.join(least_id, "root").select("key", "copies", "first_id", F.when(words, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("n_links"), F.when(words, F.col("class_id")).alias("class_id"))


def _leaves(nodes: DataFrame, runs: int, chance: float, leaf: int, levels: int) -> DataFrame:
    """num, bucket and m (sets at that node) for each set and leaf that it comes to with others, over all runs."""

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                sig = np.frombuffer(b"".join(part["signature"]), np.uint32).reshape(len(part), ENTRIES)
                for r in range(runs):
                    row, child = _children(np.full(len(part), r + 1, np.uint64), sig, chance)
                    yield pd.DataFrame({"bucket": child, "num": part["num"].to_numpy()[row], "above": _LAST})

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                sig = np.frombuffer(b"".join(part["signature"]), np.uint32).reshape(len(part), ENTRIES)
                row, child = _children(part["bucket"].to_numpy().view(np.uint64), sig, chance)
                yield pd.DataFrame({"bucket": child, "num": part["num"].to_numpy()[row], "above": part["m"].to_numpy()[row]})

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"num": pdf["num"], "bits": _bits(np.frombuffer(b"".join(pdf["signature"]), np.uint32).reshape(len(pdf), ENTRIES))})

    rows_of = "bucket long, num long, above long"
    at, out, density = nodes.mapInPandas(begin, rows_of), None, None
    for level in range(1, levels + 1):
        at = written(at, "paths")
        sizes = at.groupBy("bucket").agg(F.count("*").alias("m"), F.max("above").alias("above")).filter("m > 1")
        sizes = written(sizes, "sizes")
        met = written(at.select("bucket", "num").join(sizes, "bucket"), "met")
        forget(at, sizes)
        large = F.col("m") > leaf
        here = met.filter(~large).select("num", "bucket", "m")
        # Large nodes only: how alike their sets are, from a bit of each of some entries.
        if density is None:
            density = written(nodes.mapInPandas(bits, "num long, bits int"), "bits")
        stays = (F.col("agree") > 0.5) | (F.col("m") > F.col("above") / 2) | F.lit(level == levels)
        of_large = met.filter(large).join(density, "num").groupBy("bucket").agg(F.count("*").alias("m"), F.max("above").alias("above"), _agreement().alias("agree"))
        of_large = written(of_large.select("bucket", stays.alias("stays")), "large")
        last = met.filter(large).join(of_large, "bucket")
        here = written(here.unionByName(last.filter("stays").select("num", "bucket", "m")), "leaves")
        out = here if out is None else out.unionByName(here)
        if level == levels or of_large.filter("not stays").isEmpty():
            break
        at = last.filter("not stays").select("num", "bucket", "m").join(nodes, "num").mapInPandas(descend, rows_of)
    return out


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of df: doc_id, class_id, n_links; see jaccard_classes. A document without words is its own class."""
    classes = jaccard_classes(df, id_col=id_col, text_col=text_col, **options)
    docs = df.select(F.unhex(F.md5(clean_text(text_col).cast("binary"))).alias("key"), F.col(id_col).cast("long").alias("doc_id"))
    return docs.join(classes.select("key", "class_id", "n_links", F.col("first_id").isNull().alias("none")), "key").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without the near duplicates: of each class the document of the least id stays, and of its repeated rows one.

    Documents without words all stay, as do those of classes without any id, once per text."""
    classes = jaccard_classes(df, id_col=id_col, text_col=text_col, **options)
    best = classes.filter("class_id is not null").groupBy("class_id").agg(F.min(F.when(F.col("first_id") == F.col("class_id"), F.hex("key"))).alias("best"))
    stay = classes.join(best, "class_id", "left").filter("class_id is null or hex(key) = best").select(F.col("key").alias("__key"), F.col("copies").alias("__copies"), F.col("class_id").alias("__class"))
    keyed = df.withColumn("__key", F.unhex(F.md5(clean_text(text_col).cast("binary")))).join(stay, "__key")
    empty = F.length(F.translate(clean_text(text_col), " \t\n\x0b\x0c\r", "")) == 0
    keyed = keyed.filter(empty | F.col("__class").isNull() | (F.col(id_col) == F.col("__class")))
    single = keyed.filter(empty | (F.col("__copies") == 1))
    several = keyed.filter(~empty & (F.col("__copies") > 1)).dropDuplicates(["__key"])
    return single.unionByName(several).select(*(F.col(f"`{c}`") for c in df.columns))

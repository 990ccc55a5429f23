"""Best-fit packing of token pieces into fixed-length sequences, by hierarchical residual packing.

Each partition tokenizes its documents and packs its pieces by best fit, longest first. Bins that are
nearly full are final. The others travel on as items of their own: in each further round they are dealt
into groups of bounded size and best-fit packed again, so that no task ever holds more than one group.
Rounds end when one group is left or a round no longer saves a noticeable share of the bins.

A bin carries the list of its pieces (at most `capacity` of them), so a merge only concatenates lists and
no chain of bins has to be followed afterwards.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, clean_text, written

_ODD = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ", "\xa0", " ", "　")


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file (tokenizers JSON), kept per word.

    A word is what stands between two single spaces, with the space before it. Where a text has other
    runs of white space, or a special string, the whole text goes through the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in made["added_tokens"]]
        plain = [c for c in (*range(33, 127), *range(161, 173), *range(174, 256))]  # bytes that stand for themselves in the file
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(shown[c] for c in t): i for t, i in made["model"]["vocab"].items() if t not in self.special}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids beyond 16 bits")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the file's byte-level pre-tokenizer
        self.words = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo = Memo(lambda word: np.array(self.words.encode_ordinary(word), dtype=np.uint16).tobytes(), most=300_000)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if any(x in text for x in (*_ODD, *self.special)) or text[0] == " " or text[-1] == " " or (not text.isascii() and any(c.isspace() and c > "\x7f" for c in set(text))):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        first, *rest = text.split(" ")
        memo = self.memo
        return np.frombuffer(memo[first] + b"".join([memo[" " + w] for w in rest]), np.uint16).astype(np.uint32)


_TOKENIZERS: dict[str, ByteBpe] = {}


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling length (ties in their order), each into the open bin that it fills best."""
    room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    some = 0  # bit r: there is a bin with room r
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            at = room[r].pop()
            if not room[r]:
                some ^= 1 << r
            at.append(i)
        else:
            r, at = capacity, [i]
            bins.append(at)
        room[r - n].append(at)
        some |= 1 << (r - n)
    return bins


_PIECE = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
_BIN = f"used long, pieces array<struct<{_PIECE.replace(' ', ': ')}>>".replace(",: ", ", ")


def _pack(items: list[tuple[int, list]], capacity: int) -> pd.DataFrame:
    """Bins of (used, pieces) items."""
    made = best_fit(np.array([n for n, _ in items], dtype=np.int64), capacity)
    return pd.DataFrame({"used": [sum(items[i][0] for i in b) for b in made], "pieces": [[p for i in b for p in items[i][1]] for b in made]})


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, nearly_full: float = 0.995, group_bins: int = 50_000, least_gain: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id after them; a null text is end_id alone. One of at most `capacity`
    ids is one piece. A longer one is cut into pieces of `capacity`, the first of which is the rest and may be shorter.
    Sequences hold at most `capacity` ids and have no gaps. Rows with one id twice, or with a null id, are documents of their own.
    Bounds: a task holds the piece lengths of one input partition, or group_bins bins; no ids are kept or shuffled."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text_col).alias("text"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _TOKENIZERS.get(tokenizer_path) or _TOKENIZERS.setdefault(tokenizer_path, ByteBpe(tokenizer_path))
        items: list[tuple[int, list]] = []
        row = TaskContext.get().partitionId() << 33  # numbers the pieces
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                ids = np.append(bpe.ids(text), end_id).astype("<u4")
                cut = len(ids) % capacity or capacity
                for k, (a, b) in enumerate(zip([0, *range(cut, len(ids), capacity)], [*range(cut, len(ids), capacity), len(ids)], strict=True)):
                    items.append((b - a, [(None if doc != doc else int(doc), row, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))]))
                    row += 1
            if len(items) >= 4 * group_bins:
                yield _pack(items, capacity)
                items = []
        if items:
            yield _pack(items, capacity)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: list[tuple[int, list]] = []
        for pdf in batches:
            items += [(int(n), [tuple(p[f] for f in ("doc_id", "row", "piece", "start", "length", "ids_crc32")) for p in ps]) for n, ps in zip(pdf["used"], pdf["pieces"], strict=True)]
            if len(items) >= 2 * group_bins:
                yield _pack(items, capacity)
                items = []
        if items:
            yield _pack(items, capacity)

    final: list[DataFrame] = []
    bins = written(docs.mapInPandas(local, _BIN), "bins")
    under = F.col("used") < int(nearly_full * capacity)
    left = bins.filter(under).count()
    while left > 1:
        final.append(bins.filter(~under))
        groups = -(-left // group_bins)
        first = F.element_at("pieces", 1)
        dealt = bins.filter(under).repartition(groups, F.xxhash64(first["row"], F.lit(len(final)))) if groups > 1 else bins.filter(under).coalesce(1)
        bins = written(dealt.mapInPandas(again, _BIN), "bins")
        now = bins.count()
        under = F.col("used") < int(nearly_full * capacity)
        if groups == 1 or now > left * (1 - least_gain):
            break
        left = bins.filter(under).count()
    final.append(bins)
    packed = final[0]
    for more in final[1:]:
        packed = packed.unionByName(more)
    lengths = F.transform("pieces", lambda p: p["length"])
    placed = F.aggregate(
        lengths,
        F.struct(F.array().cast("array<long>").alias("at"), F.lit(0).cast("long").alias("sum")),
        lambda a, n: F.struct(F.concat(a["at"], F.array(a["sum"])).alias("at"), (a["sum"] + n).alias("sum")),
    )["at"]
    first = F.element_at("pieces", 1)
    out = packed.select(first["row"].alias("sequence_id"), F.explode(F.arrays_zip("pieces", placed.alias("at"))).alias("p"))
    return out.select(*(F.col(f"p.pieces.{c}").alias(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), "sequence_id", F.col("p.at").alias("offset"))

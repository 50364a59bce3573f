"""Evaluation texts leaking into training text.

Word n-grams of the items seed the search. Every n-gram of an item is a seed: an edited copy lacks the n-grams across its edits, so
whichever n-grams were picked, a copy could lack just those. Where a document holds two seeds of an item on nearly one diagonal (four
words in a row, or two times three), item and document are aligned by Smith-Waterman in a band around it; the score tells edited
copies, and the longest run of equal words on the alignment tells passages that are copied outright. Two seeds are rare together, where
one of three words is not, and every run of `passage` words has them.

Words are maximal runs of ASCII letters and digits in lower case. Defined results: null and empty texts hold no words; an item with
fewer than `passage` words has no seeds; repeated rows count once; whole texts of any length are used; an empty table on either side
gives no rows; extra columns are ignored. The items are held by every task in blocks of `block_bytes`: more items are more passes over
the documents. A copy whose words are moved by more than `slack` is scored in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive word numbers."""
    k = len(ids) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    h = np.zeros(k, np.uint64)
    for j in range(n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[j : j + k]
    return h


class Items:
    """The evaluation items as word numbers, with the table of their n-grams."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n = n
        texts = {i: words(t) for i, t in rows}
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts.values() for w in t}))}
        self.ids = {i: np.array([self.vocabulary[w] for w in t], np.int64) for i, t in texts.items()}
        grams = [_grams(x, n) for x in self.ids.values()]
        self.table = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)

    @classmethod
    def of(cls, values: dict) -> Items:
        own = cls.__new__(cls)
        own.__dict__.update(values)
        return own

    def document(self, text: str | None) -> np.ndarray:
        """The text's words as numbers; -1 is a word of no item."""
        get = self.vocabulary.get
        w = words(text)
        return np.fromiter((get(x, -1) for x in w), np.int64, len(w))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document whose n words are an n-gram of some item, and the n-gram's number."""
        n = self.n
        if len(ids) < n or not len(self.table):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ok = ids >= 0
        run = np.cumsum(np.concatenate([[0], ok]))
        at = np.flatnonzero(run[n:] - run[:-n] == n)
        if not len(at):
            return at, at
        g = _grams(ids, n)[at]
        k = np.minimum(np.searchsorted(self.table, g), len(self.table) - 1)
        same = self.table[k] == g
        return at[same], k[same]


def _align(a: np.ndarray, b: np.ndarray, match: float, miss: float, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Banded Smith-Waterman of many pairs at once: a [pairs, rows] against b [pairs, rows + width], padded with -2 and -1; row i meets
    columns i to i + width.

    Returns each pair's best score and its longest run of equal words. A row is one step: the gap within a row is a running maximum."""
    p, rows = a.shape
    width = b.shape[1] - rows + 1
    h, run = np.zeros((p, width + 1), np.float32), np.zeros((p, width), np.int32)
    best, longest = np.zeros(p, np.float32), np.zeros(p, np.int32)
    slope = (gap * np.arange(width)).astype(np.float32)
    for i in range(rows):
        same = a[:, i : i + 1] == b[:, i : i + width]
        # one step down in both is the same place in the band, one step down in a alone the next
        new = np.maximum(h[:, :-1] + np.where(same, np.float32(match), np.float32(-miss)), h[:, 1:] - np.float32(gap))
        np.maximum(new, 0, out=new)
        h[:, :-1] = np.maximum.accumulate(new + slope, axis=1) - slope
        run = np.where(same, run + 1, 0)
        np.maximum(best, h[:, :-1].max(1), out=best)
        np.maximum(longest, run.max(1), out=longest)
    return best, longest


def leaks(items: DataFrame, documents: DataFrame, passage: int = 12, n: int = 3, match: float = 1.0, miss: float = 1.0, gap: float = 1.0, block_bytes: int = 32_000_000, slack: int = 24) -> DataFrame:
    """item_id, doc_id, score (best local alignment, in words), run (longest run of equal words) of each pair with seeds in common."""
    held = items.select("item_id", "text").filter("item_id is not null").distinct()
    size = held.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts, got = max(1, -(-size // block_bytes)), None
    for k in range(parts):
        block = held if parts == 1 else held.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        one = _pass(block, documents, passage, n, match, miss, gap, slack)
        got = one if got is None else got.unionByName(one)
    return got.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"), F.max("run").alias("run"), F.min("at").alias("first_word"))


def _pass(items: DataFrame, documents: DataFrame, passage: int, n: int, match: float, miss: float, gap: float, slack: int) -> DataFrame:
    """item_id, doc_id, at, score, run of every alignment of the items of one block."""
    spark = documents.sparkSession
    it = Items([tuple(r) for r in items.collect()], n)  # no more than block_bytes
    held = spark.sparkContext.broadcast(vars(it))  # plain values: a broadcast is unpickled without this package
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")

    places: dict[int, list[tuple[int, int]]] = {}
    for item, ids in it.ids.items():
        if len(ids) >= passage:
            for q, k in enumerate(np.searchsorted(it.table, _grams(ids, n)).tolist()):
                places.setdefault(k, []).append((item, q))
    seeds = spark.sparkContext.broadcast(places)

    def jobs_of(at: list[int], grams: list[int], where: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
        """(item, least, greatest diagonal) of each band of diagonals with two seeds."""
        bands: dict[tuple[int, int], list[int]] = {}
        for p, k in zip(at, grams, strict=True):
            for item, q in where.get(k, ()):
                d = p - q
                old = bands.get((item, d // slack))
                if old is None:
                    bands[item, d // slack] = [d, d, p, p]
                else:
                    old[0], old[1], old[3] = min(old[0], d), max(old[1], d), p
        beside = lambda item, band: (item, band - 1) in bands or (item, band + 1) in bands
        return [(item, lo, hi) for (item, band), (lo, hi, first, last) in bands.items() if first != last or beside(item, band)]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, where = Items.of(held.value), seeds.value
        for b in batches:
            todo: list[tuple[int, int, int, np.ndarray]] = []
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = own.document(t)
                at, g = own.hits(ids)
                for item, lo, hi in jobs_of(at.tolist(), g.tolist(), where):
                    # the words that the item's rows can meet between the diagonals lo - slack and hi + slack
                    a, e = lo - slack, hi + slack + len(own.ids[item])
                    near = np.full(e - a, -1, np.int32)
                    from_, to = max(0, a), min(len(ids), e)
                    near[from_ - a : to - a] = ids[from_:to]
                    todo.append((item, doc, from_, near))
            todo.sort(key=lambda j: (len(j[3]) - len(own.ids[j[0]]), len(j[3])))
            out: list[tuple[int, int, int, float, int]] = []
            for s in range(0, len(todo), 256):
                part = todo[s : s + 256]
                a = [own.ids[j[0]] for j in part]
                rows, width = max(map(len, a)), max(len(j[3]) - len(x) for j, x in zip(part, a, strict=True))
                pa_, pb = np.full((len(part), rows), -2, np.int32), np.full((len(part), rows + width), -1, np.int32)
                for r, (x, j) in enumerate(zip(a, part, strict=True)):
                    pa_[r, : len(x)] = x
                    pb[r, : len(j[3])] = j[3]
                score, run = _align(pa_, pb, match, miss, gap)
                out += [(i, x, f, float(v), int(u)) for (i, x, f, _), v, u in zip(part, score, run, strict=True)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["item_id", "doc_id", "at", "score", "run"])

    return docs.mapInArrow(align, "item_id long, doc_id long, at long, score double, run long")

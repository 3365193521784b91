"""Evaluation texts inside training texts.

Items and documents are cut to windows of one size class, so that a leaked passage is
a window whose set of word shingles is wholly contained in the document's window of
the same size. Within such a class containment means equal sets, and the
MinHash of equal sets is equal: a window's candidate key is the smallest hash of
its shingles, which loses no passage. Items shorter than a passage have classes of their own length.
A bitmap of bounded size, filled with the keys of all items, tells in one pass over the corpus which windows of documents are
worth a look; only these are joined with the items' windows, by their key and
their words. The corpus itself is read once and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicry.operators.skew import salted_join
from mosaicry.scratch import materialize
from mosaicry.tables import BROADCAST_LIMIT

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
#: Bits of the key bitmap for each window of an item, and at most: 16 MB, whatever the number of items.
BITS_A_KEY, MOST_BITS = 32, 1 << 27
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return WORD.findall(text.lower()) if text else []


class _Hasher:
    """Shingle hashes of word lists; word hashes are remembered up to a bound."""

    def __init__(self, k: int) -> None:
        self.k, self.seen = k, {}

    def words(self, ws: list[str]) -> np.ndarray:
        seen, one = self.seen, xxhash.xxh64_intdigest
        if len(seen) > 500_000:
            seen.clear()
        out = []
        for w in ws:
            h = seen.get(w)
            if h is None:
                h = seen[w] = one(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def shingles(self, ws: list[str]) -> np.ndarray:
        h = self.words(ws)
        m = len(h) - self.k + 1
        s = np.zeros(max(m, 0), dtype=np.uint64)
        for j in range(self.k if m > 0 else 0):
            s = s * _P + h[j : j + m]
        s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        return s ^ (s >> np.uint64(32))

    def window_keys(self, ws: list[str], size: int) -> np.ndarray:
        """The MinHash of every window of ``size`` words; windows shorter than a shingle are one shingle."""
        k, self.k = self.k, min(self.k, size)
        s = self.shingles(ws)
        w = size - self.k + 1
        self.k = k
        keys = sliding_window_view(s, w).min(axis=1) if len(s) >= w else np.zeros(0, dtype=np.uint64)
        return keys ^ np.uint64(size * 0x9E3779B1)


def _windows(size_of, k: int):
    """A function over Arrow batches (item_id, text) giving every window of an item (item_id, size, key, words)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(k)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words_of(text)
                if size := size_of(len(ws)):
                    rows += {(i, size, key, " ".join(ws[j : j + size])) for j, key in enumerate(hasher.window_keys(ws, size).view(np.int64).tolist())}
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["item_id", "size", "key", "words"])

    return cut


def key_bitmap(windows: DataFrame) -> np.ndarray:
    """64-bit words in which the bit of every key is set; at most MOST_BITS bits reach the driver."""
    bits = 64
    want = min(MOST_BITS, BITS_A_KEY * windows.count())
    while bits < want:
        bits *= 2
    at = F.col("key").bitwiseAND(bits - 1)
    one = windows.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(key & 63 AS int))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[one.column("w").to_numpy()] = one.column("b").to_numpy().view(np.uint64)
    return out


def _candidates(bitmap: np.ndarray, sizes: list[int], k: int):
    """A function over Arrow batches (doc_id, text) giving the windows that may be an item's (doc_id, first_word, words)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, mask = _Hasher(k), np.uint64(len(bitmap) * 64 - 1)
        for b in batches:
            doc, first, words = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words_of(text)
                for size in sizes:
                    if len(ws) < size:
                        continue
                    at = hasher.window_keys(ws, size) & mask
                    for i in np.flatnonzero((bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).tolist():
                        doc.append(doc_id)
                        first.append(i)
                        words.append(" ".join(ws[i : i + size]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(words, pa.string())], names=["doc_id", "first_word", "words"])

    return search


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 12, k: int = SHINGLE, whole_short: bool = True) -> DataFrame:
    """(doc_id, item_id, first_word, containment) where a document holds ``min_words`` consecutive words of an item.

    Words are runs of letters and digits; case and what stands between them do not
    matter. ``first_word`` is where the first such passage begins in the document, ``containment`` the
    share of the item's distinct passages of that length which the document holds.
    Items of fewer words match as a whole, each length being a size class of its own, or nothing
    without ``whole_short``. Null and empty texts match nothing, repeated item ids count
    once (their rows must be equal), an item without text or id is left out.
    """
    if min_words < k:
        raise ValueError("min_words must be at least the shingle length")

    def size_of(n: int) -> int:
        return min_words if n >= min_words else n if whole_short else 0

    pairs = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).dropDuplicates(["item_id"])
    w = materialize(pairs.mapInArrow(_windows(size_of, k), "item_id long, size int, key long, words string"), "windows")
    sizes = sorted(r["size"] for r in w.select("size").distinct().collect())  # at most min_words of them
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    hit = d.mapInArrow(_candidates(key_bitmap(w), sizes, k), "doc_id long, first_word long, words string")
    n = w.groupBy("item_id").agg(F.count("*").alias("n"))
    w = materialize(w.join(n, "item_id").select("item_id", "n", "words"), "windows")
    bytes_ = w.agg(F.sum(F.length("words") * 4 + 96)).first()[0] or 0
    if bytes_ <= BROADCAST_LIMIT:
        both = hit.join(F.broadcast(w), "words")
    else:
        both = salted_join(materialize(hit, "candidates"), w, "words", "doc_id")
    # a passage that stands several times in a document counts once
    once = both.groupBy("doc_id", "item_id", "words").agg(F.min("first_word").alias("first_word"), F.first("n").alias("n"))
    return once.groupBy("doc_id", "item_id").agg(F.min("first_word").alias("first_word"), (F.count("*") / F.first("n")).alias("containment"))

"""Benchmark decontamination: item-sized windows of documents that are near an item.

A document's windows of as many words as an item has are fingerprinted (SimHash of BITS bits over five-word
shingles, weighted by how often they occur) if enough of their shingles are those of items of that length: a window at or
over `least` to an item shares a known number of shingles with it, and so with all items of its length together, which
a sliding count tells for every window. Nothing is lost by it. Fingerprints are looked up in a multi-index among the items
of that length: the bits are cut into BLOCKS blocks, and any fingerprint within the radius differs in at most
radius // BLOCKS bits in one of these, so probing those finds all of them. Of each candidate the exact
weighted-shingle similarity (sum of the smaller counts over sum of the larger) decides. At 0.8 about 19 of 128
bits differ (a standard deviation is 4), so the radius is six deviations above that; two items by chance differ in 64.

Items are broadcast in parts of at most `part_words` words, and each part is held against all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ranged

WORD = re.compile(r"\w+")
SHINGLE, BITS, BLOCKS = 5, 128, 32
BLOCK_BITS = BITS // BLOCKS
PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return list(map(str.lower, WORD.findall(text or "")))


def shingles(words: list[str]) -> list[str]:
    return [" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)] or ([" ".join(words)] if words else [])


def similarity(a: Counter, b: Counter) -> float:
    same = sum((a & b).values())
    return same / (sum(a.values()) + sum(b.values()) - same)


def votes(grams: list[str]) -> np.ndarray:
    """A row of BITS votes, 1 or -1, for each shingle."""
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(g) for g in grams), np.uint8).reshape(-1, BITS // 8)
    return np.unpackbits(hashes, axis=1, bitorder="little").astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as rows of bytes."""
    return np.packbits(sums > 0, axis=1, bitorder="little")


def shared_at_least(n: int, m: int, least: float) -> int:
    """Shingles that bags of n and m have in common at the least, if their similarity is `least`."""
    return math.ceil(least * (n + m) / (1 + least) - 1e-9)


class Items:
    """An index over benchmark items: the shingles of all, and by length their fingerprints in Hamming blocks."""

    def __init__(self, items: list[tuple[int, str]], radius: int):
        self.radius = radius
        self.words = [words_of(t) for _, t in items]
        self.ids = [i for i, _ in items]
        self.bags = [Counter(shingles(w)) for w in self.words]
        self.vocabulary: dict[str, int] = {}
        for w in self.words:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        self.short: dict[tuple[str, ...], list[int]] = defaultdict(list)  # items of fewer words than a shingle
        of_length: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(self.words):
            if len(w) >= SHINGLE:
                of_length[len(w)].append(k)
            elif w:
                self.short[tuple(w)].append(k)
        keys = {n: np.unique(np.concatenate([self.keys(np.array([self.vocabulary[x] for x in self.words[k]], np.int64)) for k in own])) for n, own in of_length.items()}
        self.key = np.concatenate([np.zeros(0, np.uint64), *keys.values()])
        self.length = np.repeat(np.array(list(keys), np.int64), [len(x) for x in keys.values()])
        order = np.argsort(self.key, kind="stable")
        self.key, self.length = self.key[order], self.length[order]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length, own in sorted(of_length.items()):
            prints = np.concatenate([packed(votes(shingles(self.words[k])).sum(axis=0, keepdims=True)) for k in own])
            self.by_length[length] = np.array(own), prints.view(np.uint64), self.blocks(prints)

    @staticmethod
    def keys(ids: np.ndarray) -> np.ndarray:
        """A key of the words at each place and the four after it."""
        n, out = len(ids) - SHINGLE + 1, np.zeros(max(0, len(ids) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            out = (out + ids[k : k + n].astype(np.uint64) + np.uint64(1)) * PRIME
        return out

    @staticmethod
    def values(prints: np.ndarray) -> np.ndarray:
        """The value of each block of each fingerprint."""
        return np.stack([prints & 15, prints >> 4], axis=2).reshape(len(prints), BLOCKS)

    def blocks(self, prints: np.ndarray) -> np.ndarray:
        """[block, value, item]: whether the item's block is within radius // BLOCKS bits of the value."""
        every = np.arange(1 << BLOCK_BITS, dtype=np.uint8)
        return np.bitwise_count(self.values(prints).T[:, None, :] ^ every[None, :, None]) <= self.radius // BLOCKS

    def near(self, length: int, windows: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place of a fingerprint, item of that length within the radius of it); so many at a time that a block's row of items stays small."""
        own, prints, blocks = self.by_length[length]
        step = max(1, (1 << 18) // (len(own) * BLOCKS))
        for lo in range(0, len(windows), step):
            some = windows[lo : lo + step]
            values, maybe = self.values(some), np.zeros((len(some), len(own)), bool)
            for b in range(BLOCKS):
                maybe |= blocks[b][values[:, b]]
            i, j = np.nonzero(maybe)
            at = np.flatnonzero(np.bitwise_count(prints[j] ^ some.view(np.uint64)[i]).sum(axis=1) <= self.radius)
            yield from zip((lo + i[at]).tolist(), own[j[at]].tolist())

    def known(self, words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(length, places whose shingle is that of an item of that length)."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(np.convolve(ids >= 0, np.ones(SHINGLE, np.int64), "valid") == SHINGLE)
        if not len(at) or not len(self.key):
            return
        keys = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            keys = (keys + ids[at + k].astype(np.uint64) + np.uint64(1)) * PRIME
        lo, hi = np.searchsorted(self.key, keys, "left"), np.searchsorted(self.key, keys, "right")
        times = hi - lo
        if not times.any():
            return
        which = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        lengths, places = self.length[which], np.repeat(at, times)
        for length in np.unique(lengths).tolist():
            yield length, places[lengths == length]

    def matches(self, text: str | None, least: float) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, start, end in code points of the text), the best window of each stretch; of items of fewer than SHINGLE words the first place."""
        words = words_of(text)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for length in {len(x) for x in self.short}:
            for s in range(len(words) - length + 1):
                for k in self.short.get(tuple(words[s : s + length]), ()):
                    best.setdefault((k, 0), (1.0, -s))
        for length, places in self.known(words) if len(words) >= SHINGLE else ():
            width = min(length, len(words)) - SHINGLE + 1
            need = shared_at_least(width, length - SHINGLE + 1, least)
            if width < need or len(places) < need:
                continue
            count = np.zeros(len(words) - SHINGLE + 2, np.int64)
            count[places + 1] = 1
            count = np.cumsum(count)
            at = np.flatnonzero(count[width:] - count[:-width] >= need)
            for part in np.split(at, np.flatnonzero(np.diff(at) > length) + 1) if len(at) else ():  # a stretch of windows that touch
                a, b = int(part[0]), min(int(part[-1]) + length, len(words))
                grams = shingles(words[a:b])
                sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(votes(grams), axis=0)])
                bags: dict[int, Counter] = {}
                for i, k in self.near(length, packed(sums[part - a + width] - sums[part - a])):
                    s = int(part[i])
                    bag = bags.get(s) or bags.setdefault(s, Counter(grams[s - a : s - a + width]))
                    sim = similarity(bag, self.bags[k])
                    if sim >= least:
                        best[k, a] = max(best.get((k, a), (0.0, 0)), (sim, -s))
        found = list(WORD.finditer(text or "")) if best else []
        return [(self.ids[k], sim, found[-s].start(), found[min(len(words), len(self.words[k]) - s) - 1].end()) for (k, _), (sim, s) in sorted(best.items())]


def parts_of(benchmark: DataFrame, part_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in lots of at most part_words words, or of one item."""
    rows = ranged(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL"), "item_id", "text")
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(r"\S+")).cast("long") + 1)
    before = rows.groupBy("pid").agg(F.sum("n").alias("s")).withColumn("before", F.sum("s").over(W.orderBy("pid")) - F.col("s"))  # a row for each part
    run = F.sum("n").over(W.partitionBy("pid").orderBy("idx")) + F.col("before")
    rows = rows.join(F.broadcast(before.select("pid", "before")), "pid").withColumn("lot", F.floor(run / part_words))
    for r in rows.groupBy("lot").count().orderBy("lot").collect():
        yield [(x.item_id, x.text) for x in rows.where(F.col("lot") == r.lot).select("item_id", "text").collect()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 44, part_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, item_id, similarity, start, end (code points): windows at or over `least`, the best of each stretch.

    Null and empty texts and items match nothing. Items of fewer than five words are one shingle, and match wherever
    their words stand; of these only the first place of a text is given. Repeated rows stay, and so do equal items
    under their own ids. An empty table on either side gives no rows.
    """
    fields = "doc_id long, item_id long, similarity double, start int, end int"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], fields)
    for lot in parts_of(benchmark, part_words):
        held = docs.sparkSession.sparkContext.broadcast(lot)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index = Items(held.value, radius)
            for b in batches:
                found = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for m in index.matches(t.as_py(), least)]
                columns = list(zip(*found)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "similarity", "start", "end"])

        out = out.union(rows.mapInArrow(run, fields))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 44, part_words: int = 2_000_000, text_col: str = "text") -> DataFrame:
    """docs without those that hold a window at or over `least`; all columns stay, and no row is moved.

    Null and empty texts stay. Of repeated rows all stay or none. An empty benchmark, or one of null and empty
    items, keeps all.
    """
    out = docs
    for lot in parts_of(benchmark, part_words):
        held = docs.sparkSession.sparkContext.broadcast(lot)
        place = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index = Items(held.value, radius)
            for b in batches:
                yield b.filter(pa.array([not index.matches(t.as_py(), least) for t in b.column(place)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out

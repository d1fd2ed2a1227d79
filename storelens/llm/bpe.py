"""Byte-level BPE: encoding by a rank file, and decoding.

A text is split by the tokenizer's pattern; each piece is merged by itself. Pieces not met before are put into
padded numpy matrices by length. In each round every row merges its leftmost pair of least rank, found through
a hashed table of pairs, and is compacted by one place; rows without a pair left leave the matrix. Pieces over
LONG bytes, for which such rounds would cost the square of their length, are merged in the same order through
a heap instead. Ids are those of the tiktoken library without special tokens.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 256
NONE = np.int32(2**31 - 1)
#: Pieces whose ids a worker remembers, and the longest of these in characters.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48
#: A text is split in one go up to so many characters.
WHOLE = 1 << 18


class Tokenizer:
    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.shift = np.uint64(64 - (max(16, (len(self.ranks) * 8).bit_length())))
        self._hash_pairs()
        self.seen: dict[str, bytes] = {}
        self.odd: set[str] = set()

    def _hash_pairs(self) -> None:
        """An open-addressing table: left id << 32 | right id -> rank of both together."""
        pairs = {self.ranks[t[:k]] << 32 | self.ranks[t[k:]]: r for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        size = 1 << (64 - int(self.shift))
        self.keys, self.values, self.probes = np.full(size, 2**63, np.uint64), np.full(size, NONE, np.int32), 0
        key, rank = np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(key)
        while len(key):
            self.probes += 1
            free = self.keys[at] == 2**63
            _, first = np.unique(at, return_index=True)  # one key for each slot
            put = np.zeros(len(key), bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.values[at[put]] = key[put], rank[put]
            key, rank, at = key[~put], rank[~put], (at[~put] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no token; negative ids are padding."""
        key = left.astype(np.int64).view(np.uint64) << np.uint64(32) | right.astype(np.int64).view(np.uint64)
        out, todo = np.full(key.shape, NONE, np.int32), np.nonzero((left >= 0) & (right >= 0))
        key = key[todo]
        at, size = self._slot(key), len(self.keys)
        where = np.arange(len(key))
        got = np.full(len(key), NONE, np.int32)
        for _ in range(self.probes):
            here = self.keys[at]
            hit = here == key
            got[where[hit]] = self.values[at[hit]]
            more = ~hit & (here != 2**63)
            if not more.any():
                break
            key, where, at = key[more], where[more], (at[more] + 1) & (size - 1)
        out[todo] = got
        return out

    def merge_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of about one length."""
        length = max(map(len, pieces))
        raw = np.frombuffer(b"".join(p.ljust(length, b"\0") for p in pieces), np.uint8).reshape(len(pieces), length)
        ids = self.single[raw]
        ids[np.arange(length) >= np.array([len(p) for p in pieces])[:, None]] = -1
        out: list = [None] * len(pieces)
        row = np.arange(len(pieces))
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while True:
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            least = rank[np.arange(len(row)), best] if rank.shape[1] else np.full(len(row), NONE)
            done = least == NONE
            if done.any():  # all rows that are done are packed in one go
                held = ids[done] >= 0
                packed, ends = ids[done][held].astype("<u4").tobytes(), (4 * np.cumsum(held.sum(axis=1))).tolist()
                for r, a, b in zip(row[done].tolist(), [0, *ends], ends):
                    out[r] = packed[a:b]
            if done.all():
                return out
            row, ids, rank, best, least = row[~done], ids[~done], rank[~done], best[~done], least[~done]
            n, width, k = len(row), ids.shape[1], np.arange(len(row))
            ids[k, best] = least
            stay = np.ones((n, width), bool)
            stay[k, best + 1] = False
            ids = ids[stay].reshape(n, width - 1)
            stay = np.ones((n, width - 1), bool)
            stay[k, best] = False
            rank = rank[stay].reshape(n, width - 2)
            for at in (best - 1, best):  # the pairs that the new token is in
                ok = (at >= 0) & (at < width - 2)
                rank[k[ok], at[ok]] = self.pair_ranks(ids[k[ok], at[ok]], ids[k[ok], at[ok] + 1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: the same merges in the same order, from a heap of (rank, place)."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        found = self.pair_ranks(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(found[k]), k, ids[k], ids[k + 1]) for k in np.flatnonzero(found != NONE).tolist()]
        heapq.heapify(heap)
        tokens, ranks = self.tokens, self.ranks
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt >= n or ids[nxt] != b:
                continue  # merged meanwhile
            ids[k], ids[nxt] = rank, -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for i in (before[k], k):
                j = after[i] if i >= 0 else n
                if i >= 0 and j < n and (r := ranks.get(tokens[ids[i]] + tokens[ids[j]])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Packed ids (little-endian unsigned 32 bits) of distinct pieces."""
        out, buckets = {}, {}
        for p in pieces:
            data = p.encode("utf-8", "replace")
            if (whole := self.ranks.get(data)) is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(data) > LONG:
                out[p] = self.merge_long(data).astype("<u4").tobytes()
            else:
                buckets.setdefault(-(-len(data) // 4), []).append((p, data))
        for bucket in buckets.values():
            for lo in range(0, len(bucket), 4096):
                part = bucket[lo : lo + 4096]
                out.update(zip([p for p, _ in part], self.merge_matrix([d for _, d in part])))
        return out

    def pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= WHOLE:
            yield self.find.findall(text)
            return
        found = self.find.finditer(text)
        while part := [m.group() for m in islice(found, WHOLE)]:
            yield part

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out, lot, chars = [], [], 0
        for t in [*texts, None]:
            if t is not None:
                lot.append(t)
                chars += len(t)
            if lot and (t is None or chars > 1 << 20):
                if sum(map(len, lot)) <= 1 << 22:
                    split = [next(self.pieces(x)) if len(x) <= WHOLE else [p for part in self.pieces(x) for p in part] for x in lot]
                    self._learn(set().union(*split))
                    out += [b"".join(map(self.seen.__getitem__, x)) for x in split]
                else:  # one or more very long texts: part by part
                    for x in lot:
                        packed = []
                        for part in self.pieces(x):
                            self._learn(set(part))
                            packed.append(b"".join(map(self.seen.__getitem__, part)))
                        out.append(b"".join(packed))
                lot, chars = [], 0
                if len(self.seen) > REMEMBERED:
                    self.seen.clear()
                for p in self.odd:  # seldom met again
                    self.seen.pop(p, None)
                self.odd.clear()
        return out

    def _learn(self, pieces: set[str]) -> None:
        new = {p for p in pieces if p not in self.seen}
        self.odd.update(p for p in new if len(p) > REMEMBERED_CHARS)
        self.seen |= self.merge(new)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(rank_file: str, pattern: str) -> Tokenizer:
    """One for each worker process, from a file that every machine has with its Python."""
    return Tokenizer(rank_file, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit ids).

    A null text counts as empty: no ids. Repeated rows and null ids stay; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(rank_file, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                packed = own.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"])
        own.seen.clear()  # workers are used again by other tasks

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids -> the same with `decoded` (binary). Null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(rank_file, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                texts = [own.decode(x or b"") for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)

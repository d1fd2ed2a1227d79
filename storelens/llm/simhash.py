"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, and groups of linked documents.

Distinct fingerprints are indexed. Upper nodes of the index are masked bit patterns: the 64 bits are cut into
radius + 1 blocks, of which two fingerprints within the radius must agree in one; the remaining bits are cut
again in the same way, and so on. A node is the set of fingerprints that share the blocks chosen on its path. A
node that holds more than `node_limit` fingerprints is split by a further level; on the last level so few bits
are free that a node is small by construction. Within a node, fingerprints stand in the order of their Gray
rank, so that neighbours share long patterns; groups of neighbours keep their shared bits, and two groups whose
shared bits differ in more than the radius are pruned with all that is below them. No pair is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, fresh, keep

SEED = 42
CHUNK = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0d]")
FAN = 8
ALL = (1 << 64) - 1


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned. A bit is set if it is set in over half of the XXH64 hashes of the text's word shingles; 0 for no words."""
    data = (text or "").encode("utf-8", "replace").lower()
    counts, n, at, last = np.zeros(64, np.int64), 0, 0, []
    while at < len(data):  # by chunks: a very long text needs little memory
        cut = SPACE.search(data, min(at + CHUNK, len(data)))
        end = cut.start() if cut else len(data)
        found = last + data[at:end].split()
        at, last = end, found[max(0, len(found) - words + 1) :]
        shingles = zip(*(found[k:] for k in range(words)))
        m = max(0, len(found) - words + 1)
        for lo in range(0, m, 1 << 16):
            size = min(1 << 16, m - lo)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, (s for s, _ in zip(shingles, range(size)))) if m > 1 << 16 else map(b" ".join, shingles), repeat(SEED)), np.uint64, size)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        n += m
    if not n and last:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little") if n else 0


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long). A null text counts as empty; repeated rows stay; null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return ids.mapInArrow(run, "doc_id long, fp long")


def gray_rank(g: np.ndarray) -> np.ndarray:
    """Place of a code in the Gray sequence."""
    for k in (1, 2, 4, 8, 16, 32):
        g = g ^ (g >> np.uint64(k))
    return g


def near_pairs(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fps (distinct, uint64) in Gray order, and the places i < j of all pairs within the radius."""
    fps = fps[np.argsort(gray_rank(fps))]
    levels = [(fps, np.full(len(fps), ALL, np.uint64))]  # shared bits: pattern, mask
    while len(levels[-1][0]) > 1:
        pattern, mask = levels[-1]
        at = np.arange(0, len(pattern), FAN)
        both, either, kept = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at), np.bitwise_and.reduceat(mask, at)
        kept &= ~(both ^ either)
        levels.append((both & kept, kept))
    i = j = np.zeros(1, np.int64)
    for pattern, mask in reversed(levels[:-1]):
        k = np.arange(FAN)
        i, j = (np.repeat(i * FAN, FAN * FAN).reshape(-1, FAN, FAN) + k[:, None]).ravel(), (np.repeat(j * FAN, FAN * FAN).reshape(-1, FAN, FAN) + k).ravel()
        ok = (j < len(pattern)) & (i <= j)
        i, j = i[ok], j[ok]
        ok = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= radius
        i, j = i[ok], j[ok]
    ok = i < j
    return fps, i[ok], j[ok]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest place that it is linked with by pairs (i, j), directly or not."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def paths(radius: int, depth: int) -> list[tuple[int, int]]:
    """(mask of the blocks chosen, mask of the bits left) of each path of that depth."""
    out = [(0, ALL)]
    for _ in range(depth):
        deeper = []
        for mask, free in out:
            bits = [b for b in range(64) if free >> b & 1]
            step, cut = divmod(len(bits), radius + 1), 0
            for k in range(radius + 1):
                size = step[0] + (k < step[1])
                block = sum(1 << b for b in bits[cut : cut + size])
                cut += size
                deeper.append((mask | block, free & ~block))
        out = deeper
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = 2, node_limit: int = 1024, depths: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """fp (distinct) -> a, b: within each node a spanning forest of the links within the radius, and so no component is lost."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for group in batch.column(0):
                own, i, j = near_pairs(np.array(group.values, np.int64).view(np.uint64), radius)
                root = forest(len(own), i, j)
                at = np.flatnonzero(root != np.arange(len(own)))
                a.append(own[at].view(np.int64))
                b.append(own[root[at]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], ["a", "b"])

    found, level = [], fps.select("fp")
    for depth in depths:
        patterns = [F.struct(F.lit(k).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("pattern")) for k, (mask, _) in enumerate(paths(radius, depth))]
        nodes = level.select("fp", F.inline(F.array(*patterns)))
        sizes = nodes.groupBy("path", "pattern").count().where("count > 1")
        last = depth == depths[-1]
        small = sizes if last else sizes.where(F.col("count") <= node_limit)
        groups = nodes.join(small.select("path", "pattern"), ["path", "pattern"], "left_semi").groupBy("path", "pattern").agg(F.collect_list("fp").alias("fps"))
        found.append(groups.select("fps").mapInArrow(search, "a long, b long"))
        if last:
            break
        large = sizes.where(F.col("count") > node_limit).select("path", "pattern")
        level = keep(nodes.join(large, ["path", "pattern"], "left_semi").select("fp").distinct(), "large-nodes")
        if level.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return keep(out.distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """a, b -> v, c: the smallest node that can be reached, for each node with an edge. Rounds of neighbours' least label and a jump to the label's label."""
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        new = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("up"))
        before, labels = labels, keep(new.join(jump, "c").select("v", "old", F.least("c", "up").alias("c")), "labels")
        discard(before)
        if labels.where("c <> old").isEmpty():
            discard(both)
            return labels.select("v", "c")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links within the radius).

    Empty and null texts have fingerprint 0 and are linked like any other. Repeated rows stay. An empty table
    gives no rows. Null ids: such rows stay, and never name a component unless it has no other id.
    """
    own = keep(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = keep(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    group = components(links(distinct, radius))
    of = distinct.join(group, distinct.fp == group.v, "left").select("fp", "least", F.coalesce("c", "fp").alias("c"))
    of = keep(of, "of")
    named = of.groupBy("c").agg(F.min("least").alias("component_id"))
    out = own.join(of.join(named, "c").select("fp", "component_id"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Least and most bits of a text's parity map, places of the table of common shingles, and the rows of a sample that fill it.
PARITY, PARITY_MOST, PLACES, SAMPLE = 512, 1 << 14, 22, 20_000
#: Earlier buckets of its own that a text carries into a bucket.
EARLIER = 64


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (ASCII lower case)."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    grams = map(b" ".join, zip(*(found[k:] for k in range(words)))) if len(found) >= words else [b" ".join(found)] if found else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))


def common_shingles(texts: DataFrame, words: int) -> bytes:
    """How common shingles are in a sample, a byte for each of 2**PLACES places: it orders shingles, and so sets the time of a search, not its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << PLACES, np.int32)
        for b in batches:
            for t in b.column(0):
                np.add.at(counts, (shingle_hashes(t.as_py(), words) >> np.uint64(64 - PLACES)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        for lo in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + 100_000], pa.int32()), pa.array(counts[at[lo : lo + 100_000]], pa.int32())], ["place", "n"])

    picked = texts.sample(min(1.0, SAMPLE / max(1, texts.count())), seed=11)
    found = picked.select("text").mapInArrow(run, "place int, n int").groupBy("place").agg(F.sum("n").alias("n")).where("n > 3").toArrow()
    levels = np.zeros(1 << PLACES, np.uint8)
    levels[found.column("place").to_numpy()] = np.minimum(255, 8 * np.log2(found.column("n").to_numpy().astype(np.float64)))
    return levels.tobytes()


def prefix(hashes: np.ndarray, levels: np.ndarray, least: float) -> np.ndarray:
    """The rarest shingles of a text, so many that two texts at `least` similarity have one of them in common. A text without a word has 0."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    n = len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1
    return hashes[np.lexsort((hashes, levels[(hashes >> np.uint64(64 - PLACES)).astype(np.int64)]))[:n]]


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingles, unsigned: the bits that over half of its hashes have set; 0 for no shingle."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def by_fingerprint(marks: DataFrame, radius: int = 2) -> DataFrame:
    """id (distinct), fp -> x < y: each id with the least id of its fingerprint, and those least ids whose fingerprints the Gray-order index links. At most a pair for each id and link."""
    lead = keep(marks.groupBy("fp").agg(F.min("id").alias("lead")), "leads")
    near = links(lead, radius)
    same = marks.join(lead, "fp").select(F.col("id").alias("x"), F.col("lead").alias("y"))
    apart = near.join(lead.toDF("a", "x"), "a").join(lead.toDF("b", "y"), "b").select("x", "y")
    pairs = same.union(apart).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    out = keep(pairs.distinct(), "by-fingerprint")
    discard(lead, near)
    return out


def parity(hashes: np.ndarray) -> bytes:
    """Two sets differ in at least as many shingles as their maps differ in bits. A map has as many bits as its set has
    shingles, up to a power of two: in a shorter one the bits of unlike sets even out."""
    bits = min(PARITY_MOST, max(PARITY, 1 << max(0, len(hashes) - 1).bit_length()))
    return np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(maps: list[bytes], size: int) -> np.ndarray:
    """Maps of one size as rows of `size` bytes: those that shorter maps of the same sets would have."""
    rows = np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1, size // 8)
    return np.bitwise_xor.reduce(rows, axis=1)


def differing(p: list[bytes], q: list[bytes]) -> np.ndarray:
    """The number of bits in which each two maps differ, the longer one folded."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(p, q)]).reshape(-1, 2)
    out = np.zeros(len(p), np.int64)
    for a, b in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes == (a, b)).all(axis=1)).tolist()
        left, right = (folded([x[k] for k in at], min(a, b)) for x in (p, q))
        out[at] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
    return out


def may_link(n: np.ndarray, m: np.ndarray, far: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n and m shingles, that differ in `far` or more, can be at `least` similarity. Exact: never false for a pair that is."""
    return np.maximum(far, np.abs(n - m)) <= (n + m) * (1 - least) / (1 + least) + 1e-6


def cross_pairs(ids: np.ndarray, group: np.ndarray, n: np.ndarray, maps: list[bytes], block: np.ndarray, earlier: list[frozenset], apart: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """ids of all pairs in different groups that may link and were in no earlier bucket together; `apart`: only between different blocks."""
    size, at_size = np.array([len(x) for x in maps]), {}
    for s in np.unique(size).tolist():  # of sets that may link one has a map of at most twice the other's size
        at_size[s] = np.zeros((len(maps), s // 8), np.uint64)
        for longer in (s, 2 * s):
            at = np.flatnonzero(size == longer)
            if len(at):
                at_size[s][at] = folded([maps[k] for k in at], s)
    x, y = [], []
    for k in range(len(ids) - 1):
        r = np.flatnonzero((group[k + 1 :] != group[k]) & ((block[k + 1 :] != block[k]) | (not apart))) + k + 1
        r = r[may_link(n[k], n[r], 0, least)]
        if not len(r):
            continue
        common, far = np.minimum(size[r], size[k]), np.zeros(len(r), np.int64)
        for s in np.unique(common).tolist():
            own = common == s
            far[own] = np.bitwise_count(at_size[s][r[own]] ^ at_size[s][k]).sum(axis=1, dtype=np.int64)
        r = r[may_link(n[k], n[r], far, least)]
        r = r[[earlier[k].isdisjoint(earlier[i]) for i in r.tolist()]] if len(r) else r
        x.append(np.minimum(ids[k], ids[r]))
        y.append(np.maximum(ids[k], ids[r]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *x]), np.concatenate([none, *y])


def similar_texts(docs: DataFrame, least: float = 0.8, words: int = 5, pivots: int = 2, block: int = 512, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, digest (of the text), group, component: documents of equal texts, or linked by word-shingle sets at or over `least` similarity (Jaccard).

    The Gray-order index comes first: it links texts whose SimHash fingerprints, of the same shingles, differ in
    `radius` bits or fewer. At `least` they may differ in a dozen, more than blocks can guarantee to find; so texts
    of different groups are then looked up by shingles: two texts at `least` have one of their rarest (`prefix`) in
    common, at any number of rows. The texts with one such shingle are a bucket; shingles of the same texts make one. In
    `pivots` rounds each is compared with one of its bucket, which links most of a large group; then all pairs of a
    bucket that are not linked yet are compared, those of a large bucket by pairs of blocks of about `block` texts. A
    pair that stands in several buckets is written in the first of them (a text carries its last EARLIER buckets into
    the next; beyond these a pair may be written twice, and is still compared once). A pair is dropped unverified
    only if the sets' sizes or parity maps prove it under `least`; the rest are verified on whole texts. No link is lost. Null and empty texts are equal texts, and all texts without a word are alike. group
    is the smallest doc_id (null if no row of the group has one); component names the group in any case. Repeated rows stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    held_levels = docs.sparkSession.sparkContext.broadcast(common_shingles(docs.select(text.alias("text")), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(held_levels.value, np.uint8)
        for b in batches:
            sizes, maps, prints, rare = [], [], [], []
            for t in b.column(2):
                own = shingle_hashes(t.as_py(), words)
                sizes.append(len(own))
                maps.append(parity(own))
                prints.append(signed(majority(own)))
                rare.append(prefix(own, levels, least).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary()), pa.array(prints, pa.int64()), pa.array(rare, pa.list_(pa.int64()))], ["doc_id", "digest", "n", "map", "fp", "rare"])

    rows = keep(whole.mapInArrow(run, "doc_id long, digest binary, n int, map binary, fp long, rare array<long>"), "shingles")
    distinct = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "map", "fp", "rare")])
    distinct = keep(distinct.withColumn("id", F.xxhash64("digest")), "distinct")  # nodes of the graph are texts; 64 bits of their digest name them
    ids = keep(rows.select("doc_id", "digest"), "ids")
    discard(rows)
    tokens = distinct.select("id", F.explode("rare").alias("s"))
    shared = keep(tokens.groupBy("s").agg(F.count("*").alias("k")).where("k > 1").select("s"), "shared")
    several = keep(tokens.join(shared, "s"), "tokens")
    whose = several.groupBy("s").agg(F.count("*").alias("k"), *[F.bit_xor(F.xxhash64("id", F.lit(j))).alias(f"whose_{j}") for j in (0, 1)])  # equal for shingles of the same texts
    buckets = keep(whose.groupBy("k", "whose_0", "whose_1").agg(F.min("s").alias("s")).select("s"), "buckets")
    left = keep(several.join(buckets, "s").withColumn("c", F.col("id")), "open")
    texts = keep(distinct.select("digest", "least", "id", "n", "map"), "texts")
    facts = texts.select("id", "n", "map")
    near = by_fingerprint(distinct.select("id", "fp"), radius)
    discard(distinct, shared, several, buckets)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(k).to_numpy().astype(np.int64) for k in (2, 4))
            at = pa.array(np.flatnonzero(may_link(n, m, differing(b.column(3).to_pylist(), b.column(5).to_pylist()), least)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["x", "y"])

    def bounded(pairs: DataFrame) -> DataFrame:
        both = pairs.join(facts.toDF("x", "n", "p"), "x").join(facts.toDF("y", "m", "q"), "y")
        return both.select("x", "y", "n", "p", "m", "q").mapInArrow(bound, "x long, y long")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            good = []
            for y, p, q in zip(b.column(1), b.column(2), b.column(3)):
                if y.as_py() != last[0]:  # rows come in the order of y
                    last = y.as_py(), shingle_hashes(q.as_py(), words)
                own = shingle_hashes(p.as_py(), words)
                same = len(np.intersect1d(own, last[1], assume_unique=True))
                good.append(same >= least * (len(own) + len(last[1]) - same))
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["x", "y"])

    def verified(pairs: DataFrame) -> DataFrame:
        """x, y (ids) -> those at `least` or more."""
        wanted = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
        lead = texts.join(wanted, "id").select(F.col("digest").alias("d"), F.col("least").alias("l"))
        named = whole.join(lead, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("l")), "left_semi")
        held = keep(named.select(F.xxhash64("digest").alias("id"), "text").dropDuplicates(["id"]), "held")
        both = pairs.join(held.toDF("x", "p"), "x").join(held.toDF("y", "q"), "y").select("x", "y", "p", "q")
        similar = keep(both.mapInArrow(verify, "x long, y long"), "similar")
        discard(held)
        return similar

    def still_open(before: DataFrame, group: DataFrame) -> DataFrame:
        """s, id, c of the buckets (of those open before) that hold more than one group; groups only grow, so others need no further look."""
        own = keep(before.select("s", "id").join(group.select(F.col("v").alias("id"), "c"), "id", "left").select("s", "id", F.coalesce("c", "id").alias("c")), "grouped")
        several = keep(own.groupBy("s").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("s"), "several")  # its own exchange in the join, so that Spark can split the rows of one shingle
        left = keep(own.join(several, "s"), "open")
        discard(before, own, several)
        return left

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for apart, cell in zip(b.column(0).to_pylist(), b.column(1)):
                v = cell.values
                earlier = list(map(frozenset, v.field("earlier").to_pylist()))
                x, y = cross_pairs(v.field("id").to_numpy(), v.field("c").to_numpy(), v.field("n").to_numpy().astype(np.int64), v.field("map").to_pylist(), v.field("part").to_numpy(), earlier, apart, least)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

    tried = keep(bounded(near), "candidates")
    edges = verified(tried)
    group = components(edges.toDF("a", "b"))
    discard(near)
    for k in range(pivots + 1):
        left = still_open(left, group)
        if k < pivots:
            pivot = keep(left.groupBy("s").agg(F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("o"), F.col("id").alias("y"), F.col("c").alias("d"))).alias("t")).select("s", "t.y", "t.d"), "pivots")
            first = keep(left.join(pivot, "s").where("c <> d").select(F.least("id", "y").alias("x"), F.greatest("id", "y").alias("y")).distinct(), "pairs")
            pairs = bounded(first)
            used = [pivot, first]
        else:
            parts = keep(left.groupBy("s").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "parts")
            before = F.collect_list("s").over(W.partitionBy("id").orderBy("s").rowsBetween(-EARLIER, -1))
            own = left.withColumn("earlier", before).join(parts, "s").join(facts, "id").withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int"))
            own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            cell = own.groupBy("s", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list(F.struct("id", "c", "n", "map", "part", "earlier")).alias("of"))
            pairs = cell.select((F.col("i") != F.col("j")).alias("apart"), "of").mapInArrow(cells, "x long, y long").distinct()
            used = [parts]
        pairs = keep(pairs.join(tried, ["x", "y"], "left_anti"), "candidates")
        discard(*used)
        tried = tried.union(pairs)
        edges = edges.union(verified(pairs))
        group = components(edges.toDF("a", "b"))
    discard(left)
    of = keep(texts.join(group, F.col("id") == F.col("v"), "left").select("digest", "least", F.coalesce("c", "id").alias("component")), "of")
    named = of.groupBy("component").agg(F.min("least").alias("group"))
    return ids.join(of.join(named, "component").select("digest", "group", "component"), "digest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each group of `similar_texts`: the one of smallest doc_id (then digest of the text); of repeated rows one stays. Null ids come last: such a row stays only if no other row of its group has an id."""
    groups = keep(similar_texts(docs, id_col=id_col, text_col=text_col, **options), "groups")
    order = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first")
    kept = keep(groups.groupBy("component").agg(order).select(F.col("first.doc_id").alias("doc_id"), F.col("first.digest").alias("digest")), "first")
    digest, d, g = fresh(docs, "digest", "of_id", "of_digest")
    marked = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    out = marked.join(kept.toDF(d, g), F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.col(digest) == F.col(g)), "left_semi")
    if not groups.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, digest])
    return out.drop(digest)

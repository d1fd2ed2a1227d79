"""Approximate nearest neighbours by cosine: balanced posting lists under a centroid graph.

Centroids are fitted on a bounded sample (`sample` vectors, or two for each list); every vector is then indexed. A vector goes to the
list of its nearest centroid and, if it lies at a boundary, to those of up to `replicas` centroids that are at
most `spread` times as far away. While fitting, crowded centroids are handicapped so that lists come out even, and
a list of over `list_limit` vectors is dealt out in chunks, and the queries of a list of over `asked_limit` in lots; each
chunk is searched by each lot by itself. There is a list for
each `list_size` vectors, up to `most_lists`, so the size of the centroids is bounded; beyond most_lists * list_size
vectors lists lengthen. Centroids are searched through an in-memory graph of neighbours; a query goes to the
lists whose centroid is at most so many times as far away as the nearest, `least_probes` lists at least. That
ratio, and with it the width of the search, is set on the sample so that `target` of the sample's own neighbours
are found; neighbours in the whole table are nearer, so that is a cautious setting. Scores are then computed on the
original vectors in double precision.

Equal vectors are searched once, and of equal candidates only the k + 1 of smallest id can be in a result; so one
vector that fills the table costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keep


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two (which rounds nothing) that brings their largest component near 1, so that squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, lists: int, rounds: int = 12, handicap: float = 0.3, seed: int = 7) -> np.ndarray:
    """Unit centroids by k-means on unit vectors; the handicap makes a crowded centroid seem farther away."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    size = np.full(len(centres), len(sample) / len(centres))
    slack = 0.0  # mean distance to the nearest centre, of the round before
    for r in range(rounds):
        crowd, own, least = np.minimum(size * len(centres) / len(sample), 8) - 1, np.empty(len(sample), np.int64), 0.0
        for lo in range(0, len(sample), 1024):  # some rows at a time: the whole matrix may be large
            cost = 1 - sample[lo : lo + 1024] @ centres.T
            least += cost.min(axis=1).sum()
            own[lo : lo + 1024] = (cost + handicap * slack * crowd).argmin(axis=1)
        slack = least / len(sample)
        size = np.bincount(own, minlength=len(centres)).astype(float)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        lost = (size == 0) | ((sums * sums).sum(axis=1) < 1e-20)
        sums[lost] = sample[rng.choice(len(sample), int(lost.sum()))]
        centres = unit(sums)
    return centres


class Graph:
    """Centroids, each with its `degree` nearest others, and some of them to start from."""

    def __init__(self, centres: np.ndarray, degree: int = 16, starts: int = 64):
        self.centres = centres
        near = np.empty((len(centres), min(degree, len(centres) - 1)), np.int64)
        for lo in range(0, len(centres), 1024):
            sims = centres[lo : lo + 1024] @ centres.T
            sims[np.arange(len(sims)), lo + np.arange(len(sims))] = -2
            near[lo : lo + 1024] = np.argsort(-sims, axis=1)[:, : near.shape[1]]
        self.near = near
        self.starts = np.linspace(0, len(centres) - 1, min(starts, len(centres))).astype(np.int64)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids and distances of the nearest `beam` found for each unit vector, nearest first: the best so far are widened by their neighbours until they no longer change."""
        beam = min(beam, len(self.centres))
        n, row = len(x), np.arange(len(x))[:, None]
        if beam * self.near.shape[1] >= len(self.centres):  # the neighbours would be nearly all centroids
            sims = x @ self.centres.T
            best = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            return best, np.sqrt(np.maximum(0, 2 - 2 * sims[row, best]))
        sims = x @ self.centres[self.starts].T
        best = self.starts[np.argsort(-sims, axis=1)[:, :beam]]
        for _ in range(32):
            wide = np.concatenate([best, self.near[best].reshape(n, -1)], axis=1)
            wide.sort(axis=1)
            sims = np.einsum("nd,nkd->nk", x, self.centres[wide])
            sims[:, 1:][wide[:, 1:] == wide[:, :-1]] = -2
            top = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            new, found = wide[row, top], sims[row, top]
            if new.shape == best.shape and (new == best).all():
                break
            best = new
        return best, np.where(found < -1.5, np.inf, np.sqrt(np.maximum(0, 2 - 2 * found)))


def tune(graph: Graph, sample: np.ndarray, k: int, replicas: int, spread: float, target: float, asked: int = 256) -> tuple[float, int]:
    """The ratio of distances, and the number of lists, within which `target` of the sample's k nearest are posted."""
    sample = sample[:8192]
    lists, dist = posted_to(graph, sample, replicas, spread)
    asked = min(asked, len(sample))
    sims = sample[:asked] @ sample.T
    sims[np.arange(asked), np.arange(asked)] = -2
    near = np.argsort(-sims, axis=1)[:, :k]
    order, far = graph.search(sample[:asked], len(graph.centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    held = np.where(np.isfinite(dist), lists, -1)[near]  # query, neighbour, replica
    places = np.where(held >= 0, place[np.arange(asked)[:, None, None], held], order.shape[1] - 1).min(axis=2)
    ratios = np.take_along_axis(far, places, axis=1) / np.maximum(far[:, :1], 1e-9)
    return float(np.quantile(ratios, target)), int(np.quantile(places, (1 + target) / 2)) + 1


def posted_to(graph: Graph, x: np.ndarray, replicas: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """The lists of each unit vector and their distances; inf where it isn't posted."""
    parts = [graph.search(x[lo : lo + 256], 2 * replicas) for lo in range(0, len(x), 256)]
    lists, dist = np.concatenate([a[:, :replicas] for a, _ in parts]), np.concatenate([b[:, :replicas] for _, b in parts])
    return lists, np.where(dist <= spread * dist[:, :1] + 1e-12, dist, np.inf)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array of double): vectors with finite components that are not all zero."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: x.cast("double") + 0.0).alias("v")).where(F.coalesce(fine, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = 20_000, list_size: int = 128, most_lists: int = 16_384,
    replicas: int = 4, spread: float = 1.15, target: float = 0.96, least_probes: int = 8, list_limit: int = 2048, asked_limit: int = 8192,
) -> DataFrame:
    """queries against vectors -> query_id, rank (from 1), vec_id, score: the k nearest found, a query's own id left out, ties to the smaller id.

    Null vectors, those that hold null or non-finite components and zero vectors take no part, on either
    side; nor do those, on either side, of another length than the commonest of `vectors`. Rows with one id and one vector count once.
    Fewer than k candidates: all of them. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    fine = usable(vectors, id_col, vec_col)
    of_length = F.size("v") == F.lit(fine.agg(F.mode(F.size("v"), True)).first()[0] or 0)
    rows = keep(fine.where(of_length & F.col("vec_id").isNotNull()).distinct(), "vectors")
    asked = keep(usable(queries, id_col, vec_col).where(of_length & F.col("vec_id").isNotNull()).distinct(), "queries")
    kinds = asked.groupBy("v").agg(F.min("vec_id").alias("q"))
    alike = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    rows = keep(rows.withColumn("alike", alike).where(F.col("alike") <= k + 1).drop("alike"), "candidates")

    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    grain, lists = 1_000_000, max(1, min(most_lists, -(-n // list_size)))
    sample = max(sample, 2 * lists)
    share = min(grain, -(-sample * grain // n))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(grain)) < share).select("v").limit(2 * sample)
    drawn = matrix(drawn.toArrow().column("v").combine_chunks())
    if not len(drawn):
        drawn = matrix(rows.select("v").limit(100).toArrow().column("v").combine_chunks())
    drawn = unit(drawn)
    graph = Graph(fit(drawn, lists))
    ratio, width = tune(graph, drawn, k, replicas, spread, target)
    width = max(width, least_probes)
    held = spark.sparkContext.broadcast(graph)  # most_lists centroids and their neighbours at most

    def post(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return posted_to(held.value, x, replicas, spread)

    def probe(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists, dist = held.value.search(x, width)
        return lists, np.where((dist <= ratio * dist[:, :1] + 1e-12) | (np.arange(dist.shape[1]) < least_probes), dist, np.inf)

    def to_lists(choose, step: int):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, step):
                    part = b.slice(lo, step)
                    lists, dist = choose(unit(matrix(part.column(1))))
                    at, which = np.nonzero(np.isfinite(dist))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(lists[at, which], pa.int32())], ["id", "v", "list"])

        return run

    posted = keep(rows.select("vec_id", "v").mapInArrow(to_lists(post, 256), "id long, v array<double>, list int"), "posted")
    sizes = F.broadcast(posted.groupBy("list").agg(F.ceil(F.count("*") / list_limit).cast("int").alias("chunks")))  # a row for each list
    posted = posted.join(sizes, "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    probes = kinds.select("q", "v").mapInArrow(to_lists(probe, max(1, 8192 // width)), "id long, v array<double>, list int")
    probes = keep(probes, "probes")
    lots = F.broadcast(probes.groupBy("list").agg(F.ceil(F.count("*") / asked_limit).cast("int").alias("lots")))  # a row for each list
    probes = probes.join(sizes, "list").join(lots, "list").withColumn("lot", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    posted = posted.join(lots, "list").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))

    def best(_: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            x, y, ids = scaled(np.stack(q.v)), scaled(np.stack(c.v)), c.id.to_numpy()
            x_norm, y_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
            for lo in range(0, len(x), 256):
                near = (x[lo : lo + 256] @ y.T) / y_norm
                floor = np.partition(near, max(0, near.shape[1] - k - 1), axis=1)[:, max(0, near.shape[1] - k - 1)] - 1e-9 * x_norm[lo : lo + 256]
                i, j = np.nonzero(near >= floor[:, None])
                score = (x[lo + i] * y[j]).sum(axis=1) / (x_norm[lo + i] * y_norm[j])  # the same sum for equal vectors wherever they stand
                one = pd.DataFrame({"q": q.id.to_numpy()[lo + i], "vec_id": ids[j], "score": score}).sort_values(["q", "score", "vec_id"], ascending=[True, False, True])
                out.append(one.groupby("q").head(k + 1))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "vec_id": [], "score": []}).astype({"q": "int64", "vec_id": "int64", "score": "float64"})

    by = ["list", "chunk", "lot"]
    found = probes.select(*by, "id", "v").groupBy(*by).cogroup(posted.select(*by, "id", "v").groupBy(*by)).applyInPandas(best, "q long, vec_id long, score double")
    found = found.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.asc("vec_id")]
    found = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("r") <= k + 1)
    lists = found.groupBy("q").agg(F.collect_list(F.struct("r", "vec_id", "score")).alias("hits"))  # k + 1 at most
    kinds = kinds.join(lists, "q")
    hits = F.slice(F.filter(F.sort_array("hits"), lambda h: h.vec_id != F.col("query_id")), 1, k)
    out = asked.select(F.col("vec_id").alias("query_id"), "v").join(kinds.select("v", "hits"), "v")
    return out.select("query_id", F.posexplode(hits).alias("rank", "hit")).select("query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", "hit.score")

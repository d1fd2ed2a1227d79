"""Segments of outlets: k-means, profiles of the clusters, labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config as C
from ..plans.lineage import cut
from . import ranking

MEASURES = ["VPO", "TOTAL_REVENUE", "AVG_SKU", "ACTIVE_MONTHS"]


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def exact_mean(name: str, places: int) -> Column:
    return F.bround(F.avg(col(name).cast("decimal(18,4)")).cast("double"), places)


def _starts(sample: np.ndarray, k: int, starts: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centres to start from (starts, k, features): k-means++ on a sample, moved a few rounds on it."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(starts):
        centres = [sample[rng.integers(len(sample))]]
        for _ in range(k - 1):
            far = ((sample[:, None] - np.array(centres)) ** 2).sum(axis=2).min(axis=1)
            centres.append(sample[rng.choice(len(sample), p=far / far.sum()) if far.sum() else rng.integers(len(sample))])
        centres = np.array(centres)
        for _ in range(rounds):
            own = ((sample[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([sample[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(k)])
        out.append(centres)
    return np.array(out)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start the nearest centre of each row, and the square of its distance."""
    starts, k, d = centres.shape
    flat = centres.reshape(-1, d)
    far = ((x * x).sum(axis=1)[:, None] - 2 * x @ flat.T + (flat * flat).sum(axis=1)).reshape(len(x), starts, k)
    own = far.argmin(axis=2)
    return own, np.maximum(np.take_along_axis(far, own[:, :, None], axis=2)[:, :, 0], 0)


def _moved(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The means of the rows nearest to each centre of each start, and each start's cost: one pass, whose sums Spark adds up."""
    starts, k, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, cost = np.zeros((starts, k, d + 1)), np.zeros(starts)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            own, far = _nearest(x, centres)
            cost += far.sum(axis=0)
            x = np.column_stack([x, np.ones(len(x))])
            for s in range(starts):
                sums[s] += (own[:, s, None] == np.arange(k)).T.astype(float) @ x
        yield pa.RecordBatch.from_arrays([pa.array([[*sums.ravel(), *cost]], pa.list_(pa.float64()))], ["xs"])

    parts = rows.mapInArrow(run, "xs array<double>").select(F.posexplode("xs").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    total = np.zeros(starts * k * (d + 1) + starts)
    for r in parts.collect():  # as many as the centres have numbers
        total[r.i] = r.x
    sums = total[:-starts].reshape(starts, k, d + 1)
    n = sums[:, :, d:]
    return np.where(n > 0, sums[:, :, :d] / np.maximum(n, 1), centres), total[-starts:]


def kmeans(df: DataFrame, features: list[str], k: int = C.CLUSTERS, seed: int = C.SEED, restarts: int = 10, rounds: int = 300, order: str = C.VALUE, tolerance: float = 1e-4, sample: int = 4000) -> DataFrame:
    """df with `cluster`: the best of some restarts, as many at any number of rows, numbered by falling mean of a column. Features are numbers or vectors.

    All restarts move in the same pass; one whose centres move less than the tolerance is settled and drops out. They
    start from k-means++ on the same `sample` rows each time (those of least hash), which the driver holds.
    """
    vector = vector_to_array(F.col("__x"))
    ready = VectorAssembler(inputCols=features, outputCol="__x").transform(df).select("*", vector.alias("__v")).drop("__x")
    rows = cut(ready.select("__v"), "features")
    drawn = rows.orderBy(F.xxhash64("__v"), "__v").limit(sample).toArrow().column("__v").combine_chunks()
    if not len(drawn):
        return df.withColumn("cluster", F.lit(None).cast("int"))
    centres = _starts(drawn.flatten().to_numpy().reshape(len(drawn), -1), k, restarts, seed)
    cost, live = np.full(restarts, np.inf), np.arange(restarts)
    for _ in range(rounds):
        new, cost[live] = _moved(rows, centres[live])
        shift = np.sqrt(((new - centres[live]) ** 2).sum(axis=2)).max(axis=1)
        centres[live] = new
        live = live[shift > tolerance]
        if not len(live):
            break
    best = centres[cost.argmin()][None]

    @F.pandas_udf("int")
    def which(v: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.stack(v), best)[0][:, 0] if len(v) else np.zeros(0), dtype="int32")

    out = ready.withColumn("__c", which("__v")).drop("__v")
    means = out.groupBy("__c").agg(F.avg(col(order)).alias("m")).orderBy(F.desc("m"), "__c").collect()  # k rows
    number = F.create_map(*(F.lit(x) for i, r in enumerate(means) for x in (r["__c"], i)))
    return out.withColumn("cluster", number[F.col("__c")]).drop("__c")


def cluster_check(df: DataFrame, features: list[str], start: str, slack: float = 1e-3) -> DataFrame:
    """Rows with `cluster` -> one row: n, clusters, far (rows that are nearer to another cluster's mean by more than `slack`), below_start (the squares around the means add up to no more than around those of the groups of another column)."""
    names = [f"__f{i}" for i in range(len(features))]
    rows = df.select("cluster", F.col(start).alias("__s"), *[col(c).cast("double").alias(n) for c, n in zip(features, names)])

    def means(by: str) -> DataFrame:
        return rows.groupBy(F.col(by).alias("__g")).agg(F.array(*[F.avg(n) for n in names]).alias("m"))  # a row for each group

    def spread(by: str) -> Column:
        return F.sum(sum((F.pow(F.col(n) - F.get(F.col(f"__m_{by}"), F.lit(i)), 2) for i, n in enumerate(names)), F.lit(0.0)))

    centres = [(r["__g"], r.m) for r in means("cluster").collect()]  # a row for each cluster
    away = lambda m: F.sqrt(sum((F.pow(F.col(n) - F.lit(float(x)), 2) for n, x in zip(names, m)), F.lit(0.0)))
    own = F.coalesce(*[F.when(F.col("cluster") == c, away(m)) for c, m in centres])
    out = rows.withColumn("__far", own - F.least(*[away(m) for _, m in centres]) > slack)
    for by, column in (("cluster", "cluster"), ("start", "__s")):
        at = means(column).withColumnsRenamed({"__g": f"__g_{by}", "m": f"__m_{by}"})
        out = out.join(F.broadcast(at), F.col(column).eqNullSafe(F.col(f"__g_{by}")))
    return out.agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"), F.count_if("__far").alias("far"), (spread("cluster") <= spread("start")).alias("below_start"))


def distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy("cluster").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("cluster", "n", F.bround(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"))


def profile_measures(df: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """cluster, n, and the mean and median (two decimals) of each measure there is."""
    names = [m for m in (measures or MEASURES) if m in df.columns]
    rows = cut(df.select("cluster", *[col(m) for m in names]), "profiled")
    out = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[exact_mean(m, 2).alias(f"mean_{m}") for m in names])
    long = rows.unpivot(["cluster"], [col(m).cast("double").alias(m) for m in names], "measure", "value")
    mid = ranking.quantiles(long, "value", {"mid": 0.5}, ["cluster", "measure"])
    mid = mid.groupBy(F.col("cluster").alias("__c")).agg(*[F.bround(F.max(F.when(F.col("measure") == m, F.col("mid"))), 2).alias(f"median_{m}") for m in names])
    out = out.join(mid, F.col("cluster").eqNullSafe(F.col("__c")), "left")  # a row for each cluster
    return out.select("cluster", "n", *[f"{s}_{m}" for m in names for s in ("mean", "median")])


def top_categories(df: DataFrame, features: list[str], top: int = 3) -> DataFrame:
    """cluster, feature, value, place, share (of the non-null values, as a whole percent)."""
    counts = df.unpivot(["cluster"], [col(c) for c in features], "feature", "value").where("value IS NOT NULL").groupBy("cluster", "feature", "value").agg(F.count("*").alias("n"))
    group = W.partitionBy("cluster", "feature")
    out = counts.withColumns({"total": F.sum("n").over(group), "place": F.row_number().over(group.orderBy(F.desc("n"), "value"))}).where(F.col("place") <= top)
    return out.select("cluster", "feature", "value", "place", F.concat(F.bround(F.col("n") * 100.0 / F.col("total"), 0).cast("int").cast("string"), F.lit("%")).alias("share"))


def demographics(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy("cluster").agg(*[exact_mean(c, 1).alias(f"mean_{c}") for c in columns if c in df.columns])


def universe(profile: DataFrame) -> DataFrame:
    """The unweighted mean of the clusters' means."""
    return profile.agg(*[F.bround(F.avg(F.col(c).cast("decimal(18,4)")).cast("double"), 2).alias(c) for c in profile.columns if c.startswith("mean_")])


def attach_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """df with label, description and action of its cluster; a cluster without one is "Segment c"."""
    own = labels.select("cluster", "label", "description", "action")  # a row for each cluster
    out = df.join(F.broadcast(own), "cluster", "left")
    return out.select(*[col(c) for c in df.columns], F.coalesce("label", F.concat(F.lit("Segment "), F.col("cluster").cast("string"))).alias("segment_label"), F.coalesce("description", F.lit("")).alias("segment_description"), F.coalesce("action", F.lit("")).alias("segment_action"))


def feature_heatmap(df: DataFrame, columns: list[str], per_feature: bool = False) -> DataFrame:
    """cluster, feature, z: the clusters' means, standardised across the features of a cluster, or across clusters."""
    means = df.groupBy("cluster").agg(*[F.avg(col(c).cast("decimal(18,4)")).cast("double").alias(c) for c in columns])
    long = means.unpivot(["cluster"], [col(c) for c in columns], "feature", "mean")
    w = W.partitionBy("feature" if per_feature else "cluster")
    return long.select("cluster", "feature", F.bround((F.col("mean") - F.avg("mean").over(w)) / F.coalesce(F.nullif(F.stddev_pop("mean").over(w), F.lit(0.0)), F.lit(1.0)), 3).alias("z"))


def segment_summary(df: DataFrame) -> DataFrame:
    """cluster, label, recommended action, n, percent, means of four measures (one decimal)."""
    df = df if "segment_action" in df.columns else df.withColumn("segment_action", F.lit(""))
    out = df.groupBy("cluster", "segment_label", F.col("segment_action").alias("action")).agg(F.count("*").alias("n"), *[exact_mean(m, 1).alias(f"avg_{m.lower()}") for m in MEASURES])
    return out.join(F.broadcast(out.agg(F.sum("n").alias("total")))).withColumn("pct", F.bround(F.col("n") * 100.0 / F.col("total"), 1)).drop("total")


def segment_texts(df: DataFrame, labels: DataFrame, sections: DataFrame, names: list[str]) -> DataFrame:
    """A row for each cluster in df: label, channel and occasion, and a column for each section's text; empty where there is none."""
    texts = sections.groupBy(F.col("doc_id").alias("cluster")).agg(*[F.max(F.when(F.col("section") == s, F.col("body"))).alias(s) for s in names])
    out = df.select("cluster").distinct().join(labels.select("cluster", "label", "channel", "occasion"), "cluster", "left").join(texts, "cluster", "left")
    label = F.coalesce("label", F.concat(F.lit("Segment "), F.col("cluster").cast("string")))
    return out.select("cluster", label.alias("label"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("channel", "occasion", *names)])


def segment_overview(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("cluster").alias("n_segments"), F.count("*").alias("n_outlets"), F.bround(F.sum(F.col("VPO").cast("decimal(18,4)")).cast("double"), 2).alias("total_vpo"))


def detail_top(df: DataFrame, group: str, order: list[tuple[str, bool]], most: int) -> DataFrame:
    """The first `most` rows of each group in an order (column, falling), nulls last, with their place."""
    return ranking.first_of(df, group, order, most)

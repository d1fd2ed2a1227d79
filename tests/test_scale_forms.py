"""Forms that don't hold a group in one task, and checks of fits, against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.operators import potential, priority, ranking, rollup, segments, sketches


def test_first_rows_of_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(9)]), i, "x") for i in range(500)] + [("one", 1, 1000, "x"), ("ties", 3, 1001, "x"), ("ties", 3, 1001, "x")]
    df = spark.createDataFrame(rows, "g string, v int, id int, place string").repartition(4).drop("place").withColumn("other", F.lit(1))
    for falling, most in ((True, 40), (False, 3), (True, 10**6)):
        got = {}
        for r in ranking.first_of(df, "g", [("v", falling), ("id", False)], most).collect():
            assert got.setdefault(r.g, {}).setdefault(r.place, (r.v, r.id)) == (r.v, r.id)
        for g in {r[0] for r in rows}:
            want = sorted(((r[1], r[2]) for r in rows if r[0] == g), key=lambda x: (x[0] is None, (-x[0] if falling else x[0]) if x[0] is not None else 0, x[1]))[:most]
            assert [got[g][k + 1] for k in range(len(want))] == want and len(got[g]) == len(want)
    assert ranking.first_of(df.limit(0), "g", [("v", True)], 5).collect() == []


def test_sparse_maps_hold_what_the_pivot_holds(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["1", " 1", "2", "3", None]), rng.choice(["x", " y ", None]), rng.choice(["s", "L", None]), rng.choice([None, 1.5, -2.0])) for _ in range(200)] + [("none", None, None, 1.0)]
    sales = spark.createDataFrame(rows, "CUST_UNIQ_ID_VAL string, BRND_NM string, PPG_DESC string, NET_SALES double").repartition(3)
    keys = rollup.brand_pack_keys(sales)
    sparse = rollup.brand_pack_sparse(sales)
    plain = lambda df: sorted(map(tuple, df.select("OUTLET_UID_EDITED", *[f"`{k}`" for k in keys]).collect()))
    assert plain(rollup.densified(sparse, keys)) == plain(rollup.brand_pack_pivot(sales, keys))
    assert all(r.k == sorted(r.k) for r in sparse.select(F.map_keys("by_key").alias("k")).collect()) and {r[0] for r in plain(rollup.densified(sparse, keys))} == {"1", "2", "3"}


def test_correlation_far_from_zero(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    y = (x + rng.normal(size=4000)) / np.sqrt(2)
    df = spark.createDataFrame([(1e9 + a, 1e9 + b, 1e9) for a, b in zip(x.tolist(), y.tolist())], "VPO double, a double, k double").repartition(4)
    got = {r.feature: r.r for r in priority.driver_correlation(df, ["a", "k"]).collect()}
    assert got == {"a": pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-3)}


def test_constants_have_no_correlation_in_any_parts(spark):
    for rows in (49, 98, 103, 7):  # of so many ones to a part (but for 7) the merged mean isn't 1
        df = spark.range(0, 20 * rows, 1, 20).select((F.col("id") % 17).cast("double").alias("VPO"), (F.col("id") % 34).cast("double").alias("a"), F.lit(1.0).alias("k"), F.lit(0.1).alias("tenth"))
        assert [r.feature for r in priority.driver_correlation(df, ["a", "k", "tenth"]).collect()] == ["a"]
        assert priority.driver_correlation(df.withColumn("VPO", F.lit(1.0)), ["a", "k"]).collect() == []


def test_restarts_move_together(spark):
    rng = np.random.default_rng(5)
    centres = [(0, 0), (9, 0), (0, 9), (9, 9)]
    rows = [(*(np.array(centres[i % 4]) + rng.normal(size=2)).tolist(), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "VPO double, x double, half string").repartition(4)
    out = segments.kmeans(df, ["VPO", "x"], k=4, restarts=3)
    assert sorted(r["count"] for r in out.groupBy("cluster").count().collect()) == [100] * 4
    assert tuple(segments.cluster_check(out, ["VPO", "x"], "half").first()) == (400, 4, 0, True)
    mixed = df.withColumn("cluster", (F.col("x") * 7).cast("int") % 2)
    bad = segments.cluster_check(mixed, ["VPO", "x"], "half").first()
    assert bad.far > 50 and bad.clusters <= 3
    assert segments.kmeans(df.limit(0), ["x"]).collect() == []
    same = spark.createDataFrame([(1.0, 2.0)] * 9, "VPO double, x double")
    assert {r.cluster for r in segments.kmeans(same, ["x"], k=3, restarts=2).collect()} == {0}


def least_loss(x, y, q, alpha):
    """The best line through two points, or a level one: one of them has the least loss."""
    lines = [((b := (y[i] - y[j]) / (x[i] - x[j])), y[i] - b * x[i]) for i, j in itertools.combinations(range(len(x)), 2) if x[i] != x[j]] + [(0.0, v) for v in y]
    return min(np.maximum(q * (r := y - a - b * x), (q - 1) * r).mean() + alpha * abs(b) for b, a in lines)


@pytest.mark.parametrize("alpha", [0.01, 5.0])
def test_no_line_beats_the_bound(spark, alpha):
    rng = np.random.default_rng(8)
    x = rng.normal(size=90)
    y = 3 * x + rng.gamma(2.0, 2.0, size=90)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double").repartition(3)
    best = least_loss(x, y, 0.75, alpha)
    fit = potential.quantile_fit(df, "y", ["x"], alpha=alpha)
    found = potential.certificate(df, "y", ["x"], fit, alpha=alpha)
    assert found["bound"] <= best + 1e-9 <= found["loss"] + 2e-9 and found["gap"] <= 2e-2 * found["loss"] and found["n"] == 90
    worse = potential.certificate(df, "y", ["x"], fit + np.array([2.0, 0.5]), alpha=alpha)
    assert worse["bound"] <= best + 1e-9 and worse["gap"] > 0.05 * worse["loss"]


def test_sketches_merge_and_keep_their_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 4).cast("string").alias("tier"), (F.col("id") % 3).cast("string").alias("month"), (F.col("id") % 20_011).alias("store")).withColumn("store", F.when(F.col("store") != 5, F.col("store")))
    near = {(r.tier, r.month): (r.near, r.error) for r in sketches.counted(sketches.rolled_up(sketches.sketched(rows, ["tier", "month"], "store"), ["tier", "month"], [])).collect()}
    exact = {(r.tier, r.month): r.n for r in rows.cube("tier", "month").agg(F.count_distinct("store").alias("n")).collect()}
    assert set(near) == set(exact) and all(abs(near[k][0] - n) <= near[k][1] < 0.08 * n for k, n in exact.items())
    ids = rows.select(F.col("store").alias("OUTLET_UID_EDITED"))
    got = sketches.duplicate_ids(ids).first()
    assert abs(got.near - (60_000 - 20_010)) <= got.error and sketches.duplicate_ids(ids.limit(0)).first().near == 0

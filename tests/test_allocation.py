"""Facings, scores and the incremental roll-up, against plain versions."""

import datetime
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.operators import apportion, rfm, strategy
from storelens.plans.lineage import shared_dir


def brute_shares(items, pool, least):
    """items: (order, weight); whole numbers that add up to the pool."""
    items = sorted(items)
    served = min(len(items), max(0, pool) // least) if least else 0
    rest = max(0, pool) - served * least
    weights = [w or 0 for _, w in items]
    if not sum(weights):
        weights = [1] * len(items)
    parts = [rest * w // sum(weights) for w in weights]
    more = sorted(range(len(items)), key=lambda k: (-(rest * weights[k] % sum(weights)), k))[: rest - sum(parts)]
    return {o: (least if k < served else 0) + parts[k] + (k in more) for k, (o, _) in enumerate(items)}


@pytest.mark.parametrize("least", [0, 1, 3])
def test_pools_are_dealt_out_in_full(spark, least):
    rng = random.Random(least)
    groups = {f"g{k}": (rng.choice([-2, 0, 1, 7, 40, 1000]), [(i, rng.choice([None, 0, 1, 5, 10**18, rng.randint(1, 99)])) for i in range(rng.choice([1, 3, 60]))]) for k in range(12)}
    groups |= {"even": (10, [(i, 0) for i in range(4)]), "hot": (997, [(i, 7) for i in range(300)])}
    rows = [(g, pool, o, w) for g, (pool, items) in groups.items() for o, w in items]
    df = spark.createDataFrame(rows, "g string, pool long, o int, w long").repartition(5)
    got = {}
    for r in apportion.apportioned(df, ["g"], "pool", "w", [F.asc("o")], least).collect():
        got.setdefault(r.g, {})[r.o] = r.facings
    assert got == {g: brute_shares(items, pool, least) for g, (pool, items) in groups.items()}
    assert all(sum(got[g].values()) == max(0, pool) for g, (pool, _) in groups.items())


def brute_scores(rows, weights):
    out = {}
    for b in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == b]
        ends = {}
        for k in range(len(weights)):
            xs = [r[2 + k] for r in own if r[2 + k] is not None]
            ends[k] = np.quantile(xs, [0.05, 0.95]) if xs else None
        for r in own:
            total = weight = 0.0
            for k, w in enumerate(weights.values()):
                if r[2 + k] is not None:
                    lo, hi = ends[k]
                    total += w * (min(1, max(0, (r[2 + k] - lo) / (hi - lo))) if hi > lo else 0.5)
                    weight += w
            out[r[1]] = total / weight if weight else None
    return out


def test_scores_with_missing_inputs(spark):
    rng = random.Random(7)
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    rows = [("t", i, rng.lognormvariate(0, 2), None if i % 4 == 0 else float(i), 3.0) for i in range(90)]
    rows += [("u", 100 + i, None, None if i % 2 else 1.0, None) for i in range(6)] + [(None, 200 + i, float(i), 0.0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "bucket string, id int, a double, b double, c double").repartition(3)
    want = brute_scores(rows, weights)
    got = {r.id: r for r in strategy.strategic_score(df, weights | {"absent": 0.4}).collect()}
    assert set(got) == set(want) and all(got[i].strategic_score == pytest.approx(want[i], abs=1e-12) if want[i] is not None else got[i].strategic_score is None for i in want)
    assert got[1].inputs_used == 3 and got[0].inputs_used == 2 and got[101].inputs_used == 0
    assert {r.strategic_score for r in strategy.strategic_score(df, {"absent": 1.0}).collect()} == {None}


def product(bucket, rank, kind, fits=True, sales=100.0, fit="neutral"):
    return (bucket, rank, kind, 1.0 if fits else None, 100.0, 1000.0, 5, sales / rank, fit)


def test_facings_of_a_tier_with_its_innovation_pool(spark):
    rows = [product("A", k, ["Hero", "Strategic", "Innovation", "Tail"][k % 4], k % 7 != 0, fit=["strong_fit", "weak", None][k % 3]) for k in range(1, 41)]
    rows += [product("B", k, "Innovation") for k in range(1, 4)] + [product("C", k, "Tail") for k in range(1, 90)] + [product("D", 1, "Hero", False)]
    df = spark.createDataFrame(rows, "bucket string, rank int, sku_class string, cap double, w double, usable double, n_shelves int, sales double, fit string").repartition(3)
    got = strategy.weighted_facings(df).collect()
    assert len(got) == len(rows) and all(r.weighted == 0 for r in got if r.cap is None)
    for bucket, pool, total in (("A", "core", 45), ("A", "innovation", 5), ("B", "innovation", 50), ("C", "core", 50)):
        assert sum(r.weighted for r in got if (r.bucket, r.pool) == (bucket, pool)) == total
    c = {r["rank"]: r.weighted for r in got if r.bucket == "C"}
    assert all(c[k] == (1 if k <= 50 else 0) for k in c)
    order = ["Hero", "Strategic", "Tail"]
    for bucket, pool in (("A", "core"), ("A", "innovation"), ("B", "innovation")):
        own = [r for r in got if (r.bucket, r.pool) == (bucket, pool) and r.cap]
        times = {None: 100, "neutral": 100, "strong_fit": 125, "weak": 75}
        key = lambda r: ((order.index(r.sku_class) if r.sku_class in order else 0), r["rank"])
        items = [(key(r), round(r.sales, 4) * 10_000 * strategy.COMMERCIAL[r.sku_class] * times[r.fit]) for r in own]
        items = [(o, int(round(w))) for o, w in items]
        assert {key(r): r.weighted for r in own} == brute_shares(items, own[0].pool_facings, 1)


DAY = datetime.date(2024, 1, 1)


def sales(spark, rows):
    return spark.createDataFrame([(i, DAY + datetime.timedelta(days=d) if d is not None else None, v) for i, d, v in rows], "id string, at date, v double").repartition(3)


def by_id(df):
    return {r.id: tuple(r)[1:] for r in df.collect()}


def test_batches_give_what_all_rows_give(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", " hot ", *map(str, range(20)), None]), rng.choice([None, *range(100)]), rng.choice([None, 0.1, -5.0, 1e9])) for _ in range(400)]
    want = by_id(rfm.rolled_up(sales(spark, rows), "id", "at", "v"))
    folder = f"{shared_dir(spark)}/rfm-{uuid.uuid4().hex}"
    assert rfm.current(spark, folder).collect() == []
    for k in range(4):
        part = sales(spark, rows[k * 100 : k * 100 + 100])
        assert rfm.append(part, folder, f"day/{k}", "id", "at", "v") and not rfm.append(part, folder, f"day/{k}", "id", "at", "v")
        if k == 1:
            rfm.compact(spark, folder)
    assert by_id(rfm.current(spark, folder)) == want
    rfm.compact(spark, folder)
    assert by_id(rfm.current(spark, folder)) == want and not rfm.append(sales(spark, rows), folder, "day/0", "id", "at", "v")


def test_a_batch_that_fails_changes_nothing(spark):
    folder = f"{shared_dir(spark)}/rfm-{uuid.uuid4().hex}"
    rfm.append(sales(spark, [("a", 1, 2.0)]), folder, "1", "id", "at", "v")
    bad = sales(spark, [("a", 5, 1.0), ("b", 2, 1.0)]).withColumn("v", F.when(F.col("id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        rfm.append(bad, folder, "2", "id", "at", "v")
    sales(spark, [("x", 9, 9.0)]).write.parquet(f"{folder}/manifest/7")  # a manifest without its end
    spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/7/_SUCCESS").getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/7/_SUCCESS"), False)
    assert [r.frequency for r in rfm.current(spark, folder).collect()] == [1]
    assert rfm.append(sales(spark, [("a", 5, 1.0), ("b", 2, 1.0)]), folder, "2", "id", "at", "v")
    assert {i: (v[1], v[2], float(v[3])) for i, v in by_id(rfm.current(spark, folder)).items()} == {"a": (DAY + datetime.timedelta(days=5), 2, 3.0), "b": (DAY + datetime.timedelta(days=2), 1, 1.0)}


def test_classes_of_equal_values_are_alike(spark):
    state = rfm.rolled_up(sales(spark, [(str(k), k // 4, float(k)) for k in range(20)]), "id", "at", "v")
    got = {r.id: r for r in rfm.scored(state, F.lit(DAY + datetime.timedelta(days=10))).collect()}
    assert [got[str(k)].r for k in range(20)] == [1 + k // 4 for k in range(20)] and {r.f for r in got.values()} == {1} and [got[str(k)].m for k in (0, 3, 4, 19)] == [1, 1, 2, 5] and got["0"].recency == 10

"""Edge tables for the outlet analytics: nulls, ties, zero totals, odd numbers, racks, replies."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storelens import config as C
from storelens.functions import encode as E
from storelens.functions import textops
from storelens.operators import assortment, potential, priority, quality, ranking, rollup, segments, skustats, space
from storelens.plans import queries

SALES = "CUST_UNIQ_ID_VAL string, BRND_NM string, SUB_BRND_NM string, FLVR_NM string, PPG_DESC string, NET_SALES double"


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([
        (" 01", "Lays", "a", "x", "Small", 50.0), ("01", "Lays", "a", "x", "Small", None), ("01", "Kurkure", "b", "y", "Large", 30.0), ("02", "Lays", "a", "x", "Small", 10.0),
        ("02", "Doritos", "c", "z", "Medium", 10.0), ("03", None, None, None, None, None), ("03", "Quaker", "q", "o", "Small", 0.0), (None, "Lays", "a", "x", "Small", 9.0),
    ], SALES)


def one(df, expr):
    return df.select(expr.alias("v")).first().v


def test_numeric_forms(spark):
    texts = ["0x2a", "0xZZ", "1d", "1_000", " 12.5 ", "", None, "-3e2", "inf", "2g", "0X1F", ".5", "5."]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.numeric(F.col("t")).alias("v")).collect()]
    assert got == [42.0, None, None, None, 12.5, None, None, -300.0, None, None, 31.0, 0.5, 5.0]


def test_codes(spark):
    df = spark.createDataFrame([(" HIGH (>100) ", "600–1000 sqft", "Rs. 15", " Yes", -2.0, "a/b:c é_-" * 9)], "f string, s string, p string, y string, n double, l string")
    got = df.select(E.footfall(F.col("f")), E.store_size(F.col("s")), E.price_pack(F.col("p")), E.yes_no(F.col("y")), E.clip_negative(F.col("n")), E.safe_name(F.col("l"))).first()
    assert tuple(got) == (150.0, None, 15.0, 1.0, 0.0, ("a_b_c é_-" * 9)[:50])
    assert one(df, E.clip_negative(F.lit(None).cast("double"))) is None and one(df, E.flag(F.lit(None).cast("string"), "mt")) == 0.0


def test_rollup_counts_rows_and_pivot_keeps_nulls(sales):
    got = {r.OUTLET_UID_EDITED: (r.VPO, r.AVG_SKU) for r in rollup.outlet_rollup(sales).collect()}
    assert got == {"01": (80.0, 3), "02": (20.0, 2), "03": (0.0, 2)}
    keys = rollup.brand_pack_keys(sales)
    assert keys == ["DORITOS MEDIUM", "KURKURE LARGE", "LAYS SMALL", "QUAKER SMALL"]
    pivot = {r.OUTLET_UID_EDITED: r["LAYS SMALL"] for r in rollup.with_pivot(rollup.outlet_rollup(sales.where("BRND_NM <> 'Quaker' OR BRND_NM IS NULL")), rollup.brand_pack_pivot(sales.where("BRND_NM <> 'Quaker'"), keys)).collect()}
    assert pivot == {"01": 50.0, "02": 10.0, "03": None}


def test_master(spark):
    base = spark.createDataFrame([("1", 5.0), ("2", 6.0)], "OUTLET_UID_EDITED string, VPO double")
    master = spark.createDataFrame([(2, "1", None, "x"), (1, "1", 9.0, "first"), (3, "2", None, None)], "n int, OUTLET_UID_EDITED string, VPO double, channel string")
    first = rollup.dedupe_master(master, ["VPO", "channel", "none"], "n")
    out = rollup.fill_defaults(rollup.prefer_master(rollup.enrich(base, first)))
    got = {r.OUTLET_UID_EDITED: r for r in out.collect()}
    assert (got["1"].VPO, got["1"].channel, got["2"].VPO, got["2"].channel, got["2"].sector) == (9.0, "first", 6.0, "GT", "Urban")


def test_ranks_agree_with_plain_windows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), str("ABCD"[rng.integers(4)]), None if rng.random() < 0.05 else float(rng.integers(0, 60))) for i in range(800)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    got = ranking.rank_within(ranking.percentile(df, "v", "p"), "g", "v", "r")
    x = F.coalesce("v", F.lit(0.0))
    w = W.orderBy(x)
    plain = df.withColumn("top", F.count("*").over(w.rangeBetween(W.unboundedPreceding, 0))).withColumn("ties", F.count("*").over(W.partitionBy(x)))
    plain = plain.select("i", ((F.col("top") - (F.col("ties") - 1) / 2) / 800 * 100).alias("p"), F.rank().over(W.partitionBy("g").orderBy(F.desc("v"))).alias("r"))
    assert {(r.i, r.p, r.r) for r in got.collect()} == {(r.i, r.p, r.r) for r in plain.collect()}


def test_places_running_sums_and_quantiles_by_range(spark):
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 7 == 0 else "ab"[int(rng.integers(2))], float(rng.integers(0, 40)), int(rng.integers(0, 9))) for i in range(500)] + [(900, "one", 5.0, 1), (901, "none", None, 2)]
    df = spark.createDataFrame(rows, "i int, g string, v double, n long").repartition(5)
    got = {r.i: (r.place, r.run_n, r.all_n) for r in ranking.numbered(df, ["g"], [F.desc("v"), F.asc("i")], "place", ("n",)).collect()}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        run = np.cumsum([r[3] for r in own])
        assert all(got[r[0]] == (k + 1, run[k], run[-1]) for k, r in enumerate(own))
    q = {r.g: (r.a, r.b, r.c) for r in ranking.quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 1.0}, ["g"]).collect()}
    for g in {r[1] for r in rows} - {"none"}:
        assert np.allclose(q[g], np.quantile([r[2] for r in rows if r[1] == g], (0.25, 0.5, 1.0)))
    assert "none" not in q and ranking.quantiles(df.limit(0), "v", {"a": 0.5}).first().a is None
    down = ranking.filled_down(df.withColumn("x", F.when(F.col("i") % 50 == 3, F.col("i"))), "x", "i")
    assert {r.i: r.x for r in down.collect()} == {i: None if i < 3 else min(453, i - (i - 3) % 50) if i < 900 else 453 for i in (r[0] for r in rows)}


def test_buckets_at_their_borders(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "VPO double")
    got = {r.VPO: r.priority_bucket for r in priority.prioritised(df).collect()}
    assert got == {1: "D", 2: "D", 3: "D", 4: "C", 5: "C", 6: "C", 7: "B", 8: "B", 9: "A", 10: "A"}


@pytest.mark.parametrize("vpo, bucket, predicted, gap, pct", [(3902.0163, "B", 6905.09, 3003.07, 43.5), (1536.72168, "C", 2795.96, 1259.24, 45.0), (1218.876845, "D", 2110.23, 891.35, 42.2)])
def test_gap_formulas(spark, vpo, bucket, predicted, gap, pct):
    r = priority.gaps(spark.createDataFrame([(vpo, bucket, predicted)], "VPO double, priority_bucket string, predicted_raw double")).first()
    assert (r.opportunity_gap, r.gap_pct_of_potential, r.priority, r.has_upside) == (pytest.approx(gap, abs=0.011), pct, bucket + "+", True)
    none = priority.gaps(spark.createDataFrame([(None, "D", 0.0)], "VPO double, priority_bucket string, predicted_raw double")).first()
    assert (none.opportunity_gap, none.gap_pct_of_potential, none.priority) == (0.0, None, "D")


def test_impute_and_standardise(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (3.0, None, 5.0), (10.0, None, 5.0), (None, None, 5.0)], "a double, b double, c double")
    assert [r.a for r in priority.imputed(df, ["a", "b"]).collect()] == [1.0, 2.0, 3.0, 10.0, 2.5]
    out, names = priority.standardised(df, ["a", "b", "c"])
    assert names == ["z_a", "z_c"] and all(r.z_c == 0 for r in out.collect())
    x = np.array([1, 2, 3, 10, 2.5])
    assert np.allclose([r.z_a for r in out.collect()], (x - x.mean()) / x.std())
    with pytest.raises(ValueError, match="features"):
        priority.select_features(df, ["b"])


def test_correlation_leaves_constants_out(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k, 1.0, None if k == 3 else -float(k)) for k in range(9)], "VPO double, a double, k double, n double")
    assert {r.feature: r.r for r in priority.driver_correlation(df, ["a", "k", "n"]).collect()} == {"a": 1.0, "n": -1.0}


def test_quantile_fit_is_a_minimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 2))
    y = 10 + 3 * x[:, 0] + rng.exponential(2.0, 1500)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double").repartition(2).persist()
    beta = potential.quantile_fit(df, "y", ["a", "b"], tolerance=1e-7)
    value = lambda b: np.mean(np.maximum(0.75 * (y - b[0] - x @ b[1:]), -0.25 * (y - b[0] - x @ b[1:]))) + 0.01 * np.abs(b[1:]).sum()
    best = value(beta)
    assert abs(np.mean(y <= beta[0] + x @ beta[1:]) - 0.75) < 0.01
    assert all(value(beta + d) >= best * (1 - 1e-4) for d in rng.normal(scale=0.05, size=(300, 3)))
    ols = potential.least_squares_fit(df, "y", ["a", "b"])
    assert np.allclose(ols, np.linalg.lstsq(np.c_[np.ones(1500), x], y, rcond=None)[0])
    assert all(r.predicted_raw >= 0 for r in potential.predicted(df, ["a", "b"], np.array([-50.0, 1, 1])).collect())


def test_quality_checks(spark):
    df = spark.createDataFrame([("1", 0.0, -1.0), ("1", 1.0, 2.0), (None, None, 3.0), ("4", 1.0, 4.0)], "OUTLET_UID_EDITED string, VPO double, LAYS_SKU double")
    assert tuple(quality.duplicate_ids(df).first()) == (2, False) and tuple(quality.duplicate_ids(df.drop("OUTLET_UID_EDITED")).first()) == (0, True)
    assert tuple(quality.zero_share(df).first()) == (2, 50.0, False)
    assert [tuple(r) for r in quality.negatives(df, ["LAYS"]).collect()] == [("LAYS_SKU", 1)] and quality.negatives(df, []).count() == 0
    assert {r["column"]: r.null_pct for r in quality.null_percent(df).collect()}["VPO"] == 25.0
    rows = quality.report(df, ["VPO", "gone"]).orderBy("position").collect()
    assert len(rows) == 7 and [r["pass"] for r in rows] == [False, True, False, True, True, False, True]
    assert quality.verdict(quality.report(df, ["VPO"])).first().text.startswith("- required_columns: PASS\n- null_pct: PASS")
    assert quality.outliers(df.limit(0)).first().pct == 0.0


def test_kmeans_groups_and_numbers(spark):
    rows = [(float(c * 100 + k % 3), float(c)) for c in range(3) for k in range(20)]
    out = segments.kmeans(spark.createDataFrame(rows, "VPO double, x double"), ["x"], k=3, restarts=2)
    assert {(r.x, r.cluster) for r in out.collect()} == {(2.0, 0), (1.0, 1), (0.0, 2)}
    assert out.columns == ["VPO", "x", "cluster"]


def test_kmeans_of_embeddings_takes_every_component(spark, tmp_path):
    rows = [(k, [1.0] * 8 + [0.0] * 55 + [100.0 * (k % 2) + k / 100]) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = {r.vec_id: r.cluster for r in queries.kmeans_embeddings(spark, str(tmp_path)).collect()}
    assert not {c for k, c in out.items() if k % 2} & {c for k, c in out.items() if not k % 2}


@pytest.fixture(scope="module")
def listed(spark, sales):
    segs = spark.createDataFrame([("01", "A"), ("02", "A"), ("03", "B"), ("04", "B")], "OUTLET_UID_EDITED string, priority_bucket string")
    rows = assortment.joined(sales, segs)
    return assortment.products(rows, assortment.bucket_stores(segs)).persist(), rows


def test_products(listed):
    got = {(r.bucket, r.BRND_NM): r for r in listed[0].collect()}
    assert got["A", "Lays"].share == 0.6 and got["A", "Lays"].penetration == 1.0 and got["A", "Lays"]["index"] == pytest.approx(100.0) and got["A", "Lays"]["rank"] == 1
    assert got["B", "Quaker"].share == 0.0 and got["B", "Quaker"]["index"] is None and got["B", "Quaker"].penetration == 0.5
    heroes = assortment.heroes(listed[0]).where("sku_type = 'Hero'").select("bucket").collect()
    assert [r.bucket for r in heroes] == ["B"]  # in A the first product is over half of the sales
    assert {(r.bucket, r.avg_sku) for r in assortment.skus_per_store(listed[1]).collect()} == {("A", 2.0), ("B", 1.0)}
    tops = {(r.bucket, r["rank"]): r.cumulative for r in assortment.top_contribution(listed[0], (1, 3, 9)).collect()}
    assert tops["A", 1] == 0.6 and tops["A", 3] == 1.0 and tops["A", 9] == 0.0
    totals = {(r.BRND_NM, r.PPG_DESC): r.n for r in assortment.brand_pack_matrix(listed[0]).where("bucket = 'A'").collect()}
    assert totals[None, None] == 3 and totals["Lays", None] == 1


def test_racks_and_packs(spark):
    rows = [("Height", '1,600 mm (63")', "2000", "x"), ("Total WIDTH", "900.5 mm", "1200 mm", "800"), ("depth", "400 mm", "450", "1"), ("tiers", "4-5", "none", "2")]
    got = {r.rack: r for r in space.rack_specs(spark.createDataFrame(rows, "Parameter string, b string, a string, z string")).collect()}
    assert (got["b"].height_mm, got["b"].width_mm, got["b"].n_shelves, got["b"].position) == (1600.0, 900.5, 4, 0)
    assert (got["a"].height_mm, got["a"].n_shelves, got["z"].height_mm, got["z"].n_shelves) == (2000.0, 3, None, 2)
    raw = [(1, "lays", "large (Party Pack)", "25", "20", "8"), (2, "", "small", "10", "x", "3"), (3, " ", "insti mids", "12", "9", "4"), (4, None, "Large", "1", "1", "1"), (5, "New brand", "Family size", "9", "9", "9")]
    dims = space.pack_dims(spark.createDataFrame(raw, "row_no long, brand string, ppg_raw string, height_cm string, width_cm string, depth_cm string")).collect()
    assert {(r.brand_norm, r.ppg_norm, r.width_mm) for r in dims} == {("Lay's", "Large", 200.0), ("Lay's", "Medium", 90.0), ("New Brand", "Family Size", 90.0)}


@pytest.mark.parametrize("shelves", [1, 2, 3, 4, 5, 7])
def test_shelves_are_never_over_full(spark, shelves):
    rng = np.random.default_rng(shelves)
    rows = [("A", f"p{k}", k + 1, "Hero" if k < 10 else "Strategic" if k < 15 else "", 0.01 * (k % 4 + 1), 0.5, 100.0, *(None,) * 3) if k == 7 else ("A", f"p{k}", k + 1, "Hero" if k < 10 else "Strategic" if k < 15 else "", 0.01 * (k % 4 + 1), 0.5, 100.0, 900.0 if k == 9 else 100.0, float(rng.integers(40, 400)), 50.0) for k in range(60)]
    df = spark.createDataFrame(rows, "bucket string, product string, rank int, sku_type string, share double, penetration double, index double, h double, w double, d double").withColumns({"ppg_norm": F.when(F.col("rank") % 3 == 0, "Large").otherwise("Small"), "brand_norm": F.lit("x")})
    rack = spark.createDataFrame([Row(rack="r", position=0, depth_mm=400.0, shelf_height_mm=300.0, usable_width_mm=855.0, n_shelves=shelves)])
    out = space.shelf_assignment(space.preferred_zones(space.placement_order(space.facings(df, rack)))).persist()
    got = sorted(out.collect(), key=lambda r: r.place_no)
    assert [r.sku_type for r in got][:15] == ["Hero"] * 10 + ["Strategic"] * 5
    zones = space.ZONES.get(shelves, space.ZONES[5]) if shelves > 1 else ["eye_level"]
    left = dict.fromkeys(range(1, len(zones) + 1), 855.0)
    for r in got:  # the same first fit by hand
        if not r.facings:
            assert (r.shelf, r.zone) == (0, "not_placed") and r.warning
            continue
        fits = [s for z in r.zones for s in left if zones[s - 1] == z and left[s] >= r.used_mm]
        assert (r.shelf, r.zone) == ((fits[0], zones[fits[0] - 1]) if fits else (0, "overflow"))
        if fits:
            left[fits[0]] -= r.used_mm
    total = space.assets_needed(out).first()
    assert total.assets_needed == 1 and total.n_no_dims == 1 and total.n_placed + total.n_overflow == 58 and total.assets_with_overflow >= 1
    assert len(space.display(out).columns) == 21


def test_replies(spark):
    fenced = '```json\n[{"cluster_id": 1, "label": "B", "channel": "MT"}]\n```'
    df = spark.createDataFrame([(1, fenced), (2, "not json"), (3, None)], "doc_id int, text string")
    got = {(r.doc_id, r.cluster): (r.label, r.channel) for r in textops.labels_from_json(df, 2).collect()}
    assert got[1, 1] == ("B", "MT") and got[1, 0] == ("Segment 0", "GT") and got[2, 1] == ("Segment 1", "GT") and len(got) == 6
    lines = spark.createDataFrame([(1, "LABEL: lost\nCluster 0:\n label: One: two\nACTION: x\nCLUSTER two:\nCLUSTER 1 :\nlabel: B")], "doc_id int, text string")
    got = {r.cluster: (r.label, r.action) for r in textops.labels_from_lines(lines, 2).collect()}
    assert got == {0: ("One: two", "x"), 1: ("B", "Review cluster details manually.")}
    text = "intro\n## 1. IDENTITY CARD\nold\n**Identity**\nnew\nlines\nSection 6: Dimensions Radar\nScores: [2, 5]"
    got = {r.section: r.body for r in textops.sections(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()}
    assert got == {"identity_card": "new\nlines", "dimensions_radar": "Scores: [2, 5]"}
    table = textops.selection_table(spark.createDataFrame([("A", "RANK | TYPE\n1 | Hero | c | r\n2|Strategic\nx|y\n1 | Tail | d | s")], "bucket string, text string"))
    assert {tuple(r) for r in table.collect()} == {("A", 1, "Tail", "d", "s"), ("A", 2, "Strategic", "", "")}


def test_sku_statistics(sales):
    got = {r.BRND_NM: (r.n, r.penetration) for r in skustats.reference_penetration(sales).collect()}
    assert got["Lays"] == (4, 1.0) and got["Quaker"] == (1, 0.25)  # ids as they are written
    assert one(sales, skustats.tier_range(F.lit(0.7999))["lo"]) == 0.72 and one(sales, skustats.tier_range(F.lit(0.31))["hi"]) == 0.15
    sigma = {r.BRND_NM: r.sigma for r in skustats.lognormal(sales).collect()}
    assert sigma["Kurkure"] == 1.2 and sigma["Quaker"] == sigma["Quaker"]
    assert C.TIERS[0] == "A+"


def test_first_fit_agrees_with_a_plain_fold_on_long_lists(spark):
    rng = np.random.default_rng(4)
    zones = [["base", "eye_level", "grab_zone", "upper"], ["upper", "eye_level", "grab_zone", "base"], ["eye_level", "grab_zone", "base", "upper"]]
    rows = []
    for bucket in "AB":
        for n in range(600):
            f = int(rng.integers(0, 4))
            rows.append((bucket, "r", n + 1, f"p{n}", f if n % 9 else None, None if f == 0 else float(rng.integers(2, 40)) * 7.5, zones[int(rng.integers(3))], 855.0, 4))
    df = spark.createDataFrame(rows, "bucket string, rack string, place_no int, product string, facings int, used_mm double, zones array<string>, usable double, n_shelves int").repartition(3)
    got = {(r.bucket, r.place_no): (r.shelf, r.zone) for r in space.shelf_assignment(df).collect()}
    names = space.ZONES[4]
    for bucket in "AB":
        left = [855.0] * 4
        for _, _, n, _, f, used, order, *_ in sorted(r for r in rows if r[0] == bucket):
            shelf, zone = 0, "not_placed"
            if f:
                fits = [k for z in order for k in range(4) if names[k] == z and left[k] >= used]
                shelf, zone = (fits[0] + 1, names[fits[0]]) if fits else (0, "overflow")
                if fits:
                    left[fits[0]] -= used
            assert got[bucket, n] == (shelf, zone)


def test_negative_text_counts_as_the_number_that_it_is(spark):
    df = spark.createDataFrame([("-1", "x"), ("2", "-3"), (None, "-0.5")], "LAYS_SKU string, ACCT string")
    assert {r.column: r.negatives for r in quality.negatives(df, ["SKU", "ACCT"]).collect()} == {"LAYS_SKU": 1, "ACCT": 2}

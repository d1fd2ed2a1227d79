"""Lists that keep rules, against a plain version that looks at all products."""

import random

import pytest

from storelens.operators import mustlist

SCHEMA = "bucket string, BRND_NM string, PPG_DESC string, rank long, sales double, penetration double, cumulative double, why string"


def table(spark, products):
    out = []
    for bucket, rows in products.items():
        total, run = sum(s for *_, s in rows) or 1, 0
        for k, (brand, pack, sales) in enumerate(rows, 1):
            run += sales
            out.append((bucket, brand, pack, k, float(sales), 0.1 if k % 3 == 0 else 0.5, run / total, "x"))
    return spark.createDataFrame(out, SCHEMA).repartition(3)


def brute(rows, least, most):
    total, held = sum(s for *_, s in rows), {}
    for k, (_, _, s) in enumerate(rows, 1):
        if len(held) < most and (len(held) < least or sum(rows[j - 1][2] for j in held) * 100 < 70 * total):
            held[k] = "Sales"
    brand, pack = (lambda k: rows[k - 1][0]), (lambda k: rows[k - 1][1])
    while True:
        n, off = len(held), [k for k in range(1, len(rows) + 1) if k not in held]
        of_brand, of_pack = (lambda b: sum(brand(k) == b for k in held)), (lambda p: sum(pack(k) == p for k in held))
        add = drop = None
        new = next((k for k in off if not of_pack(pack(k))), None)
        spare = max((k for k in held if of_pack(pack(k)) >= 2), default=None)
        over = next((brand(k) for k in sorted(held) if of_brand(brand(k)) * 100 > 60 * n), None)
        if new and (n < most or spare):
            add, drop, why = new, spare if n >= most else None, "Pack balance"
        elif over and (other := next((k for k in off if brand(k) != over), None)) and (n < most or any(brand(k) == over and (of_pack(pack(k)) >= 2 or pack(k) == pack(other)) for k in held)):
            add, drop, why = other, None if n < most else max(k for k in held if brand(k) == over and (of_pack(pack(k)) >= 2 or pack(k) == pack(other))), "Brand balance"
        elif n < most and (n < least or sum(rows[j - 1][2] for j in held) * 100 < 70 * total):
            add, why = next((k for k in off if (of_brand(brand(k)) + 1) * 100 <= 60 * (n + 1)), None), "Coverage"
        if not add:
            return held
        held.pop(drop, None)
        held[add] = why


def products(rng, n, brands, packs):
    """A hot brand holds most of the top, packs are rare."""
    sales = sorted((rng.randint(0, 300) * rng.choice([1, 1, 10]) for _ in range(n)), reverse=True)
    return [(("hot" if rng.random() < 0.75 else f"b{rng.randrange(brands)}"), (f"p{rng.randrange(packs)}" if rng.random() < 0.1 else "p0"), s) for s in sales]


@pytest.mark.parametrize("seed", range(4))
def test_lists_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    tiers = {t: products(rng, rng.choice([0, 1, 4, 30, 150]) if seed else 150, rng.choice([1, 3, 40]), rng.choice([1, 4, 30])) for t in "ABCD"}
    tiers |= {"other": products(rng, 30, 3, 3)}
    got = {}
    for r in mustlist.selection(table(spark, tiers)).collect():
        assert got.setdefault(r.bucket, {}).setdefault(r.rank, r.why) == r.why
    assert got == {t: brute(tiers[t], *mustlist.SLOTS[t]) for t in "ABCD" if tiers[t]}


def test_repairs_are_made_and_rules_told(spark):
    rows = [("hot", "p0", 1000 - k) for k in range(60)] + [("cold", "p1", 5), ("cold", "p2", 4), ("mild", "p0", 3), ("mild", "p0", 2)] + [("cold", "p0", 1)] * 3
    df = table(spark, {"D": rows, "A": rows[:3]})
    chosen = mustlist.selection(df)
    d = {r["rank"]: r.why for r in chosen.where("bucket = 'D'").collect()}
    assert len(d) == 8 and d[61] == d[62] == "Pack balance" and sum(v == "Brand balance" for v in d.values()) == 2 and max(k for k in d if k <= 60) == 4
    told = {(r.bucket, r.rule): (r.found, r.wanted, r["pass"]) for r in mustlist.validation(df, chosen).collect()}
    assert told["D", "brand_share"] == (50.0, 60.0, True) and told["D", "packs"] == (3.0, 3.0, True) and not told["D", "coverage"][2] and told["D", "penetration"] == (1.0, 0.0, False)
    assert told["A", "least_products"] == (3.0, 15.0, False) and told["A", "brand_share"] == (100.0, 60.0, False) and told["A", "coverage"][2] and len(told) == 14


def test_other_rules_and_no_products(spark):
    assert mustlist.selection(table(spark, {"A": []})).collect() == []
    rows = [(f"b{k % 2}", "p", 10) for k in range(10)]
    df = table(spark, {"own": rows})
    got = mustlist.selection(df, {"own": (1, 6)}, coverage=25, brand_share=50)
    assert sorted(r["rank"] for r in got.collect()) == [1, 2, 3, 4]  # three suffice, but hold one brand twice
    assert [r.rule for r in mustlist.validation(df, got, {"own": (1, 6)}, 25, 50).where("NOT pass").collect()] == ["penetration"]

"""Must-stock lists that keep rules: enough of a tier's sales, a number of products by tier, every pack, no brand too often.

The list is first the top of the ranking: as many products as it takes to reach the share of sales, within the
tier's numbers. Then it is repaired, one product a step: a missing pack gets its best product, a brand that has too
many slots loses some to the best products of others, and what that cost in sales is made good while there is room.
A step that would break a pack again isn't taken, so this ends.

What the repair can ever choose from is known beforehand: no more than the last number of slots of each brand, of
those the first three times as many, and the best product of each pack. These few products of a tier are one row, and
the repair is a fold over it; the tier's other products are only counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Least and most products on the list of a tier; shares, in percent, that the rules name.
SLOTS = {"A": (15, 20), "B": (10, 15), "C": (8, 12), "D": (5, 8)}
COVERAGE, BRAND_SHARE, PENETRATION = 70, 60, 20
#: Why a product is on the list.
WHY = ["Sales", "Pack balance", "Brand balance", "Coverage"]
UNITS = 10_000


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def of_tier(bucket: Column, slots: dict[str, tuple[int, int]], which: int) -> Column:
    return F.create_map(*(F.lit(x) for tier, range_ in slots.items() for x in (tier, range_[which])))[bucket]


def candidates(listed: DataFrame, slots: dict[str, tuple[int, int]]) -> DataFrame:
    """bucket, and the products that its list can hold by rank (struct of rank, brand, pack, units of sales), the units of all its products, least and most slots."""
    rows = listed.select("bucket", F.col("BRND_NM").alias("brand"), F.col("PPG_DESC").alias("pack"), F.col("rank").cast("int").alias("rank"), (F.col("sales").cast("decimal(28,4)") * UNITS).cast("long").alias("units"))
    rows = rows.withColumn("most", of_tier(F.col("bucket"), slots, 1)).where("most IS NOT NULL")
    widest = max(most for _, most in slots.values())
    in_brand = F.row_number().over(W.partitionBy("bucket", "brand").orderBy("rank"))
    first = rows.withColumn("k", in_brand).where(F.col("k") <= widest)  # a limit that Spark applies before the exchange too
    first = first.withColumn("k", F.row_number().over(W.partitionBy("bucket").orderBy("rank"))).where(F.col("k") <= 3 * widest).drop("k")
    packs = rows.groupBy("bucket", "pack").agg(F.min_by(F.struct(*rows.columns), "rank").alias("p")).select("p.*")
    packs = packs.withColumn("k", F.row_number().over(W.partitionBy("bucket").orderBy("rank"))).where(F.col("k") <= widest).drop("k")
    held = first.union(packs).groupBy("bucket").agg(F.array_sort(F.collect_set(F.struct("rank", "brand", "pack", "units"))).alias("items"))  # 4 times `widest` at most
    whole = rows.groupBy("bucket").agg(F.sum("units").alias("all_units"))
    return held.join(F.broadcast(whole), "bucket").withColumns({"least": of_tier(F.col("bucket"), slots, 0), "most": of_tier(F.col("bucket"), slots, 1)})  # a row for each tier


def repaired(items: Column, start: Column, least: Column, most: Column, all_units: Column, steps: int, coverage: int, brand_share: int) -> Column:
    """The list (array of rank, why) after as many repairs as can be needed."""
    among = lambda xs, x: F.size(F.filter(xs, lambda y: y.pack == x.pack))
    first = lambda xs: F.get(xs, F.lit(0))
    last = lambda xs: F.try_element_at(xs, F.lit(-1))

    def move(add: Column, drop: Column, why: int) -> Column:
        return F.struct(add.rank.alias("add"), drop.alias("drop"), F.lit(why).alias("why"))

    def moves(on: Column, off: Column) -> Column:
        n = F.size(on)
        room = n < most
        of_brand = lambda b: F.size(F.filter(on, lambda y: y.brand == b))
        no_drop = F.lit(None).cast("int")
        # a pack that has no product on the list
        pack = let(first(F.filter(off, lambda x: ~F.exists(on, lambda y: y.pack == x.pack))), lambda x: F.when(x.isNotNull(), let(last(F.filter(on, lambda y: among(on, y) >= 2)).rank, lambda out: F.when(room, move(x, no_drop, 1)).when(out.isNotNull(), move(x, out, 1)))))
        # a brand with more than its share of the slots
        too_often = first(F.filter(on, lambda x: of_brand(x.brand) * 100 > brand_share * n)).brand
        swap = lambda b, x: let(last(F.filter(on, lambda y: (y.brand == b) & ((among(on, y) >= 2) | (y.pack == x.pack)))).rank, lambda out: F.when(room, move(x, no_drop, 2)).when(out.isNotNull(), move(x, out, 2)))
        brand = let(too_often, lambda b: F.when(b.isNotNull(), let(first(F.filter(off, lambda x: x.brand != b)), lambda x: F.when(x.isNotNull(), swap(b, x)))))
        # too little of the sales, or too few products
        short = (F.aggregate(on, F.lit(0).cast("long"), lambda s, y: s + y.units) * 100 < all_units * coverage) | (n < least)
        more = let(first(F.filter(off, lambda x: (of_brand(x.brand) + 1) * 100 <= brand_share * (n + 1))), lambda x: F.when(room & short & x.isNotNull(), move(x, no_drop, 3)))
        return F.coalesce(pack, brand, more)

    def step(state: Column, _: Column) -> Column:
        listed = lambda x: F.exists(state, lambda y: y.rank == x.rank)
        made = let(F.filter(items, listed), lambda on: let(F.filter(items, lambda x: ~listed(x)), lambda off: moves(on, off)))
        after = lambda m: F.concat(F.filter(state, lambda y: (y.rank != m["drop"]) | m["drop"].isNull()), F.array(F.struct(m["add"].alias("rank"), m["why"].alias("why"))))
        return let(made, lambda m: F.when(m.isNull(), state).otherwise(after(m)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def selection(listed: DataFrame, slots: dict[str, tuple[int, int]] | None = None, coverage: int = COVERAGE, brand_share: int = BRAND_SHARE) -> DataFrame:
    """Products of a ranking (as `assortment.products` makes it) -> bucket, rank, why: the list of each tier that `slots` names.

    `why`: Sales for the top of the ranking, else the repair that brought the product in. Tiers without products have no list.
    """
    slots = slots or SLOTS
    widest = max(most for _, most in slots.values())
    held = candidates(listed, slots)
    enough = F.size(F.filter(F.transform("items", lambda x: F.aggregate(F.filter("items", lambda y: y.rank < x.rank), F.lit(0).cast("long"), lambda s, y: s + y.units)), lambda ahead: ahead * 100 < F.col("all_units") * coverage))
    top = F.least(F.greatest(enough, F.col("least")), F.col("most"))
    start = F.transform(F.filter("items", lambda x: x.rank <= top), lambda x: F.struct(x.rank.alias("rank"), F.lit(0).alias("why")))
    out = held.withColumn("start", start)
    out = out.select("bucket", F.inline(repaired(F.col("items"), F.col("start"), F.col("least"), F.col("most"), F.col("all_units"), 4 * widest, coverage, brand_share)))
    return out.select("bucket", "rank", F.get(F.array(*map(F.lit, WHY)), F.col("why")).alias("why"))


def validation(listed: DataFrame, chosen: DataFrame, slots: dict[str, tuple[int, int]] | None = None, coverage: int = COVERAGE, brand_share: int = BRAND_SHARE, penetration: int = PENETRATION) -> DataFrame:
    """A ranking and a list (bucket, rank, why) -> bucket, rule, found, wanted, pass: a row for each tier of the ranking and each rule.

    Shares are in percent. penetration: products that few stores sell are on the list for a reason other than their sales only.
    """
    slots = slots or SLOTS
    units = (F.col("sales").cast("decimal(28,4)") * UNITS).cast("long")
    rows = listed.where(of_tier(F.col("bucket"), slots, 0).isNotNull()).select("bucket", F.col("rank").cast("int").alias("rank"), F.col("BRND_NM").alias("brand"), F.col("PPG_DESC").alias("pack"), units.alias("units"), "penetration", "cumulative")
    packs = rows.groupBy("bucket", "pack").agg(F.sum("units").alias("units"))
    whole = packs.groupBy("bucket").agg(F.count("*").alias("n_packs"), F.sum("units").alias("all_units"))
    own = rows.join(F.broadcast(chosen.select("bucket", F.col("rank").cast("int").alias("rank"), "why")), ["bucket", "rank"])  # as many as there are slots
    brands = own.groupBy("bucket", "brand").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max("n").alias("n_brand"))
    found = own.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("units").alias("units"), F.sum(F.when(F.col("cumulative") <= 0.5, F.col("units")).otherwise(0)).alias("hero_units"), F.count_distinct("pack").alias("packs"),
        F.count_if((F.col("penetration") * 100 < penetration) & (F.col("why") == WHY[0])).alias("rare"),
    )
    all_ = whole.join(found, "bucket", "left").join(brands, "bucket", "left").na.fill(0)
    percent = lambda a, b: F.coalesce(F.try_divide(a.cast("double") * 100, b.cast("double")), F.lit(0.0))
    c, num = F.col, lambda x: F.lit(x).cast("double")
    least, most = of_tier(c("bucket"), slots, 0), of_tier(c("bucket"), slots, 1)
    rules = {
        "hero_share": (percent(c("hero_units"), c("all_units")), num(50), c("hero_units") * 2 <= c("all_units")),
        "coverage": (percent(c("units"), c("all_units")), num(coverage), c("units") * 100 >= c("all_units") * coverage),
        "least_products": (c("n").cast("double"), least.cast("double"), c("n") >= least),
        "most_products": (c("n").cast("double"), most.cast("double"), c("n") <= most),
        "brand_share": (percent(c("n_brand"), c("n")), num(brand_share), c("n_brand") * 100 <= c("n") * brand_share),
        "packs": (c("packs").cast("double"), c("n_packs").cast("double"), c("packs") == c("n_packs")),
        "penetration": (c("rare").cast("double"), num(0), c("rare") == 0),
    }
    lines = F.array(*[F.struct(F.lit(k).alias("rule"), F.bround(f, 4).alias("found"), w.alias("wanted"), p.alias("pass")) for k, (f, w, p) in rules.items()])
    return all_.select("bucket", F.inline(lines))

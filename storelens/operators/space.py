"""Shelf space: facings and days of supply of the listed products, and their places on the shelves of a rack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config as C
from ..functions.encode import looked_up, plain
from ..plans.lineage import cut
from . import ranking

# Zones by number of shelves, standard names of brands and packs.
ZONES = {
    2: ["grab_zone", "eye_level"],
    3: ["base", "eye_level", "upper"],
    4: ["base", "grab_zone", "eye_level", "upper"],
    5: ["base", "grab_zone", "eye_level", "eye_level", "upper"],
}
FALL_THROUGH = ["eye_level", "grab_zone", "base", "upper"]
BRANDS = {"lays": "Lay's", "lay's": "Lay's", "kurkure": "Kurkure", "uncle chipps": "Uncle Chipps", "doritos": "Doritos", "cheetos": "Cheetos", "quaker": "Quaker"}
PACKS = {"small": "Small", "medium": "Medium", "large": "Large", "extra large": "Extra Large", "insti large": "Large", "insti mids": "Medium"}


def brand_name(c: Column) -> Column:
    return F.coalesce(looked_up(plain(c), BRANDS), F.initcap(F.trim(c)))


def pack_name(c: Column) -> Column:
    return F.coalesce(looked_up(plain(c), PACKS), F.initcap(F.trim(c)))


def pack_dims(raw: DataFrame) -> DataFrame:
    """row_no, brand, ppg_raw and sizes in cm as text -> brand_norm, ppg_norm and sizes in cm and mm, one row for a brand and pack (the first).

    A blank brand is that of the rows above it; rows without three numbers go. What stands in brackets after
    a pack's name is left out of the standard name.
    """
    out = ranking.filled_down(raw.withColumn("brand", F.when(F.trim("brand") != "", F.trim("brand"))), "brand", "row_no")
    sizes = ["height", "width", "depth"]
    out = out.withColumns({f"{s}_cm": F.trim(F.col(f"{s}_cm")).try_cast("double") for s in sizes}).dropna(subset=[f"{s}_cm" for s in sizes])
    out = out.withColumns({"brand_norm": brand_name(F.col("brand")), "ppg_norm": pack_name(F.regexp_replace("ppg_raw", r"\s*\(.*", ""))})
    out = out.withColumns({f"{s}_mm": F.col(f"{s}_cm") * 10 for s in sizes})
    first = F.row_number().over(W.partitionBy("brand_norm", "ppg_norm").orderBy("row_no"))
    return out.withColumn("__n", first).where("__n = 1").select("brand", "brand_norm", "ppg_raw", "ppg_norm", *[f"{s}_{u}" for u in ("cm", "mm") for s in sizes])


def rack_specs(raw: DataFrame) -> DataFrame:
    """Parameter and a column for each rack -> a row for each rack, in file order: sizes in mm, shelves, usable width, height of a shelf."""
    racks = [c for c in raw.columns if c != "Parameter"]
    rows = raw.withColumn("at", F.monotonically_increasing_id()).unpivot(["Parameter", "at"], [F.col(f"`{c}`") for c in racks], "rack", "cell")
    name = F.lower("Parameter")
    kind = F.when(name.contains("height"), "height").when(name.contains("width"), "width").when(name.contains("depth"), "depth").when(name.contains("shelf") | name.contains("tier"), "shelves")
    mm = F.nullif(F.regexp_replace(F.regexp_extract("cell", r"([\d,]+(?:\.\d+)?)\s*mm", 1), ",", ""), F.lit("")).try_cast("double")
    digits = F.transform(F.regexp_extract_all("cell", F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("double"))
    size = F.coalesce(mm, F.try_element_at(digits, F.lit(1)))
    mean = F.bround(F.aggregate(digits, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(digits), F.lit(0)), 0)
    rows = rows.select("rack", "at", kind.alias("kind"), F.when(kind == "shelves", F.coalesce(mean, F.lit(3.0))).otherwise(size).alias("value")).where("kind IS NOT NULL")
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.col("at")))
    out = rows.groupBy("rack").agg(last("height").alias("height_mm"), last("width").alias("width_mm"), last("depth").alias("depth_mm"), F.coalesce(last("shelves"), F.lit(5.0)).cast("int").alias("n_shelves"))
    place = F.create_map(*(F.lit(x) for k, r in enumerate(racks) for x in (r, k)))
    return out.select(place[F.col("rack")].alias("position"), "*", (F.col("width_mm") * C.USABLE_WIDTH).alias("usable_width_mm"), (F.col("height_mm") / F.col("n_shelves") * C.USABLE_HEIGHT).alias("shelf_height_mm"))


def msl_fields(msl: DataFrame) -> DataFrame:
    """Numbers of a list as numbers (share and penetration 0 if they are none), `selected`; rows without a product go."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    out = msl.where(F.col("product").isNotNull() & (F.trim("product") != ""))
    return out.withColumns({"share": F.coalesce(number("share"), F.lit(0.0)), "penetration": F.coalesce(number("penetration"), F.lit(0.0)), "rank": number("rank").cast("int"), "index": number("index"), "selected": F.coalesce(F.col("msl_selection") == "✓", F.lit(False))})


def selected_or_all(msl: DataFrame) -> DataFrame:
    """Per bucket the selected products, or all where none is."""
    some = msl.groupBy(F.col("bucket").alias("__b")).agg(F.max("selected").alias("__some"))  # a row for each tier
    return msl.join(F.broadcast(some), F.col("bucket").eqNullSafe(F.col("__b"))).where(F.col("selected") | ~F.col("__some")).drop("__b", "__some")


def with_packs(msl: DataFrame, dims: DataFrame) -> DataFrame:
    """Products with the size of their pack, null where it isn't known."""
    own = msl.withColumns({"brand_norm": brand_name(F.col("BRND_NM")), "ppg_norm": pack_name(F.col("PPG_DESC"))})
    return own.join(dims.select("brand_norm", "ppg_norm", "height_mm", "width_mm", "depth_mm").withColumnsRenamed({"height_mm": "h", "width_mm": "w", "depth_mm": "d"}), ["brand_norm", "ppg_norm"], "left")


def first_rack(racks: DataFrame) -> DataFrame:
    return racks.orderBy("position").limit(1)


def facings(products: DataFrame, rack: DataFrame) -> DataFrame:
    """Products in one rack: units a week, facings, width, days of supply (before the width cap), warning.

    Packs without a size have no facings; packs taller than a shelf have 0; packs wider than a shelf in
    the facings they need are cut to what fits, with a warning.
    """
    spec = rack.select("rack", F.col("depth_mm").alias("rack_d"), F.col("shelf_height_mm").alias("shelf_h"), F.col("usable_width_mm").alias("usable"), "n_shelves")
    out = products.join(F.broadcast(spec))  # one rack
    known, tall = F.col("h").isNotNull() & F.col("w").isNotNull() & F.col("d").isNotNull(), F.col("h") > F.col("shelf_h")
    cap = F.greatest(F.lit(1.0), F.floor(F.try_divide(F.col("rack_d"), F.col("d")))) * F.greatest(F.lit(1.0), F.floor(F.try_divide(F.col("shelf_h"), F.col("h"))))
    out = out.withColumns({"units": C.WEEKLY_UNITS * F.col("share"), "cap": F.when(known & ~tall, cap.cast("double"))})
    need = F.greatest(F.lit(1.0), F.ceil(F.col("units") / F.col("cap")).cast("double"))
    out = out.withColumn("need", F.when(known & ~tall, need))
    out = out.withColumn("dos", F.bround(F.col("cap") * F.col("need") / F.greatest(F.col("units") / C.DAYS, F.lit(0.01)), 1))
    wide = F.col("need") * F.col("w") > F.col("usable")
    final = F.when(~known, None).when(tall, 0.0).when(wide, F.greatest(F.lit(1.0), F.floor(F.try_divide(F.col("usable"), F.col("w"))).cast("double"))).otherwise(F.col("need"))
    warning = F.when(~known, "No pack dimensions").when(tall, "Pack taller than shelf").when(wide, "Facings cut to shelf width").otherwise("")
    return out.withColumn("facings", final.cast("int")).withColumns({"used_mm": F.col("facings") * F.col("w"), "warning": warning}).drop("need")


def placement_order(df: DataFrame) -> DataFrame:
    """place_no within a bucket: Hero, Strategic, the rest; then rank (null last), then name."""
    kind = F.when(F.col("sku_type") == "Hero", 0).when(F.col("sku_type") == "Strategic", 1).otherwise(2)
    out = ranking.numbered(df.withColumn("__kind", kind), ["bucket", "rack"], [F.asc("__kind"), F.asc_nulls_last("rank"), F.asc("product")], "place_no")
    return out.drop("__kind")


def preferred_zones(df: DataFrame) -> DataFrame:
    """zones: large packs to the base, Hero at eye level, Strategic in the grab zone, the rest on top; then the fixed order."""
    first = F.when(F.col("ppg_norm").isin("Large", "Extra Large"), "base").when(F.col("sku_type") == "Hero", "eye_level").when(F.col("sku_type") == "Strategic", "grab_zone").otherwise("upper")
    return df.withColumn("zones", F.array_distinct(F.concat(F.array(first), F.array(*map(F.lit, FALL_THROUGH)))))


def zone_of_shelves(n: Column) -> Column:
    """The zones of a rack's shelves from below: those of 5 shelves for more; one shelf is eye level."""
    out = F.when(n == 1, F.array(F.lit("eye_level")))
    for k in (2, 3, 4):
        out = out.when(n == k, F.array(*map(F.lit, ZONES[k])))
    return out.otherwise(F.array(*map(F.lit, ZONES[5])))


def shelf_assignment(df: DataFrame) -> DataFrame:
    """Greedy first fit, by place_no, then by preferred zone, then from the lowest shelf: shelf and zone of each product.

    "overflow" where no shelf has the width left; "not_placed" (shelf 0) where there are no facings. Of products of
    one width and zones only as many can find a place as the rack holds of that width, so only these first ones of each
    width are folded (as many as widths and shelves make, however long the list is), and the fold keeps what it places.
    """
    df = cut(df, "to-place")
    kind = W.partitionBy("bucket", "rack", "used_mm", "zones").orderBy("place_no")
    fits = F.floor(F.col("usable") / F.col("used_mm")) * F.col("n_shelves")
    on = df.where((F.col("facings") > 0) & (F.col("used_mm") > 0))
    most = int(on.agg(F.max(fits)).first()[0] or 0)  # known before, so that tasks keep no more of a width
    first = on.withColumn("__n", F.row_number().over(kind)).where((F.col("__n") <= most) & (F.col("__n") <= fits))
    item = F.struct("place_no", F.col("used_mm").alias("used"), "zones")
    groups = first.groupBy("bucket", "rack").agg(F.first("usable").alias("usable"), zone_of_shelves(F.first("n_shelves")).alias("shelf_zones"), F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.transform("shelf_zones", lambda z: F.col("usable")).alias("left"), F.array().cast("array<struct<place_no:int,shelf:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        shelves = F.sequence(F.lit(1), F.size("shelf_zones"))
        fit = F.flatten(F.transform(x.zones, lambda z: F.filter(shelves, lambda s: (F.col("shelf_zones")[s - 1] == z) & (acc.left[s - 1] >= x.used))))
        shelf = F.try_element_at(fit, F.lit(1))
        left = F.transform(acc.left, lambda w, i: F.when(i + 1 == shelf, w - x.used).otherwise(w))
        out = F.when(shelf.isNull(), acc.out).otherwise(F.array_append(acc.out, F.struct(x.place_no.alias("place_no"), shelf.alias("shelf"))))
        return F.struct(left.alias("left"), out.alias("out"))

    placed = groups.select("bucket", "rack", "shelf_zones", F.inline(F.aggregate("items", start, step, lambda acc: acc.out)))  # what stands on a rack
    placed = placed.select(F.col("bucket").alias("__b"), F.col("rack").alias("__r"), F.col("place_no").alias("__p"), "shelf", F.get("shelf_zones", F.col("shelf") - 1).alias("zone"))
    out = df.join(placed, F.col("bucket").eqNullSafe(F.col("__b")) & F.col("rack").eqNullSafe(F.col("__r")) & (F.col("place_no") == F.col("__p")), "left").drop("__b", "__r", "__p")
    other = F.when(F.coalesce("facings", F.lit(0)) > 0, "overflow").otherwise("not_placed")
    return out.withColumns({"zone": F.coalesce("zone", other), "shelf": F.coalesce("shelf", F.lit(0))})


def assets_needed(placed: DataFrame) -> DataFrame:
    """bucket: racks needed for what is placed, and with what overflows; share placed in percent; counts."""
    on = ~F.col("zone").isin("overflow", "not_placed")
    room = F.first(F.col("usable") * F.col("n_shelves"))
    racks = lambda c: F.greatest(F.lit(1), F.ceil(F.try_divide(F.coalesce(F.sum(F.when(c, F.col("used_mm"))), F.lit(0.0)), room)).cast("int"))
    return placed.groupBy("bucket").agg(
        racks(on).alias("assets_needed"), racks(on | (F.col("zone") == "overflow")).alias("assets_with_overflow"),
        F.bround(F.coalesce(F.sum(F.when(on, F.col("share").cast("decimal(20,10)"))).cast("double"), F.lit(0.0)) * 100, 1).alias("coverage_pct"),
        F.count_if(on).alias("n_placed"), F.count_if(F.col("zone") == "overflow").alias("n_overflow"), F.count_if(F.col("h").isNull()).alias("n_no_dims"),
    )


def highlights(placed: DataFrame, top: int = 8) -> DataFrame:
    """The first `top` Hero and Strategic products of each bucket by rank, and those with a warning."""
    own = placed.select("bucket", "sku_type", "product", "rank", "shelf", "zone", "dos", "warning", "rack", "place_no")
    n = F.row_number().over(W.partitionBy("bucket", "sku_type").orderBy(F.asc_nulls_last("rank"), "product"))
    first = own.where(F.col("sku_type").isin("Hero", "Strategic")).withColumn("__n", n).where(F.col("__n") <= top).drop("__n")  # tasks keep `top` of a group before they pass it on
    return first.union(own.where("warning <> ''")).distinct().drop("rack", "place_no")


def display(placed: DataFrame) -> DataFrame:
    """The columns of a report, shares and penetration in percent."""
    return placed.select(
        "bucket", "rack", "place_no", "rank", "product", F.col("brand_norm").alias("brand"), F.col("ppg_norm").alias("pack"), "sku_type",
        F.bround(F.col("share") * 100, 2).alias("share_pct"), F.bround(F.col("penetration") * 100, 1).alias("penetration_pct"), F.bround("index", 1).alias("index"),
        F.col("h").alias("height_mm"), F.col("w").alias("width_mm"), F.col("d").alias("depth_mm"), "units", "facings", "used_mm", "dos", "shelf", "zone", "warning",
    )

"""The whole run: quality, tiers, potential, segments, must-stock lists, space and reports, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import encode as E
from ..operators import assortment, potential, priority, quality, rollup, segments, space
from ..sources import sinks
from .lineage import cut

ENCODED = {
    "estmtd_daily_footfall_numeric": ("estmtd_daily_footfall_tag", E.footfall), "cooler_available_bin": ("cooler_available", E.yes_no), "BI_bin": ("BI", E.yes_no),
    "store_size_bracket_num": ("store_size_bracket", E.store_size), "chocolates_lead_pack_num": ("chocolates_lead_pack", E.price_pack),
    "is_modern_trade": ("store_format", lambda c: E.flag(c, "mt")), "is_urban": ("sector", lambda c: E.flag(c, "urban")), "is_urban_tagged": ("urban_vs_periphery_tagging", lambda c: E.flag(c, "urban")),
}


def encoded(df: DataFrame) -> DataFrame:
    """df with the numeric form of each attribute that it has."""
    return df.withColumns({new: f(F.col(f"`{old}`")) for new, (old, f) in ENCODED.items() if old in df.columns})


def outlet_table(df: DataFrame, master: DataFrame | None = None, order: str = C.OUTLET_ID) -> DataFrame:
    """Outlets as they are; sales of products are rolled up first, and enriched from a master table if there is one."""
    if rollup.is_sku_table(df):
        out = rollup.outlet_rollup(df)
        if master is not None:
            out = rollup.prefer_master(rollup.enrich(out, rollup.dedupe_master(master, master.columns, order)))
        df = rollup.fill_defaults(out)
    return df


def prioritise(outlets: DataFrame, features: list[str], least: float = C.LEAST_COVERAGE) -> DataFrame:
    """Tiers, potential, gap and tags; the features that are filled well enough are used."""
    df = cut(priority.prioritised(encoded(outlets)), "tiers")
    chosen = priority.select_features(df, [f for f in [*features, *ENCODED] if f in df.columns], least)
    ready, names = priority.standardised(priority.coerced(df, chosen), chosen)
    ready = ready.withColumn("__y", F.coalesce(C.VALUE, F.lit(0.0)))
    beta = potential.quantile_fit(ready, "__y", names)
    out = priority.gaps(potential.predicted(ready, names, beta)).drop("__y", "predicted_raw", *names)
    return cut(priority.gap_ranked(out), "prioritised")


def segment(df: DataFrame, features: list[str], labels: DataFrame | None = None, k: int = C.CLUSTERS) -> DataFrame:
    """Clusters of outlets over their features and tier, with labels."""
    own = df.withColumn("priority_bucket_num", E.bucket_code(F.col("priority_bucket")))
    chosen = priority.select_features(own, [f for f in [*features, *ENCODED, "priority_bucket_num"] if f in own.columns], at_least=3)
    ready, names = priority.standardised(priority.coerced(own, chosen), chosen)
    out = segments.kmeans(ready, names, k=k).drop(*names)
    none = df.sparkSession.createDataFrame([], "cluster int, label string, description string, action string")
    return cut(segments.attach_labels(out, none if labels is None else labels), "segments")


def run(outlets: DataFrame, sales: DataFrame | None, features: list[str], packs: DataFrame | None = None, racks: DataFrame | None = None, master: DataFrame | None = None, required: list[str] | None = None, folder: str | None = None, run_id: str = "run") -> dict[str, DataFrame]:
    """All tables of a run by name; written under folder/run_id if a folder is given. A failed check doesn't stop the run."""
    table = outlet_table(outlets, master)
    checks = quality.report(table, required or [C.OUTLET_ID, C.VALUE])
    scored = segment(prioritise(table, features), features)
    out = {"checks": checks, "verdict": quality.verdict(checks), "outlets": scored, "tiers": priority.tier_summary(scored), "segments": segments.segment_summary(scored)}
    if sales is not None:
        rows = assortment.joined(sales, scored)
        listed = cut(assortment.heroes(assortment.products(rows, assortment.bucket_stores(scored))), "listed")
        out |= {"must_stock": listed, "brand_mix": assortment.mix(rows, "BRND_NM"), "pack_mix": assortment.mix(rows, "PPG_DESC"), "contribution": assortment.top_contribution(listed)}
        if packs is not None and racks is not None:
            own = space.with_packs(space.selected_or_all(space.msl_fields(listed)), space.pack_dims(packs))
            placed = space.shelf_assignment(space.preferred_zones(space.placement_order(space.facings(own, space.first_rack(space.rack_specs(racks))))))
            out |= {"space": space.display(placed), "racks": space.assets_needed(placed)}
    if folder:
        sinks.report_tables(out, folder, run_id)
    return out

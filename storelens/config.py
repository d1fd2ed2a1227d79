"""Defaults of the analyses; every one is an argument of the functions that use it."""

from __future__ import annotations

# Names of columns, and numbers and orders that results must agree with.
OUTLET_ID = "OUTLET_UID_EDITED"
SALES_ID = "CUST_UNIQ_ID_VAL"
VALUE = "VPO"
PRODUCT = ["BRND_NM", "SUB_BRND_NM", "FLVR_NM", "PPG_DESC"]
NULL_PERCENT = 60.0
OUTLIER_TIMES = 10.0
LEAST_COVERAGE = 0.10
QUANTILE = 0.75
CLUSTERS, SEED = 6, 42
TOP_RANKS = (20, 35, 50)
TIERS = ["A+", "A", "B+", "B", "C+", "C", "D+", "D"]
COVERAGE_COLUMNS = ["DB State", "COHORT", "Top City", "channel"]
PREFERRED = ["VPO", "TOTAL_REVENUE", "AVG_SKU", "ACTIVE_MONTHS"]
#: What stands in for a missing mandatory column or value.
MANDATORY = {
    "BI": "yes", "COHORT": "SKU Data", "DB State": "Unknown", "Top City": "Unknown",
    "channel": "GT", "store_format": "GT", "sector": "Urban", "sub_channel_name": "Retail",
}
DAYS, WEEKLY_UNITS, USABLE_WIDTH, USABLE_HEIGHT = 7, 100.0, 0.95, 0.95

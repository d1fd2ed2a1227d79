"""Column expressions that turn outlet attributes into numbers, and names into their standard forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the attributes' texts in lower case.
FOOTFALL = {"low": 15.0, "low (<30)": 15.0, "medium": 65.0, "medium (30-100)": 65.0, "high": 150.0, "high (>100)": 150.0}
STORE_SIZE = {
    "<200 sqft": 1.0, "200–300 sqft": 2.0, "300–500 sqft": 3.0, "500–1000 sqft": 4.0, ">1000 sqft": 5.0,
    "micro outlet": 1.0, "small outlet": 2.0, "medium outlet": 3.0, "large outlet": 4.0, "very large outlet": 5.0,
}
PRICE_PACK = {"rs. 5": 5.0, "rs. 10": 10.0, "rs. 15": 15.0, "rs. 20": 20.0, "rs. 30": 30.0}
BUCKET = {"A": 4.0, "B": 3.0, "C": 2.0, "D": 1.0}
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def looked_up(key: Column, codes: dict) -> Column:
    """The key's code, null for other keys."""
    return F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[key]


def plain(c: Column) -> Column:
    return F.lower(F.trim(c))


def footfall(c: Column) -> Column:
    return looked_up(plain(c), FOOTFALL)


def yes_no(c: Column) -> Column:
    return F.when(plain(c) == "yes", 1.0).when(plain(c) == "no", 0.0)


def store_size(c: Column) -> Column:
    return looked_up(plain(c), STORE_SIZE)


def price_pack(c: Column) -> Column:
    return looked_up(plain(c), PRICE_PACK)


def bucket_code(c: Column) -> Column:
    return looked_up(c, BUCKET)


def flag(c: Column, value: str) -> Column:
    """1.0 where the text is the value in any case, else 0.0, also for null."""
    return F.coalesce(plain(c) == value.lower(), F.lit(False)).cast("double")


def clip_negative(c: Column) -> Column:
    """Negative values become 0; null stays."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def numeric(c: Column) -> Column:
    """A text as a number: hexadecimal with 0x, else decimal; null for all else, also for forms that only Spark would take (1d, 1f)."""
    text = F.trim(c.cast("string"))
    hexed = F.conv(F.substring(text, 3, 40), 16, 10).cast("double")
    return F.when(F.rlike(text, F.lit("^0[xX][0-9a-fA-F]{1,15}$")), hexed).when(F.rlike(text, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")), text.try_cast("double"))


def brand_pack(brand: Column, pack: Column) -> Column:
    """BRAND PACK in capitals; null if either is."""
    return F.concat(F.upper(F.trim(brand)), F.lit(" "), F.upper(F.trim(pack)))


def safe_name(label: Column) -> Column:
    """A file name: letters, digits, space, _ and - stay, others become _; 50 characters."""
    return F.substring(F.regexp_replace(label, r"[^\p{L}\p{N} _-]", "_"), 1, 50)


def product_name(brand: Column, sub: Column, flavour: Column, pack: Column) -> Column:
    return F.concat(brand, F.lit(" "), sub, F.lit(" "), flavour, F.lit(" ("), pack, F.lit(")"))


def rounded(c: Column, places: int) -> Column:
    """A double at so many decimals, half to even: scaled, rounded and scaled back, as numpy and SQL's round_even do.

    bround goes by the shortest decimals of the number instead, which for about a twelfth of all halves gives the other
    neighbour (32.145 -> 32.14, not 32.15). What can't be scaled any more stays.
    """
    scaled = c * F.lit(10.0**places)
    return F.when(F.abs(scaled) < float("inf"), F.rint(scaled) / F.lit(10.0**places)).otherwise(c)


def penetration_band(c: Column) -> Column:
    return F.when(c <= 0.55, "red").when(c <= 0.69, "orange").when(c.isNotNull(), "green")


#: Fixed value: the form in which a reply gives its scores.
SCORES = r"Scores\s*:\s*\[([^\]]+)\]"


def radar_scores(text: Column, n: int = 8, fill: float = 3.0) -> Column:
    """The numbers after "Scores:", filled up with 3 to n values; all 3 if they are missing or one is no number."""
    inner = F.regexp_extract(text, SCORES, 1)
    values = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("double"))
    full = F.slice(F.concat(values, F.array_repeat(F.lit(fill), n)), 1, n)
    return F.when((F.length(F.trim(inner)) > 0) & ~F.exists(values, lambda x: x.isNull()), full).otherwise(F.array_repeat(F.lit(fill), n))

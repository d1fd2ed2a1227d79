r"""Secret scans: fixed patterns, and a battery of randomness tests over unknown strings.

DataFrame functions only. Places of matches are running sums of the lengths of the matches and of the texts between
them, over rows (one for each match), so a text of very many matches costs no more than its length. Candidates
are runs of 20 or more characters that keys are written in, after "=" too. The encoding of each (base 10, 16, 32, 62
or 64) is inferred from its characters. Under the hypothesis that a candidate is random in its encoding, three tests
are made: chi-squared for the uniform use of the alphabet (as the number of equal pairs of characters, of which it is
a linear function, with its exact mean, variance and third moment), runs above and below the middle of the alphabet,
and the correlation of neighbours. Fisher's method combines their p-values.

Two false-discovery rates are held, each within an encoding and length band. The Benjamini-Hochberg rule decides which
candidates are not random: of those, a share `q` at most is random. And of what is reported, a share `q` at most
is not random: random candidates have even p-values, so their number shows in the upper half of these, and only p-values
from where on the candidates are no more than that number explains (within two standard deviations, so a band of few
candidates rests on the first rule) are reported, if they carry `least_bits` bits at least. Both rules work on counts of
p-values in bins, a table of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keep

#: Kind, pattern, pattern of matches that count. The last two kinds carry their least length in the
#: pattern, as a run that is too short cannot hold a longer match.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = (
    ("assign", ASSIGN),
    ("access", r"AKIA[A-Z0-9]{12,}"),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}"),
)
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {
    10: "0123456789",
    16: "0123456789abcdef",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    62: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Bins of -log10 p: width, the last, and those of the p-values over a half.
BIN, BINS, UPPER = 0.05, 400, 6


def pieces(text: Column, pattern: str, order: int) -> Column:
    """Array of order, i, gap (signs since the match before), what: the leftmost matches that do not overlap; the pattern never matches nothing."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, w: F.struct(F.length(g).alias("gap"), w.alias("what")))
    out = F.transform(pairs, lambda x, i: F.struct(F.lit(order).alias("order"), i.alias("i"), x.gap.alias("gap"), x.what.alias("what")))
    return F.when(F.rlike(text, F.lit(pattern)), out).otherwise(F.array().cast("array<struct<order:int,i:int,gap:int,what:string>>"))


def placed(rows: DataFrame) -> DataFrame:
    """doc_id, h, pieces -> doc_id, h, order, start, end, what: a row for each match."""
    each = rows.where(F.size("pieces") > 0).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", F.inline("pieces"))
    length = F.length("what")
    end = F.sum(F.col("gap") + length).over(W.partitionBy("doc_id", "h", "order").orderBy("i")).cast("int")  # of one text
    return each.select("doc_id", "h", "order", (end - length).alias("start"), end.alias("end"), "what")


def count_of(order: int) -> Column:
    return F.size(F.filter("spans", lambda x: x.order == order)).cast("long")


def tail(z: Column, terms: int = 40) -> Column:
    """Share of the normal distribution above z (a column, not an expression, as it is named often): a series within 2, else a continued fraction."""
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    series, fraction = F.lit(1.0), F.abs(z)
    for k in range(terms, 0, -1):
        series, fraction = 1 + series * z * z / (2 * k + 1), F.abs(z) + k / fraction
    within, beyond = 0.5 - density * z * series, density / fraction
    return F.when(F.abs(z) <= 2, within).when(z > 0, beyond).otherwise(1 - beyond)


def battery(found: DataFrame) -> DataFrame:
    """what -> base, n, p (of the hypothesis that it is random in its base)."""
    body = F.rtrim(F.col("what"), F.lit("="))
    base = F.when(F.rlike(body, F.lit("^[0-9]+$")), 10).when(F.rlike(F.lower(body), F.lit("^[0-9a-f]+$")), 16).when(F.rlike(body, F.lit("^[A-Z2-7]+$")), 32).when(F.rlike(body, F.lit("^[A-Za-z0-9]+$")), 62).otherwise(64)
    plain = F.when(F.col("base") == 16, F.lower(body)).otherwise(F.translate(body, "-_", "+/"))
    out = found.withColumn("base", base).withColumn("body", plain)
    out = out.withColumn("alphabet", F.element_at(F.create_map(*(F.lit(x) for kv in ALPHABETS.items() for x in kv)), F.col("base")))
    out = out.withColumn("n", F.length("body").cast("double")).withColumn("k", F.col("base").cast("double"))
    n, k = F.col("n"), F.col("k")
    codes = F.transform(F.slice(F.split("body", ""), 1, F.length("body")), lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double"))
    out = out.withColumn("codes", codes)
    own = lambda i: n - F.length(F.replace(F.col("body"), F.substring(F.col("alphabet"), i, F.lit(1)), F.lit("")))
    pairs = F.aggregate(F.sequence(F.lit(1), F.length("alphabet")), F.lit(0.0), lambda s, i: s + own(i) * (own(i) - 1) / 2)
    all_pairs, p = n * (n - 1) / 2, 1 / k
    out = out.withColumns({"pairs": pairs, "sd": F.sqrt(all_pairs * p * (1 - p)), "third": all_pairs * p * (1 - p) * (1 - 2 * p) + n * (n - 1) * (n - 2) * p * p * (1 - p)})
    out = out.withColumn("shape", 4 * F.pow("sd", F.lit(6.0)) / (F.col("third") * F.col("third")))  # of the gamma distribution with these moments
    high = 1 + (F.col("pairs") - 0.5 - all_pairs * p) / F.col("sd") / F.sqrt("shape")
    out = out.withColumn("chi", 3 * F.sqrt("shape") * (F.cbrt(F.greatest(F.lit(0.0), high)) - 1 + 1 / (9 * F.col("shape"))))
    ups = F.aggregate("codes", F.lit(0.0), lambda s, x: s + F.when(x >= k / 2, 1.0).otherwise(0.0))
    mean = F.aggregate("codes", F.lit(0.0), lambda s, x: s + x) / n
    out = out.withColumns({"up": ups, "mean": mean})
    first, second = F.slice("codes", F.lit(1), F.size("codes") - 1), F.slice("codes", F.lit(2), F.size("codes") - 1)
    changes = F.aggregate(F.zip_with(first, second, lambda a, b: F.when((a >= k / 2) != (b >= k / 2), 1.0).otherwise(0.0)), F.lit(1.0), lambda s, x: s + x)
    cross = F.aggregate(F.zip_with(first, second, lambda a, b: (a - F.col("mean")) * (b - F.col("mean"))), F.lit(0.0), lambda s, x: s + x)
    spread = F.aggregate("codes", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))
    out = out.withColumns({"changes": changes, "cross": cross, "spread": spread})
    mixed = 2 * F.col("up") * (n - F.col("up"))
    spread_runs = F.sqrt(mixed * (mixed - n) / (n * n * (n - 1)))
    runs = F.when((mixed > n), F.greatest(F.lit(0.0), F.abs(F.col("changes") - mixed / n - 1) - 0.5) / F.nullif(spread_runs, F.lit(0.0)))
    serial = F.abs(F.try_divide(F.col("cross"), F.col("spread")) * F.sqrt(n) + 1 / F.sqrt(n))
    out = out.withColumns({"runs": F.coalesce(runs, F.lit(12.0)), "serial": F.coalesce(serial, F.lit(12.0))})
    ps = [tail(F.col("chi")), 2 * tail(F.col("runs")), 2 * tail(F.col("serial"))]
    half = -sum((F.ln(F.greatest(F.lit(1e-300), F.least(F.lit(1.0), p))) for p in ps), F.lit(0.0))
    out = out.withColumn("half", half)
    return out.withColumn("p", F.exp(-F.col("half")) * (1 + F.col("half") + F.col("half") * F.col("half") / 2)).select(*found.columns, "base", "n", "p")


def random_strings(found: DataFrame, q: float = 0.05, least_bits: float = 100.0) -> DataFrame:
    """Rows with `what` -> those that are reported, with base and p. A string counts once, however often it stands."""
    tested = battery(found.select("what").distinct()).withColumn("band", F.floor(F.log2("n")).cast("int"))
    tested = tested.withColumn("bin", F.least(F.lit(BINS), F.floor(-F.log10(F.greatest("p", F.lit(1e-300))) / BIN)).cast("int"))
    tested = keep(tested, "tested")  # it is read twice, and a filter above would be computed from the tests' expressions again
    counts = tested.groupBy("base", "band", "bin").count()  # 5 encodings, some 20 bands and BINS bins at most
    group = W.partitionBy("base", "band")
    upper = F.sum(F.when(F.col("bin") < UPPER, F.col("count")).otherwise(0)).over(group)
    counts = counts.withColumns({"m": F.sum("count").over(group), "upper": upper, "rank": F.sum("count").over(group.orderBy(F.desc("bin"))), "above": F.sum("count").over(group.orderBy("bin"))})
    random = F.least(F.col("m"), (F.col("upper") + 1 + 2 * F.sqrt("upper")) / (1 - 10 ** (-BIN * UPPER)))
    over = 1 - F.pow(F.lit(10.0), -(F.col("bin") + 1) * BIN)
    false_share = 1 - (random * over + 1 + 2 * F.sqrt(random * over * (1 - over))) / F.col("above")
    not_random = F.pow(F.lit(10.0), -F.col("bin") * BIN) <= q * F.col("rank") / F.col("m")
    limits = counts.groupBy("base", "band").agg(F.coalesce(F.min(F.when(not_random, F.col("bin"))), F.lit(BINS + 1)).alias("from_bin"), F.coalesce(F.max(F.when(false_share <= q, F.col("bin"))), F.lit(-1)).alias("to_bin"))
    out = tested.join(F.broadcast(limits), ["base", "band"])
    out = out.where((F.col("bin") < F.col("from_bin")) & (F.col("bin") <= F.col("to_bin")) & (F.col("n") * F.log2("base") >= least_bits)).select("what", "base", "p")
    return found.join(out, "what").select(*found.columns, "base", "p")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05, least_bits: float = 100.0) -> DataFrame:
    """docs -> doc_id, spans (array of start, order, kind, end): base kinds and 'random', by start, then kind.

    A null text counts as empty: no spans. Repeated rows and null ids stay. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    found = [pieces(F.col("text"), pattern, k) for k, pattern in enumerate([*(p for _, p in KINDS), CANDIDATE])]
    rows = keep(rows.select("doc_id", F.xxhash64("text").alias("h"), F.concat(*found).alias("pieces")), "secrets")
    matches = keep(placed(rows), "matches")
    right = (F.col("order") < len(KINDS)) & ((F.col("order") != 0) | (F.length(F.regexp_extract("what", ASSIGN, 2)) >= 8))
    base = matches.where(right).select("doc_id", "h", "start", "order", "end")
    more = random_strings(matches.where(F.col("order") == len(KINDS)), q, least_bits).select("doc_id", "h", "start", "order", "end")
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in KINDS], F.lit("random")), F.col("order") + 1)
    spans = base.union(more).groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "order", kind.alias("kind"), "end"))).alias("spans"))  # of one text
    spans = spans.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "spans")
    out = rows.select("doc_id", "h").join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    return out.select("doc_id", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x.order < len(KINDS))
    counts = [count_of(k).alias(f"n_{kind}") for k, (kind, _) in enumerate(KINDS)]
    return scanned.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

"""Reading text replies into tables: label lists as JSON or lines, sections, selection tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FIELDS = ["label", "channel", "occasion", "description", "action"]
# What stands for a cluster that the reply leaves out.
DEFAULTS = {"channel": "GT", "occasion": "Immediate/GrabGo", "description": "Cluster profile pending review.", "action": "Review cluster details manually."}
#: How a section's first line begins, longer forms first, and the section's name.
SECTIONS = [
    ("COMMERCIAL", "commercial_action_plan"), ("IDENTITY", "identity_card"), ("SHOPPER", "shopper_profile"), ("DEMOGRAPHIC", "demographic_catchment"),
    ("STORE CHARACTERISTICS", "store_characteristics"), ("CHARACTERISTICS", "store_characteristics"), ("DIMENSIONS", "dimensions_radar"), ("COMPARATIVE", "comparative_snapshot"),
]


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a row for each line: line_no, line (trimmed)."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))


def every_cluster(found: DataFrame, ids: DataFrame, n_clusters: int) -> DataFrame:
    """One row for each reply and cluster 0 to n - 1, with defaults for what is missing."""
    whole = ids.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(n_clusters - 1))))
    out = whole.join(found, ["doc_id", "cluster"], "left")
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.concat(F.lit("Segment "), F.col("cluster").cast("string")))
    return out.select("doc_id", "cluster", label.alias("label"), *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in DEFAULTS.items()])


def labels_from_json(replies: DataFrame, n_clusters: int) -> DataFrame:
    """doc_id, text (a JSON array, bare or in code fences) -> doc_id, cluster and the five fields. Bad JSON: all defaults."""
    body = F.trim(F.regexp_replace("text", r"(?m)^\s*```(?:json)?\s*$", ""))
    kind = "array<struct<cluster_id:int,label:string,channel:string,occasion:string,description:string,action:string>>"
    found = replies.select("doc_id", F.explode(F.from_json(body, kind)).alias("x")).where("x.cluster_id IS NOT NULL").select("doc_id", F.col("x.cluster_id").alias("cluster"), *[f"x.{c}" for c in FIELDS])
    return every_cluster(found.dropDuplicates(["doc_id", "cluster"]), replies.select("doc_id"), n_clusters)


def labels_from_lines(replies: DataFrame, n_clusters: int) -> DataFrame:
    """doc_id, text with "CLUSTER n:" blocks of "LABEL: ..." lines -> the same table. The last line of a kind holds."""
    rows = lines(replies)
    number = F.regexp_extract("line", r"(?i)^CLUSTER\s*(\d+)\s*:", 1).try_cast("int")
    rows = rows.withColumn("cluster", F.last(number, True).over(W.partitionBy("doc_id").orderBy("line_no")))
    field = F.lower(F.regexp_extract("line", r"(?i)^(LABEL|CHANNEL|OCCASION|DESCRIPTION|ACTION)\s*:", 1))
    rows = rows.withColumns({"field": field, "value": F.trim(F.regexp_replace("line", r"^[^:]*:", ""))}).where("field <> '' AND cluster IS NOT NULL")
    found = rows.groupBy("doc_id", "cluster").agg(*[F.max_by(F.when(F.col("field") == c, F.col("value")), F.when(F.col("field") == c, F.col("line_no"))).alias(c) for c in FIELDS])
    return every_cluster(found, replies.select("doc_id"), n_clusters)


def sections(replies: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, section, body. Marks are lines that begin with a section's name, after *, #, "Section n:" or "n."; a repeated section's last body holds."""
    rows = lines(replies)
    bare = F.upper(F.trim(F.regexp_replace(F.regexp_replace("line", r"[*#]", ""), r"(?i)^\s*(section\s*\d+\s*[:.]|\d+\s*[.)])", "")))
    mark = F.coalesce(*[F.when(bare.startswith(m), F.lit(s)) for m, s in SECTIONS])
    own = W.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("mark", mark).withColumns({"section": F.last("mark", True).over(own), "block": F.count("mark").over(own)}).where("mark IS NULL AND section IS NOT NULL")
    bodies = rows.groupBy("doc_id", "section", "block").agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n")).alias("body")).where("body <> ''")
    return bodies.groupBy("doc_id", "section").agg(F.max_by("body", "block").alias("body"))


def selection_table(replies: DataFrame) -> DataFrame:
    """bucket, text with "RANK | TYPE | CRITERION | REASON" lines -> bucket, rank, sku_type, criterion, reason. The last line of a rank holds."""
    rows = lines(replies).withColumn("parts", F.transform(F.split("line", r"\|"), lambda x: F.trim(x))).where(F.size("parts") >= 2)
    part = lambda k: F.coalesce(F.try_element_at("parts", F.lit(k)), F.lit(""))
    out = rows.select("bucket", "line_no", part(1).try_cast("int").alias("rank"), part(2).alias("sku_type"), part(3).alias("criterion"), part(4).alias("reason")).where("rank IS NOT NULL")
    return out.groupBy("bucket", "rank").agg(*[F.max_by(c, "line_no").alias(c) for c in ("sku_type", "criterion", "reason")])

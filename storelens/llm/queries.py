"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import ann, bpe, chat, decontam, passages, pii, secrets, sharding, simhash, spelling, toxicity, warc, whitening
from .common import shared_dir, table


def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


#: A conversation that holds a mark of the kind that templates use.
MARKED = "\\### Assistant: </turn> ok"


def op2_budget_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(MARKED))
    return chat.digests(chat.windows(turns.unionByName(extra)))


def op3_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"))


def op5_item_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op6_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"))))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_matrix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), *how), *how))


def op8_random_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op9_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op10_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))


def op11_variant_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of one document in 97 loses a letter, so that there are misspellings to find."""
    return spelling.group(table(spark, sf_dir, "documents"), spoil_each=97).select("word", "form", "root", "n", "n_near", "form_n")


def op12_content_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/storelens/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.digests(warc.read(spark, folder))


def op13_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.long_form(whitening.whiten(table(spark, sf_dir, "embeddings")))


def chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 says of turns and loss masks, which SQL can say too."""
    return op2_budget_windows(spark, sf_dir).drop("formatted_chars")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of op8 by its fixed patterns, counted, and the code points that they cover."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    covered = F.aggregate(F.filter("spans", lambda x: x.order < len(secrets.KINDS)), F.lit(0), lambda s, x: s + x.end - x.start)
    counts = [secrets.count_of(k).alias(f"n_{kind}") for k, (kind, _) in enumerate(secrets.KINDS)]
    return found.select("doc_id", *counts, covered.cast("long").alias("covered"))


def personal_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of op10 by its fixed patterns, counted, and the code points that they cover."""
    found = pii.detect(table(spark, sf_dir, "documents"))
    covered = F.aggregate(F.filter("spans", lambda x: x.order < len(pii.KINDS)), F.lit(0), lambda s, x: s + x.end - x.start)
    return found.select("doc_id", *[pii.count_of(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)], covered.cast("long").alias("covered"))


def shard_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op1's shards: documents, bytes, equal texts in more than one shard, shards with a gap, and whether the
    largest is within the mean and the largest group of equal texts."""
    rows = op1_minimax_shards(spark, sf_dir)
    groups = rows.groupBy("group_first", "text_crc32").agg(F.count_distinct("shard").alias("k"), F.sum("size").alias("size"))
    shards = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high"))
    gap = (F.col("slots") != F.col("n")) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | ~F.col("shard").between(0, 39)
    one = shards.agg(F.sum("n").alias("docs"), F.sum("size").alias("bytes"), F.count_if(gap).alias("gaps"), F.max("size").alias("largest"))
    split = groups.agg(F.count_if(F.col("k") > 1).alias("split_groups"), F.max("size").alias("atom"))  # one row each
    return one.join(F.broadcast(split)).select("docs", "bytes", "split_groups", "gaps", (F.col("largest") <= F.col("bytes") / 40 + F.col("atom")).alias("within"))


QUERIES = {
    "op1_minimax_shards": op1_minimax_shards,
    "op2_budget_windows": op2_budget_windows,
    "op3_gray_simhash": op3_gray_simhash,
    "op4_repeated_units": op4_repeated_units,
    "op5_item_windows": op5_item_windows,
    "op6_counterfactual_toxicity": op6_counterfactual_toxicity,
    "op7_matrix_bpe": op7_matrix_bpe,
    "op8_random_secrets": op8_random_secrets,
    "op9_balanced_postings": op9_balanced_postings,
    "op10_disclosure_pii": op10_disclosure_pii,
    "op11_variant_chunks": op11_variant_chunks,
    "op12_content_warc": op12_content_warc,
    "op13_feast_whitening": op13_feast_whitening,
    "chat_round_trip": chat_round_trip,
    "secret_base_counts": secret_base_counts,
    "personal_base_counts": personal_base_counts,
    "shard_invariants": shard_invariants,
}
#: Matches of a pattern that hold by a further test, and their code points, as DuckDB counts them.
DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(length({DIGITS})), lambda k: (CAST({DIGITS}[length({DIGITS}) - k] AS INT) * (1 + k % 2)) - 9 * CAST(CAST({DIGITS}[length({DIGITS}) - k] AS INT) * (1 + k % 2) > 9 AS INT))) % 10 = 0"
PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(x, '.'), lambda p: coalesce(TRY_CAST(p AS HUGEINT) <= 255, false)))"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 8 AND 15"),
}
SECRET = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?[A-Za-z0-9+/_.=-]+""", r"""length(regexp_extract(x, '(?i:password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)', 1)) >= 8"""),
    "access": ("AKIA[A-Z0-9]+", "length(x) >= 16"),
    "hex": ("[0-9a-f]+", "length(x) >= 32"),
}


def counted(patterns: dict[str, tuple[str, str]]) -> str:
    """SQL: doc_id, n_<kind> for each pattern, covered."""
    lists = ", ".join(f"list_filter(regexp_extract_all(coalesce(text, ''), '{p}'), lambda x: {test}) AS {kind}" for kind, (p, test) in patterns.items())
    covered = " + ".join(f"coalesce(list_sum(list_transform({kind}, lambda x: length(x))), 0)" for kind in patterns)
    return f"WITH m AS (SELECT doc_id, {lists} FROM documents) SELECT doc_id, {', '.join(f'len({kind}) AS n_{kind}' for kind in patterns)}, CAST({covered} AS BIGINT) AS covered FROM m"


ORACLES: dict[str, str] = {
    "chat_round_trip": rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{MARKED}' UNION ALL SELECT -7, 1, 'assistant', '{MARKED}'),
 c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS said, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS target FROM t GROUP BY 1)
 SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(target) AS loss_chars, sha256(target) AS loss_sha256 FROM c""",
    "secret_base_counts": counted(SECRET),
    "personal_base_counts": counted(PERSONAL),
    "shard_invariants": "SELECT count(*) AS docs, CAST(sum(strlen(coalesce(text, '')) + 16) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS split_groups, CAST(0 AS BIGINT) AS gaps, true AS within FROM documents",
    "op12_content_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
 SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN strlen(h) >= 1000 AND page_id < last THEN last END AS refers_to FROM p""",
}

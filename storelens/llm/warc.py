r"""A content-addressed web archive: payloads stored once, record headers apart, records put together again by joins.

An archive is a folder with two tables. `payloads` holds the bytes of every distinct payload once, named by their
SHA-256; all rows of one name must agree in length and SHA-1, or the write fails. `heads` holds, for each page, the exact
bytes that stand before the payload in its WARC record (the WARC header, a blank line, the HTTP header, a blank line),
with the name of the payload. `read` joins the two, computes both digests of the stored bytes again and fails if they
differ from the name or from what the header says. `export` writes plain .warc files.

Of records with equal payloads of at least `least` bytes one is a response and the others are revisits, which hold no
payload of their own but can be put together all the same; shorter payloads are responses in every record, though
their bytes are stored once too.

No task holds a group: digests are counted and their last records chosen by partial aggregation, and a payload that many
records share is joined in lots of LOT records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep

LOT = 1000
#: Copies of a digest's row that the records of the digest are dealt to when they are told who holds their payload.
DEALT = 8
END = "\r\n"


def hashed(payload: Column) -> dict[str, Column]:
    return {"sha256": F.unhex(F.sha2(payload, 256)), "sha1": F.sha1(payload), "bytes": F.octet_length(payload).cast("long")}


def checked(good: Column, value: Column, why: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.lit(why)))


def one_line(text: Column) -> Column:
    """A text as part of a header line: spaces and line breaks are percent-encoded."""
    for sign, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def urn(*parts: Column) -> Column:
    """A UUID that follows from the parts."""
    name = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.regexp_replace(name, "(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")


def write(pages: DataFrame, folder: str, least: int = 1000, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """pages -> an archive in `folder`, which must be new: a record for each row.

    A null body is an empty payload, a null url leaves its header line out. Of equal payloads the record of the largest
    id is the response (null ids are least); of rows that have that id too, any one. Repeated rows have a record
    each. An empty table gives an archive without records. Other columns are not looked at.
    """
    payload = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    stored = rows.select("payload", *[c.alias(n) for n, c in hashed(F.col("payload")).items()]).groupBy("sha256").agg(
        F.any_value("payload").alias("payload"), F.count("*").alias("copies"), F.max("bytes").alias("bytes"), ((F.min("bytes") == F.max("bytes")) & (F.min("sha1") == F.max("sha1"))).alias("alike")
    )
    stored.select("sha256", checked(F.col("alike"), F.col("payload"), "two payloads have one SHA-256").alias("payload"), "bytes", F.ceil(F.col("copies") / LOT).cast("int").alias("lots")).write.parquet(f"{folder}/payloads")

    rows = keep(rows.select("page_id", "url", *[c.alias(n) for n, c in hashed(F.col("payload")).items()]).withColumn("row", F.monotonically_increasing_id()), "pages")
    last = rows.groupBy("sha256").agg(F.count("*").alias("copies"), F.max(F.struct("page_id", "row")).alias("last")).where("copies > 1")
    last = last.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    rows = rows.withColumn("deal", (F.col("row") % DEALT).cast("int")).join(last, ["sha256", "deal"], "left")
    revisit = F.coalesce((F.col("bytes") >= least) & (F.col("row") != F.col("last.row")), F.lit(False))
    rows = rows.withColumns({"revisit": revisit, "record": urn(F.col("row"), F.col("page_id"), F.col("sha1")), "of": urn(F.col("last.row"), F.col("last.page_id"), F.col("sha1"))})
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    length = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    only = lambda c: F.when(F.col("revisit"), c)
    head = F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), line("WARC-Record-ID", F.col("record")), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", one_line(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), line("WARC-Refers-To", only(F.col("of"))),
        line("WARC-Profile", only(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), line("Page-ID", F.col("page_id").cast("string")),
        line("Refers-To-Page-ID", only(F.col("last.page_id").cast("string"))), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit(END), http,
    )
    lots = F.ceil(F.coalesce("copies", F.lit(1)) / LOT).cast("int")
    rows.select("row", "sha256", F.pmod(F.xxhash64("row"), lots).cast("int").alias("lot"), head.alias("head")).write.parquet(f"{folder}/heads")


def field(name: str) -> Column:
    """The value of a line of the WARC header; null where there is none."""
    return F.nullif(F.regexp_extract(F.substring_index("head", END + END, 1), rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """An archive -> row, head, payload (the whole one, of revisits too), payload_digest (SHA-1), and record: the bytes of the WARC record.

    Bytes that don't have the SHA-256 they are named by, nor the SHA-1 and length that their header tells, end the read with an error.
    """
    stored = spark.read.parquet(f"{folder}/payloads")
    stored = stored.withColumn("payload", checked(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.col("payload"), "a stored payload is damaged"))
    stored = stored.select("sha256", "payload", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    out = spark.read.parquet(f"{folder}/heads").join(stored, ["sha256", "lot"], "left")
    sha1 = F.sha1("payload")
    body = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    http = F.octet_length(F.col("head")) - F.octet_length(F.substring_index("head", END + END, 1)) - 4
    lengths = (field("Content-Length").cast("long") == http + F.octet_length(body)) & F.col("head").endswith(F.concat(F.lit("Content-Length: "), F.octet_length("payload").cast("string"), F.lit(END + END)))
    good = (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), sha1)) & lengths
    out = out.withColumn("payload_digest", checked(F.coalesce(good, F.lit(False)), sha1, "a record and its payload don't agree"))
    return out.select("row", "head", "payload", "payload_digest", F.concat(F.encode("head", "UTF-8"), body).alias("record"))


def export(records: DataFrame, folder: str, compression: str = "none") -> None:
    """Records as plain .warc text parts: each record and the two line ends that close it."""
    records.select(F.col("record").cast("string")).write.option("lineSep", END + END).option("compression", compression).text(folder)


def digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records as they are read back."""
    return records.select(
        field("Page-ID").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", field("WARC-Type").alias("record_type"),
        field("Refers-To-Page-ID").cast("long").alias("refers_to"),
    )

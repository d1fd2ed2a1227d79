import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from storelens.llm import warc
from storelens.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, payload string, head string, lot string, row string, sha1 string, last string, copies string"


@pytest.fixture
def archive(spark):
    def of(rows, **options):
        folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
        warc.write(spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA).repartition(3), folder, **options)
        return folder

    return of


def brute(rows, least=1000):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        key = -1 if i is None else i
        last = max((-1 if j is None else j) for j, _, h in rows if (h or "") == (html or ""))
        revisit = len(body) >= least and key < last
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/1 x", "é" * 600), (2, None, "é" * 600), (3, "http://a/3\r\nPage-ID: 9", "é" * 600), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "y\r\n\r\nWARC/1.1\r\n" * 400), (9, "u", "z" * 999), (10, "u", "z" * 999), (11, "u", "q" * 2_000_000), (None, "u", "é" * 600), (12, "u", "W" * 1000), (13, "u", "W" * 1000)]


def test_records_against_brute_force(spark, archive):
    got = [tuple(r) for r in warc.digests(warc.read(spark, archive(ROWS))).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_a_hot_payload_in_lots(spark, archive, monkeypatch):
    monkeypatch.setattr(warc, "LOT", 7)
    rows = [(k, "u", "hot " * 400 if k % 3 else f"own {k} " * 200) for k in range(200)] + [(500 + k, "u", "") for k in range(60)]
    folder = archive(rows)
    got = [tuple(r) for r in warc.digests(warc.read(spark, folder)).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h for _, _, h in rows})


def test_repeated_rows_have_one_response(spark, archive):
    got = warc.digests(warc.read(spark, archive([(1, "u", "r" * 2000)] * 5))).collect()
    assert sorted(r.record_type for r in got) == ["response"] + ["revisit"] * 4 and {r.refers_to for r in got} == {1, None}


def parsed(data):
    """The records of a WARC file, by their lengths."""
    at, out = 0, []
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:cut].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        end = cut + 4 + int(fields["Content-Length"])
        assert version == "WARC/1.1" and data[end : end + 4] == b"\r\n\r\n"
        out.append((fields, data[cut + 4 : end]))
        at = end + 4
    return out


def test_exported_files_are_warc(spark, archive, tmp_path):
    folder = archive(ROWS)
    warc.export(warc.read(spark, folder), str(tmp_path / "out"))
    records = [r for p in (tmp_path / "out").glob("part-*") for r in parsed(p.read_bytes())]
    assert len(records) == len(ROWS) == len({f["WARC-Record-ID"] for f, _ in records})
    ids = {f["WARC-Record-ID"]: f for f, _ in records}
    texts = {i: h or "" for i, _, h in ROWS if i}
    for fields, block in records:
        http, body = block.split(b"\r\n\r\n", 1)
        if fields["WARC-Type"] == "revisit":
            assert body == b"" and ids[fields["WARC-Refers-To"]]["WARC-Type"] == "response" and ids[fields["WARC-Refers-To"]]["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
        elif "Page-ID" in fields:
            assert body == texts[int(fields["Page-ID"])].encode() and fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
            assert f"Content-Length: {len(body)}".encode() in http


def test_whole_payloads_come_back_for_revisits_too(spark, archive):
    back = warc.read(spark, archive(ROWS)).select(warc.field("Page-ID").cast("long").alias("i"), F.decode("payload", "UTF-8").alias("h")).collect()
    assert sorted(((r.i, r.h) for r in back), key=str) == sorted(((i, h or "") for i, _, h in ROWS), key=str)


@pytest.mark.parametrize("table", ["payloads", "heads"])
def test_damage_is_seen(spark, archive, table):
    folder = archive([(1, "u", "a" * 1500), (2, "u", "b" * 20)])
    rows = spark.read.parquet(f"{folder}/{table}")
    changed = rows.withColumn("payload", F.encode(F.lit("c"), "UTF-8")) if table == "payloads" else rows.withColumn("head", F.regexp_replace("head", "Content-Length: 20", "Content-Length: 21"))
    changed = changed.collect()
    spark.createDataFrame(changed, rows.schema).write.mode("overwrite").parquet(f"{folder}/{table}")
    with pytest.raises(Exception, match="damaged|agree"):
        warc.digests(warc.read(spark, folder)).collect()


def test_no_pages(spark, archive):
    assert warc.digests(warc.read(spark, archive([]))).collect() == []

"""Sources, sinks and the watched folder."""

import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from storelens.sources import files, sinks
from storelens.streaming import commits
from storelens.streaming.inbox import inbox


def test_csv_with_a_mark_quotes_and_null_words(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text('﻿CUST_UNIQ_ID_VAL,BRND_NM,SUB_BRND_NM,FLVR_NM,PPG_DESC,NET_SALES\n 01908872 ,"La ""y""s\nx",null,NaN,Null,1.5\nS1,,,,,\n', encoding="utf-8")
    rows = files.sku_sales(spark, str(path)).collect()
    assert rows[0].CUST_UNIQ_ID_VAL == "01908872" and rows[0].BRND_NM == 'La "y"s\nx' and rows[0].SUB_BRND_NM is None and rows[0].FLVR_NM is None and rows[0].PPG_DESC == "Null"
    assert rows[1].NET_SALES is None and rows[1].BRND_NM is None


def test_systematic_sample(spark):
    df = spark.range(1, 1001).withColumnRenamed("id", "k").repartition(5)
    assert sorted(r.k for r in files.systematic_sample(df, 300, "k").collect()) == list(range(3, 1001, 3))
    assert files.systematic_sample(df, 2000, "k").count() == 1000


def test_latest(spark, tmp_path):
    for k, name in enumerate(["b/all_segments_1.csv", "all_segments_2.csv", "other.csv"]):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"x\n{k}\n")
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    assert files.latest(spark, str(tmp_path), "all_segments_*.csv").first().x == "1"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, "A/b", 1), (1, "C", 2)], "cluster int, segment_label string, v int")
    sinks.all_segments(df, f"{tmp_path}/all")
    sinks.per_segment(df, f"{tmp_path}/each")
    sinks.report_tables({"t": df}, f"{tmp_path}/runs", "7")
    assert spark.read.option("header", True).csv(f"{tmp_path}/all").count() == 2
    assert sorted(p for p in os.listdir(f"{tmp_path}/each") if p.startswith("segment")) == ["segment=segment_0_A_b", "segment=segment_1_C"]
    assert spark.read.parquet(f"{tmp_path}/runs/7/t").count() == 2


def test_inbox_runs_each_file_once_and_goes_on_after_a_failure(spark, tmp_path):
    folder, seen, failed = tmp_path / "in", [], []
    folder.mkdir()
    for name, text in (("a.csv", "k,v\n1,2\n"), ("~b.csv", "k,v\n9,9\n"), (".c.csv", "k,v\n8,8\n"), ("d.txt", "k,v\n7,7\n"), ("bad.csv", "k,v\n5,5\n")):
        (folder / name).write_text(text)

    def run(rows, batch):
        values = [r.k for r in rows.select(F.col("k")).collect()]
        if values == [5]:
            raise RuntimeError("bad file")
        seen.extend(values)

    schema = spark.createDataFrame([], "k int, v int").schema
    start = lambda: inbox(spark, str(folder), schema, f"{tmp_path}/check", run, once=True, on_error=lambda b, e: failed.append(str(e))).awaitTermination(60)
    start()
    time.sleep(1)
    (folder / "e.csv").write_text("k,v\n3,4\n")
    start()
    assert sorted(seen) == [1, 3] and failed == ["bad file"]


def test_a_lost_run_leaves_nothing_and_the_next_attempt_is_whole(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("k,v\n1,2\n3,4\n")
    schema, calls = spark.createDataFrame([], "k int, v int").schema, []

    def make(rows):
        calls.append(1)
        third = rows if len(calls) > 1 else rows.withColumn("v", F.raise_error(F.lit("lost")))
        return {"one": rows, "two": rows.select("k"), "three": third}

    out = str(tmp_path / "out")
    run = commits.committed(out, make)
    start = lambda: inbox(spark, str(tmp_path / "in"), schema, f"{tmp_path}/check", run, once=True).awaitTermination(60)
    with pytest.raises(StreamingQueryException):
        start()
    assert [(r.state, r.tables) for r in commits.records(spark, out).collect()] == [("failed", ["one", "two"])]
    assert commits.results(spark, out, "two").count() == 0  # written, but of no run that counts
    start()
    rows = commits.records(spark, out).where("state = 'done'").collect()
    assert [(r.batch, r.tables, len(r.files)) for r in rows] == [(0, ["one", "two", "three"], 1)] and rows[0].files[0].endswith("a.csv")
    assert sorted(commits.results(spark, out, "three").select("k", "v", "batch").collect()) == [(1, 2, 0), (3, 4, 0)]
    run(spark.createDataFrame([(9, 9)], schema), 0)  # the same batch again
    assert len(calls) == 2 and commits.results(spark, out, "one").count() == 2
    (tmp_path / "in/b.csv").write_text("k,v\n5,6\n")
    start()
    assert sorted(r.batch for r in commits.results(spark, out, "one").collect()) == [0, 0, 1]

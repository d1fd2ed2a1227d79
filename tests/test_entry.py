"""The registered queries against the oracle, and the library without its llm part."""

import ast
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from storelens.functions.encode import rounded
from storelens.plans import queries as plans

TOP = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", ["outlet_rollup", "vpo_percentile", "bucket_distribution", "dq_report", "gap_rank", "tier_summary", "hero_selection", "brand_pack_matrix", "topn_contribution", "facings", "cluster_top_categories", "feature_heatmap", "lognormal_params", "parse_label_json", "tier_distribution"])
def test_query_matches_the_oracle(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key) == want


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(plans.QUERIES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["priority_bucket", "n", "avg_vpo"]


def test_nothing_else_imports_the_llm_part():
    for p in (TOP / "storelens").rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), p


def test_gap_ranks_of_halves_match_the_oracle(spark, tmp_path):
    """One order each, so that its price, half a cent over, is the VPO: bround would give other gaps, and other ranks, than round_even."""
    rows = {
        "region": "SELECT 0 AS r_regionkey, 'R' AS r_name", "nation": "SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey",
        "customer": "SELECT range AS c_custkey, 0 AS c_nationkey, 1.0::DOUBLE AS c_acctbal, 'M' AS c_mktsegment FROM range(1, 2001)",
        "part": "SELECT 1::BIGINT AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type, 1 AS p_size",
        "orders": "SELECT range AS o_orderkey, range AS o_custkey, TIMESTAMP '1995-01-02' AS o_orderdate FROM range(1, 2001)",
        "lineitem": "SELECT range AS l_orderkey, 1::BIGINT AS l_partkey, ((range * 7919 % 4000) * 2 + 1) * 0.005::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount FROM range(1, 2001)",
    }
    con = duckdb.connect()
    for t, sql in rows.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in ("gap_rank", "opportunity_gap"):
        df = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(entry.oracle_sql()[name]).fetchall()
        assert len(want) == 2000 and sorted(tuple(r) for r in df.collect()) == sorted(want)


def test_rounds_as_numpy_does(spark):
    halves = [(2 * i + 1) * 0.005 * s for i in range(2000) for s in (1, -1)]
    odd = [None, 0.0, -0.001, 1e300, 1.7e308, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(x,) for x in halves + odd], "x double").select("x", rounded(F.col("x"), 2).alias("y")).collect()
    for r in df:
        want = r.x if r.x is None or abs(r.x) > 1e306 else float(np.round(r.x, 2))
        assert r.y == want or (r.x != r.x and r.y != r.y), r

"""Queries on tables of other shapes and sizes than the smallest data set: part files, large keys."""

import base64
import os

import duckdb
import numpy as np
import pytest

from __spark_entry__ import queries
from compare import TABLES, compare, duck

SF = "/root/testdata/sf0.001"


def tables(folder, name, *parts):
    """A data set like SF in which one table is a file, or with more parts a folder of files, made by these selects."""
    for t in TABLES:
        if t != name:
            os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    at = folder / f"{name}.parquet"
    if len(parts) > 1:
        at.mkdir()
    con = duckdb.connect()
    for i, select in enumerate(parts):
        to = at / f"part-{i}.parquet" if len(parts) > 1 else at
        con.execute(f"COPY ({select.format(t=f'{SF}/{name}.parquet')}) TO '{to}' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["incremental_ingestion", "ingestion_ledger"])
def test_documents_in_part_files_arrive(spark, tmp_path, name):
    parts = [f"SELECT * FROM '{{t}}' WHERE doc_id % 3 {op} 0" for op in ("=", "<>")]
    assert compare(spark, duck(SF), tables(tmp_path, "documents", *parts), name) is None


def test_latest_objects_with_large_keys_and_equal_versions(spark, tmp_path):
    """A later order does not outweigh a higher quantity; equal quantity, order, line and supplier leave nothing open."""
    rows = "SELECT * REPLACE (l_orderkey + 30000000 * (l_orderkey % 3) AS l_orderkey) FROM '{t}'"
    ties = rows.replace("* REPLACE (", "* REPLACE (CASE l_returnflag WHEN 'A' THEN 'R' ELSE 'A' END AS l_returnflag, ")
    folder = tables(tmp_path, "lineitem", f"{rows} UNION ALL {ties}")
    assert compare(spark, duck(folder), folder, "latest_objects") is None
    (tmp_path / "other").mkdir()
    shuffled = tables(tmp_path / "other", "lineitem", f"{ties} UNION ALL {rows}")
    assert compare(spark, duck(folder), shuffled, "latest_objects") is None


# Two vectors of a larger table whose product is 0.3751650305 less a few units of the last bit, or more, by the order of its sum.
_BY_ORDER = (
    "i5vlPERT8jzGZZE9vlKtPImoND15DrW92ayfPQN4Az5lqhO9Imiavpv9aD02ltw9TaiNvRirqr36H5+95i11PfNY4Lz4+LM9vKeJPZG5ib4tELu97tDVu8U6"
    "Zj2d1K8+nQ0nvcIGn76cSGw9fG2FvDEz1z2mLeu9IQizvDP6YT6dEm+6xc6evZ1phr2aGAk92J8xvVDiij3LESA+US6nPZ6NRD7fUcI7VBNCPpEK6z3LLAO9"
    "GN8QPaVZIT5LyDQ+Xj9TPplxyT1a3US9Rzo7Pd0drTwcLUu+CqCPPn0s4r2aYaS9e6ZEPtXI1z0FlUG9OMAnvZhEDzxkUGM9eizbOw==",
    "JK3bvf7J4L0SOKA+2i2KPv5F3byTfKM9IuiLvZ3qEz4NLse6AlqCvtMc0L2WYPU9uEW1PDbhwb0LrJE+swNvvkoGEz0ddw2+q7CtPStpQL4Pq2y9HeaAvbrt"
    "dD0ZvoA+hYe9PNzejr3h+Lk9s3YVPMoxK75YnE89xtWXPbCHRz1WS8Y9SCdevTZiP75FAjA9Dk6xvV5EATwNJQS9xCBevURL3b2YhhU8B0MmvMDZlT0rQOM8"
    "RIpJPQ/xUD7Gizs+Lt6DPD/ZBr3QWzG+VOjoPbPjwL0F/L69srL/Pet5ED7i8N699oBmvRhdRT73ahi+5nzwvLo56z3BVFg96LqOPQ==")


def test_similarity_edges_equal_their_sql_in_the_last_decimal(spark, tmp_path):
    """The order of a sum, a half in the tenth decimal, and a product that only rounding brings to the threshold."""
    first, second = (np.frombuffer(base64.b64decode(v), np.float32).tolist() for v in _BY_ORDER)
    at = lambda *x, place=0: [0.0] * place + list(x) + [0.0] * (64 - place - len(x))
    vectors = [first, second, at(1.0), at(*(x / 1024 for x in (701, 746, 25, 5, 3))), at(1.0, place=10), at(1.0, 2.6764273643493652, 0.001367500051856041, place=10)]
    rows = ", ".join(f"({60 + i}, {v}, {i})" for i, v in enumerate(vectors))
    select = f"SELECT a::BIGINT AS vec_id, b::FLOAT[] AS embedding, c::INTEGER AS label FROM (VALUES {rows}) t(a, b, c)"
    folder = tables(tmp_path, "embeddings", select)
    assert compare(spark, duck(folder), folder, "similarity_edges") is None
    edges = {r.similarity for r in queries()["similarity_edges"](spark, folder).collect()}
    assert {0.375165031, 0.684570313} <= edges and 0.35 not in edges


def test_response_store_makes_no_file_per_response(spark, tmp_path, monkeypatch):
    from sightledger.catalog import roundtrips
    monkeypatch.setattr(roundtrips, "_folder", lambda v, kind: str(tmp_path / kind))
    more = "SELECT * REPLACE (s_suppkey + 1000 * r AS s_suppkey) FROM (SELECT *, unnest(range(20)) AS r FROM '{t}')"
    (tmp_path / "sf").mkdir()
    folder = tables(tmp_path / "sf", "supplier", more.replace("*, unnest", "s.*, unnest").replace("'{t}'", "'{t}' s"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM '{folder}/supplier.parquet'")
    assert compare(spark, con, folder, "response_store") is None
    assert len(list((tmp_path / "responses").rglob("*.json"))) <= 3 * 8

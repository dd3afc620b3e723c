"""Every registered query agrees with its SQL on the same tables, and its plan has no cross join."""

import glob
import os
import re

import duckdb
import pytest

from trajmill.plans.catalog import ORACLES, QUERIES

# Queries that hand token arrays, texts or lengths to Python in Arrow batches; all others stay in the JVM.
IN_PYTHON = {
    "agg_target_counts", "arr_labels", "audit_periodic_text", "arr_split_by_mask", "arr_truncate", "tok_completion_mask_rows", "tok_decode", "tok_encode",
    "tok_encode_ranks", "tok_pack_bfd", "tok_pack_rows", "tok_verify", "tok_verify_damaged", "udf_batch_map", "udf_row_map", "win_boundary_check", "win_mask_runs",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(
        tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in row) for row in frame.itertuples(index=False)
    )


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.toPandas()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    found = any(node in plan for node in ("InArrow", "InPandas", "EvalPython"))
    assert found == (name in IN_PYTHON)
    assert name in ORACLES
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    kinds = {c: (str(got[c].dtype)[:5], str(want[c].dtype)[:5]) for c in got.columns}
    assert all(a == b for a, b in kinds.values() if a.startswith("float") or b.startswith("float")), kinds
    assert len(got) > 0
    assert _rows(got) == _rows(want)


def test_queries_read_the_tables():
    for name, sql in ORACLES.items():
        assert re.search("|".join(TABLES.split()), sql), name

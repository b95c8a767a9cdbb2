"""Every registered query with a SQL twin against it, and the others against small simulations."""

import math
import os

import duckdb
import pandas as pd
import pytest

from millrace.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(value):
    if value is None or (not isinstance(value, (list, dict)) and pd.isna(value)):
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        number = float(value)
        return f"{number:.6f}" if math.isfinite(number) else str(number)
    return str(value)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def events(spark):
    pdf = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    return pdf.to_dict("records")


def test_every_query_has_its_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_correlate_latest_is_a_stack(spark):
    waiting, pairs = {}, set()
    for r in events(spark):
        side, other = {"click": ("l", "r"), "purchase": ("r", "l")}.get(r["event_type"], (None, None))
        if side is None:
            continue
        stack = waiting.setdefault((r["user_id"], other), [])
        if stack:
            o = stack.pop()
            pairs.add((r["user_id"], *((r["event_id"], o) if side == "l" else (o, r["event_id"]))))
        else:
            waiting.setdefault((r["user_id"], side), []).append(r["event_id"])
    got = {(r.user_id, r.left_id, r.right_id) for r in catalogue.correlate_latest(spark, SF).collect()}
    assert got == pairs


def test_correlate_timeout_keeps_every_row_once(spark):
    got = catalogue.correlate_timeout(spark, SF).collect()
    ids = [i for r in got for i in (r.left_id, r.right_id) if i is not None]
    want = [r["event_id"] for r in events(spark) if r["event_type"] in {"click", "purchase"}]
    assert sorted(ids) == sorted(want)
    at = {r["event_id"]: r for r in events(spark)}
    for r in got:
        if r.left_id is not None and r.right_id is not None:
            a, b = at[r.left_id], at[r.right_id]
            assert a["value"] <= b["value"] and abs(a["ts"] - b["ts"]) <= pd.Timedelta(days=1)

import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest

from tesserae import plans
from tesserae.plans import bridge
from tesserae.plans.grids import PT

from .conftest import ROOT
from .oracle import SF, connect, same

ORACLES = plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, con, name):
    same(spark, con, plans.queries()[name], ORACLES[name])


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["bbox_join", "radius_candidates", "nearest_building"])
def test_spatial_joins_are_equi_joins(spark, name):
    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _with_tables(tmp_path, **tables):
    """The small tables with some of them replaced by frames of another size."""
    for p in Path(SF).iterdir():
        if p.stem not in tables:
            (tmp_path / p.name).symlink_to(p)
    for name, table in tables.items():
        table.to_parquet(tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_an_empty_set_has_its_row(spark, tmp_path):
    """With one disc inside of a box, no cell is the discs' alone."""
    part, events = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("part", "events"))
    sf_dir = _with_tables(tmp_path, part=part.head(1).assign(p_partkey=2900 * 4, p_size=50), events=events.head(1).assign(event_id=2900 * 9))
    got = plans.queries()["cell_set_algebra"](spark, sf_dir).select("op", "cells", "mark").collect()
    want = connect(sf_dir).sql(f"SELECT op, cells, mark FROM ({ORACLES['cell_set_algebra']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and ("only_discs", 0, None) in want


def test_points_are_those_of_sql_to_the_bit(spark, tmp_path):
    customer = pd.read_parquet(f"{SF}/customer.parquet")
    ids = pd.DataFrame({"c_custkey": range(1, 36001)}).assign(c_nationkey=0)
    sf_dir = _with_tables(tmp_path, customer=ids.astype({"c_nationkey": customer["c_nationkey"].dtype}))
    same(spark, connect(sf_dir), lambda s, d: bridge.points(s, d).select("id", "lon", "lat"), f"SELECT id, lon, lat FROM {PT}", sf_dir)
    same(spark, connect(sf_dir), plans.queries()["nearest_cell"], ORACLES["nearest_cell"], sf_dir)


def test_components_query_against_union_find(spark):
    """No SQL runs over this graph in time: most parts and suppliers are one component, orders form one for each customer."""
    got = {r["node"]: r["component"] for r in plans.queries()["components"](spark, SF).collect()}
    lines, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    pairs = [(r[0], r[1] + 10_000_000) for r in lines.select("l_partkey", "l_suppkey").collect()] + [(r[0] + 1_000_000_000, r[1] + 20_000_000) for r in orders.select("o_orderkey", "o_custkey").collect()]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}

"""Plan checks: no single-partition exchange over row-level data, no Python UDF
nodes, filters and column pruning reach the scan."""
import re

import pytest

from postlens.plans import catalog
from conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF",
                "MapInArrow", "FlatMapCoGroupsInPandas")
BOUNDED = ("HashAggregate", "TakeOrderedAndProject", "GlobalLimit", "ObjectHashAggregate", "SortAggregate",
           "LocalTableScan")


def _plan_lines(df):
    return df._jdf.queryExecution().sparkPlan().toString().splitlines()


def _depth(line):
    m = re.search(r"[+:]-|\S", line)
    return m.start() if m else 0


def single_partition_over_rows(df):
    """Exchange SinglePartition nodes whose input is not already aggregated / limited."""
    lines = _plan_lines(df)
    bad = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        d = _depth(line)
        sub = []
        for nxt in lines[i + 1:]:
            if _depth(nxt) <= d:
                break
            sub.append(nxt)
        # the nearest operator below must bound the rows
        first_ops = [s for s in sub if any(b in s for b in BOUNDED)]
        if not first_ops:
            bad.append(line.strip())
    return bad


NAMES = sorted(catalog.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_plan_shape(spark, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    text = "\n".join(_plan_lines(df))
    assert not any(p in text for p in PYTHON_NODES), name
    assert single_partition_over_rows(df) == [], name


def test_pushdown_and_pruning(spark):
    from postlens.operators import derive as DV
    from postlens.sources import tables as T
    df = DV.filter_years(DV.derive(T.archive_posts(spark, SF_SMALL)), [1996]).select("tweet_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "o_orderkey" in ln][0]
    # only the columns the query needs are read from orders
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in scan
    assert "PushedFilters: [IsNotNull(o_orderdate)" in scan


def test_year_partitions_pruned(spark, tmp_path):
    from postlens.operators import derive as DV
    from postlens.sources import posts_table as PT
    from postlens.sources import tables as T
    path = PT.write_posts_table(DV.derive(T.archive_posts(spark, SF_SMALL)), str(tmp_path / "posts"))
    df = PT.read_posts_table(spark, path, years=[1996])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "1996" in plan
    assert {r["year"] for r in df.select("year").distinct().collect()} == {1996}

"""Calendar tables from cells equal those from the posts; a dashboard reads the posts once."""
import datetime as dt
import random

import pytest

from postlens.operators import calendar as CAL
from postlens.operators import derive as DV
from postlens.plans import registry as RG

from conftest import make_posts


@pytest.fixture(scope="module")
def derived(spark):
    r = random.Random(3)
    start = dt.datetime(2021, 12, 30)
    rows = [(str(i), f"{start + dt.timedelta(minutes=r.choice([r.randrange(600_000), 77]), microseconds=r.randrange(10**6)):%Y-%m-%d %H:%M:%S.%f}" if i % 9 else None, "a post", None) for i in range(400)]
    return DV.derive(make_posts(spark, rows))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_tables_from_cells(derived):
    cells = CAL.calendar_cells(derived)
    assert cells.count() < derived.count()
    for f in (CAL.yearly_counts, CAL.monthly_counts, CAL.weekday_counts, CAL.weekday_counts_filled, CAL.hourly_counts, CAL.daily_counts, CAL.daily_counts_full,
              CAL.average_yearly_counts, CAL.average_monthly_counts, CAL.average_weekday_counts_filled, CAL.weekly_counts, CAL.monthday_counts,
              CAL.weekday_hour_counts, CAL.weekday_hour_matrix, CAL.weekday_monthday_matrix, CAL.daily_calendar_matrix, CAL.basic_counts, CAL.average_counts):
        assert f(cells).schema.simpleString() == f(derived).schema.simpleString(), f.__name__
        assert _rows(f(cells)) == _rows(f(derived)), f.__name__


def test_empty_input(derived):
    none = derived.limit(0)
    cells = CAL.calendar_cells(none)
    assert _rows(CAL.basic_counts(cells)) == _rows(CAL.basic_counts(none)) and _rows(CAL.average_counts(cells)) == _rows(CAL.average_counts(none))
    assert CAL.calendar_rollups(none).count() == 0


def test_rollups(derived):
    got = CAL.calendar_rollups(derived)
    for level, keys, f in ((0b01111, ["year"], CAL.yearly_counts), (0b00111, ["year", "month"], CAL.monthly_counts), (0b11011, ["weekday"], CAL.weekday_counts),
                           (0b11101, ["hour"], CAL.hourly_counts), (0b11110, ["date"], CAL.daily_counts), (0b11001, ["weekday", "hour"], CAL.weekday_hour_counts)):
        assert _rows(got.where(f"level = {level}").select(*keys, "posts")) == _rows(f(derived))
    assert _rows(CAL.calendar_rollups(CAL.calendar_cells(derived))) == _rows(got)


def test_a_dashboard_reads_the_posts_once(spark, derived, tmp_path):
    derived.write.parquet(str(tmp_path / "posts"))
    posts = spark.read.parquet(str(tmp_path / "posts"))
    panels = RG.run_calendar(posts, RG.AnalysisOptions(years=[2022], years_mode="selected"))
    assert set(panels) == set(RG.CALENDAR_PANELS)
    for name, tables in panels.items():
        for kind, df in tables.items():
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "InMemoryRelation" in plan and "Relation [" not in plan.replace("InMemoryRelation [", ""), kind
            if kind != "average_counts":
                assert _rows(df) == _rows(RG.run(kind, posts, RG.AnalysisOptions(years=[2022], years_mode="selected"), preset="panel"))

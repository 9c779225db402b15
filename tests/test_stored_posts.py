"""The longest texts of a stored table: lengths are ranked, texts read for the winners alone."""
import glob

import pytest

from postlens.operators import derive as DV
from postlens.operators import histograms as H
from postlens.sources import posts_table as STORED

from conftest import make_posts


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = [(str(i), f"202{i % 4}-03-05 10:00:00" if i % 11 else None, "x" * (i * 37 % 101) + ("é\n日本" if i % 5 == 0 else ""), f"https://x.com/{i}") for i in range(300)]
    posts = DV.derive(make_posts(spark, rows)).repartition(7)
    path = str(tmp_path_factory.mktemp("a folder") / "posts")
    STORED.write_posts_table(posts, path)
    return path


@pytest.mark.parametrize("n", [1, 20, 1000])
@pytest.mark.parametrize("years", [None, [2021, 2023], [1999]])
def test_same_rows_as_the_ranking_of_all(spark, table, n, years):
    expected = H.long_text_ranking(STORED.read_posts_table(spark, table, years), n)
    got = STORED.long_texts(spark, table, n, years)
    assert got.columns == expected.columns and got.collect() == expected.collect()


def test_only_the_files_of_the_winners_are_read(spark, table):
    got = STORED.long_texts(spark, table, 1)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "ReadSchema" in plan and "text:string" in plan.split("ReadSchema")[1]
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x]
    assert len(scans) == 1 and "file_path" in scans[0].split("DataFilters: ")[1].split("ReadSchema")[0]  # files are pruned by it
    assert len(glob.glob(table + "/**/*.parquet", recursive=True)) > 10

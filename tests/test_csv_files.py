"""CSV input of several files: each has its own layout; lines that are records stay where they are."""
import os

import pytest
from pyspark.sql import functions as F

from postlens.sources import csv_ingest as CSV
from postlens.sources.posts_table import read_posts_table
from postlens.streaming.ingest import start_ingest

HEAD = ("tweet_id", "created_at", "text", "status_url")


def _q(v):
    return '"' + v.replace('"', '""') + '"'


def _posts(first, n, text="a post with some words"):
    return [(f"{12345678900 + first + i}", "2024-01-05 10:11:12", f"{text} {first + i}", f"https://x.com/s/{first + i}") for i in range(n)]


def _file(path, rows, order=(0, 1, 2, 3), header=None, encoding="utf-8", sep="\n", lead=""):
    lines = [",".join(header)] if header else []
    lines += [",".join(_q(r[i]) for i in order) for r in rows]
    path.write_bytes((lead + sep.join(lines) + sep).encode(encoding))


def _read(spark, path, **kw):
    return sorted(map(tuple, CSV.read_posts_csv(spark, path, **kw).select("tweet_id", F.col("created_at").cast("string"), "text", "status_url").collect()), key=repr)


def _exchanges_of_lines(df):
    """Exchanges between a scan of the files and the result."""
    found, above = [], []
    for line in df._jdf.queryExecution().sparkPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, n) for d, n in above if d < depth] + [(depth, line)]
        if "FileScan text" in line:
            found += [n for _, n in above if "Exchange" in n and "Broadcast" not in n or "Aggregate" in n or "SortMergeJoin" in n]
    return found


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "in"
    os.mkdir(d)
    return d


def _expected(*parts):
    return sorted(((i, t, text, u) for part in parts for i, t, text, u in part), key=repr)


def test_files_of_different_layouts(spark, folder):
    parts = [_posts(0, 3), _posts(100, 4, 'with "quotes", commas'), _posts(200, 2, "two\nlines\n\nor four"), _posts(300, 60, "今日は良い天気です カタカナ"),
             _posts(400, 2), _posts(500, 55, "cr lf"), _posts(600, 1)]
    _file(folder / "a.csv", parts[0], header=HEAD)
    _file(folder / "b.csv", parts[1], order=(2, 3, 1, 0))
    _file(folder / "c.csv", parts[2])
    _file(folder / "d.csv", parts[3], order=(1, 2, 0, 3), encoding="shift_jis")
    _file(folder / "e.csv", parts[4], order=(3, 0, 1, 2), header=("link", "number", "when", "what"), lead="\n\n")
    _file(folder / "f.csv", parts[5], sep="\r\n", header=HEAD)
    _file(folder / "g.csv", parts[6])
    (folder / "h.csv").write_bytes(b"")
    assert _read(spark, str(folder)) == _expected(*parts)


def test_files_of_different_widths(spark, folder):
    wide, narrow = _posts(0, 5), _posts(50, 5)
    (folder / "wide.csv").write_text("".join(f"x,{_q(t)},y,{i},{_q(d)},z,{u}\n" for i, d, t, u in wide))
    (folder / "narrow.csv").write_text("".join(f"{d},{_q(t)},{i}\n" for i, d, t, u in narrow))
    assert _read(spark, str(folder)) == _expected(wide, [(i, d, t, None) for i, d, t, u in narrow])


@pytest.mark.parametrize("span_lines", [0, 1 << 20])
@pytest.mark.parametrize("head_lines", [1, 256])
def test_long_records_and_small_splits(spark, folder, monkeypatch, span_lines, head_lines):
    """Records over many lines, over split borders and over the first lines looked at; both joins."""
    monkeypatch.setattr(CSV, "SPAN_LINES", span_lines)
    monkeypatch.setattr(CSV, "HEAD_LINES", head_lines)
    parts = [_posts(0, 70, "line\n" * 9 + '"q"\r\nend'), _posts(1000, 300), _posts(2000, 40, "some\nlines")]
    _file(folder / "a.csv", parts[0], order=(2, 0, 1, 3), header=("text", "tweet_id", "created_at", "status_url"))
    _file(folder / "b.csv", parts[1])
    _file(folder / "c.csv", parts[2], order=(1, 0, 2, 3))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert _read(spark, str(folder)) == _expected(*parts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lines_without_quoted_breaks_are_not_exchanged(spark, folder, monkeypatch):
    monkeypatch.setattr(CSV, "materialize", lambda df: df.checkpoint())  # leaves what is kept out of the plan
    for k in range(3):
        _file(folder / f"{k}.csv", _posts(100 * k, 50, 'a "quoted" word'))
    assert not _exchanges_of_lines(CSV.read_posts_csv(spark, str(folder)))
    _file(folder / "3.csv", _posts(900, 2, "two\nlines"))
    source = CSV.Source(spark, str(folder))
    assert source.span_lines == 4  # only these lines are gathered
    assert source.numbered().where("dirty").count() == 4
    assert _exchanges_of_lines(source.records())


@pytest.mark.parametrize("split", [200, 3000, 1 << 27])
def test_records_inside_a_split_are_joined_in_its_task(spark, folder, monkeypatch, split):
    """Only lines of records that cross a split's border are gathered by an exchange."""
    monkeypatch.setattr(CSV, "SPAN_LINES", 0)
    parts = [_posts(0, 60, "two\nlines\n\nor four"), _posts(100, 9, "a long one\n" * 30), _posts(200, 30)]
    for k, part in enumerate(parts):
        _file(folder / f"{k}.csv", part)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(before, (split, split // 2, 7)):
            spark.conf.set(k, str(v))
        source = CSV.Source(spark, str(folder))
        assert source.span_lines == source.spans().count() == 60 * 4 + 9 * 31
        crossing = source.numbered().where("border IS NOT NULL").count()
        assert crossing == 0 if split == 1 << 27 else 0 < crossing < source.span_lines
        assert "SortMergeJoin" not in source.records()._jdf.queryExecution().sparkPlan().toString()
        assert _read(spark, str(folder)) == _expected(*parts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_an_unclosed_quote_takes_the_rest_of_its_file(spark, folder):
    _file(folder / "a.csv", _posts(0, 3))
    (folder / "b.csv").write_text('12345678990,2024-01-05,"never closed,https://x.com/1\n12345678991,2024-01-06,two,https://x.com/2\n')
    got = _read(spark, str(folder))
    assert set(_expected(_posts(0, 3))) <= set(got) and len(got) == 4


def test_given_header_and_encoding(spark, folder):
    rows = _posts(0, 5, "良い天気です、今日は散歩に行きました")
    _file(folder / "a.csv", rows, encoding="euc_jp")
    assert _read(spark, str(folder), has_header=False, encoding="EUC-JP") == _expected(rows)
    assert len(_read(spark, str(folder), has_header=True, encoding="EUC-JP")) == 4


def test_later_files_of_a_stream_have_their_own_layout(spark, folder, tmp_path):
    table = str(tmp_path / "posts")
    first, second, third = _posts(0, 4), _posts(100, 6, "二つ目のファイル\nです"), _posts(200, 3, "another archive with other words")
    _file(folder / "1.csv", first, header=HEAD)
    start_ingest(spark, str(folder), table).awaitTermination(120)
    _file(folder / "2.csv", second, order=(2, 1, 0, 3), encoding="shift_jis")
    start_ingest(spark, str(folder), table).awaitTermination(120)
    _file(folder / "3.csv", third, order=(1, 0, 3, 2))
    (folder / "4.csv").write_bytes(b"")
    for _ in range(2):
        start_ingest(spark, str(folder), table).awaitTermination(120)
    got = sorted(map(tuple, read_posts_table(spark, table).select("tweet_id", F.col("created_at").cast("string"), "text", "status_url").collect()), key=repr)
    assert got == _expected(first, second, third)


def test_a_repeated_batch_replaces_what_it_wrote(spark, folder, tmp_path):
    from postlens.streaming.ingest import append_csv_files
    _file(folder / "1.csv", _posts(0, 4))
    files = spark.createDataFrame([(f"file:{folder}/1.csv",)], "path string")
    for _ in range(2):
        append_csv_files(files, str(tmp_path / "posts"))
    assert read_posts_table(spark, str(tmp_path / "posts")).count() == 4

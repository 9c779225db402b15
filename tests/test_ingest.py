"""CSV ingest round trips (FIXTURES.md section 1)."""
import os
import tempfile

import pytest

from postlens.sources import csv_ingest as CSV

ROWS = [
    ("1234567890123", "2024-01-05 10:11:12", "今日は\"良い\"天気です。散歩に行きました。\n二行目も書いておきます", "https://x.com/me/status/1234567890123"),
    ("1234567890124", "2024-01-06 08:00", "カタカナとひらがな、漢字が混ざった少し長めの投稿です", "https://x.com/me/status/1234567890124"),
    ("1234567890125", "2024-01-07", "短いけれど十分な長さの本文です", "https://x.com/me/status/1234567890125"),
    ("1234567890126", "2024/01/08", "日付が読めない行もそのまま残ります", "https://x.com/me/status/1234567890126"),
]
HEADER = ["tweet_id", "created_at", "text", "status_url"]


def _q(v):
    return '"' + v.replace('"', '""') + '"'


def _write(rows, order, header, encoding):
    d = tempfile.mkdtemp(prefix="postlens-csv-")
    path = os.path.join(d, "posts.csv")
    lines = []
    if header:
        lines.append(",".join(HEADER[i] for i in order))
    for r in rows:
        lines.append(",".join(_q(r[i]) for i in order))
    with open(path, "wb") as f:
        f.write(("\n".join(lines) + "\n").encode(encoding))
    return path


def _read(spark, path, **kw):
    return {r["tweet_id"]: r for r in CSV.read_posts_csv(spark, path, **kw).collect()}


@pytest.mark.parametrize("encoding", ["utf-8", "shift_jis", "euc_jp"])
@pytest.mark.parametrize("header", [True, False])
def test_round_trip(spark, encoding, header):
    order = [2, 0, 3, 1]  # shuffled columns
    got = _read(spark, _write(ROWS, order, header, encoding))
    assert set(got) == {r[0] for r in ROWS}
    r = got["1234567890123"]
    assert r["text"] == ROWS[0][2]  # quoted newline and doubled quotes survive
    assert str(r["created_at"]) == "2024-01-05 10:11:12"
    assert str(got["1234567890124"]["created_at"]) == "2024-01-06 08:00:00"
    assert str(got["1234567890125"]["created_at"]) == "2024-01-07 00:00:00"
    assert got["1234567890126"]["created_at"] is None
    assert r["status_url"] == ROWS[0][3]


def test_detects_encoding(spark):
    assert CSV.detect_encoding(spark, _write(ROWS, [0, 1, 2, 3], False, "utf-8")) == "UTF-8"
    assert CSV.detect_encoding(spark, _write(ROWS, [0, 1, 2, 3], False, "shift_jis")) in ("windows-31j", "Shift_JIS")
    assert CSV.detect_encoding(spark, _write(ROWS, [0, 1, 2, 3], False, "euc_jp")) == "EUC-JP"


def test_no_url_column(spark):
    rows = [(r[0], r[1], r[2]) for r in ROWS]
    got = _read(spark, _write([r + ("",) for r in rows], [1, 0, 2], False, "utf-8"))
    assert all(v["status_url"] is None for v in got.values())
    assert got["1234567890125"]["text"] == "短いけれど十分な長さの本文です"


def test_zero_rows_is_an_error(spark):
    path = _write([], [0, 1, 2, 3], False, "utf-8")
    with pytest.raises(Exception):
        CSV.read_posts_csv(spark, path)


def test_parse_created_at_formats(spark):
    from pyspark.sql import functions as F
    vals = ["2024-01-05 10:11:12", " 2024-01-05 10:11 ", "2024-01-05", "2024-01-05T10:11", "2024-02-30",
            "2024-01-05 10:11:12.5", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(CSV.parse_created_at(F.col("s"))).collect()]
    assert [str(g) if g else None for g in got] == [
        "2024-01-05 10:11:12", "2024-01-05 10:11:00", "2024-01-05 00:00:00", None, None, None, None]


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "x,y")], "n int, l array<string>, s string")
    path = CSV.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(path).collect()
    assert back[0]["l"] == '["a","b"]' and back[0]["s"] == "x,y"
    with pytest.raises(CSV.CSVLoadError):
        CSV.write_csv(df.limit(0), str(tmp_path / "empty"))


def test_parse_created_at_matches_strptime(spark):
    import datetime as dt
    import random
    from pyspark.sql import functions as F
    rnd = random.Random(9)
    vals = []
    for _ in range(400):
        y, m, d = rnd.choice([1999, 2000, 2023, 2024]), rnd.randint(0, 13), rnd.randint(0, 32)
        hh, mm, ss = rnd.randint(0, 25), rnd.randint(0, 61), rnd.randint(0, 61)
        shape = rnd.randrange(6)
        vals.append([f"{y:04d}-{m:02d}-{d:02d} {hh:02d}:{mm:02d}:{ss:02d}", f"{y:04d}-{m:02d}-{d:02d} {hh:02d}:{mm:02d}",
                     f"{y:04d}-{m:02d}-{d:02d}", f" {y:04d}-{m:02d}-{d:02d} ", f"{y:04d}/{m:02d}/{d:02d}",
                     f"{y:04d}-{m:02d}-{d:02d}T{hh:02d}:{mm:02d}"][shape])

    def expected(s):
        for fmt in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d"):
            try:
                return dt.datetime.strptime(s.strip(), fmt)
            except ValueError:
                pass
        return None

    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = {r["s"]: r["t"] for r in df.select("s", CSV.parse_created_at(F.col("s")).alias("t")).collect()}
    for v in vals:
        assert got[v] == expected(v), v

"""Distributed global-order operators against brute force."""
import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import make_posts
from postlens.operators import derive as DV
from postlens.operators import gaps as GP


def _random_rows(n, seed, authors=1, burst=0.3):
    rnd = random.Random(seed)
    rows = []
    base = 1704067200000  # 2024-01-01
    t = base
    for i in range(n):
        if rnd.random() < burst:
            pass  # same instant as the previous post (hot timestamp)
        else:
            t += rnd.choice([1, 500, 60000, 1800000, 1800001, 3600000 * 5, rnd.randint(0, 10 ** 7)])
        ms = t
        ts = f"{ms // 1000}"
        rows.append((str(i), ms, f"text {i}", None, rnd.randrange(authors)))
    rnd.shuffle(rows)
    return rows


def _to_df(spark, rows):
    df = spark.createDataFrame(rows, "tweet_id string, ms long, text string, status_url string, author_id bigint")
    return df.select("tweet_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("created_at"),
                     "text", "status_url", "author_id")


def _brute(rows, gap_ms, by_author=False):
    groups = {}
    for r in rows:
        groups.setdefault(r[4] if by_author else 0, []).append(r[1])
    diffs, sizes = [], {}
    for ms in groups.values():
        ms.sort()
        size = 1
        for a, b in zip(ms, ms[1:]):
            diffs.append(b - a)
            if b - a > gap_ms:
                sizes[size] = sizes.get(size, 0) + 1
                size = 1
            else:
                size += 1
        sizes[size] = sizes.get(size, 0) + 1
    return sorted(diffs), sizes


def test_stitched_lag_equals_global_lag(spark):
    rows = _random_rows(3000, 1)
    df = _to_df(spark, rows)
    want, want_sizes = _brute(rows, 1800000)
    for parts in (1, 7, 32):
        got = sorted(r["diff_ms"] for r in GP.ordered_gaps(df, num_partitions=parts).collect()
                     if r["diff_ms"] is not None)
        assert got == want
        g = GP.ordered_gaps(df, gap_minutes=30, num_partitions=parts)
        sizes = {r["s"]: r["c"] for r in g.groupBy("session_id").count().groupBy(F.col("count").alias("s"))
                 .agg(F.count("*").alias("c")).collect()}
        assert sizes == want_sizes


def test_keyed_sessions_per_author(spark):
    rows = _random_rows(2000, 2, authors=13)
    df = _to_df(spark, rows)
    want, want_sizes = _brute(rows, 1800000, by_author=True)
    g = GP.ordered_gaps(df, gap_minutes=30, by="author_id", num_partitions=9)
    got = sorted(r["diff_ms"] for r in g.collect() if r["diff_ms"] is not None)
    assert got == want
    sizes = {r["s"]: r["c"] for r in g.groupBy("session_id").count().groupBy(F.col("count").alias("s"))
             .agg(F.count("*").alias("c")).collect()}
    assert sizes == want_sizes


def test_select_ranks_exact(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([0, 0, 0, 5, 17, 10 ** 9, rnd.randint(0, 10 ** 11)]) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "d long")
    s = sorted(vals)
    ranks = [0, 1, 2499, 2500, 4499, 4999]
    got = GP.select_ranks(df, "d", ranks, min(vals), max(vals), bins=16)
    assert got == {k: s[k] for k in ranks}


def test_p90_half_even_rule():
    assert [GP.p90_index(n) for n in (1, 5, 15, 25)] == [0, 3, 13, 21]


def test_interval_summary_small_counts(spark):
    for n in (5, 15, 25):
        rows = [(str(i), f"2024-01-01 00:{i:02d}:00", "x", None) for i in range(n + 1)]
        rows[-1] = (str(n), f"2024-01-01 01:{n:02d}:00", "x", None)
        d = DV.derive(make_posts(spark, rows))
        r = GP.posting_interval_summary(d).collect()[0]
        diffs = sorted([1.0] * (n - 1) + [61.0])
        assert r["count"] == n and r["p90"] == diffs[GP.p90_index(n)]
        assert r["median"] == (diffs[n // 2] if n % 2 else (diffs[n // 2 - 1] + diffs[n // 2]) / 2)


def test_empty_intervals(spark):
    d = DV.derive(make_posts(spark, [("1", None, "x", None)]))
    r = GP.posting_interval_summary(d).collect()[0]
    assert r["count"] == 0
    assert GP.session_length_distribution(d).count() == 0


def test_hot_instant_is_split_across_partitions(spark):
    # a third of all posts share one millisecond
    rows = [(str(i), 1704067200000 if i % 3 == 0 else 1704067200000 + i * 1000, "x", None, 0) for i in range(6000)]
    df = _to_df(spark, rows)
    sizes = [r["count"] for r in GP.range_partitioned(df, num_partitions=12).groupBy("pid").count().collect()]
    assert sum(sizes) == 6000 and len(sizes) >= 10
    assert max(sizes) < 2 * 6000 / 12  # no partition holds the hot instant's third
    want, want_sizes = _brute(rows, 1800000)
    got = sorted(r["diff_ms"] for r in GP.ordered_gaps(df, num_partitions=12).collect() if r["diff_ms"] is not None)
    assert got == want


def test_ranks_outside_their_first_interval(spark):
    rnd = random.Random(4)
    vals = [int(rnd.paretovariate(0.3)) for _ in range(800)]
    df = spark.createDataFrame([(v,) for v in vals], "d bigint")
    ranks = [0, 1, 399, 400, 719, 799]
    for within in ({}, {k: (sorted(vals)[k], sorted(vals)[k]) for k in ranks}, {k: (min(vals), min(vals)) for k in ranks}, {k: (max(vals), max(vals)) for k in ranks},
                   {k: (10 ** 6, 10 ** 7) for k in ranks}):
        for bins, few in ((3, False), (GP.BINS, False), (3, True)):
            assert GP.select_ranks(df, "d", ranks, min(vals), max(vals), bins, within, few) == {k: sorted(vals)[k] for k in ranks}


def test_summary_takes_two_counts(spark, monkeypatch):
    """One pass with sketches, then one count of each rank's bins, at a range of years."""
    rounds = []
    plain = GP.select_ranks
    monkeypatch.setattr(GP, "select_ranks", lambda v, *a, **k: plain(_counted(v, rounds), *a, **k))
    rows = [(str(i), str(dt.datetime(2000, 1, 1) + dt.timedelta(minutes=i * i)), "x", None) for i in range(2000)]
    got = GP.posting_interval_summary(make_posts(spark, rows)).head()
    gaps = sorted((2 * i + 1) * 1.0 for i in range(1999))
    assert (got["median"], got["p90"], got["count"]) == (gaps[999], gaps[GP.p90_index(1999)], 1999)
    assert len(rounds) == 1


def _counted(df, rounds):
    class Counting:
        def select(self, *a):
            rounds.append(1)
            return df.select(*a)
    return Counting()


def test_session_sizes_are_those_of_the_posts(spark):
    rnd = random.Random(8)
    rows, t = [], dt.datetime(1969, 12, 25)
    for i in range(600):
        t += dt.timedelta(milliseconds=rnd.choice([0, 1, 59_999, 60_000, 60_001, 1_799_999, 1_800_000, 1_800_001, 90_000_000]))
        rows.append((str(i), str(t) if "." in str(t) else f"{t}.000000", "x", None, i % 3))
    posts = make_posts(spark, rows, with_author=True)
    for gap in (0, 1, 30, 0.5):
        for by in (None, "author_id"):
            expected = sorted((r["start_ms"], r["end_ms"], r["posts"]) for r in GP.sessions(posts, gap, by).collect())
            assert sorted((r["start_ms"], r["end_ms"], r["posts"]) for r in GP.session_sizes(posts, gap, by).collect()) == expected
    assert GP.session_cells(posts, 30).count() < 600


def test_bounds_part_a_burst(spark):
    from pyspark.sql import functions as F
    rows = [(str(i), "2024-01-05 10:00:00" if i < 900 else f"2024-01-{6 + i % 20:02d} 10:00:00", "x", None) for i in range(1000)]
    r = GP.range_partitioned(make_posts(spark, rows), num_partitions=4)
    sizes = [x["n"] for x in r.groupBy("pid").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < 130

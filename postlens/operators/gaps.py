"""Order-dependent operators: posting intervals, sessions, exact rank selection.

Global time order without a single partition
--------------------------------------------
``Window.orderBy`` with no partition key moves every row to one task.  Instead:

1. each row gets a range number ``pid`` from fixed bounds on (key, ms, tie).  Without a
   key one pass of mergeable quantile sketches over the times gives them, and bounds that
   fall on one instant part it evenly by the tie, which is a hash; with a key a bounded
   sample, the rows of small hash, is sorted and every so-manieth row is a bound.
   ``pid`` is an expression of the row alone, so every branch of a plan and every
   recomputed task agrees on it, whether or not Spark reuses an exchange.  A burst of
   posts at one instant is split too (the tie column is a hash of the row);
2. rows are shuffled once, by ``pid``, several ranges to a task; ``lag`` and running
   sums run as an ordinary window over ``pid`` on that same partitioning;
3. the only facts that cross ranges -- the last timestamp (and author) before each
   range, and the number of sessions started in earlier ranges -- come from a table
   with one row per range (bounded by the number of ranges, so broadcasting it is
   safe), combined with a window over that tiny table.

The result equals a global ``lag`` over all rows in time order.

Sessions without their posts
----------------------------
Posts of one key in one cell of time, no wider than the gap, are in one session.  So
session sizes are worked out from cells (first, last, count), which are summed where the
posts are read: what is shuffled and ordered are the cells with posts, at most the time
span divided by the gap for each key, however many posts there are.

Exact percentiles without a single group
----------------------------------------
``median``/``percentile`` keep a map of all distinct values of the group in one
task.  Here the pass that counts the values also merges quantile sketches, which give an
interval of values around each rank; a second pass counts the values below and in
``BINS`` bins of it.  Where a bin is one integer that ends it, else the next pass divides
the bin; an interval that should have missed its rank is replaced by the rest of
the range.  The result is exact in any case.
"""

from __future__ import annotations

import itertools
import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import shuffle_partitions

# Tie-breaker for range partitioning: spreads posts sharing one instant over
# partitions.  Identifiers only -- hashing whole texts would cost a pass over them.
_TIE_COLS = ("tweet_id", "status_url")


# Ranges per task, and sampled rows per range.
RANGES_PER_TASK = 4
SAMPLE_PER_RANGE = 16
# Bins of a count around a rank, and the relative error of the sketches before it.
BINS = 1 << 13
SKETCH_ERROR = 1e-4


def _range_bounds(t: DataFrame, ranges: int) -> list:
    """Ascending (k, ms, tb) rows that part ``t`` into about equal ranges, from a sample of
    about ``SAMPLE_PER_RANGE * ranges`` rows: those with a hash below a cut-off, the same in
    every run and with so many rows brought to the driver at any size."""
    wanted, n = SAMPLE_PER_RANGE * ranges, t.count()
    if n > wanted:
        steps = 1 << 40
        t = t.where(F.pmod(F.xxhash64("tb", "ms"), F.lit(steps)) < int(steps * wanted / n))
    rows = t.orderBy("k", "ms", "tb").collect()
    step = max(1, len(rows) // ranges)
    return rows[step::step]


def _time_bounds(t: DataFrame, ranges: int) -> list[tuple]:
    """Ascending (0, ms, tb) that part ``t`` (all of key 0) into about equal ranges, from one pass."""
    shares = [i / ranges for i in range(1, ranges)]
    times = (t.agg(F.percentile_approx("ms", shares, F.lit(10 * ranges))).head()[0] or []) if shares else []
    out = []
    for ms, same in itertools.groupby(times):
        n = len(list(same))  # a burst: n bounds on one instant part its ties
        out += [(0, ms, -(1 << 63) + (i << 64) // n) for i in range(n)]
    return out


def _range_number(bounds: list, schema) -> F.Column:
    """How many bounds are not above the row, found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    kinds = [schema[c].dataType for c in ("k", "ms", "tb")]
    lit = [F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(("k", "ms", "tb"), b, kinds)]) for b in bounds]
    step = max(1, math.isqrt(len(lit)))
    row = F.struct("k", "ms", "tb")
    coarse = F.size(F.filter(F.array(*lit[step - 1::step]), lambda b: b <= row))
    fine = F.size(F.filter(F.slice(F.array(*lit), coarse * step + 1, step - 1), lambda b: b <= row)) if step > 1 else F.lit(0)
    return coarse * step + fine


def range_partitioned(df: DataFrame, by: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """(k, ms, tb, pid): posts with a time, shuffled by their range of (key, ms, tie).
    The tie column spreads posts that share one instant (or one author's whole history)
    over several ranges.  Building the plan reads the sample."""
    n = num_partitions or shuffle_partitions(df.sparkSession)
    key = F.col(by) if by else F.lit(0)
    ties = [c for c in _TIE_COLS if c in df.columns]
    t = (df.where(F.col("created_at").isNotNull())
         .select(key.alias("k"), C.epoch_millis(F.col("created_at")).alias("ms"),
                 F.xxhash64(*ties).alias("tb") if ties else F.lit(0).cast("long").alias("tb")))
    pid = _range_number((_range_bounds if by else _time_bounds)(t, RANGES_PER_TASK * n), t.schema)
    return t.withColumn("pid", pid).repartition(n, "pid")


def ordered_gaps(df: DataFrame, gap_minutes: float | None = None, by: str | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """One row per post with a time: ``ms`` (whole milliseconds), ``diff_ms`` to the
    previous post of the same ``by`` key (null for the first) and, when
    ``gap_minutes`` is given, ``session_id`` (sessions split where the gap is
    larger than ``gap_minutes``; numbered in time order, globally unique)."""
    r = range_partitioned(df, by, num_partitions)

    w = Window.partitionBy("pid").orderBy("k", "ms", "tb")
    local = (r.withColumn("prev_ms", F.lag("ms").over(w))
              .withColumn("prev_k", F.lag("k").over(w))
              .withColumn("first_row", F.row_number().over(w) == 1))
    local = local.withColumn("prev_ms", F.when(~F.col("first_row") & F.col("prev_k").eqNullSafe(F.col("k")), F.col("prev_ms")))

    # One row per non-empty range: first and last (key, ms).
    parts = r.groupBy("pid").agg(F.min(F.struct("k", "ms")).alias("first"),
                                 F.max(F.struct("k", "ms")).alias("last"))
    wp = Window.orderBy("pid")
    parts = (parts.withColumn("before", F.lag("last").over(wp))
             .withColumn("carry", F.when(F.col("before").isNotNull() & F.col("before.k").eqNullSafe(F.col("first.k")),
                                         F.col("before.ms"))))

    if gap_minutes is None:
        x = local.join(F.broadcast(parts.select("pid", "carry")), "pid", "left")
        prev = F.when(F.col("first_row"), F.col("carry")).otherwise(F.col("prev_ms"))
        return x.select(F.col("k").alias(by or "k"), "ms", (F.col("ms") - prev).alias("diff_ms"))

    gap_ms = float(gap_minutes) * 60000.0
    new_flag = (F.col("prev_ms").isNull() | ((F.col("ms") - F.col("prev_ms")) > F.lit(gap_ms))).cast("long")
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = local.withColumn("flag", new_flag).withColumn("local_sid", F.sum("flag").over(wr))

    flags = local.groupBy("pid").agg(F.sum("flag").alias("flags"))
    # The first row of a partition starts a session locally; it does not when the
    # carried previous post of the same key is close enough.
    cont = (F.col("carry").isNotNull() & ((F.col("first.ms") - F.col("carry")) <= F.lit(gap_ms))).cast("long")
    parts = (parts.join(flags, "pid").withColumn("cont", cont)
             .withColumn("adj", F.col("flags") - F.col("cont"))
             .withColumn("offset", F.coalesce(F.sum("adj").over(
                 wp.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    x = local.join(F.broadcast(parts.select("pid", "carry", "cont", "offset")), "pid", "left")
    prev = F.when(F.col("first_row"), F.col("carry")).otherwise(F.col("prev_ms"))
    return x.select(F.col("k").alias(by or "k"), "ms", (F.col("ms") - prev).alias("diff_ms"),
                    (F.col("offset") + F.col("local_sid") - F.col("cont")).alias("session_id"))


def interval_lag(df: DataFrame, by: str | None = None) -> DataFrame:
    """Minutes between consecutive posts (one row per post except the first)."""
    g = ordered_gaps(df, by=by)
    return g.where(F.col("diff_ms").isNotNull()).select(
        (F.col("diff_ms") / F.lit(60000.0)).alias("diff_min"))


def posting_interval_distribution(df: DataFrame, bin_size: int = 30, max_minutes: int | None = None,
                                  by: str | None = None) -> DataFrame:
    """Histogram of minutes between consecutive posts (of the same ``by`` key)."""
    if bin_size <= 0:
        bin_size = 30
    d = interval_lag(df, by).where(F.col("diff_min") >= 0)
    if max_minutes is not None and max_minutes > 0:
        d = d.where(F.col("diff_min") <= F.lit(float(max_minutes)))
    start = (F.floor(F.col("diff_min") / F.lit(float(bin_size))) * F.lit(bin_size)).cast("double")
    out = (d.groupBy(start.alias("bin_start")).agg(F.count(F.lit(1)).alias("posts"))
           .withColumn("bin_end", F.col("bin_start") + F.lit(float(bin_size - 1))))
    return out.select("bin_start", "bin_end", "posts",
                      F.concat(C.float_label(F.col("bin_start")), F.lit("-"),
                               C.float_label(F.col("bin_end"))).alias("bin_label")).orderBy("bin_start")


def session_cells(df: DataFrame, gap_minutes: float, by: str | None = None) -> DataFrame:
    """One row for each key and cell of time that has posts: ``k``, ``cell``, ``first`` and
    ``last`` (ms) and ``posts``."""
    width = max(1, math.floor(gap_minutes * 60000.0))
    t = df.where(F.col("created_at").isNotNull()).select((F.col(by) if by else F.lit(0)).alias("k"), C.epoch_millis(F.col("created_at")).alias("ms"))
    # div cuts towards zero, so the cell around 1970 is twice as wide: pmod keeps all alike.
    cell = (F.col("ms") - F.pmod("ms", F.lit(width).cast("long"))) / F.lit(width)
    return (t.groupBy("k", cell.cast("long").alias("cell"))
            .agg(F.min("ms").alias("first"), F.max("ms").alias("last"), F.count(F.lit(1)).alias("posts")))


def session_sizes(df: DataFrame, gap_minutes: float, by: str | None = None) -> DataFrame:
    """One row for each session: ``k``, its number within the key, ``start_ms``, ``end_ms``, ``posts``."""
    cells = session_cells(df, gap_minutes, by)
    w = Window.partitionBy("k").orderBy("cell") if by else Window.orderBy("cell")
    begins = F.coalesce(F.col("first") - F.lag("last").over(w) > F.lit(gap_minutes * 60000.0), F.lit(True))
    numbered = cells.withColumn("begins", begins.cast("long")).withColumn("nth", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("k", "nth").agg(F.min("first").alias("start_ms"), F.max("last").alias("end_ms"), F.sum("posts").alias("posts"))


def session_length_distribution(df: DataFrame, gap_minutes: int = 30, by: str | None = None) -> DataFrame:
    """Number of sessions per session size (posts per session)."""
    sizes = session_sizes(df, gap_minutes, by).select(F.col("posts").alias("session_size"))
    return (sizes.groupBy("session_size").agg(F.count(F.lit(1)).alias("sessions")).orderBy("session_size"))


def sessions(df: DataFrame, gap_minutes: int = 30, by: str | None = None) -> DataFrame:
    """One row per session: id (time order), first / last post time (ms), size."""
    g = ordered_gaps(df, gap_minutes=gap_minutes, by=by)
    return (g.groupBy("session_id").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"),
                                        F.count(F.lit(1)).alias("posts")).orderBy("session_id"))


def select_ranks(values: DataFrame, col: str, ranks: list[int], lo: int, hi: int, bins: int = BINS,
                 within: dict[int, tuple[int, int]] | None = None, few: bool = False) -> dict:
    """Exact k-th smallest (0-based) integer values of ``col`` for each k in ranks.

    ``within`` gives an interval to look in first for each k; with ``few`` that holds so few
    values that each is counted by itself.  Otherwise, and in later rounds, each round is one aggregation
    returning at most ``len(ranks) * (bins + 2)`` rows: counts in the bins of each rank's
    interval, below and above it.
    """
    state = {k: (within or {}).get(k, (lo, hi)) for k in set(ranks)}
    done: dict[int, int] = {}
    while len(done) < len(state):
        open_ = [(k, a, b, 1 if few else max(1, math.ceil((b - a + 1) / bins))) for k, (a, b) in state.items() if k not in done]
        tagged = F.array(*[
            F.struct(F.lit(i).alias("t"), F.when(F.col(col) < a, F.lit(-1)).when(F.col(col) > b, F.lit(1 << 62))
                     .otherwise(F.floor((F.col(col) - F.lit(a)) / F.lit(w)).cast("long")).alias("bin"))
            for i, (_, a, b, w) in enumerate(open_)])
        hist = (values.select(F.explode(tagged).alias("s")).groupBy("s.t", "s.bin").agg(F.count(F.lit(1)).alias("c")).collect())
        by_target: dict[int, list] = {}
        for row in hist:
            by_target.setdefault(row["t"], []).append((row["bin"], row["c"]))
        for i, (k, a, b, w) in enumerate(open_):
            acc = 0
            for bin_, c in sorted(by_target.get(i, [])):
                if acc + c > k:
                    inside = 0 <= bin_ < 1 << 62
                    new = (a + bin_ * w, min(b, a + bin_ * w + w - 1)) if inside else (lo, a - 1) if bin_ < 0 else (b + 1, hi)
                    state[k] = new
                    if inside and new[0] == new[1]:
                        done[k] = new[0]
                    break
                acc += c
            else:  # rank beyond the data: cannot happen for 0 <= k < n
                raise ValueError(f"rank {k} out of range")
        few = False
    return done


def p90_index(n: int) -> int:
    """0-based index of the 90th percentile: round-half-even of 0.9 n, minus one."""
    return max(int(round(n * 0.9)) - 1, 0)


def _r2(x: float) -> float:
    return math.floor(x * 100.0 + 0.5) / 100.0


def interval_lag_ms(df: DataFrame, by: str | None = None) -> DataFrame:
    g = ordered_gaps(df, by=by)
    return g.where(F.col("diff_ms").isNotNull()).select(F.col("diff_ms").alias("d"))


def _interval_ranks(df: DataFrame, which, shares: list[float], by: str | None = None) -> tuple[int, int, int, dict]:
    """(n, min_ms, sum_ms, {rank: value_ms}) over the persisted intervals; ``which`` gives the
    ranks for n, each near one of ``shares`` of n."""
    g = interval_lag_ms(df, by).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        around = sorted({min(1.0, max(0.0, share + side * 2 * SKETCH_ERROR)) for share in shares for side in (-50, -1, 1, 50)})
        stats = g.agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum("d").alias("s"),
                      F.percentile_approx("d", around, F.lit(int(1 / SKETCH_ERROR))).alias("near")).collect()[0]
        n = stats["n"]
        if not n:
            return 0, 0, 0, {}
        lo, hi, ranks = int(stats["lo"]), int(stats["hi"]), which(n)
        known = [(0.0, lo), *zip(around, stats["near"]), (1.0, hi)]
        within = {k: (max(v for p, v in known if p <= k / n or v == lo), min(v for p, v in known if p >= (k + 1) / n or v == hi)) for k in ranks}
        few = n * 200 * SKETCH_ERROR <= 4 * BINS  # the widest interval around a share holds 2 %
        vals = select_ranks(g, "d", ranks, lo, hi, within=within, few=few)
        return n, lo, int(stats["s"]), vals
    finally:
        g.unpersist()


def _median_ranks(n: int) -> list[int]:
    mid = n // 2
    return [mid] + ([mid - 1] if n % 2 == 0 else [])


def _median(n: int, vals: dict) -> float:
    mid = n // 2
    if n % 2 == 0:
        return (vals[mid - 1] / 60000.0 + vals[mid] / 60000.0) / 2
    return vals[mid] / 60000.0


def posting_interval_summary(df: DataFrame, by: str | None = None) -> DataFrame:
    """count, min, median, mean and p90 of the minutes between consecutive posts
    (of the same ``by`` key; each rounded to 2 places).  All work runs in Spark;
    the result is one row."""
    n, lo, s, vals = _interval_ranks(df, lambda n: _median_ranks(n) + [p90_index(n)], [0.5, 0.9], by)
    spark = df.sparkSession
    schema = "count bigint, min double, median double, mean double, p90 double"
    if n == 0:
        return spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0)], schema)
    row = (n, _r2(lo / 60000.0), _r2(_median(n, vals)), _r2(float(s) / n / 60000.0),
           _r2(vals[p90_index(n)] / 60000.0))
    return spark.createDataFrame([row], schema)


def rank_select_p90(df: DataFrame) -> DataFrame:
    """n, the 0-based p90 rank and the interval at that rank in minutes (unrounded)."""
    n, _, _, vals = _interval_ranks(df, lambda n: [p90_index(n)], [0.9])
    k = p90_index(n) if n else 0
    return df.sparkSession.createDataFrame(
        [(n, k, vals[k] / 60000.0 if n else None)], "n bigint, p90_rank bigint, p90_minutes double")


def median_exact(df: DataFrame) -> DataFrame:
    """Exact median of the intervals in minutes (mean of the two middle values when even)."""
    n, _, _, vals = _interval_ranks(df, _median_ranks, [0.5])
    return df.sparkSession.createDataFrame(
        [(n, _median(n, vals) if n else None)], "n bigint, median_minutes double")

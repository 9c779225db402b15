"""Calendar counts, zero-filled series and dense matrices.

All counts are partial (map-side) aggregations; zero-filling joins a generated
calendar whose size is bounded by the date span (days), or a fixed 7 / 24 / 31
row table, never by the number of posts.

Every operator takes posts or the cells that :func:`calendar_cells` makes of them: one row
for each date and hour with posts, at most the hours of the time span.  A dashboard counts
the posts once and works out all its tables from the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


# Columns of a cell: its posts and the last of their times (``created_at`` is the first).
CELL_POSTS, CELL_LAST = "_posts", "_last_at"
# Tables that GROUPING SETS roll up from the cells at once.
ROLLUPS = [["year"], ["year", "month"], ["weekday"], ["hour"], ["date"], ["weekday", "hour"]]


def _posts(df: DataFrame) -> Column:
    """Aggregate: number of posts of rows that are posts or cells."""
    return F.coalesce(F.sum(CELL_POSTS), F.lit(0)) if CELL_POSTS in df.columns else F.count(F.lit(1))


def _last(df: DataFrame) -> Column:
    return F.col(CELL_LAST if CELL_LAST in df.columns else "created_at")


def calendar_cells(df: DataFrame) -> DataFrame:
    """One row for each date and hour that has posts (and one for posts without a time): the
    calendar columns, the posts, and their first and last time."""
    return (df.groupBy("date", "year", "month", "weekday", "hour")
            .agg(F.count(F.lit(1)).alias(CELL_POSTS), F.min("created_at").alias("created_at"), F.max("created_at").alias(CELL_LAST)))


def calendar_rollups(df: DataFrame) -> DataFrame:
    """Posts of every year, month, weekday, hour, date and weekday with hour, from one count of
    the posts; ``level`` is the grouping id over (year, month, weekday, hour, date)."""
    keys = ["year", "month", "weekday", "hour", "date"]
    cells = df if CELL_POSTS in df.columns else calendar_cells(df)
    return cells.groupingSets(ROLLUPS, *keys).agg(_posts(cells).alias("posts"), F.grouping_id().alias("level")).select("level", *keys, "posts")


def _count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(_posts(df).alias("posts")).orderBy(*keys)


def _range_table(df: DataFrame, name: str, start: int, stop: int) -> DataFrame:
    """Fixed small key table (e.g. weekdays 0..6), built on the same session."""
    spark = df.sparkSession
    return spark.range(start, stop).select(F.col("id").cast("int").alias(name))


def yearly_counts(df: DataFrame) -> DataFrame:
    return _count(df, "year")


def monthly_counts(df: DataFrame) -> DataFrame:
    return _count(df, "year", "month")


def weekday_counts(df: DataFrame) -> DataFrame:
    return _count(df, "weekday")


def weekday_counts_filled(df: DataFrame) -> DataFrame:
    """Panel form: all seven weekdays, zero when absent, with label."""
    counts = df.where(F.col("weekday").isNotNull()).groupBy("weekday").agg(_posts(df).alias("posts"))
    base = _range_table(df, "weekday", 0, 7)
    return (F.broadcast(base).join(counts, "weekday", "left")
            .select("weekday", F.coalesce("posts", F.lit(0)).alias("posts"),
                    C.weekday_label(F.col("weekday")).alias("weekday_label"))
            .orderBy("weekday"))


def hourly_counts(df: DataFrame) -> DataFrame:
    return _count(df, "hour")


def daily_counts(df: DataFrame) -> DataFrame:
    return _count(df, "date")


def daily_counts_full(df: DataFrame) -> DataFrame:
    """Posts of every date from the first to the last, zeros included.

    One pass over the posts: they are counted by date, and the span comes from those
    counts.  Each date is then followed by the days up to the next date (a gap of days,
    not of posts), so no second table is joined."""
    counts = df.where(F.col("date").isNotNull()).groupBy("date").agg(_posts(df).alias("posts"))
    after = F.lead("date").over(Window.orderBy("date"))  # one row per date
    until = F.coalesce(F.date_sub("_after", 1), F.col("date"))
    return (counts.withColumn("_after", after)
            .select(F.col("date").alias("_day"), "posts", F.explode(F.sequence("date", until)).alias("date"))
            .select("date", F.when(F.col("date") == F.col("_day"), F.col("posts")).otherwise(F.lit(0)).alias("posts"))
            .orderBy("date"))


def daily_counts_zero_filled(df: DataFrame) -> DataFrame:
    """Zero-filled days with their year, month and weekday."""
    d = daily_counts_full(df)
    return d.select("date", "posts", F.year("date").alias("year"), F.month("date").alias("month"),
                    F.weekday("date").alias("weekday"))


def _avg_daily(df: DataFrame, *keys: str) -> DataFrame:
    return (daily_counts_zero_filled(df).groupBy(*keys)
            .agg(C.round_half_up(F.avg("posts"), 2).alias("avg_posts"))
            .orderBy(*keys))


def average_yearly_counts(df: DataFrame) -> DataFrame:
    return _avg_daily(df, "year")


def average_monthly_counts(df: DataFrame) -> DataFrame:
    return _avg_daily(df, "year", "month")


def average_weekday_counts(df: DataFrame) -> DataFrame:
    return _avg_daily(df, "weekday")


def average_weekday_counts_filled(df: DataFrame) -> DataFrame:
    """Panel form: seven rows, 0.0 for weekdays without any day in range."""
    avg = _avg_daily(df, "weekday")
    base = _range_table(df, "weekday", 0, 7)
    return (F.broadcast(base).join(avg, "weekday", "left")
            .select("weekday", F.coalesce("avg_posts", F.lit(0.0)).alias("avg_posts"),
                    C.weekday_label(F.col("weekday")).alias("weekday_label"))
            .orderBy("weekday"))


def weekly_counts(df: DataFrame) -> DataFrame:
    return _count(df.withColumn("iso_week", C.iso_week_label(F.col("date"))), "iso_week")


def monthday_counts(df: DataFrame) -> DataFrame:
    counts = (df.where(F.col("date").isNotNull())
              .groupBy(F.dayofmonth("date").alias("monthday")).agg(_posts(df).alias("posts")))
    base = _range_table(df, "monthday", 1, 32)
    return (F.broadcast(base).join(counts, "monthday", "left")
            .select("monthday", F.coalesce("posts", F.lit(0)).alias("posts")).orderBy("monthday"))


def weekday_hour_counts(df: DataFrame, with_label: bool = False) -> DataFrame:
    out = _count(df, "weekday", "hour")
    if with_label:
        out = out.withColumn("weekday_label", C.weekday_label(F.col("weekday")))
    return out


def _dense_pivot(counts: DataFrame, row_key: str, col_key: str, values, prefix: str, width: int,
                 base: DataFrame, value_col: str = "posts") -> DataFrame:
    """Long (row_key, col_key, value) -> dense wide table with one column per value,
    rows for every key of ``base``, zeros where nothing was counted."""
    wide = counts.groupBy(row_key).pivot(col_key, list(values)).agg(F.sum(value_col))
    names = {str(v): f"{prefix}{str(v).zfill(width)}" for v in values}
    cols = [F.coalesce(F.col(f"`{src}`"), F.lit(0)).cast("bigint").alias(dst) for src, dst in names.items()]
    return F.broadcast(base).join(wide, row_key, "left").select(row_key, *cols)


def weekday_hour_matrix(df: DataFrame) -> DataFrame:
    """Dense 7 x 24 matrix: weekday rows, columns h00..h23."""
    counts = (df.where(F.col("weekday").isNotNull() & F.col("hour").isNotNull())
              .groupBy("weekday", "hour").agg(_posts(df).alias("posts")))
    out = _dense_pivot(counts, "weekday", "hour", range(24), "h", 2, _range_table(df, "weekday", 0, 7))
    return out.withColumn("weekday_label", C.weekday_label(F.col("weekday"))).orderBy("weekday")


def weekday_monthday_matrix(df: DataFrame) -> DataFrame:
    """Dense 7 x 31 matrix from the date: weekday rows, columns d01..d31."""
    counts = (df.where(F.col("date").isNotNull())
              .groupBy(F.weekday("date").alias("weekday"), F.dayofmonth("date").alias("monthday"))
              .agg(_posts(df).alias("posts")))
    out = _dense_pivot(counts, "weekday", "monthday", range(1, 32), "d", 2, _range_table(df, "weekday", 0, 7))
    return out.withColumn("weekday_label", C.weekday_label(F.col("weekday"))).orderBy("weekday")


def daily_calendar_matrix(df: DataFrame) -> DataFrame:
    """ISO week x weekday grid of zero-filled daily counts; one row per ISO week
    (ordered by its Monday), columns wd0 (Mon) .. wd6 (Sun)."""
    daily = daily_counts_full(df).select(
        "posts", F.weekday("date").alias("weekday"), C.iso_week_label(F.col("date")).alias("iso_week"),
        F.date_sub(F.col("date"), F.weekday("date")).alias("week_start"))
    wide = daily.groupBy("iso_week", "week_start").pivot("weekday", list(range(7))).agg(F.sum("posts"))
    cols = [F.coalesce(F.col(f"`{i}`"), F.lit(0)).cast("bigint").alias(f"wd{i}") for i in range(7)]
    return wide.select("iso_week", "week_start", *cols).orderBy("week_start")


def basic_counts(df: DataFrame) -> DataFrame:
    """total posts and posts per day over whole 24 h periods between first and last post."""
    agg = df.agg(_posts(df).alias("total"), F.min("created_at").alias("lo"),
                 F.max(_last(df)).alias("hi"))
    days = _span_days(F.col("lo"), F.col("hi"))
    return agg.select("total", C.round_half_up(F.col("total") / days, 2).alias("avg_per_day"))


def _span_days(lo, hi):
    """floor((hi - lo) / 24 h) + 1, at least 1; 1 when either end is missing."""
    micros = F.timestamp_diff("MICROSECOND", lo, hi)
    days = F.floor(micros / F.lit(86400000000.0)) + F.lit(1)
    return F.when(lo.isNull() | hi.isNull(), F.lit(1)).otherwise(F.greatest(days, F.lit(1))).cast("double")


def average_counts(df: DataFrame) -> DataFrame:
    """Average posts per day, week, month (calendar months spanned) and year."""
    def ym(at: Column) -> Column:
        return F.year(at) * 12 + F.month(at)

    agg = df.agg(_posts(df).alias("total"), F.min("created_at").alias("lo"),
                 F.max(_last(df)).alias("hi"), F.min(ym(F.col("created_at"))).alias("ym_lo"), F.max(ym(_last(df))).alias("ym_hi"))
    days = _span_days(F.col("lo"), F.col("hi"))
    weeks = F.greatest(days / F.lit(7.0), F.lit(1.0))
    months = F.when(F.col("ym_lo").isNull(), F.greatest(days / F.lit(30.4), F.lit(1.0))).otherwise(
        F.greatest((F.col("ym_hi") - F.col("ym_lo") + 1).cast("double"), F.lit(1.0)))
    years = F.greatest(days / F.lit(365.0), F.lit(1.0))
    total = F.col("total").cast("double")
    return agg.select(C.round_half_up(total / days, 2).alias("per_day"),
                      C.round_half_up(total / weeks, 2).alias("per_week"),
                      C.round_half_up(total / months, 2).alias("per_month"),
                      C.round_half_up(total / years, 2).alias("per_year"))

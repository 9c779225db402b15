"""Query catalogue: one entry per operator of the inventory.

``QUERIES[id] = fn(spark, sf_dir) -> DataFrame`` runs the operator over post
tables derived from the given parquet tables; ``ORACLE[id]`` is the matching
DuckDB SQL (absent for operators checked by properties only).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import calendar as CAL
from ..operators import derive as DV
from ..operators import gaps as GP
from ..operators import histograms as H
from ..operators import ratios as R
from ..sources import tables as T
from .oracle import r2, r4, with_posts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def stream(spark: SparkSession, sf: str) -> DataFrame:
    return DV.derive(T.stream_posts(spark, sf))


def archive(spark: SparkSession, sf: str) -> DataFrame:
    return DV.derive(T.archive_posts(spark, sf))


def S(body: str) -> str:
    return with_posts(body, stream=True)


def A(body: str) -> str:
    return with_posts(body, stream=False, archive=True)


# ---------------------------------------------------------------------------
# 2.2 derived columns
# ---------------------------------------------------------------------------

_J = " "  # list elements never contain white space, so a space joins them unambiguously


def _joined(c: str):
    return F.array_join(F.col(c), _J).alias(c + "_joined")


@query("derive_posts", S("""
SELECT tweet_id, created_at, date, year, month, weekday, hour, text_length,
       array_to_string(urls, ' ') AS urls_joined, url_count,
       array_to_string(hashtag_list, ' ') AS hashtag_list_joined, hashtag_count,
       array_to_string(mention_list, ' ') AS mention_list_joined, mention_count,
       array_to_string(domains, ' ') AS domains_joined,
       is_reply, contains_code, language_hint
FROM sp"""))
def q_derive_posts(spark, sf):
    d = stream(spark, sf)
    return d.select("tweet_id", "created_at", "date", "year", "month", "weekday", "hour", "text_length",
                    _joined("urls"), "url_count", _joined("hashtag_list"), "hashtag_count",
                    _joined("mention_list"), "mention_count", _joined("domains"),
                    "is_reply", "contains_code", "language_hint")


def _derive_part(name: str, spark_cols, sql_cols: str):
    @query(name, S(f"SELECT tweet_id, {sql_cols} FROM sp"))
    def fn(spark, sf):
        return stream(spark, sf).select("tweet_id", *spark_cols())
    return fn


_derive_part("derive_text", lambda: [F.col("text")], "text")
_derive_part("derive_calendar", lambda: ["date", "year", "month", "weekday", "hour"],
             "date, year, month, weekday, hour")
_derive_part("derive_text_length", lambda: ["text_length"], "text_length")
_derive_part("derive_urls", lambda: [_joined("urls"), "url_count"],
             "array_to_string(urls, ' ') AS urls_joined, url_count")
_derive_part("derive_hashtags", lambda: [_joined("hashtag_list"), "hashtag_count"],
             "array_to_string(hashtag_list, ' ') AS hashtag_list_joined, hashtag_count")
_derive_part("derive_mentions", lambda: [_joined("mention_list"), "mention_count"],
             "array_to_string(mention_list, ' ') AS mention_list_joined, mention_count")
_derive_part("derive_is_reply", lambda: ["is_reply"], "is_reply")
_derive_part("derive_contains_code", lambda: ["contains_code"], "contains_code")
_derive_part("derive_domains", lambda: [_joined("domains"), F.size("domains").alias("domain_count")],
             "array_to_string(domains, ' ') AS domains_joined, CAST(len(domains) AS INTEGER) AS domain_count")
_derive_part("derive_empty_lists",
             lambda: [F.size("urls").alias("n_urls"), F.size("hashtag_list").alias("n_tags"),
                      F.size("mention_list").alias("n_mentions"), F.size("domains").alias("n_domains")],
             "CAST(len(urls) AS INTEGER) AS n_urls, CAST(len(hashtag_list) AS INTEGER) AS n_tags, "
             "CAST(len(mention_list) AS INTEGER) AS n_mentions, CAST(len(domains) AS INTEGER) AS n_domains")
_derive_part("derive_language_hint", lambda: ["language_hint"], "language_hint")

# ---------------------------------------------------------------------------
# 2.3 filters
# ---------------------------------------------------------------------------

FILTER_YEARS = [1996, 1998]


@query("filter_years", A("SELECT tweet_id, year FROM ap WHERE year IN (1996, 1998)"))
def q_filter_years(spark, sf):
    return DV.filter_years(archive(spark, sf), FILTER_YEARS).select("tweet_id", "year")


@query("exclude_retweets", S("SELECT tweet_id, text_length FROM sp WHERE NOT starts_with(text, 'RT')"))
def q_exclude_retweets(spark, sf):
    return DV.exclude_retweets(stream(spark, sf)).select("tweet_id", "text_length")


@query("available_years", A("SELECT DISTINCT year FROM ap WHERE year IS NOT NULL"))
def q_available_years(spark, sf):
    return DV.available_years(archive(spark, sf))


# ---------------------------------------------------------------------------
# 2.4 / 2.5 calendar counts, fills, matrices
# ---------------------------------------------------------------------------

_CAL_DAYS_SQL = """
bounds AS (SELECT min(date) AS lo, max(date) AS hi FROM ap),
cal AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds
        WHERE lo IS NOT NULL),
cnt AS (SELECT date, count(*) AS posts FROM ap WHERE date IS NOT NULL GROUP BY date),
daily AS (SELECT cal.date, coalesce(cnt.posts, 0) AS posts FROM cal LEFT JOIN cnt USING (date)),
dz AS (SELECT date, posts, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
              CAST(isodow(date) - 1 AS INTEGER) AS weekday FROM daily)"""


def _A_cal(body: str) -> str:
    return with_posts(body, stream=False, archive=True, ctes=_CAL_DAYS_SQL)


@query("yearly_counts", A("SELECT year, count(*) AS posts FROM ap GROUP BY year"))
def q_yearly(spark, sf):
    return CAL.yearly_counts(archive(spark, sf))


@query("monthly_counts", A("SELECT year, month, count(*) AS posts FROM ap GROUP BY year, month"))
def q_monthly(spark, sf):
    return CAL.monthly_counts(archive(spark, sf))


@query("weekday_counts", A("SELECT weekday, count(*) AS posts FROM ap GROUP BY weekday"))
def q_weekday(spark, sf):
    return CAL.weekday_counts(archive(spark, sf))


_WD_LABEL_SQL = "(['月','火','水','木','金','土','日'])[{c} + 1]"

_WEEKDAY_FILL_SQL = S(f"""
SELECT w.weekday, coalesce(c.posts, 0) AS posts, {_WD_LABEL_SQL.format(c='w.weekday')} AS weekday_label
FROM (SELECT CAST(range AS INTEGER) AS weekday FROM range(7)) w
LEFT JOIN (SELECT weekday, count(*) AS posts FROM sp WHERE weekday IS NOT NULL GROUP BY weekday) c USING (weekday)""")


@query("join_weekday_fill", _WEEKDAY_FILL_SQL)
def q_join_weekday_fill(spark, sf):
    return CAL.weekday_counts_filled(stream(spark, sf))


@query("hourly_counts", S("SELECT hour, count(*) AS posts FROM sp GROUP BY hour"))
def q_hourly(spark, sf):
    return CAL.hourly_counts(stream(spark, sf))


@query("daily_counts", S("SELECT date, count(*) AS posts FROM sp GROUP BY date"))
def q_daily(spark, sf):
    return CAL.daily_counts(stream(spark, sf))


@query("daily_counts_full", _A_cal("SELECT date, posts FROM daily"))
def q_daily_full(spark, sf):
    return CAL.daily_counts_full(archive(spark, sf))


@query("join_calendar_fill", _A_cal("SELECT date, posts FROM daily"))
def q_join_calendar_fill(spark, sf):
    return CAL.daily_counts_full(archive(spark, sf))


@query("daily_counts_zero_filled", _A_cal("SELECT date, posts, year, month, weekday FROM dz"))
def q_daily_zero(spark, sf):
    return CAL.daily_counts_zero_filled(archive(spark, sf))


@query("average_yearly_counts", _A_cal(f"SELECT year, {r2('avg(posts)')} AS avg_posts FROM dz GROUP BY year"))
def q_avg_yearly(spark, sf):
    return CAL.average_yearly_counts(archive(spark, sf))


@query("average_monthly_counts",
       _A_cal(f"SELECT year, month, {r2('avg(posts)')} AS avg_posts FROM dz GROUP BY year, month"))
def q_avg_monthly(spark, sf):
    return CAL.average_monthly_counts(archive(spark, sf))


@query("average_weekday_counts",
       _A_cal(f"SELECT weekday, {r2('avg(posts)')} AS avg_posts FROM dz GROUP BY weekday"))
def q_avg_weekday(spark, sf):
    return CAL.average_weekday_counts(archive(spark, sf))


@query("weekly_counts", A("SELECT strftime(date, '%G-W%V') AS iso_week, count(*) AS posts FROM ap GROUP BY 1"))
def q_weekly(spark, sf):
    return CAL.weekly_counts(archive(spark, sf))


_MONTHDAY_SQL = A("""
SELECT m.monthday, coalesce(c.posts, 0) AS posts
FROM (SELECT CAST(range AS INTEGER) AS monthday FROM range(1, 32)) m
LEFT JOIN (SELECT CAST(day(date) AS INTEGER) AS monthday, count(*) AS posts FROM ap
           WHERE date IS NOT NULL GROUP BY 1) c USING (monthday)""")


@query("monthday_counts", _MONTHDAY_SQL)
def q_monthday(spark, sf):
    return CAL.monthday_counts(archive(spark, sf))


@query("join_monthday_fill", _MONTHDAY_SQL)
def q_join_monthday_fill(spark, sf):
    return CAL.monthday_counts(archive(spark, sf))


@query("weekday_hour_counts", S(f"""
SELECT weekday, hour, count(*) AS posts, {_WD_LABEL_SQL.format(c='weekday')} AS weekday_label
FROM sp GROUP BY weekday, hour"""))
def q_weekday_hour(spark, sf):
    return CAL.weekday_hour_counts(stream(spark, sf), with_label=True)


def _matrix_sql(source: str, key_expr: str, n: int, start: int, prefix: str, where: str) -> str:
    cols = ", ".join(f"CAST(count(*) FILTER (WHERE k = {v}) AS BIGINT) AS {prefix}{v:02d}"
                     for v in range(start, start + n))
    return f"""
SELECT w.weekday, {", ".join(f"coalesce(c.{prefix}{v:02d}, 0) AS {prefix}{v:02d}" for v in range(start, start + n))},
       {_WD_LABEL_SQL.format(c='w.weekday')} AS weekday_label
FROM (SELECT CAST(range AS INTEGER) AS weekday FROM range(7)) w
LEFT JOIN (SELECT wd AS weekday, {cols}
           FROM (SELECT {key_expr}) x WHERE {where} GROUP BY wd) c USING (weekday)"""


@query("weekday_hour_matrix", S(_matrix_sql("sp", "weekday AS wd, hour AS k FROM sp", 24, 0, "h",
                                            "wd IS NOT NULL AND k IS NOT NULL")))
def q_weekday_hour_matrix(spark, sf):
    return CAL.weekday_hour_matrix(stream(spark, sf))


_WD_MD_SQL = A(_matrix_sql("ap", "CAST(isodow(date) - 1 AS INTEGER) AS wd, CAST(day(date) AS INTEGER) AS k FROM ap",
                           31, 1, "d", "wd IS NOT NULL"))


@query("weekday_monthday_matrix", _WD_MD_SQL)
def q_weekday_monthday_matrix(spark, sf):
    return CAL.weekday_monthday_matrix(archive(spark, sf))


@query("pivot_sum", _WD_MD_SQL)
def q_pivot_sum(spark, sf):
    return CAL.weekday_monthday_matrix(archive(spark, sf))


_WD_COLS = ", ".join(f"coalesce(CAST(sum(posts) FILTER (WHERE isodow(date) - 1 = {i}) AS BIGINT), 0) AS wd{i}"
                     for i in range(7))


@query("daily_calendar_matrix", _A_cal(f"""
SELECT strftime(date, '%G-W%V') AS iso_week, CAST(date - CAST(isodow(date) - 1 AS INTEGER) AS DATE) AS week_start,
       {_WD_COLS}
FROM daily GROUP BY 1, 2"""))
def q_daily_calendar(spark, sf):
    return CAL.daily_calendar_matrix(archive(spark, sf))


_SPAN_DAYS = ("CASE WHEN min(created_at) IS NULL THEN 1.0 ELSE CAST(greatest(floor("
              "date_diff('microsecond', min(created_at), max(created_at)) / 86400000000.0) + 1, 1) AS DOUBLE) END")


@query("calendar_rollups", S("""
SELECT GROUPING(year, month, weekday, hour, date) AS level, year, month, weekday, hour, date, count(*) AS posts FROM sp
GROUP BY GROUPING SETS ((year), (year, month), (weekday), (hour), (date), (weekday, hour))"""))
def q_calendar_rollups(spark, sf):
    return CAL.calendar_rollups(stream(spark, sf))


@query("basic_counts", A(f"""
SELECT count(*) AS total, {r2(f'count(*) / ({_SPAN_DAYS})')} AS avg_per_day FROM ap"""))
def q_basic_counts(spark, sf):
    return CAL.basic_counts(archive(spark, sf))


@query("average_counts", A(f"""
SELECT {r2('total / days')} AS per_day, {r2('total / greatest(days / 7.0, 1.0)')} AS per_week,
       {r2('total / months')} AS per_month, {r2('total / greatest(days / 365.0, 1.0)')} AS per_year
FROM (SELECT CAST(count(*) AS DOUBLE) AS total, {_SPAN_DAYS} AS days,
             CASE WHEN min(year * 12 + month) IS NULL THEN greatest(({_SPAN_DAYS}) / 30.4, 1.0)
                  ELSE greatest(CAST(max(year * 12 + month) - min(year * 12 + month) + 1 AS DOUBLE), 1.0) END AS months
      FROM ap) t"""))
def q_average_counts(spark, sf):
    return CAL.average_counts(archive(spark, sf))


# ---------------------------------------------------------------------------
# 2.5 ratios
# ---------------------------------------------------------------------------

def _rate(part: str) -> str:
    return f"CASE WHEN count(*) > 0 THEN {r4(f'{part} / count(*)')} ELSE 0.0 END"


@query("reply_ratio", S(f"""
SELECT count(*) FILTER (WHERE is_reply) AS reply, count(*) FILTER (WHERE NOT is_reply OR is_reply IS NULL) AS non_reply,
       {_rate('count(*) FILTER (WHERE is_reply)')} AS rate FROM sp"""))
def q_reply_ratio(spark, sf):
    return R.reply_ratio(stream(spark, sf))


@query("night_post_ratio", S(f"""
SELECT count(*) FILTER (WHERE hour BETWEEN 0 AND 5) AS night,
       count(*) - count(*) FILTER (WHERE hour BETWEEN 0 AND 5) AS daytime,
       {_rate('count(*) FILTER (WHERE hour BETWEEN 0 AND 5)')} AS rate FROM sp"""))
def q_night_ratio(spark, sf):
    return R.night_post_ratio(stream(spark, sf))


@query("url_presence_stats", S(f"""
SELECT count(*) FILTER (WHERE url_count > 0) AS with_url, count(*) - count(*) FILTER (WHERE url_count > 0) AS without_url,
       {_rate('count(*) FILTER (WHERE url_count > 0)')} AS rate FROM sp"""))
def q_url_presence(spark, sf):
    return R.url_presence_stats(stream(spark, sf))


_SELF_DOM = "list_bool_or(list_transform(domains, lambda x: ends_with(lower(x), 'twitter.com') OR ends_with(lower(x), 'x.com')))"


@query("self_reference_stats", S(f"""
SELECT count(*) FILTER (WHERE coalesce({_SELF_DOM}, false)) AS self_ref,
       count(*) - count(*) FILTER (WHERE coalesce({_SELF_DOM}, false)) AS external,
       {_rate(f'count(*) FILTER (WHERE coalesce({_SELF_DOM}, false))')} AS rate FROM sp"""))
def q_self_reference(spark, sf):
    return R.self_reference_stats(stream(spark, sf))


_STRIP = "split_part(split_part({x}, '?', 1), '#', 1)"


@query("self_post_url_stats", S(f"""
SELECT count(*) FILTER (WHERE has_url AND own) AS self_post, count(*) FILTER (WHERE has_url AND NOT own) AS other_url,
       count(*) FILTER (WHERE NOT has_url) AS no_url, {_rate('count(*) FILTER (WHERE has_url AND own)')} AS rate
FROM (SELECT len(urls) > 0 AS has_url,
             {_STRIP.format(x="coalesce(status_url, '')")} <> ''
             AND coalesce(list_bool_or(list_transform(urls, lambda u: {_STRIP.format(x='u')} = {_STRIP.format(x="coalesce(status_url, '')")})), false) AS own
      FROM sp) t"""))
def q_self_post(spark, sf):
    return R.self_post_url_stats(stream(spark, sf))


# ---------------------------------------------------------------------------
# 2.6 histograms
# ---------------------------------------------------------------------------

@query("text_length_distribution", S("""
SELECT bin_start, bin_start + 19 AS bin_end, count(*) AS posts,
       CAST(bin_start AS VARCHAR) || '-' || CAST(bin_start + 19 AS VARCHAR) AS bin_label
FROM (SELECT CAST(floor(text_length / 20) * 20 AS BIGINT) AS bin_start FROM sp WHERE text_length IS NOT NULL) t
GROUP BY bin_start"""))
def q_text_length_dist(spark, sf):
    return H.text_length_distribution(stream(spark, sf))


@query("url_count_distribution", S("SELECT CAST(url_count AS BIGINT) AS url_count, count(*) AS posts FROM sp GROUP BY 1"))
def q_url_count_dist(spark, sf):
    return H.url_count_distribution(stream(spark, sf))


@query("newline_count_distribution", S("""
SELECT CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS newlines, count(*) AS posts
FROM sp GROUP BY 1"""))
def q_newline_dist(spark, sf):
    return H.newline_count_distribution(stream(spark, sf))


@query("emoji_count_distribution", S("""
SELECT CAST(len(regexp_extract_all(text, '[\\x{2600}-\\x{27BF}\\x{1F300}-\\x{1FAFF}]', 0)) AS BIGINT) AS emojis,
       count(*) AS posts FROM sp GROUP BY 1"""))
def q_emoji_dist(spark, sf):
    return H.emoji_count_distribution(stream(spark, sf))


@query("hashtag_count_distribution",
       S("SELECT CAST(coalesce(hashtag_count, 0) AS BIGINT) AS hashtag_count, count(*) AS posts FROM sp GROUP BY 1"))
def q_hashtag_count_dist(spark, sf):
    return H.hashtag_count_distribution(stream(spark, sf))


@query("mention_count_distribution",
       S("SELECT CAST(coalesce(mention_count, 0) AS BIGINT) AS mention_count, count(*) AS posts FROM sp GROUP BY 1"))
def q_mention_count_dist(spark, sf):
    return H.mention_count_distribution(stream(spark, sf))


_PATH_DEPTH_SQL = S("""
SELECT CAST(len(parts) - 1 AS BIGINT) AS depth, count(*) AS occurrences
FROM (SELECT string_split(split_part(split_part(regexp_replace(u, '^https?://', ''), '#', 1), '?', 1), '/') AS parts
      FROM (SELECT unnest(urls) AS u FROM sp) x) y
WHERE NOT (ends_with(lower(parts[1]), 'twitter.com') OR ends_with(lower(parts[1]), 'x.com'))
GROUP BY 1""")


@query("path_depth_distribution", _PATH_DEPTH_SQL)
def q_path_depth(spark, sf):
    return H.path_depth_distribution(stream(spark, sf))


@query("filter_self_domains", _PATH_DEPTH_SQL)
def q_filter_self_domains(spark, sf):
    return H.path_depth_distribution(stream(spark, sf), exclude_self_ref=True)


@query("value_counts_topn", S("""
SELECT hour, count(*) AS count FROM sp GROUP BY hour ORDER BY count DESC, hour ASC NULLS FIRST LIMIT 10"""))
def q_value_counts(spark, sf):
    return H.value_counts_topn(stream(spark, sf), "hour", 10)


# ---------------------------------------------------------------------------
# 2.6 / 2.8 intervals and sessions (stitched global order)
# ---------------------------------------------------------------------------

_DIFFS = """
ms AS (SELECT (epoch_us(created_at) // 1000) AS ms FROM sp WHERE created_at IS NOT NULL),
diffs AS (SELECT ms - lag(ms) OVER (ORDER BY ms) AS d FROM ms),
dm AS (SELECT d, d / 60000.0 AS diff_min FROM diffs WHERE d IS NOT NULL)"""


def _S_diffs(body: str, extra: str = "") -> str:
    return with_posts(body, ctes=_DIFFS + extra)


@query("interval_lag_by_author", S("""
SELECT (ms - prev) / 60000.0 AS diff_min
FROM (SELECT ms, lag(ms) OVER (PARTITION BY author_id ORDER BY ms) AS prev
      FROM (SELECT author_id, epoch_us(created_at) // 1000 AS ms FROM sp WHERE created_at IS NOT NULL) t) l
WHERE prev IS NOT NULL"""))
def q_interval_lag_by_author(spark, sf):
    return GP.interval_lag(stream(spark, sf), by="author_id")


@query("interval_lag", _S_diffs("SELECT diff_min FROM dm"))
def q_interval_lag(spark, sf):
    return GP.interval_lag(stream(spark, sf))


@query("posting_interval_distribution", _S_diffs("""
SELECT bin_start, bin_start + 29.0 AS bin_end, count(*) AS posts,
       CAST(CAST(bin_start AS BIGINT) AS VARCHAR) || '.0-' || CAST(CAST(bin_start + 29.0 AS BIGINT) AS VARCHAR) || '.0' AS bin_label
FROM (SELECT CAST(floor(diff_min / 30.0) * 30 AS DOUBLE) AS bin_start FROM dm WHERE diff_min >= 0) t
GROUP BY bin_start"""))
def q_interval_dist(spark, sf):
    return GP.posting_interval_distribution(stream(spark, sf))


_P90_IDX = ("greatest(CASE WHEN (9 * n) % 10 < 5 THEN (9 * n) // 10 WHEN (9 * n) % 10 > 5 THEN (9 * n) // 10 + 1 "
            "WHEN ((9 * n) // 10) % 2 = 0 THEN (9 * n) // 10 ELSE (9 * n) // 10 + 1 END - 1, 0)")

_RANKED = """
st AS (SELECT count(*) AS n, min(d) AS lo, sum(d) AS s FROM dm),
ranked AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS rk FROM dm)"""


@query("posting_interval_summary", _S_diffs(f"""
SELECT n AS count, {r2('lo / 60000.0')} AS min,
       {r2("CASE WHEN n % 2 = 1 THEN (SELECT d FROM ranked WHERE rk = n // 2) / 60000.0 ELSE "
           "((SELECT d FROM ranked WHERE rk = n // 2 - 1) / 60000.0 + (SELECT d FROM ranked WHERE rk = n // 2) / 60000.0) / 2 END")} AS median,
       {r2('CAST(s AS DOUBLE) / n / 60000.0')} AS mean,
       {r2(f'(SELECT d FROM ranked WHERE rk = {_P90_IDX}) / 60000.0')} AS p90
FROM st""", "," + _RANKED))
def q_interval_summary(spark, sf):
    return GP.posting_interval_summary(stream(spark, sf))


@query("rank_select_p90", _S_diffs(f"""
SELECT n, CAST({_P90_IDX} AS BIGINT) AS p90_rank,
       (SELECT d FROM ranked WHERE rk = {_P90_IDX}) / 60000.0 AS p90_minutes FROM st""", "," + _RANKED))
def q_rank_select_p90(spark, sf):
    return GP.rank_select_p90(stream(spark, sf))


@query("median_exact", _S_diffs("""
SELECT n, CASE WHEN n % 2 = 1 THEN (SELECT d FROM ranked WHERE rk = n // 2) / 60000.0 ELSE
       ((SELECT d FROM ranked WHERE rk = n // 2 - 1) / 60000.0 + (SELECT d FROM ranked WHERE rk = n // 2) / 60000.0) / 2 END
       AS median_minutes FROM st""", "," + _RANKED))
def q_median_exact(spark, sf):
    return GP.median_exact(stream(spark, sf))


_SESSIONS = """
ms AS (SELECT (epoch_us(created_at) // 1000) AS ms FROM sp WHERE created_at IS NOT NULL),
fl AS (SELECT ms, CASE WHEN lag(ms) OVER (ORDER BY ms) IS NULL OR ms - lag(ms) OVER (ORDER BY ms) > 1800000
                  THEN 1 ELSE 0 END AS f FROM ms),
sid AS (SELECT ms, sum(f) OVER (ORDER BY ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_id FROM fl)"""


def _S_sessions(body: str) -> str:
    return with_posts(body, ctes=_SESSIONS)


@query("session_length_distribution", _S_sessions("""
SELECT session_size, count(*) AS sessions
FROM (SELECT session_id, count(*) AS session_size FROM sid GROUP BY session_id) t GROUP BY session_size"""))
def q_session_dist(spark, sf):
    return GP.session_length_distribution(stream(spark, sf))


@query("session_ids", _S_sessions("""
SELECT CAST(session_id AS BIGINT) AS session_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS posts
FROM sid GROUP BY session_id"""))
def q_session_ids(spark, sf):
    return GP.sessions(stream(spark, sf))


# ---------------------------------------------------------------------------
# 2.7 links, tags, mentions, keyword categories, co-occurrence
# ---------------------------------------------------------------------------

from ..operators import links as L  # noqa: E402
from ..operators import tags as TG  # noqa: E402

_DOMAINS = "(SELECT {keep} unnest(domains) AS domain FROM {src})"


@query("domain_ranking", S(f"""
SELECT domain, count(*) AS occurrences FROM {_DOMAINS.format(keep='', src='sp')} x GROUP BY domain"""))
def q_domain_ranking(spark, sf):
    return L.domain_ranking(stream(spark, sf), None)


@query("explode_list", S(f"""
SELECT domain, count(*) AS occurrences FROM {_DOMAINS.format(keep='', src='sp')} x GROUP BY domain"""))
def q_explode_list(spark, sf):
    return L.domain_ranking(stream(spark, sf), None)


@query("tld_distribution", S(f"""
SELECT tld, count(*) AS occurrences
FROM (SELECT nullif(regexp_extract(lower(domain), '\\.([A-Za-z0-9-]+)$', 1), '') AS tld
      FROM {_DOMAINS.format(keep='', src='sp')} x) y
WHERE tld IS NOT NULL GROUP BY tld"""))
def q_tld(spark, sf):
    return L.tld_distribution(stream(spark, sf), None)


def _trend_sql(src: str, key: str, exploded: str, top_n: int) -> str:
    return f"""
SELECT year, {key}, count(*) AS occurrences FROM {exploded} e
WHERE {key} IN (SELECT {key} FROM {exploded} t GROUP BY {key} ORDER BY count(*) DESC, {key} LIMIT {top_n})
GROUP BY year, {key}"""


_TREND_DOMAINS = _DOMAINS.format(keep="year,", src="ap")


@query("domain_year_trend", A(_trend_sql("ap", "domain", _TREND_DOMAINS, 10)))
def q_domain_year_trend(spark, sf):
    return L.domain_year_trend(archive(spark, sf), 10)


@query("join_top_domains", A(_trend_sql("ap", "domain", _TREND_DOMAINS, 5)))
def q_join_top_domains(spark, sf):
    return L.domain_year_trend(archive(spark, sf), 5)


_DOMAIN_MONTH_SQL = A(f"""
SELECT year, month, count(*) AS occurrences, CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS year_month
FROM {_DOMAINS.format(keep='year, month,', src='ap')} e
WHERE domain = (SELECT domain FROM {_DOMAINS.format(keep='', src='ap')} t GROUP BY domain
                ORDER BY count(*) DESC, domain LIMIT 1)
GROUP BY year, month""")


@query("domain_month_trend", _DOMAIN_MONTH_SQL)
def q_domain_month(spark, sf):
    return L.domain_month_trend(archive(spark, sf))


@query("filter_domain", _DOMAIN_MONTH_SQL)
def q_filter_domain(spark, sf):
    return L.domain_month_trend(archive(spark, sf))


def _tags(src: str, col: str, name: str, keep: str = "") -> str:
    return (f"(SELECT {keep} {name} FROM (SELECT {keep} trim(unnest({col})) AS {name} FROM {src}) z "
            f"WHERE {name} <> '')")


@query("hashtag_ranking", S(f"""
SELECT hashtag, count(*) AS occurrences FROM {_tags('sp', 'hashtag_list', 'hashtag')} x GROUP BY hashtag"""))
def q_hashtag_ranking(spark, sf):
    return TG.hashtag_ranking(stream(spark, sf), None)


_TREND_TAGS = _tags("ap", "hashtag_list", "hashtag", "year,")


@query("hashtag_year_trend", A(_trend_sql("ap", "hashtag", _TREND_TAGS, 20)))
def q_hashtag_year_trend(spark, sf):
    return TG.hashtag_year_trend(archive(spark, sf), 20)


@query("join_top_hashtags", A(_trend_sql("ap", "hashtag", _TREND_TAGS, 10)))
def q_join_top_hashtags(spark, sf):
    return TG.hashtag_year_trend(archive(spark, sf), 10)


@query("mention_ranking", S(f"""
SELECT mention, count(*) AS occurrences FROM {_tags('sp', 'mention_list', 'mention')} x
GROUP BY mention ORDER BY occurrences DESC, mention LIMIT 200"""))
def q_mention_ranking(spark, sf):
    return TG.mention_ranking(stream(spark, sf), 200)


_MW = _tags("sp", "mention_list", "mention", "weekday,")


@query("mention_weekday_counts", S(f"SELECT weekday, mention, count(*) AS occurrences FROM {_MW} x GROUP BY 1, 2"))
def q_mention_weekday(spark, sf):
    return TG.mention_weekday_counts(stream(spark, sf))


@query("mention_weekday_totals", S(f"""
SELECT weekday, CAST(count(*) AS BIGINT) AS occurrences, {_WD_LABEL_SQL.format(c='weekday')} AS weekday_label
FROM {_MW} x GROUP BY weekday"""))
def q_mention_weekday_totals(spark, sf):
    return TG.mention_weekday_totals(stream(spark, sf))


_MW_TOP = S(f"""
SELECT weekday, mention, count(*) AS occurrences, {_WD_LABEL_SQL.format(c='weekday')} AS weekday_label FROM {_MW} x
WHERE mention IN (SELECT mention FROM {_tags('sp', 'mention_list', 'mention')} t GROUP BY mention
                  ORDER BY count(*) DESC, mention LIMIT 5)
GROUP BY weekday, mention""")


@query("mention_weekday_top", _MW_TOP)
def q_mention_weekday_top(spark, sf):
    return TG.mention_weekday_top(stream(spark, sf), 5)


@query("top_mentions_filter", _MW_TOP)
def q_top_mentions_filter(spark, sf):
    return TG.mention_weekday_top(stream(spark, sf), 5)


def _pairs_sql(items: str, a: str, b: str, min_count: int, top_n: int | None) -> str:
    limit = f" ORDER BY count DESC, {a}, {b} LIMIT {top_n}" if top_n else ""
    return f"""
items AS (SELECT DISTINCT id, item FROM {items} i),
kept AS (SELECT * FROM items WHERE item IN (SELECT item FROM items GROUP BY item HAVING count(*) >= {min_count})),
pairs AS (SELECT x.item AS {a}, y.item AS {b}, count(*) AS count FROM kept x JOIN kept y
          ON x.id = y.id AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= {min_count}{limit})"""


_TAG_ITEMS = "(SELECT tweet_id AS id, hashtag AS item FROM " + _tags("sp", "hashtag_list", "hashtag", "tweet_id,") + " q)"
_TAG_PAIRS_CTES = _pairs_sql(_TAG_ITEMS, "tag_a", "tag_b", 2, 200)

HASHTAG_PAIR_TOP = 200


@query("hashtag_cooccurrence", with_posts("SELECT * FROM pairs", ctes=_TAG_PAIRS_CTES))
def q_hashtag_cooc(spark, sf):
    return TG.hashtag_cooccurrence(stream(spark, sf), HASHTAG_PAIR_TOP, 2)


@query("cooccurrence_nodes", with_posts("SELECT DISTINCT node FROM (SELECT tag_a AS node FROM pairs UNION ALL "
                                        "SELECT tag_b FROM pairs) n", ctes=_TAG_PAIRS_CTES))
def q_cooc_nodes(spark, sf):
    return TG.cooccurrence_nodes(TG.hashtag_cooccurrence(stream(spark, sf), HASHTAG_PAIR_TOP, 2))


@query("cooccurrence_degree", with_posts("SELECT node, count(*) AS degree FROM (SELECT tag_a AS node FROM pairs "
                                         "UNION ALL SELECT tag_b FROM pairs) n GROUP BY node", ctes=_TAG_PAIRS_CTES))
def q_cooc_degree(spark, sf):
    return TG.cooccurrence_degree(TG.hashtag_cooccurrence(stream(spark, sf), HASHTAG_PAIR_TOP, 2))


@query("pair_generate", S(f"""
SELECT x.id AS tweet_id, x.item AS tag_a, y.item AS tag_b
FROM (SELECT DISTINCT id, item FROM {_TAG_ITEMS} i) x
JOIN (SELECT DISTINCT id, item FROM {_TAG_ITEMS} i) y ON x.id = y.id AND x.item < y.item"""))
def q_pair_generate(spark, sf):
    return TG.hashtag_pairs_raw(stream(spark, sf))


# Keyword setting of the registered queries: terms that occur in the test tables, with
# both colons and both separators, a label given twice and lines that say nothing.
KEYWORD_DICT = """Events：signup、click
Links: https://,example.com
Secrets: token , password,,secret
Mail: @mail
no colon here
Code: def,import
: term without label
Nothing: ,、
Syllables：tion、ment,heit
Links: http,www
Mixed: a：b、ing
"""
# What it means, written out by hand.
KEYWORD_ENTRIES = [
    ("Events", ["signup", "click"]), ("Links", ["http", "www"]), ("Secrets", ["token", "password", "secret"]),
    ("Mail", ["@mail"]), ("Code", ["def", "import"]), ("Syllables", ["tion", "ment", "heit"]), ("Mixed", ["a：b", "ing"]),
]


def _keyword_sql(entries) -> str:
    parts = []
    for i, (label, terms) in enumerate(entries):
        cond = " OR ".join(f"contains(lower(text), '{t.lower()}')" for t in terms)
        parts.append(f"SELECT '{label}' AS category, (SELECT count(*) FROM sp WHERE {cond}) AS posts")
    return S("\nUNION ALL\n".join(parts))


@query("keyword_category_counts", _keyword_sql(KEYWORD_ENTRIES))
def q_keyword_counts(spark, sf):
    return TG.keyword_category_counts(stream(spark, sf), KEYWORD_DICT)


@query("join_keyword_contains", _keyword_sql(KEYWORD_ENTRIES))
def q_join_keyword(spark, sf):
    return TG.keyword_category_counts(stream(spark, sf), KEYWORD_DICT)


@query("keyword_dict_parse", _keyword_sql(KEYWORD_ENTRIES))
def q_keyword_parse(spark, sf):
    return TG.keyword_category_counts(stream(spark, sf), KEYWORD_DICT)


# ---------------------------------------------------------------------------
# 2.9 tokens, frequency, TF-IDF, trends, co-occurrence
# ---------------------------------------------------------------------------

from ..functions import patterns as PT  # noqa: E402
from ..operators import terms as TM  # noqa: E402
from ..operators import tokens as TK  # noqa: E402

# Parameters of the registered text queries.
TERM = "the"
# Stop-word setting of the registered queries and what it means, written out by hand.
STOPWORDS = "the,and,of\n la , le,,de\r\nder,die,und\nel,los\nthe\n"
STOPWORD_LIST = ["the", "and", "of", "la", "le", "de", "der", "die", "und", "el", "los"]
# A long list by rule: all two-letter words over these letters (196).
_LETTERS = "aeioudlnrstmhc"
LONG_STOPWORDS = [x + y for x in _LETTERS for y in _LETTERS]
POS_FILTER = "noun / 動詞"


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _tok_sql(src: str, keep: str, mode: str = "C", stop=None) -> str:
    """Kept tokens with their 0-based position among kept tokens."""
    re_ = PT.TOKEN_PATTERNS_RE2[mode]
    cond = "length(t) > 1" + (f" AND NOT list_contains({_sql_list(stop)}, t)" if stop else "")
    return f"""(SELECT {keep} unnest(arr) AS token, CAST(unnest(range(len(arr))) AS INTEGER) AS position
   FROM (SELECT {keep} list_filter(regexp_extract_all(text, '{re_}', 0), lambda t: {cond}) AS arr FROM {src}) a)"""


def _S_with(ctes: str, body: str) -> str:
    return with_posts(body, ctes=ctes)


def _A_with(ctes: str, body: str) -> str:
    return with_posts(body, stream=False, archive=True, ctes=ctes)


def s_tokens(spark, sf, opts: TK.TextOptions | None = None, keep=("tweet_id",)):
    return TK.tokenize(stream(spark, sf), opts, keep)


def s_arrays(spark, sf, opts: TK.TextOptions | None = None, keep=("tweet_id",)):
    return TK.token_arrays(stream(spark, sf), opts, keep)


@query("tokenize_posts", _S_with(f"toks AS {_tok_sql('sp', 'tweet_id,')}", "SELECT tweet_id, position, token FROM toks"))
def q_tokenize(spark, sf):
    return s_tokens(spark, sf)


def _freq_sql(tok_cte: str, top_n: int | None, extra_cols: str = "") -> str:
    limit = f" ORDER BY count DESC, word LIMIT {top_n}" if top_n else ""
    return _S_with(f"toks AS {tok_cte}", f"SELECT {extra_cols}token AS word, count(*) AS count FROM toks "
                                         f"GROUP BY token{limit}")


@query("word_frequency", _freq_sql(_tok_sql("sp", "tweet_id,"), None))
def q_word_frequency(spark, sf):
    return TM.word_frequency(s_arrays(spark, sf), None)


@query("stopwords", _freq_sql(_tok_sql("sp", "tweet_id,", stop=STOPWORD_LIST), 100))
def q_stopwords(spark, sf):
    return TM.word_frequency(s_arrays(spark, sf, TK.TextOptions(stopwords=STOPWORDS)), 100)


@query("stopwords_long", _S_with(
    f"toks AS {_tok_sql('sp', 'tweet_id,', stop=LONG_STOPWORDS)}", "SELECT tweet_id, position, token FROM toks"))
def q_stopwords_long(spark, sf):
    return s_tokens(spark, sf, TK.TextOptions(stopwords=LONG_STOPWORDS))


_LEXICON_SQL = (f"(SELECT DISTINCT unnest(regexp_extract_all(text, '{PT.TOKEN_PATTERNS_RE2['C']}', 0)) AS word "
                f"FROM benchmark)")


@query("pos_filter", _S_with(f"toks AS {_tok_sql('sp', 'tweet_id,')}",
                             f"SELECT token AS word, count(*) AS count FROM toks WHERE token IN {_LEXICON_SQL} "
                             f"AND (length(token) % 2 = 0 OR length(token) % 3 = 0) "
                             f"GROUP BY token"))
def q_pos_filter(spark, sf):
    lex = TK.benchmark_lexicon(spark, T.table(spark, sf, "benchmark"))
    return TM.word_frequency(s_arrays(spark, sf, TK.TextOptions(pos_filter=POS_FILTER, lexicon=lex)), None)


@query("token_modes", _S_with(
    ", ".join(f"t{m} AS {_tok_sql('sp', 'tweet_id,', m)}" for m in "ABC"),
    "\nUNION ALL\n".join(f"SELECT '{m}' AS mode, token AS word, count(*) AS count FROM t{m} GROUP BY token"
                         for m in "ABC")))
def q_token_modes(spark, sf):
    return TM.mode_frequencies(stream(spark, sf), top_n=None)


@query("token_mode_compare", _S_with(
    ", ".join(f"t{m} AS {_tok_sql('sp', 'tweet_id,', m)}" for m in "ABC"),
    "\nUNION ALL\n".join(f"(SELECT '{m}' AS mode, token AS word, count(*) AS count FROM t{m} GROUP BY token "
                         f"ORDER BY count DESC, word LIMIT 50)" for m in "ABC")))
def q_token_mode_compare(spark, sf):
    return TM.token_mode_compare(stream(spark, sf), top_n=50)


@query("word_cloud_weights", _S_with(f"toks AS {_tok_sql('sp', 'tweet_id,')}", """
SELECT word, count, count / max(count) OVER () AS weight
FROM (SELECT token AS word, count(*) AS count FROM toks GROUP BY token ORDER BY count DESC, word LIMIT 150) t"""))
def q_word_cloud(spark, sf):
    return TM.word_cloud_weights(s_arrays(spark, sf), 150)


def _idf(tf: str, df: str, n: str) -> str:
    return f"floor((CAST({tf} AS DOUBLE) * (ln((1 + {n}) / (1 + {df})) + 1)) * 1e4 + 0.5) / 1e4"


_TFIDF_CORPUS = f"""
pt AS (SELECT tweet_id, token, count(*) AS c FROM toks GROUP BY 1, 2),
agg AS (SELECT token AS word, CAST(sum(c) AS BIGINT) AS tf, count(*) AS df FROM pt GROUP BY 1),
nn AS (SELECT greatest(count(*), 1) AS n FROM sp),
corpus AS (SELECT word, tf, df, {_idf('tf', 'df', 'nn.n')} AS score FROM agg, nn)"""


@query("tfidf_corpus", _S_with(f"toks AS {_tok_sql('sp', 'tweet_id,')}," + _TFIDF_CORPUS,
                               "SELECT * FROM corpus ORDER BY score DESC, word LIMIT 50"))
def q_tfidf_corpus(spark, sf):
    d = stream(spark, sf)
    return TM.tfidf_corpus(d, TK.token_arrays(d), 50)


def _period_sql(period_expr: str) -> str:
    return f"""
pt AS (SELECT tweet_id, {period_expr} AS period, token, count(*) AS c FROM toks
       WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY 1, 2, 3),
tf AS (SELECT period, token AS word, CAST(sum(c) AS BIGINT) AS tf FROM pt GROUP BY 1, 2),
dfc AS (SELECT token AS word, count(*) AS df FROM pt GROUP BY 1),
np AS (SELECT count(DISTINCT period) AS n FROM tf),
scored AS (SELECT period, word, tf, df, {_idf('tf', 'df', 'np.n')} AS score FROM tf JOIN dfc USING (word), np),
ranked AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, word) AS rn FROM scored)"""


_YM = "CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0')"


@query("tfidf_by_period", _A_with(f"toks AS {_tok_sql('ap', 'tweet_id, year, month,')}," + _period_sql(_YM),
                                  "SELECT period AS year_month, word, tf, df, score FROM ranked WHERE rn <= 50"))
def q_tfidf_by_period(spark, sf):
    return TM.tfidf_by_period(TK.token_arrays(archive(spark, sf), keep=("tweet_id", "year", "month")), "month", 50)


@query("tfidf_by_year", _A_with(f"toks AS {_tok_sql('ap', 'tweet_id, year, month,')}," +
                                _period_sql("CAST(year AS VARCHAR)"),
                                "SELECT period AS year, word, tf, df, score FROM ranked WHERE rn <= 50"))
def q_tfidf_by_year(spark, sf):
    return TM.tfidf_by_period(TK.token_arrays(archive(spark, sf), keep=("tweet_id", "year", "month")), "year", 50)


_MONTHLY_TOP = _A_with(f"toks AS {_tok_sql('ap', 'tweet_id, year, month,')}," + _period_sql(_YM), """
SELECT CAST(split_part(period, '-', 1) AS INTEGER) AS year, CAST(split_part(period, '-', 2) AS INTEGER) AS month,
       period AS year_month, word, score FROM ranked WHERE rn <= 5""")


@query("monthly_tfidf_top", _MONTHLY_TOP)
def q_monthly_tfidf_top(spark, sf):
    return TM.monthly_tfidf_top(TK.token_arrays(archive(spark, sf), keep=("tweet_id", "year", "month")), 5)


@query("topn_per_group", _MONTHLY_TOP)
def q_topn_per_group(spark, sf):
    return TM.monthly_tfidf_top(TK.token_arrays(archive(spark, sf), keep=("tweet_id", "year", "month")), 5)


@query("word_monthly_counts", _A_with(f"toks AS {_tok_sql('ap', 'tweet_id, year, month,')}", f"""
SELECT year, month, count(*) AS posts, {_YM} AS year_month
FROM (SELECT DISTINCT tweet_id, year, month FROM toks
      WHERE token = '{TERM}' AND year IS NOT NULL AND month IS NOT NULL) t GROUP BY year, month"""))
def q_word_monthly(spark, sf):
    return TM.word_monthly_counts(TK.token_arrays(archive(spark, sf), keep=("tweet_id", "year", "month")), TERM)


@query("word_cooccurrence_for_term", _S_with(f"toks AS {_tok_sql('sp', 'tweet_id,')}", f"""
SELECT token AS word, count(*) AS count
FROM (SELECT DISTINCT tweet_id, token FROM toks) s
WHERE token <> '{TERM}' AND tweet_id IN (SELECT tweet_id FROM toks WHERE token = '{TERM}')
GROUP BY token ORDER BY count DESC, word LIMIT 200"""))
def q_word_cooc_term(spark, sf):
    return TM.word_cooccurrence_for_term(s_arrays(spark, sf), TERM, 200)


WORD_PAIR_TOP = 200


@query("word_cooccurrence_pairs", _S_with(
    f"toks AS {_tok_sql('sp', 'tweet_id,')}," +
    _pairs_sql("(SELECT tweet_id AS id, token AS item FROM toks)", "word_a", "word_b", 2, WORD_PAIR_TOP),
    "SELECT * FROM pairs"))
def q_word_pairs(spark, sf):
    return TM.word_cooccurrence_pairs(s_arrays(spark, sf), WORD_PAIR_TOP, 2)


ALL_PAIRS_MIN = 2


@query("word_cooccurrence_all", _S_with(
    f"toks AS {_tok_sql('sp', 'tweet_id,')}," +
    _pairs_sql("(SELECT tweet_id AS id, token AS item FROM toks)", "word_a", "word_b", ALL_PAIRS_MIN, None),
    "SELECT * FROM pairs"))
def q_word_pairs_all(spark, sf):
    return TM.word_cooccurrence_pairs(s_arrays(spark, sf), None, ALL_PAIRS_MIN)


@query("topic_word_trend", _A_with(
    f"toks AS {_tok_sql('ap', 'tweet_id, year, month,')}," + _TFIDF_CORPUS.replace("FROM sp", "FROM ap"), f"""
SELECT year_month, count(*) AS posts, word
FROM (SELECT DISTINCT tweet_id, token AS word, {_YM} AS year_month FROM toks
      WHERE year IS NOT NULL AND month IS NOT NULL
        AND token IN (SELECT word FROM corpus ORDER BY score DESC, word LIMIT 5)) t
GROUP BY year_month, word"""))
def q_topic_trend(spark, sf):
    d = archive(spark, sf)
    return TM.topic_word_trend(d, TK.token_arrays(d, keep=("tweet_id", "year", "month")), 5)


@query("vocab_topk_by_df", _S_with(f"toks AS {_tok_sql('sp', 'tweet_id,')}", """
SELECT token AS word, count(DISTINCT tweet_id) AS df FROM toks GROUP BY token ORDER BY df DESC, word LIMIT 200"""))
def q_vocab(spark, sf):
    return TM.vocab_topk_by_df(s_arrays(spark, sf), 200)


# ---------------------------------------------------------------------------
# 2.1 sources and sinks (CSV round trips through the shared scratch folder)
# ---------------------------------------------------------------------------

from ..session import scratch_path  # noqa: E402
from ..sources import csv_ingest as CSV  # noqa: E402

_SECONDS = "yyyy-MM-dd HH:mm:ss"


def _csv_source(spark, sf, order, header: bool) -> str:
    """Write the stream posts as CSV (created_at as text, to whole seconds) in the
    given column order; return the folder."""
    p = T.stream_posts(spark, sf).withColumn("created_at", F.date_format("created_at", _SECONDS))
    path = scratch_path(spark, "posts-csv")
    (p.select(*order).write.option("header", header).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


_CSV_ORACLE = S("""
SELECT tweet_id, date_trunc('second', created_at) AS created_at, text, status_url FROM stream_posts""")


@query("csv_ingest", _CSV_ORACLE)
def q_csv_ingest(spark, sf):
    path = _csv_source(spark, sf, ["text", "created_at", "status_url", "tweet_id"], header=True)
    return CSV.read_posts_csv(spark, path)


@query("header_detect", _CSV_ORACLE)
def q_header_detect(spark, sf):
    path = _csv_source(spark, sf, ["created_at", "status_url", "tweet_id", "text"], header=False)
    return CSV.read_posts_csv(spark, path)


@query("infer_columns", _CSV_ORACLE)
def q_infer_columns(spark, sf):
    path = _csv_source(spark, sf, ["status_url", "text", "tweet_id", "created_at"], header=False)
    return CSV.read_posts_csv(spark, path, has_header=False)


@query("normalize_posts", S("""
SELECT tweet_id, date_trunc('minute', created_at) AS created_at, text, NULL::VARCHAR AS status_url FROM stream_posts"""))
def q_normalize_posts(spark, sf):
    raw = T.stream_posts(spark, sf).select(
        F.col("text").alias("c0"), F.col("tweet_id").cast("string").alias("c1"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("c2"))
    return CSV.normalize_posts(raw, CSV.ColumnMapping(tweet_id="c1", created_at="c2", text="c0"))


def _mixed_format():
    return (F.when(F.col("event_type") == "signup", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
            .when(F.col("event_type") == "click", F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm"),
                                                          F.lit(" ")))
            .when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd"))
            .when(F.col("event_type") == "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
            .otherwise(F.date_format("ts", "yyyy/MM/dd")))

_PARSED_SQL = """
parsed AS (SELECT CAST(event_id AS VARCHAR) AS tweet_id,
                  CASE event_type WHEN 'signup' THEN date_trunc('second', ts) WHEN 'click' THEN date_trunc('minute', ts)
                                  WHEN 'view' THEN date_trunc('day', ts) ELSE NULL END AS created_at FROM events)"""


def _mixed_dates(spark, sf):
    e = T.table(spark, sf, "events")
    return e.select(F.col("event_id").cast("string").alias("tweet_id"),
                    CSV.parse_created_at(_mixed_format()).alias("created_at"))


@query("parse_created_at", "WITH" + _PARSED_SQL + "\nSELECT tweet_id, created_at FROM parsed")
def q_parse_created_at(spark, sf):
    return _mixed_dates(spark, sf)


@query("parse_score", "WITH" + _PARSED_SQL + "\nSELECT count(created_at) AS parsed FROM parsed")
def q_parse_score(spark, sf):
    return CSV.parse_score(_mixed_dates(spark, sf))


@query("csv_export", S(f"""
SELECT CAST(weekday AS VARCHAR) AS weekday, CAST(hour AS VARCHAR) AS hour, CAST(count(*) AS VARCHAR) AS posts,
       {_WD_LABEL_SQL.format(c='weekday')} AS weekday_label
FROM sp GROUP BY weekday, hour"""))
def q_csv_export(spark, sf):
    """Export a result table to CSV and read it back (row count / header check)."""
    from ..operators import calendar as _cal
    path = CSV.write_csv(_cal.weekday_hour_counts(stream(spark, sf), with_label=True), scratch_path(spark, "export"))
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


# ---------------------------------------------------------------------------
# 2.10 clustering (property checks only) and 2.11 top-N ranking
# ---------------------------------------------------------------------------

from ..operators import topics as TP  # noqa: E402

KMEANS_K, KMEANS_FEATURES = 4, 200


@query("tfidf_vectors", _S_with(f"""toks AS {_tok_sql('sp', 'tweet_id,')},
vocab AS (SELECT token AS word, count(DISTINCT tweet_id) AS df FROM toks GROUP BY token
          ORDER BY df DESC, word LIMIT {KMEANS_FEATURES}),
nn AS (SELECT count(*) AS n FROM sp),
tf AS (SELECT tweet_id, token, count(*) AS c FROM toks WHERE token IN (SELECT word FROM vocab) GROUP BY 1, 2),
w AS (SELECT tf.tweet_id, tf.c * (ln((1 + nn.n) / (1 + v.df)) + 1) AS x FROM tf JOIN vocab v ON v.word = tf.token, nn)""",
    f"""SELECT sp.tweet_id, CAST(count(w.x) AS INTEGER) AS nnz, {r4('sqrt(coalesce(sum(w.x * w.x), 0))')} AS l2
FROM sp LEFT JOIN w USING (tweet_id) GROUP BY sp.tweet_id"""))
def q_tfidf_vectors(spark, sf):
    """Per post: number of non-zero TF-IDF weights and the vector's L2 norm (4 places)."""
    d = stream(spark, sf)
    vectors, _, _, _ = TP.tfidf_vectors(d, TK.token_arrays(d), KMEANS_FEATURES)
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array("features")
    l2 = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v * v))
    return vectors.select("tweet_id", F.size(F.filter(arr, lambda v: v != 0)).alias("nnz"),
                          C.round_half_up(l2, 4).alias("l2"))


KMEANS_ROUNDS = 12  # centre updates at most; posts are assigned once more to the last centres


def _kmeans_sql(body: str) -> str:
    """The same assignments in SQL: starting rows, then per round the nearest centre and the new centres."""
    ctes = f"""toks AS {_tok_sql('sp', 'tweet_id,')},
vocab AS MATERIALIZED (SELECT word, df, row_number() OVER (ORDER BY df DESC, word) AS i
  FROM (SELECT token AS word, count(DISTINCT tweet_id) AS df FROM toks GROUP BY token ORDER BY df DESC, word LIMIT {KMEANS_FEATURES}) v),
w AS MATERIALIZED (SELECT t.tweet_id, t.token, t.c * (ln((1 + (SELECT count(*) FROM sp)) / (1 + v.df)) + 1) AS x
  FROM (SELECT tweet_id, token, count(*) AS c FROM toks GROUP BY 1, 2) t JOIN vocab v ON v.word = t.token),
kk AS (SELECT unnest(range({KMEANS_K})) AS cid),
c0 AS MATERIALIZED (SELECT cid, w.token, w.x AS c FROM (SELECT tweet_id, row_number() OVER (ORDER BY CAST(tweet_id AS BIGINT)) - 1 AS cid
  FROM (SELECT DISTINCT tweet_id FROM w) d) s JOIN w USING (tweet_id) WHERE cid < {KMEANS_K})"""
    for r in range(KMEANS_ROUNDS + 1):
        score = r4("coalesce(n.cn, 0) - 2 * coalesce(dots.dot, 0)")
        ctes += f""",
a{r} AS MATERIALIZED (SELECT tweet_id, cid FROM (
  SELECT p.tweet_id, kk.cid, row_number() OVER (PARTITION BY p.tweet_id ORDER BY {score}, kk.cid) AS rn
  FROM (SELECT tweet_id FROM sp) p CROSS JOIN kk
  LEFT JOIN (SELECT w.tweet_id, c.cid, sum(w.x * c.c) AS dot FROM w JOIN c{r} c USING (token) GROUP BY 1, 2) dots
    ON dots.tweet_id = p.tweet_id AND dots.cid = kk.cid
  LEFT JOIN (SELECT cid, sum(c * c) AS cn FROM c{r} GROUP BY cid) n ON n.cid = kk.cid) z WHERE rn = 1),
c{r + 1} AS MATERIALIZED (SELECT a.cid, w.token, sum(w.x) / any_value(m.n) AS c FROM a{r} a JOIN w USING (tweet_id)
  JOIN (SELECT cid, count(*) AS n FROM a{r} GROUP BY cid) m ON m.cid = a.cid GROUP BY a.cid, w.token
  UNION ALL SELECT * FROM c{r} WHERE cid NOT IN (SELECT cid FROM a{r}))"""
    return _S_with(ctes, body.format(a=f"a{KMEANS_ROUNDS}"))


_SIZES_SQL = "(SELECT CAST(kk.cid AS INTEGER) AS cluster_id, count(x.tweet_id) AS size FROM kk LEFT JOIN {a} x USING (cid) GROUP BY kk.cid)"


@query("kmeans_cluster_summary", _kmeans_sql(f"""
SELECT z.cluster_id, z.size, coalesce(t.top_terms, '') AS top_terms FROM {_SIZES_SQL} z LEFT JOIN (
  SELECT cid, string_agg(token, ', ' ORDER BY rn) AS top_terms FROM (
    SELECT cid, token, row_number() OVER (PARTITION BY cid ORDER BY {r4('s')} DESC, i) AS rn FROM (
      SELECT x.cid, w.token, v.i, sum(w.x) AS s FROM {{a}} x JOIN w USING (tweet_id) JOIN vocab v ON v.word = w.token GROUP BY 1, 2, 3) q) g
  WHERE rn <= 8 GROUP BY cid) t ON t.cid = z.cluster_id"""))
def q_kmeans_summary(spark, sf):
    d = stream(spark, sf)
    return TP.kmeans_cluster_summary(d, TK.token_arrays(d), KMEANS_K, KMEANS_FEATURES, KMEANS_ROUNDS + 1, start="first")


@query("cluster_sizes", _kmeans_sql("SELECT * FROM " + _SIZES_SQL + " z"))
def q_cluster_sizes(spark, sf):
    d = stream(spark, sf)
    assigned, k, _ = TP.kmeans_clusters(d, TK.token_arrays(d), KMEANS_K, KMEANS_FEATURES, KMEANS_ROUNDS + 1, start="first")
    return TP.cluster_sizes(assigned, k)


_LONG_SQL = S("""
SELECT tweet_id, created_at, text_length, text, status_url FROM sp
ORDER BY text_length DESC, tweet_id LIMIT 100""")


@query("long_text_ranking", _LONG_SQL)
def q_long_text(spark, sf):
    return H.long_text_ranking(stream(spark, sf), 100)


@query("topk", _LONG_SQL)
def q_topk(spark, sf):
    return H.long_text_ranking(stream(spark, sf), 100)


@query("long_texts_stored", _LONG_SQL)
def q_long_texts_stored(spark, sf):
    """The same ranking over the stored table: lengths first, then the texts of the winners alone."""
    from ..sources import posts_table as STORED
    return STORED.long_texts(spark, STORED.write_posts_table(stream(spark, sf), scratch_path(spark, "posts")), 100)


# ---------------------------------------------------------------------------
# 2.11 building blocks with keys of their own
# ---------------------------------------------------------------------------

@query("multi_key_sort", A(_trend_sql("ap", "domain", _TREND_DOMAINS, 10)))
def q_multi_key_sort(spark, sf):
    """year ascending, count descending (the trend ordering)."""
    return L.domain_year_trend(archive(spark, sf), 10)


@query("union_vertical", _S_with(
    ", ".join(f"t{m} AS {_tok_sql('sp', 'tweet_id,', m)}" for m in "ABC"),
    "\nUNION ALL\n".join(f"(SELECT '{m}' AS mode, token AS word, count(*) AS count FROM t{m} GROUP BY token "
                         f"ORDER BY count DESC, word LIMIT 20)" for m in "ABC")))
def q_union_vertical(spark, sf):
    return TM.token_mode_compare(stream(spark, sf), top_n=20)


@query("distinct", S("SELECT DISTINCT tweet_id, token FROM " + _tok_sql("sp", "tweet_id,") + " t"))
def q_distinct(spark, sf):
    return TK.distinct_tokens(stream(spark, sf))


@query("series_split", A(f"""
SELECT domain AS series, year AS x, occurrences AS y FROM ({_trend_sql("ap", "domain", _TREND_DOMAINS, 5)}) t"""))
def q_series_split(spark, sf):
    t = L.domain_year_trend(archive(spark, sf), 5)
    return t.select(F.col("domain").alias("series"), F.col("year").alias("x"),
                    F.col("occurrences").alias("y")).orderBy("series", "x")

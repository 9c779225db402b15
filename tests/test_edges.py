"""Hand-made edge rows (FIXTURES.md section 5)."""
from pyspark.sql import functions as F

from conftest import make_posts
from postlens.operators import calendar as CAL
from postlens.operators import derive as DV
from postlens.operators import gaps as GP
from postlens.operators import histograms as H
from postlens.operators import links as L
from postlens.operators import ratios as R
from postlens.operators import tags as TG

ROWS = [
    ("1", "2024-01-01 10:00:00", "", None),
    ("2", "2024-01-01 10:30:00", None, None),
    ("3", None, "#日本 #a_b", None),
    ("4", "2024-01-01 11:00:00.001", "see https://example.com/a　next", "https://x.com/me/status/4"),
    ("5", "2024-01-01 11:00:00.001", "https:///path", None),
    ("6", "2024-01-02 09:00:00", "http://host:8080/a?q#f", None),
    ("7", "2024-01-02 09:05:00", "look https://netflix.com/x", None),
    ("8", "2024-01-02 09:06:00", "@name first", None),
    ("9", "2024-01-02 09:07:00", "RTX is new", None),
    ("10", "2024-01-02 09:08:00", "abcあい", None),
    ("11", "2024-01-02 09:09:00", "#a #a", "https://x.com/me/status/11"),
    ("12", "2024-01-02 09:10:00", "mine https://x.com/me/status/12?s=20 #f", "https://x.com/me/status/12"),
]


def _derived(spark):
    return DV.derive(make_posts(spark, ROWS))


def test_derived_columns(spark):
    d = {r["tweet_id"]: r for r in _derived(spark).collect()}
    assert d["1"]["text_length"] == 0 and d["1"]["language_hint"] == "ja-biased"
    assert d["2"]["text"] == "" and d["2"]["urls"] == []
    assert d["3"]["year"] is None and d["3"]["hashtag_list"] == ["#日本", "#a_b"]
    assert d["4"]["urls"] == ["https://example.com/a"]
    assert d["5"]["domains"] == [""]
    assert d["6"]["domains"] == ["host:8080"]
    assert d["8"]["is_reply"] is True and d["8"]["mention_list"] == ["@name"]
    assert d["10"]["language_hint"] == "ja-biased"  # ASCII share exactly 0.6 is not above 0.6
    assert d["11"]["hashtag_count"] == 2
    assert d["4"]["weekday"] == 0  # 2024-01-01 is a Monday


def test_code_and_language(spark):
    df = make_posts(spark, [("1", None, "from x import y", None), ("2", None, "fromage important", None),
                            ("3", None, "DEF f(): pass", None), ("4", None, "plain english words", None)])
    d = {r["tweet_id"]: r for r in DV.derive(df).collect()}
    assert [d[k]["contains_code"] for k in "1234"] == [True, False, True, False]
    assert d["4"]["language_hint"] == "en-biased"


def test_retweet_filter_drops_any_rt_prefix(spark):
    ids = {r["tweet_id"] for r in DV.exclude_retweets(_derived(spark)).collect()}
    assert "9" not in ids and "8" in ids


def test_self_reference_suffix_rule(spark):
    row = R.self_reference_stats(_derived(spark)).collect()[0]
    # netflix.com ends with "x.com" (plain suffix test) and x.com itself
    assert row["self_ref"] == 2 and row["external"] == len(ROWS) - 2


def test_self_post_urls(spark):
    row = R.self_post_url_stats(_derived(spark)).collect()[0]
    assert (row["self_post"], row["other_url"], row["no_url"]) == (1, 4, 7)
    assert row["rate"] == round(1 / 12, 4)


def test_path_depth_and_tld(spark):
    d = _derived(spark)
    depth = {r["depth"]: r["occurrences"] for r in H.path_depth_distribution(d).collect()}
    # example.com/a -> 1, /path -> 1 ('' + 'path'), host:8080/a -> 1; netflix and x.com dropped
    assert depth == {1: 3}
    tlds = {r["tld"]: r["occurrences"] for r in L.tld_distribution(d, None).collect()}
    assert "8080" not in tlds and tlds["com"] >= 1


def test_hashtag_pairs_need_two_distinct_tags(spark):
    d = _derived(spark)
    assert TG.hashtag_cooccurrence(d, top_n=0, min_count=1).count() == 1  # only #a_b / #日本


def test_sessions_boundary_and_same_millisecond(spark):
    rows = [("a", "2024-01-01 10:00:00", "x", None), ("b", "2024-01-01 10:30:00", "x", None),
            ("c", "2024-01-01 11:00:00.001", "x", None), ("d", "2024-01-01 11:00:00.001", "x", None)]
    d = DV.derive(make_posts(spark, rows))
    sizes = {r["session_size"]: r["sessions"] for r in GP.session_length_distribution(d, 30).collect()}
    assert sizes == {2: 2}  # exactly 30 min joins, 30 min + 1 ms splits
    diffs = sorted(r["diff_min"] for r in GP.interval_lag(d).collect())
    assert diffs == [0.0, 30.0, 30.0 + 1 / 60000]


def test_zero_filled_years(spark):
    rows = [("a", "2020-06-01 10:00:00", "x", None), ("b", "2022-06-01 10:00:00", "x", None)]
    d = DV.filter_years(DV.derive(make_posts(spark, rows)), [2020, 2022])
    out = {r["year"]: r["avg_posts"] for r in CAL.average_yearly_counts(d).collect()}
    assert out[2021] == 0.0 and set(out) == {2020, 2021, 2022}


def test_null_created_at_kept_in_totals_and_groups(spark):
    d = _derived(spark)
    assert CAL.basic_counts(d).collect()[0]["total"] == len(ROWS)
    years = {r["year"]: r["posts"] for r in CAL.yearly_counts(d).collect()}
    assert years[None] == 1


def test_weekday_fill_has_seven_rows(spark):
    out = CAL.weekday_counts_filled(_derived(spark)).collect()
    assert [r["weekday"] for r in out] == list(range(7))
    assert out[6]["weekday_label"] == "日"


def test_keyword_dictionary_parse():
    raw = "A: x,y\nB：p、q\n\nnolabel\n: z\nA: w\n"
    assert TG.parse_keyword_dictionary(raw) == [("A", ["w"]), ("B", ["p", "q"])]


def test_keyword_counts_keep_zero_categories(spark):
    d = _derived(spark)
    out = {r["category"]: r["posts"] for r in TG.keyword_category_counts(d, "Net: NETFLIX\nNone: zzzz").collect()}
    assert out == {"Net": 1, "None": 0}


def test_text_length_bins(spark):
    d = _derived(spark)
    rows = H.text_length_distribution(d, 5).collect()
    assert sum(r["posts"] for r in rows) == len(ROWS)
    assert rows[0]["bin_label"] == "0-4"


def test_strict_self_domain(spark):
    d = _derived(spark)
    assert R.self_reference_stats(d, strict_self_domain=True).collect()[0]["self_ref"] == 1  # netflix.com no more


def test_pos_filter_and_stopword_parsing():
    from postlens.operators import tokens as TK
    assert TK.normalize_pos_filter(None) == ["名詞", "動詞", "形容詞"]
    assert TK.normalize_pos_filter("noun, Verb/adj") == ["名詞", "動詞", "形容詞"]
    assert TK.normalize_pos_filter(" , / ") == []
    assert TK.parse_stopwords("a\nb,, c\r\n\n") == ["a", "b", "c"]


def test_parse_created_at_accepts_t_on_request(spark):
    from postlens.sources import csv_ingest as CSV
    df = spark.createDataFrame([("2024-01-05T10:11",)], "s string")
    assert df.select(CSV.parse_created_at(F.col("s"))).collect()[0][0] is None
    assert str(df.select(CSV.parse_created_at(F.col("s"), accept_t=True)).collect()[0][0]) == "2024-01-05 10:11:00"


def test_period_df_unit(spark):
    from postlens.operators import terms as TM
    rows = [("1", "2024-01-01 10:00:00", "alpha beta", None), ("2", "2024-01-02 10:00:00", "alpha gamma", None),
            ("3", "2024-02-01 10:00:00", "alpha", None)]
    from postlens.operators import tokens as TK
    arr = TK.token_arrays(DV.derive(make_posts(spark, rows)), keep=("tweet_id", "year", "month"))
    posts_df = {r["word"]: r["df"] for r in TM.tfidf_by_period(arr, "month", 10).collect()}
    period_df = {r["word"]: r["df"] for r in TM.tfidf_by_period(arr, "month", 10, df_unit="period").collect()}
    assert posts_df["alpha"] == 3 and period_df["alpha"] == 2


def test_long_stopword_list_matches_short(spark):
    from postlens.operators import terms as TM
    from postlens.operators import tokens as TK
    rows = [("1", None, "alpha beta gamma alpha delta", None), ("2", None, "beta epsilon zeta", None)]
    posts = DV.derive(make_posts(spark, rows))
    stop = "alpha\nzeta\n" + "\n".join(f"filler{i}" for i in range(300))
    big = {r["word"]: r["count"] for r in TM.word_frequency(TK.token_arrays(posts, TK.TextOptions(stopwords=stop)),
                                                             None).collect()}
    short = {r["word"]: r["count"] for r in TM.word_frequency(TK.token_arrays(posts, TK.TextOptions(stopwords="alpha,zeta")),
                                                               None).collect()}
    assert big == short == {"beta": 2, "gamma": 1, "delta": 1, "epsilon": 1}

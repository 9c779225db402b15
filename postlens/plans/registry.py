"""Export / panel registry: every analysis of the original tool by its kind name.

``run(kind, derived, options, term=None, preset="export")`` returns the result
DataFrame; ``export_csv(...)`` writes it as CSV.  The two presets differ only in
list lengths and a few switches (the dashboard panel shows fewer rows than the
CSV export); the operators are the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark.sql import DataFrame

from ..functions import patterns as P
from ..operators import calendar as CAL
from ..operators import derive as DV
from ..operators import gaps as GP
from ..operators import histograms as H
from ..operators import links as L
from ..operators import ratios as R
from ..operators import tags as TG
from ..operators import terms as TM
from ..operators import tokens as TK
from ..operators import topics as TP
from ..session import materialize
from ..sources import csv_ingest as CSV


@dataclass(frozen=True)
class AnalysisOptions:
    """Session options of the original tool, as an immutable value."""
    years: Sequence[int] = ()
    years_mode: str = "all"          # "all" or "selected"
    mode: str = "C"                  # tokenizer granularity A / B / C
    pos_filter: str | None = None
    stopwords: str | None = None
    keyword_dict: str | None = None
    lexicon: DataFrame | None = field(default=None, compare=False, hash=False)
    period: str = "month"            # TF-IDF document unit: "month" or "year"
    exclude_retweets: bool = False   # mention panel switch
    max_words: int = 150             # word cloud size (clamped 10..400)
    max_minutes: int = 720           # interval panel upper bound (clamped 30..1440)
    per_author: bool = False         # intervals / sessions between posts of the same author_id
    strict_self_domain: bool = False  # self domains as domain-or-subdomain instead of plain suffix
    df_unit: str = "post"            # period TF-IDF document frequency: "post" (original) or "period"

    def author(self, d: DataFrame) -> str | None:
        return "author_id" if self.per_author and "author_id" in d.columns else None

    def text(self, mode: str | None = None) -> TK.TextOptions:
        return TK.TextOptions(mode=mode or self.mode, pos_filter=self.pos_filter, stopwords=self.stopwords,
                              lexicon=self.lexicon)


def _clamp(v: int, lo: int, hi: int) -> int:
    return max(lo, min(int(v), hi))


# (export, panel) list lengths where they differ
SIZES = {
    "mentions": (200, 30), "hashtags": (None, 30), "domains": (None, 20), "tlds": (None, 20),
    "word_freq": (None, 50), "tfidf": (50, 20), "hashtag_years": (20, 8), "hashtag_pairs": (200, 40),
    "word_network": (200, 40), "word_cooccurrence": (200, 30), "domain_years": (10, 5), "long_texts": (100, 30),
    "sudachi_compare": (50, 20),
}


def _n(kind: str, preset: str):
    e, p = SIZES[kind]
    return e if preset == "export" else p


def _tokens(d: DataFrame, o: AnalysisOptions, keep=("tweet_id",)) -> DataFrame:
    """Per-post token arrays (the input of the text operators)."""
    return TK.token_arrays(d, o.text(), keep)


def _period_tokens(d: DataFrame, o: AnalysisOptions) -> DataFrame:
    return _tokens(d, o, ("tweet_id", "year", "month"))


def _intervals(d, o, t, p):
    if p == "panel":
        return GP.posting_interval_distribution(d, 30, _clamp(o.max_minutes, 30, 1440), by=o.author(d))
    return GP.posting_interval_distribution(d, 30, by=o.author(d)).select("bin_label", "posts")


def _mentions(d, o, t, p):
    if p == "panel" and o.exclude_retweets:
        d = DV.exclude_retweets(d)
    return TG.mention_ranking(d, _n("mentions", p))


def _domain_month(d, o, t, p):
    """The export needs a domain (none: empty result); the panel defaults to the most linked one."""
    out = L.domain_month_trend(d, t or None)
    return out.limit(0) if (p == "export" and not t) else out


def _word_cloud(pos_filter: str | None):
    """Word-cloud table; the cloud routes override the part-of-speech filter
    (nouns; nouns and verbs).  ``term`` may carry max_words."""
    def run_(d, o, t, p):
        text = TK.TextOptions(mode=o.mode, pos_filter=pos_filter if pos_filter is not None else o.pos_filter,
                              stopwords=o.stopwords, lexicon=o.lexicon)
        return TM.word_cloud_weights(TK.token_arrays(d, text), int(t) if t else o.max_words)
    return run_


def _clusters(d, o, t, p):
    k = _clamp(int(t or 4), 2, 8)
    return TP.kmeans_cluster_summary(d, _tokens(d, o), k=k, max_features=200, max_iter=12)


KINDS: dict[str, Callable] = {
    "yearly": lambda d, o, t, p: CAL.yearly_counts(d),
    "monthly": lambda d, o, t, p: CAL.monthly_counts(d),
    "avg_yearly": lambda d, o, t, p: CAL.average_yearly_counts(d),
    "avg_monthly": lambda d, o, t, p: CAL.average_monthly_counts(d),
    "avg_weekday": lambda d, o, t, p: CAL.average_weekday_counts_filled(d),
    "hourly": lambda d, o, t, p: CAL.hourly_counts(d),
    "weekday": lambda d, o, t, p: CAL.weekday_counts_filled(d),
    "weekday_hour": lambda d, o, t, p: CAL.weekday_hour_counts(d, with_label=True),
    "daily": lambda d, o, t, p: CAL.daily_counts(d),
    "weekly": lambda d, o, t, p: CAL.weekly_counts(d),
    "daily_calendar": lambda d, o, t, p: CAL.daily_counts_full(d) if p == "export" else CAL.daily_calendar_matrix(d),
    "monthday": lambda d, o, t, p: CAL.monthday_counts(d),
    "weekday_monthday": lambda d, o, t, p: CAL.weekday_monthday_matrix(d),
    "weekday_hour_matrix": lambda d, o, t, p: CAL.weekday_hour_matrix(d),
    "domains": lambda d, o, t, p: L.domain_ranking(d, _n("domains", p)),
    "word_freq": lambda d, o, t, p: TM.word_frequency(_tokens(d, o), _n("word_freq", p)),
    "word_cloud": _word_cloud(None),
    "wordcloud": _word_cloud(P.POS_NOUN),
    "wordcloud_nv": _word_cloud(f"{P.POS_NOUN},{P.POS_VERB}"),
    "tfidf": lambda d, o, t, p: TM.tfidf_by_period(_period_tokens(d, o), "year" if o.period == "year" else "month",
                                                   _n("tfidf", p), o.df_unit),
    "hashtags": lambda d, o, t, p: TG.hashtag_ranking(d, _n("hashtags", p)),
    "lengths": lambda d, o, t, p: H.text_length_distribution(d, 20).select("bin_label", "posts"),
    "tlds": lambda d, o, t, p: L.tld_distribution(d, _n("tlds", p)),
    "intervals": _intervals,
    "sessions": lambda d, o, t, p: GP.session_length_distribution(d, 30, by=o.author(d)),
    "url_counts": lambda d, o, t, p: H.url_count_distribution(d),
    "url_rate": lambda d, o, t, p: R.url_presence_stats(d),
    "newlines": lambda d, o, t, p: H.newline_count_distribution(d),
    "emojis": lambda d, o, t, p: H.emoji_count_distribution(d),
    "reply_ratio": lambda d, o, t, p: R.reply_ratio(d),
    "hashtag_counts": lambda d, o, t, p: H.hashtag_count_distribution(d),
    "mention_counts": lambda d, o, t, p: H.mention_count_distribution(d),
    "night_ratio": lambda d, o, t, p: R.night_post_ratio(d),
    "interval_stats": lambda d, o, t, p: GP.posting_interval_summary(d, by=o.author(d)),
    "long_texts": lambda d, o, t, p: H.long_text_ranking(d, _n("long_texts", p)),
    "path_depth": lambda d, o, t, p: H.path_depth_distribution(d, True, o.strict_self_domain),
    "domain_month": _domain_month,
    "mentions": _mentions,
    "mention_weekday": lambda d, o, t, p: TG.mention_weekday_totals(d),
    "mention_weekday_detail": lambda d, o, t, p: (TG.mention_weekday_counts(d) if p == "export"
                                                   else TG.mention_weekday_top(d, 5)),
    "hashtag_years": lambda d, o, t, p: TG.hashtag_year_trend(d, _n("hashtag_years", p)),
    "hashtag_pairs": lambda d, o, t, p: TG.hashtag_cooccurrence(d, _n("hashtag_pairs", p), 2),
    "keyword_categories": lambda d, o, t, p: TG.keyword_category_counts(d, o.keyword_dict or ""),
    "word_trend": lambda d, o, t, p: TM.word_monthly_counts(_period_tokens(d, o), t or ""),
    "domain_years": lambda d, o, t, p: L.domain_year_trend(d, _n("domain_years", p)),
    "self_reference": lambda d, o, t, p: R.self_reference_stats(d, o.strict_self_domain),
    "self_post_urls": lambda d, o, t, p: R.self_post_url_stats(d),
    "word_cooccurrence": lambda d, o, t, p: TM.word_cooccurrence_for_term(_tokens(d, o), t or "",
                                                                          _n("word_cooccurrence", p)),
    "word_network": lambda d, o, t, p: TM.word_cooccurrence_pairs(_tokens(d, o), _n("word_network", p), 2),
    "sudachi_compare": lambda d, o, t, p: TM.token_mode_compare(d, o.text(), _n("sudachi_compare", p)),
    "topics_monthly": lambda d, o, t, p: TM.monthly_tfidf_top(_period_tokens(d, o), 5),
    "topic_trends": lambda d, o, t, p: TM.topic_word_trend(d, _period_tokens(d, o), 5),
    "clusters": _clusters,
}

# The 49 CSV export kinds of the original tool, in its order.
EXPORT_KINDS = [
    "yearly", "monthly", "avg_yearly", "avg_monthly", "avg_weekday", "hourly", "weekday", "weekday_hour", "daily",
    "weekly", "daily_calendar", "monthday", "weekday_monthday", "domains", "word_freq", "tfidf", "hashtags",
    "lengths", "tlds", "intervals", "sessions", "url_counts", "url_rate", "newlines", "emojis", "reply_ratio",
    "hashtag_counts", "mention_counts", "night_ratio", "interval_stats", "long_texts", "path_depth",
    "domain_month", "mentions", "mention_weekday", "mention_weekday_detail", "hashtag_years", "hashtag_pairs",
    "keyword_categories", "word_trend", "domain_years", "self_reference", "self_post_urls", "word_cooccurrence",
    "word_network", "sudachi_compare", "topics_monthly", "topic_trends", "clusters",
]
# Same analysis under a name that says what it does (granularities A / B / C of our tokenizer).
KINDS["token_mode_compare"] = KINDS["sudachi_compare"]


# Dashboard panels that show several tables at once (the other panels show one kind).
PANELS = {
    "summary": ["avg_yearly", "avg_monthly", "avg_weekday"],
    "time": ["hourly", "weekday", "daily", "weekday_hour_matrix"],
    "monthday_bias": ["monthday", "weekday_monthday"],
    "urls": ["url_rate", "url_counts"],
}


# Panels whose tables are all worked out from calendar cells.
CALENDAR_PANELS = ("summary", "time", "monthday_bias")


def run_panel(name: str, derived: DataFrame, options: AnalysisOptions | None = None) -> dict[str, DataFrame]:
    """Tables of a multi-table panel by kind name (``summary`` adds the average counts).
    The posts of a calendar panel are read once, for its cells."""
    if name in CALENDAR_PANELS:
        return run_calendar(derived, options, (name,))[name]
    return {kind: run(kind, derived, options, preset="panel") for kind in PANELS[name]}


def run_calendar(derived: DataFrame, options: AnalysisOptions | None = None,
                 panels: Sequence[str] = CALENDAR_PANELS) -> dict[str, dict[str, DataFrame]]:
    """All calendar panels of a dashboard, by panel and kind, from one count of the posts."""
    options = options or AnalysisOptions()
    cells = materialize(CAL.calendar_cells(prepare(derived, options)))  # at most the hours of the time span
    out = {name: {kind: run(kind, cells, options, preset="panel") for kind in PANELS[name]} for name in panels}
    if "summary" in out:
        out["summary"]["average_counts"] = CAL.average_counts(cells)
    return out


def prepare(derived: DataFrame, options: AnalysisOptions) -> DataFrame:
    """Apply the year selection (partition pruning on a year-partitioned table)."""
    return DV.filter_years(derived, list(options.years), options.years_mode)


def run(kind: str, derived: DataFrame, options: AnalysisOptions | None = None, term: str | None = None,
        preset: str = "export") -> DataFrame:
    if kind not in KINDS:
        raise KeyError(f"unknown kind {kind!r}")
    options = options or AnalysisOptions()
    return KINDS[kind](prepare(derived, options), options, term, preset)


def export_csv(kind: str, derived: DataFrame, path: str, options: AnalysisOptions | None = None,
               term: str | None = None) -> str:
    return CSV.write_csv(run(kind, derived, options, term, "export"), path)


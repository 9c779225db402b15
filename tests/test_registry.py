"""Every export kind through the registry (both presets): lengths, and values from the posts."""
import itertools
from collections import Counter

import pytest

from conftest import SF_SMALL
from postlens.operators import derive as DV
from postlens.plans import registry as RG
from postlens.sources import tables as T


@pytest.fixture(scope="module")
def derived(spark):
    return DV.derive(T.stream_posts(spark, SF_SMALL)).cache()


def test_all_export_kinds_registered():
    assert len(RG.EXPORT_KINDS) == 49 and set(RG.EXPORT_KINDS) <= set(RG.KINDS)


@pytest.fixture(scope="module")
def posts(derived):
    return derived.collect()


# List lengths of the export and of the panel (None: all), as the original has them.
LENGTHS = {
    "mentions": (200, 30), "hashtags": (None, 30), "domains": (None, 20), "tlds": (None, 20), "word_freq": (None, 50),
    "hashtag_pairs": (200, 40), "word_network": (200, 40), "word_cooccurrence": (200, 30), "long_texts": (100, 30),
}


def _counted(values):
    n = Counter(values)
    return sorted(n.items(), key=lambda x: (x[0] is not None, x[0]))


def _ranked(values):
    return sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))


def _bins(values, width):
    return [(f"{b}-{b + width - 1}", n) for b, n in _counted(v // width * width for v in values)]


# The first two columns of a kind, from the posts alone.
BRUTE = {
    "yearly": lambda p: _counted(r["year"] for r in p),
    "hourly": lambda p: _counted(r["hour"] for r in p),
    "weekday": lambda p: [(d, sum(r["weekday"] == d for r in p)) for d in range(7)],
    "daily": lambda p: _counted(r["date"] for r in p),
    "domains": lambda p: _ranked(d for r in p for d in r["domains"]),
    "hashtags": lambda p: _ranked(t for r in p for t in r["hashtag_list"]),
    "mentions": lambda p: _ranked(t for r in p for t in r["mention_list"]),
    "hashtag_counts": lambda p: _counted(len(r["hashtag_list"]) for r in p),
    "mention_counts": lambda p: _counted(len(r["mention_list"]) for r in p),
    "url_counts": lambda p: _counted(len(r["urls"]) for r in p),
    "newlines": lambda p: _counted(r["text"].count("\n") for r in p),
    "hashtag_pairs": lambda p: [x for x, n in sorted(Counter(
        q for r in p for q in itertools.combinations(sorted(set(r["hashtag_list"])), 2)).items(), key=lambda x: (-x[1], x[0])) if n > 1],
}


@pytest.mark.parametrize("kind", RG.EXPORT_KINDS)
def test_kind_values(spark, derived, posts, kind):
    opts = RG.AnalysisOptions(keyword_dict="Web: http\nCode: def,import", stopwords="the\nand")
    term = {"word_trend": "the", "word_cooccurrence": "that", "clusters": "3"}.get(kind)
    for preset in ("export", "panel"):
        rows = RG.run(kind, derived, opts, term, preset).collect()
        if kind in LENGTHS:
            most = LENGTHS[kind][preset == "panel"]
            assert 0 < len(rows) <= (most or len(rows)), kind
        if kind in BRUTE:
            expected = BRUTE[kind](posts)
            most = LENGTHS.get(kind, (None, None))[preset == "panel"]
            assert [tuple(r)[:2] for r in rows] == expected[:most], kind


def test_year_selection(spark, derived):
    opts = RG.AnalysisOptions(years=[2024], years_mode="selected")
    assert RG.run("yearly", derived, opts).collect()[0]["year"] == 2024
    assert RG.run("yearly", derived, RG.AnalysisOptions(years=[1999], years_mode="selected")).count() == 0


def test_per_author_intervals(spark, derived):
    opts = RG.AnalysisOptions(per_author=True)
    per_author = RG.run("interval_stats", derived, opts).collect()[0]
    overall = RG.run("interval_stats", derived).collect()[0]
    # one interval fewer per author than posts of that author
    n_authors = derived.select("author_id").distinct().count()
    assert per_author["count"] == derived.count() - n_authors
    assert overall["count"] == derived.count() - 1
    sizes = RG.run("sessions", derived, opts).collect()
    assert sum(r["session_size"] * r["sessions"] for r in sizes) == derived.count()


def test_panels_and_word_clouds(spark, derived):
    tables = RG.run_panel("summary", derived)
    assert set(tables) == {"avg_yearly", "avg_monthly", "avg_weekday", "average_counts"}
    assert tables["avg_weekday"].count() == 7
    for name in RG.PANELS:
        assert all(df.count() > 0 for df in RG.run_panel(name, derived).values())
    # without a lexicon there is no part-of-speech restriction, so both clouds equal the plain one
    plain = RG.run("word_cloud", derived, term="30").collect()
    assert RG.run("wordcloud", derived, term="30").collect() == plain
    assert len(plain) == 30

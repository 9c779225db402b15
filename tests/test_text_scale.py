"""Text operators that shuffle no row for each token, and k-means' last assignment."""
from pyspark.sql import functions as F

from postlens.operators import terms as TM
from postlens.operators import tokens as TK
from postlens.plans import catalog

TEXTS = ["the cat's FooBar the\nnaïve été 漢字かなカナー 漢字漢字 x1y2 ªb", "the the\tthe  ", "", None, "the cat's FooBar", "a　bb cc ⅧⅧ"]


def _posts(spark):
    rows = [(str(i // 2) if i else None, t) for i, t in enumerate(TEXTS * 2)]
    return spark.createDataFrame(rows, "tweet_id string, text string")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_lexicon_is_looked_up_in_place_and_joined_when_long(spark, monkeypatch):
    words = [("the", "名詞"), ("cat", "動詞"), ("été", "名詞"), ("FooBar", "副詞"), ("the", "動詞"), (None, "名詞"), ("bb\u0001", "名詞"), ("", "名詞")]
    lex = spark.createDataFrame(words, "word string, pos string")
    for listed in (lex, lex.limit(0)):
        opts = TK.TextOptions(lexicon=listed)
        found = TK.token_arrays(_posts(spark), opts)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        here = _rows(found)
        with monkeypatch.context() as m:
            m.setattr(TK, "LEXICON_WORDS", 0)
            if listed is lex:
                assert _rows(TK.token_arrays(_posts(spark), opts)) == here
    assert all("tokens=[]" in r for r in here)


def test_modes_are_counted_over_distinct_pieces(spark):
    posts = _posts(spark)
    found = TM.mode_frequencies(posts, TK.TextOptions(stopwords="cat"), None)
    each = [TM.word_frequency(TK.token_arrays(posts, TK.TextOptions(mode=m, stopwords="cat")), None).select(F.lit(m).alias("mode"), "word", "count") for m in "ABC"]
    assert _rows(found) == _rows(each[0].union(each[1]).union(each[2])) != []
    assert "split(replace(" in found._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_tokens_of_repeated_and_missing_ids(spark):
    posts = _posts(spark)
    assert _rows(TK.distinct_tokens(posts)) == _rows(TK.tokenize(posts).select("tweet_id", "token").distinct()) != []


def test_kmeans_assigns_once_more_after_the_last_update():
    for name in ("kmeans_cluster_summary", "cluster_sizes"):
        assert "a12 AS MATERIALIZED" in catalog.ORACLE[name] and "FROM kk LEFT JOIN a12 " in catalog.ORACLE[name]

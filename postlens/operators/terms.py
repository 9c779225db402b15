"""Word frequency, TF-IDF, term trends and word co-occurrence.

Inputs are per-post token arrays (``tokens.token_arrays``): one row per post with
its kept tokens.  Term frequency and document frequency come from a single
explode of each post's sorted tokens and one partial aggregation, so a
frequent word is pre-aggregated in every map task and no token is shuffled by
post.  Term filters (``array_contains``) need no explode at all.

All scores use idf = ln((1 + N) / (1 + df)) + 1 and are rounded half-up to 4
places; rankings order by the rounded score, then the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import pairs as PR
from .tokens import TextOptions, _kept_tokens, restricts_classes, token_arrays


def _idf_score(tf: Column, df: Column, n: Column) -> Column:
    idf = F.ln((F.lit(1.0) + n) / (F.lit(1.0) + df)) + F.lit(1.0)
    return C.round_half_up(tf * idf, 4)


def term_rows(arrays: DataFrame, *keep: str) -> DataFrame:
    """(keep..., token, doc): one row per occurrence; doc is 1 for one of a post's equal tokens
    and 0 for the others.  The count of rows is the term frequency, sum(doc) the number of
    posts containing the token.  Sorting a post's tokens puts equal ones side by side, so
    one explode in generated code tells the first of them."""
    each = arrays.select(*keep, F.sort_array("tokens").alias("_s")).select(*keep, "_s", F.posexplode("_s").alias("_i", "token"))
    again = (F.col("_i") > 0) & (F.get("_s", F.col("_i") - 1) == F.col("token"))
    return each.select(*keep, "token", F.when(again, 0).otherwise(1).alias("doc"))


def word_frequency(arrays: DataFrame, top_n: int | None = 50) -> DataFrame:
    out = (arrays.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
           .orderBy(F.desc("count"), F.asc("word")))
    return out.limit(top_n) if top_n else out


def word_cloud_weights(arrays: DataFrame, max_words: int = 150) -> DataFrame:
    """The table behind a word cloud: top words (max_words clamped to 10..400) with
    weight = count / largest count."""
    n = min(max(int(max_words), 10), 400)
    top = word_frequency(arrays, n)
    w = Window.partitionBy()  # at most 400 rows
    return top.withColumn("weight", F.col("count") / F.max("count").over(w)).orderBy(
        F.desc("count"), F.asc("word"))


def _tf_df(arrays: DataFrame, *keys: str) -> DataFrame:
    return (term_rows(arrays, *keys).groupBy(*keys, F.col("token").alias("word"))
            .agg(F.count(F.lit(1)).alias("tf"), F.sum("doc").cast("long").alias("df")))


def _n_posts(posts: DataFrame, n_posts: int | None) -> Column:
    """Number of posts, at least 1: the given one or a one-row aggregate inside the plan."""
    if n_posts is not None:
        return F.lit(float(max(n_posts, 1)))
    return posts.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double")).scalar()


def tfidf_corpus(posts: DataFrame, arrays: DataFrame, top_n: int | None = 50,
                 n_posts: int | None = None) -> DataFrame:
    """Corpus TF-IDF: tf = occurrences, df = posts containing the word, N = all posts."""
    scored = _tf_df(arrays).withColumn("_n", _n_posts(posts, n_posts))
    out = (scored.withColumn("score", _idf_score(F.col("tf"), F.col("df"), F.col("_n"))).drop("_n")
           .orderBy(F.desc("score"), F.asc("word")))
    return out.limit(top_n) if top_n else out


def _period_scores(arrays: DataFrame, period_col: Column, df_unit: str = "post") -> DataFrame:
    """(period, word, tf, df, score) where a document is a period, df counts posts
    (``df_unit='post'``, as the original does) or periods (``'period'``, the
    textbook form), and N counts periods that have at least one word.

    (period, word, tf, posts) comes from one aggregation; df is a window sum of posts
    over the word, N a one-row aggregate over the same rows.  Both branches read all
    columns of that aggregation, so its exchange is the same and Spark reuses it."""
    with_period = arrays.where(period_col.isNotNull()).select(period_col.alias("period"), "tokens")
    pw = _tf_df(with_period, "period").withColumnRenamed("df", "posts")
    periods = pw.groupBy("period").agg(F.sum(F.col("tf") + F.col("posts")).alias("w")).where("w > 0")
    n_periods = periods.agg(F.count(F.lit(1)).cast("double")).scalar()
    per_word = Window.partitionBy("word")
    df_col = F.count(F.lit(1)).over(per_word) if df_unit == "period" else F.sum("posts").over(per_word)
    scored = pw.withColumn("df", df_col).withColumn("_n", n_periods)
    return scored.withColumn("score", _idf_score(F.col("tf"), F.col("df"), F.col("_n")))


def _top_per_period(scored: DataFrame, top_n: int) -> DataFrame:
    w = Window.partitionBy("period").orderBy(F.desc("score"), F.asc("word"))
    return scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top_n).drop("_rn")


def _month_label() -> Column:
    return F.when(F.col("month").isNotNull(), C.year_month_label(F.col("year"), F.col("month")))


def tfidf_by_period(arrays: DataFrame, period: str = "month", top_n: int = 50, df_unit: str = "post") -> DataFrame:
    """Top words per period ('year' or 'month'); arrays must carry year and month."""
    if period == "year":
        key, pcol = "year", F.col("year").cast("string")
    else:
        key, pcol = "year_month", _month_label()
    scored = _period_scores(arrays, pcol, df_unit)
    return (_top_per_period(scored, top_n)
            .select(F.col("period").alias(key), "word", "tf", "df", "score")
            .orderBy(F.asc(key), F.desc("score"), F.asc("word")))


def monthly_tfidf_top(arrays: DataFrame, top_n: int = 5) -> DataFrame:
    out = _top_per_period(_period_scores(arrays, _month_label()), top_n)
    return (out.select(F.split("period", "-")[0].cast("int").alias("year"),
                       F.split("period", "-")[1].cast("int").alias("month"),
                       F.col("period").alias("year_month"), "word", "score")
            .orderBy("year", "month", F.desc("score"), F.asc("word")))


def word_monthly_counts(arrays: DataFrame, term: str) -> DataFrame:
    """Posts per (year, month) containing the exact token ``term``."""
    hits = arrays.where(F.array_contains("tokens", term) & F.col("year").isNotNull() & F.col("month").isNotNull())
    return (hits.groupBy("year", "month").agg(F.count(F.lit(1)).alias("posts"))
            .withColumn("year_month", C.year_month_label(F.col("year"), F.col("month")))
            .orderBy("year", "month"))


def word_cooccurrence_for_term(arrays: DataFrame, term: str, top_n: int | None = 30) -> DataFrame:
    """Other distinct words of the posts that contain ``term``, by number of posts."""
    others = (arrays.where(F.array_contains("tokens", term))
              .select(F.explode(F.array_distinct("tokens")).alias("word")).where(F.col("word") != F.lit(term)))
    out = others.groupBy("word").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc("word"))
    return out.limit(top_n) if top_n else out


def word_cooccurrence_pairs(arrays: DataFrame, top_n: int | None = 50, min_count: int = 2) -> DataFrame:
    return PR.top_pairs(arrays, "tweet_id", "tokens", top_n=top_n, min_count=min_count, names=("word_a", "word_b"))


def _tag_with(mode: str):
    """One-argument lambda for ``transform`` (a second parameter would receive the index)."""
    return lambda t: F.struct(F.lit(mode).alias("mode"), t.alias("word"))


def mode_frequencies(posts: DataFrame, opts: TextOptions | None = None, top_n: int | None = 20) -> DataFrame:
    """Word counts for granularities A, B and C (column ``mode``), top_n per mode
    (None: all).  No token holds a space or a line feed, so the texts are counted first by
    what stands between those, in one pass over the posts; the three tokenisers run over
    the distinct pieces alone."""
    opts = opts or TextOptions()
    per_mode = {m: TextOptions(mode=m, pos_filter=opts.pos_filter, stopwords=opts.stopwords, lexicon=opts.lexicon)
                for m in ("A", "B", "C")}
    if restricts_classes(opts):  # a join per mode
        parts = [word_frequency(token_arrays(posts, o), top_n).withColumn("mode", F.lit(m))
                 for m, o in per_mode.items()]
        out = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return out.select("mode", "word", "count")
    arrays = {m: F.transform(_kept_tokens(o), _tag_with(m)) for m, o in per_mode.items()}
    pieces = posts.select(F.explode(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), " ")).alias("text"))
    pieces = pieces.where("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    rows = pieces.select("n", F.explode(F.concat(*arrays.values())).alias("r")).select("r.mode", "r.word", "n")
    counts = rows.groupBy("mode", "word").agg(F.sum("n").alias("count"))
    if top_n:
        w = Window.partitionBy("mode").orderBy(F.desc("count"), F.asc("word"))
        counts = counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top_n).drop("_rn")
    return counts.select("mode", "word", "count").orderBy("mode", F.desc("count"), F.asc("word"))


def token_mode_compare(posts: DataFrame, opts: TextOptions | None = None, top_n: int = 20) -> DataFrame:
    """Top words for granularities A, B and C side by side (column ``mode``)."""
    return mode_frequencies(posts, opts, top_n)


def topic_word_trend(posts: DataFrame, arrays: DataFrame, top_n: int = 5, n_posts: int | None = None) -> DataFrame:
    """For the top corpus TF-IDF words: posts per month containing each word.

    Words are counted once, by month (posts without one included); sums over the months
    rank them, inside the plan, and the ``top_n`` words of that select among the same counts."""
    by_month = _tf_df(arrays.select(_month_label().alias("year_month"), "tokens"), "year_month")
    corpus = by_month.groupBy("word").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).withColumn("_n", _n_posts(posts, n_posts))
    top = (corpus.withColumn("score", _idf_score(F.col("tf"), F.col("df"), F.col("_n")))
           .orderBy(F.desc("score"), F.asc("word")).limit(top_n).select("word"))
    # The filter holds for every row; with it both branches read both counts, so their exchange is one.
    hits = by_month.where(F.col("year_month").isNotNull() & (F.col("tf") > 0)).join(F.broadcast(top), "word")
    return hits.select("year_month", F.col("df").alias("posts"), "word").orderBy("year_month", "word")


def vocab_topk_by_df(arrays: DataFrame, max_features: int = 200) -> DataFrame:
    return (arrays.select(F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word")
            .agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), F.asc("word")).limit(max_features))

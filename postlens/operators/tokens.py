"""Tokenisation: posts -> (tweet_id, position, token).

The original tool runs a Japanese morphological analyser row by row.  Here the
tokeniser is a regular expression per granularity (A / B / C, see
``functions.patterns``) evaluated by Spark itself; part-of-speech filtering uses
a user-supplied lexicon table ``(word, pos)`` joined in Spark.  With no lexicon
there is no part-of-speech restriction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

POS_ADVERB = "副詞"
# Most allowed words of a lexicon that are a literal of the plan; longer ones are joined.
LEXICON_WORDS = 1 << 16
_SEP = "\u0001"  # no token holds a control character


@dataclass(frozen=True)
class TextOptions:
    mode: str = "C"
    pos_filter: str | None = None
    stopwords: str | Sequence[str] | None = None
    lexicon: DataFrame | None = field(default=None, compare=False, hash=False)


def parse_stopwords(raw: str | Sequence[str] | None) -> list[str]:
    """Newline- or comma-separated words, trimmed, empties dropped."""
    if raw is None:
        return []
    parts = re.split(r"[,\n\r]+", raw) if isinstance(raw, str) else list(raw)
    seen: dict[str, None] = {}
    for p in parts:
        if p and p.strip():
            seen[p.strip()] = None
    return list(seen)


def normalize_pos_filter(raw: str | None) -> list[str]:
    """The classes that a filter text names, in order, each once.

    Rule: no text means the default classes.  Names are what commas, slashes and white
    space separate; an English alias stands for its class.  A text of separators only
    names nothing, which means no restriction.
    """
    if not raw:
        return [*P.DEFAULT_POS]
    names = re.findall(r"[^,/\s]+", raw)
    return [*dict.fromkeys(P.POS_ALIASES.get(n.lower(), n) for n in names)]


def _kept_tokens(opts: TextOptions) -> Column:
    """Array expression of the tokens of ``text`` of two characters or more that are no
    stop-word; one hashed membership test per token, whatever the length of the list."""
    pattern = P.TOKEN_PATTERNS_JAVA[P.token_mode(opts.mode)]
    stop = parse_stopwords(opts.stopwords)
    arr = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(pattern), F.lit(0))
    if stop:
        return F.filter(arr, lambda t: (F.char_length(t) > 1) & ~t.isin(stop))
    return F.filter(arr, lambda t: F.char_length(t) > 1)


def restricts_classes(opts: TextOptions) -> bool:
    """Whether a lexicon drops tokens (the only case that needs a join)."""
    return opts.lexicon is not None and bool(normalize_pos_filter(opts.pos_filter))


def _allowed_words(opts: TextOptions) -> DataFrame:
    """Words that the lexicon lists under an allowed class (a word may have several)."""
    allowed = normalize_pos_filter(opts.pos_filter)
    return opts.lexicon.where(F.col("pos").isin(allowed)).select(F.col("word").alias("_word")).distinct()


def _is_one_of(words: list[str], buckets: list[int], size: int):
    """One-argument test of a token: a literal array of texts, each the words of a bucket of
    hashes between control characters; a token is looked for in its own bucket alone."""
    texts = [""] * size
    for word, bucket in zip(words, buckets):
        texts[bucket] = f"{texts[bucket] or _SEP}{word}{_SEP}"
    table = F.split(F.lit("\u0002".join(texts)), "\u0002")  # the optimiser folds it
    return lambda t: F.get(table, _bucket(t, size)).contains(F.concat(F.lit(_SEP), t, F.lit(_SEP)))


def _bucket(word: Column, size: int) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(size - 1)).cast("int")


def token_arrays(df: DataFrame, opts: TextOptions | None = None, keep: Sequence[str] = ("tweet_id",)) -> DataFrame:
    """One row per post: ``keep`` columns and ``tokens`` (kept tokens in text order,
    empty when none are left).

    This is the working representation of the text operators: counts, document
    frequencies, term filters and vectors are computed from the array of each post
    without shuffling tokens by post.  A lexicon (part-of-speech filter) with up to
    ``LEXICON_WORDS`` allowed words is a hashed literal, in which each post looks its tokens
    up; nothing is shuffled for it.  A longer one needs a
    join: rows that agree in ``keep`` and tokens are counted as one, their tokens
    joined to the allowed words and gathered again, and the row repeated as often as
    it was counted, so no row id is needed and a post stays a post.
    """
    opts = opts or TextOptions()
    rows = df.select(*keep, _kept_tokens(opts).alias("tokens"))
    if not restricts_classes(opts):
        return rows
    words = _allowed_words(opts)
    # Words with a control character equal no token.
    size = max(1, LEXICON_WORDS // 2)  # a power of two
    few = words.where(~F.col("_word").rlike("[\\x01\\x02]")).select("_word", _bucket(F.col("_word"), size)).limit(LEXICON_WORDS + 1).collect()
    if len(few) <= LEXICON_WORDS:
        listed = _is_one_of([r[0] for r in few], [r[1] for r in few], size)
        return rows.withColumn("tokens", F.filter("tokens", listed))
    rows = rows.withColumn("_set", F.sha2(F.concat_ws("\u0000", "tokens"), 256))
    each = rows.groupBy(*keep, "_set").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("_rows"))
    items = each.select(*keep, "_set", "_rows", F.posexplode_outer("tokens").alias("_at", "_token"))
    found = items.join(words, F.col("_token") == F.col("_word"), "left")
    hit = F.when(F.col("_word").isNotNull(), F.struct("_at", "_token"))
    back = found.groupBy(*keep, "_set", "_rows").agg(F.array_sort(F.collect_list(hit)).alias("_hits"))
    return (back.select(*keep, F.transform("_hits", lambda s: s["_token"]).alias("tokens"),
                        F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_nth")).drop("_nth"))


def distinct_tokens(df: DataFrame, opts: TextOptions | None = None, keep: Sequence[str] = ("tweet_id",)) -> DataFrame:
    """The distinct rows of ``keep`` columns and ``token``.

    A post's tokens are told apart where the post is and travel as one text, so the rows of a key meet without a row for each token."""
    texts = (token_arrays(df, opts, keep).where(F.size("tokens") > 0)
             .select(*keep, F.array_join(F.array_distinct("tokens"), _SEP).alias("_t")).repartition(*keep))
    every = F.split(F.array_join(F.collect_set("_t"), _SEP), _SEP)
    return texts.groupBy(*keep).agg(F.array_distinct(every).alias("_t")).select(*keep, F.explode("_t").alias("token"))


def tokenize(df: DataFrame, opts: TextOptions | None = None, keep: Sequence[str] = ("tweet_id",)) -> DataFrame:
    """One row per kept token: ``keep`` columns, ``position`` (0-based among the
    kept tokens of the post) and ``token``.  Tokens of one character, stop-words
    and (with a lexicon) tokens outside the allowed classes are dropped."""
    return token_arrays(df, opts, keep).select(*keep, F.posexplode("tokens").alias("position", "token"))


def benchmark_lexicon(spark, benchmark: DataFrame) -> DataFrame:
    """A (word, pos) lexicon derived from a text table by a stated rule, to exercise
    class filters on the given tables (which carry no part-of-speech data): every C-mode
    word of the texts is a noun if it has an even number of characters and a verb if
    that number is divisible by 3; a word may be both, and others are adverbs."""
    words = F.regexp_extract_all(F.col("text"), F.lit(P.TOKEN_PATTERNS_JAVA["C"]), F.lit(0))
    word, n = F.col("word"), F.char_length("word")
    classes = F.filter(F.array(F.when(n % 2 == 0, F.lit(P.POS_NOUN)), F.when(n % 3 == 0, F.lit(P.POS_VERB)),
                               F.when((n % 2 != 0) & (n % 3 != 0), F.lit(POS_ADVERB))), lambda c: c.isNotNull())
    return benchmark.select(F.explode(words).alias("word")).distinct().select(word, F.explode(classes).alias("pos"))

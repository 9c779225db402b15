"""Column expressions used by the operators.

Everything here is a built-in Spark expression (JVM side, whole-stage codegen);
no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def round_half_up(col: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d.

    Spark's ``round``/``bround`` and other engines differ on decimal ties; this
    formula uses the same IEEE steps everywhere, so every engine gets the same
    bits (the oracle SQL writes the same expression).
    """
    scale = float(10 ** digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def epoch_millis(ts: Column) -> Column:
    """Whole milliseconds since 1970 of a TIMESTAMP_NTZ, independent of the session zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def extract_all(text: Column, pattern: str, needle: str | None = None) -> Column:
    """All matches of ``pattern``; when every match must contain ``needle``, texts
    without it skip the regex (a plain substring search decides)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needle is None:
        return found
    return F.when(F.contains(text, F.lit(needle)), found).otherwise(F.array().cast("array<string>"))


def urls(text: Column) -> Column:
    return extract_all(text, P.URL_PATTERN, "http")


def hashtags(text: Column) -> Column:
    return extract_all(text, P.HASHTAG_PATTERN, "#")


def mentions(text: Column) -> Column:
    return extract_all(text, P.MENTION_PATTERN, "@")


def strip_scheme(url: Column) -> Column:
    return F.regexp_replace(url, F.lit(P.SCHEME_PATTERN), F.lit(""))


def domain_of(url: Column) -> Column:
    """Scheme removed once, then everything before the first '/' (port kept, may be '')."""
    return F.substring_index(strip_scheme(url), "/", 1)


def domains(url_list: Column) -> Column:
    return F.transform(url_list, domain_of)


def strip_query_fragment(url: Column) -> Column:
    """Drop '#...' first, then '?...' (same order as the original)."""
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def is_self_domain(domain: Column, strict: bool = False) -> Column:
    """Domain of the platform itself.  Default: plain suffix test, as in the
    original (so 'netflix.com' ends with 'x.com'); ``strict``: the domain or one
    of its subdomains."""
    low = F.lower(domain)
    if strict:
        alts = "|".join(s.replace(".", r"\.") for s in P.SELF_DOMAIN_SUFFIXES)
        return low.rlike(f"(^|\\.)({alts})$")
    cond = None
    for suffix in P.SELF_DOMAIN_SUFFIXES:
        c = low.endswith(suffix)
        cond = c if cond is None else (cond | c)
    return cond


def contains_code(text: Column) -> Column:
    return text.rlike(P.CODE_PATTERN)


def language_hint(text: Column) -> Column:
    n = F.char_length(text)
    # UTF-8: a text is all ASCII exactly when it has as many bytes as characters.
    ascii_n = F.when(F.octet_length(text) == n, n).otherwise(n - F.regexp_count(text, F.lit(P.NON_ASCII_PATTERN)))
    ratio = ascii_n / F.when(n == 0, F.lit(1)).otherwise(n)
    return F.when(ratio > F.lit(P.ASCII_RATIO_THRESHOLD), F.lit(P.LANG_EN)).otherwise(F.lit(P.LANG_JA))


def emoji_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.EMOJI_CLASS))


def newline_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.NEWLINE_PATTERN))


def iso_week_label(date: Column) -> Column:
    """ISO week as 'GGGG-Www' (ISO week-numbering year)."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def year_month_label(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def weekday_label(weekday: Column) -> Column:
    """Monday=0 .. Sunday=6 to its label via a literal map (no Python per row)."""
    pairs = []
    for i, label in enumerate(P.WEEKDAY_LABELS):
        pairs += [F.lit(i), F.lit(label)]
    return F.element_at(F.create_map(*pairs), weekday.cast("int"))


def float_label(value: Column) -> Column:
    """Text of an integral double as Python prints it ('30.0'), for bin labels."""
    return F.concat(value.cast("bigint").cast("string"), F.lit(".0"))

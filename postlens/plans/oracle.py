"""Independent DuckDB SQL for every value-checked query.

Each string is self-contained: it rebuilds the post views from the base tables
(``events``, ``orders``, ``documents``, ``pages``, ``benchmark``), derives the
post columns with RE2 spellings of the same patterns, and computes the answer
the straightforward way (global sorts, full pair enumeration, exact medians).
"""

from __future__ import annotations

from ..functions import patterns as P

# SQL string literal helper (patterns contain no single quotes).
def _lit(s: str) -> str:
    assert "'" not in s
    return "'" + s + "'"


URL_RE = _lit(P.URL_PATTERN)
TAG_RE = _lit(P.HASHTAG_PATTERN)
MENTION_RE = _lit(P.MENTION_PATTERN)
CODE_RE = _lit(P.CODE_PATTERN)
EMOJI_RE = _lit(P.EMOJI_CLASS)
NON_ASCII_RE = _lit(P.NON_ASCII_PATTERN)
TLD_RE = _lit(P.TLD_PATTERN)

STREAM_POSTS = """
stream_posts AS (
  SELECT CAST(e.event_id AS VARCHAR) AS tweet_id,
         e.ts AS created_at,
         (CASE coalesce(e.event_type, '')
            WHEN 'signup' THEN 'RT @user' || coalesce(CAST(e.user_id AS VARCHAR), '') || ': '
            WHEN 'click' THEN '@user' || coalesce(CAST(e.user_id AS VARCHAR), '') || ' '
            ELSE '' END)
         || coalesce(dd.text, coalesce(e.event_type, '') || ' ' || coalesce(e.props, ''))
         || ' #' || coalesce(e.event_type, '')
         || ' #k' || regexp_extract(coalesce(e.props, ''), '[0-9]+', 0)
         || CASE WHEN pp.url IS NOT NULL THEN ' ' || pp.url ELSE '' END
         || CASE WHEN coalesce(e.event_type, '') = 'purchase'
                 THEN ' https://x.com/u' || coalesce(CAST(e.user_id AS VARCHAR), '') || '/status/'
                      || coalesce(CAST(e.event_id AS VARCHAR), '') || '?s=20' ELSE '' END
         || CASE WHEN coalesce(e.event_type, '') = 'error' THEN ' def import \U0001F600☀' ELSE '' END AS text,
         'https://x.com/u' || coalesce(CAST(e.user_id AS VARCHAR), '') || '/status/'
           || coalesce(CAST(e.event_id AS VARCHAR), '') AS status_url,
         e.user_id AS author_id
  FROM events e
  LEFT JOIN documents dd ON dd.doc_id = e.event_id
  LEFT JOIN pages pp ON pp.page_id = e.event_id
)"""

ARCHIVE_POSTS = """
archive_posts AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS tweet_id,
         o.o_orderdate AS created_at,
         coalesce(dd.text, coalesce(o.o_orderpriority, '') || ' ' || coalesce(o.o_orderstatus, ''))
         || ' #status' || coalesce(o.o_orderstatus, '')
         || ' #p' || substr(coalesce(o.o_orderpriority, ''), 1, 1)
         || CASE WHEN pp.url IS NOT NULL THEN ' ' || pp.url ELSE '' END AS text,
         'https://x.com/c' || coalesce(CAST(o.o_custkey AS VARCHAR), '') || '/status/'
           || coalesce(CAST(o.o_orderkey AS VARCHAR), '') AS status_url,
         o.o_custkey AS author_id
  FROM orders o
  LEFT JOIN documents dd ON dd.doc_id = o.o_orderkey
  LEFT JOIN pages pp ON pp.page_id = o.o_orderkey
)"""


def derived_cte(name: str, source: str) -> str:
    return f"""
{name}_0 AS (
  SELECT tweet_id, created_at, coalesce(text, '') AS text, status_url, author_id FROM {source}
),
{name}_1 AS (
  SELECT *,
    CAST(created_at AS DATE) AS date,
    CAST(year(created_at) AS INTEGER) AS year,
    CAST(month(created_at) AS INTEGER) AS month,
    CAST(isodow(created_at) - 1 AS INTEGER) AS weekday,
    CAST(hour(created_at) AS INTEGER) AS hour,
    CAST(length(text) AS INTEGER) AS text_length,
    regexp_extract_all(text, {URL_RE}, 0) AS urls,
    regexp_extract_all(text, {TAG_RE}, 0) AS hashtag_list,
    regexp_extract_all(text, {MENTION_RE}, 0) AS mention_list,
    starts_with(text, '@') AS is_reply,
    regexp_matches(text, {CODE_RE}) AS contains_code,
    CASE WHEN length(regexp_replace(text, {NON_ASCII_RE}, '', 'g'))
              / (CASE WHEN length(text) = 0 THEN 1 ELSE length(text) END) > 0.6
         THEN 'en-biased' ELSE 'ja-biased' END AS language_hint
  FROM {name}_0
),
{name} AS (
  SELECT *,
    CAST(len(urls) AS INTEGER) AS url_count,
    CAST(len(hashtag_list) AS INTEGER) AS hashtag_count,
    CAST(len(mention_list) AS INTEGER) AS mention_count,
    list_transform(urls, lambda u: split_part(regexp_replace(u, '^https?://', ''), '/', 1)) AS domains
  FROM {name}_1
)"""


def with_posts(body: str, stream: bool = True, archive: bool = False, ctes: str = "") -> str:
    """``WITH <post views>[, <ctes>] <body>``: the derived post views (``sp`` for
    the event posts, ``ap`` for the order posts) plus extra CTEs."""
    parts = []
    if stream:
        parts += [STREAM_POSTS, derived_cte("sp", "stream_posts")]
    if archive:
        parts += [ARCHIVE_POSTS, derived_cte("ap", "archive_posts")]
    if ctes.strip():
        parts.append(ctes.strip().strip(","))
    return "WITH " + ",\n".join(parts) + "\n" + body


def r2(expr: str) -> str:
    return f"(floor(({expr}) * 1e2 + 0.5) / 1e2)"


def r4(expr: str) -> str:
    return f"(floor(({expr}) * 1e4 + 0.5) / 1e4)"

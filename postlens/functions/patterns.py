"""Regular expressions, keyword lists and labels.

The values below must stay as they are for results to agree with the original
tool's behaviour.  Each pattern is written so that the same text works in Java
regex (Spark) and in RE2 (the DuckDB oracle): Unicode word and space classes are
spelled out instead of relying on ``\\w``/``\\s``/``\\b`` whose meaning differs
between the two engines.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the original tool's)
# ---------------------------------------------------------------------------

# Words that mark a post as containing code (case-insensitive, whole words).
CODE_KEYWORDS = ["import", "from", "def", "class", "const", "let", "var", "function", "async", "await"]

# Emoji code-point ranges counted per post: U+2600..U+27BF and U+1F300..U+1FAFF.
EMOJI_CLASS = r"[\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}]"

# ASCII share above which a post is "en-biased", else "ja-biased".
ASCII_RATIO_THRESHOLD = 0.6
LANG_EN = "en-biased"
LANG_JA = "ja-biased"

# Domains counted as self references (plain suffix test, no dot required).
SELF_DOMAIN_SUFFIXES = ["twitter.com", "x.com"]

# Weekday labels, Monday first.
WEEKDAY_LABELS = ["月", "火", "水", "木", "金", "土", "日"]

# Part-of-speech classes.
POS_NOUN = "名詞"
POS_VERB = "動詞"
POS_ADJ = "形容詞"
DEFAULT_POS = [POS_NOUN, POS_VERB, POS_ADJ]
POS_ALIASES = {"noun": POS_NOUN, "verb": POS_VERB, "adj": POS_ADJ, "adjective": POS_ADJ}

# Accepted created_at layouts: "YYYY-MM-DD HH:MM:SS", "YYYY-MM-DD HH:MM", "YYYY-MM-DD".
# Column-role guess: a cell looks like a date when it matches this.
DATE_GUESS_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$"
# Sample size for the column-role guess.
GUESS_SAMPLE_ROWS = 50

# ---------------------------------------------------------------------------
# Character classes (shared Java / RE2 spelling)
# ---------------------------------------------------------------------------

# Unicode word character: letters, letter numbers, marks, decimal digits,
# connector punctuation (incl. "_"), zero-width (non-)joiner.
WORD_CLASS = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}]"
NOT_WORD_CLASS = r"[^\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}]"
# Unicode White_Space = separators (Z*) plus TAB..CR and NEL.
NOT_SPACE_CLASS = r"[^\t\n\x0B\f\r\x{85}\p{Z}]"

URL_PATTERN = r"https?://" + NOT_SPACE_CLASS + "+"
HASHTAG_PATTERN = "#" + WORD_CLASS + "+"
MENTION_PATTERN = "@" + WORD_CLASS + "+"
CODE_PATTERN = (r"(?i)(^|" + NOT_WORD_CLASS + ")(" + "|".join(CODE_KEYWORDS) + ")(" + NOT_WORD_CLASS + "|$)")
NON_ASCII_PATTERN = r"[^\x00-\x7F]"
SCHEME_PATTERN = r"^https?://"
TLD_PATTERN = r"\.([A-Za-z0-9-]+)$"
NEWLINE_PATTERN = r"\n"

# Tokenizer granularities (our rule-based stand-in for a morphological analyser).
#   C: longest runs of letters / marks / digits / underscore
#   B: runs of one script (Han, Hiragana, Katakana + long-vowel mark, Latin, digits)
#   A: as B, but Han runs cut into pieces of at most two characters and Latin
#      words split where a capital letter starts a new word.
TOKEN_PATTERNS_JAVA = {
    "C": r"[\p{L}\p{M}\p{N}_]+",
    "B": r"\p{IsHan}+|\p{IsHiragana}+|[\p{IsKatakana}ー]+|[\p{IsLatin}\p{M}]+|\p{N}+",
    "A": r"\p{IsHan}{1,2}|\p{IsHiragana}+|[\p{IsKatakana}ー]+|\p{Lu}?[\p{Ll}\p{M}]+|\p{Lu}+|\p{N}+",
}
TOKEN_PATTERNS_RE2 = {
    "C": r"[\p{L}\p{M}\p{N}_]+",
    "B": r"\p{Han}+|\p{Hiragana}+|[\p{Katakana}ー]+|[\p{Latin}\p{M}]+|\p{N}+",
    "A": r"\p{Han}{1,2}|\p{Hiragana}+|[\p{Katakana}ー]+|\p{Lu}?[\p{Ll}\p{M}]+|\p{Lu}+|\p{N}+",
}


def token_mode(mode: str | None) -> str:
    """A / B select the finer granularities; anything else is C."""
    return mode if mode in ("A", "B") else "C"

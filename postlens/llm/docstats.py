"""Per-text statistics, computed slice by slice over whole texts.

A null text counts as empty.  Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textarrays as ta

#: Counts of :func:`counts`, in order.
COUNTS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
          "n_distinct_words", "n_upper", "n_digits", "n_punct", "n_marks", "n_long_words", "n_title_words"]

#: Features of :func:`features`, in order.
FEATURES = ["log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share",
            "upper_share", "digit_share", "punct_per_word", "marks_per_word", "long_word_share", "title_share",
            "log_words_per_line"]


def _lut(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars.encode())] = True
    return t


_SYMBOLS = _lut("#*$%&|<>")
_DIGITS = _lut("0123456789")
_PUNCT = _lut(".,;:'\"()-")
_MARKS = _lut("!?")
_UPPER = _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LONG_WORD_BYTES = 20


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _keys(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    return hashes ^ ta.mix64(text.astype(np.uint64) + np.uint64(1))


def counts(s: ta.Slice) -> np.ndarray:
    """int64 matrix, a row for each text and a column for each of ``COUNTS``."""
    buf, offsets = s.buf, s.offsets
    n = len(offsets) - 1
    out = np.zeros((n, len(COUNTS)), dtype=np.int64)
    heads = (buf & 0xC0) != 0x80
    w = ta.words(buf, offsets)
    n_words = np.diff(w.ptr)
    n_chars = _per_text(heads, offsets)
    out[:, 0] = n_chars
    out[:, 1] = n_words
    out[:, 2] = n_chars - _per_text(ta._SPACE[buf], offsets)
    out[:, 3] = _per_text(_SYMBOLS[buf], offsets)

    # Lines: cut at \n and at text ends; those without a word are left out.
    breaks = np.flatnonzero(buf == 0x0A)
    line_starts = np.union1d(offsets[:-1], breaks + 1)
    line_starts = line_starts[line_starts < len(buf)]
    line_ends = np.append(line_starts[1:], len(buf))
    line_ends = line_ends - (buf[line_ends - 1] == 0x0A) if len(line_ends) else line_ends
    first_word = np.searchsorted(w.starts, line_starts)
    has_word = np.searchsorted(w.starts, line_ends) > first_word
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    if len(line_starts):
        text = np.searchsorted(offsets, line_starts, "right") - 1
        _, first = np.unique(_keys(ta.span_hashes(buf, line_starts, line_ends), text), return_index=True)
        lines = np.bincount(text, minlength=n)
        out[:, 4] = lines
        out[:, 5] = lines - np.bincount(text[first], minlength=n)

    if len(w.starts):
        hashes = ta.span_hashes(buf, w.starts, w.ends)
        text = ta.owner(w.ptr)
        _, first = np.unique(_keys(hashes, text), return_index=True)
        out[:, 7] = np.bincount(text[first], minlength=n)
        grams, gptr = ta.windows(hashes, w.ptr, 3)
        if len(grams):
            gtext = ta.owner(gptr)
            keys = _keys(grams, gtext)
            order = np.argsort(keys)
            ranked = keys[order]
            same = ranked[1:] == ranked[:-1]
            again = np.zeros(len(keys), dtype=bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            at = np.flatnonzero(again)
            at = at + (w.ptr[:-1] - gptr[:-1])[gtext[at]]
            covered = np.zeros(len(hashes), dtype=bool)
            for k in range(3):
                covered[at + k] = True
            out[:, 6] = ta.sums(covered, w.ptr)
        out[:, 12] = ta.sums((w.ends - w.starts) > LONG_WORD_BYTES, w.ptr)
        out[:, 13] = ta.sums(_UPPER[buf[w.starts]], w.ptr)
    out[:, 8] = _per_text(_UPPER[buf], offsets)
    out[:, 9] = _per_text(_DIGITS[buf], offsets)
    out[:, 10] = _per_text(_PUNCT[buf], offsets)
    out[:, 11] = _per_text(_MARKS[buf], offsets)
    return out


def batch_counts(texts: pa.Array) -> np.ndarray:
    parts = [counts(s) for s in ta.slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), dtype=np.int64)


def features(c: np.ndarray) -> np.ndarray:
    """float64 matrix of ``FEATURES`` from a matrix of ``COUNTS``; finite for empty texts too."""
    c = c.astype(np.float64)
    col = {name: c[:, i] for i, name in enumerate(COUNTS)}
    words, chars, lines = (np.maximum(col[x], 1) for x in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([
        np.log1p(col["n_words"]), col["word_chars"] / words, col["n_symbols"] / words, col["n_dup_lines"] / lines,
        col["n_repeat_words"] / words, col["n_distinct_words"] / words, col["n_upper"] / chars, col["n_digits"] / chars,
        col["n_punct"] / words, col["n_marks"] / words, col["n_long_words"] / words, col["n_title_words"] / words,
        np.log1p(col["n_words"] / lines)])

"""Small tables and brute-force versions shared by the tests."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text[, source])"""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def shingles(text, width):
    w = words(lower(text))
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(zip(*(w[k:] for k in range(width))))


#: Nulls, empty and very long texts, ties, repeated rows, ids given twice.
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "one two", "b"), (6, "One TWO", None),
    (7, "x " * 30_000, "c"), (8, "é ü 日本 語　です " * 40, "c"), (9, "tie tie tie", "a"), (10, "tie tie tie", "a"),
    (10, "tie tie tie", "a"), (11, "other text of the same id", "b"), (11, "and a second one", "b"), (None, "No Id here", "a"),
    (None, None, None), (12, "<|endoftext|> \u0085 \U0001F600 $$$ ###", "zz"), (13, "a\nb\n\na\nb\n", "a"),
]


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))

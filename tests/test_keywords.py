"""All terms of a dictionary in one search of each text."""
import random
import re

from postlens.operators import tags as TG

from conftest import make_posts


def _brute(texts, entries):
    out = [(label, sum(any(t.lower() in x.lower() for t in terms) for x in texts), i) for i, (label, terms) in enumerate(entries)]
    return [(a, n) for a, n, _ in sorted(out, key=lambda r: (-r[1], r[2]))]


def _check(spark, texts, entries):
    posts = make_posts(spark, [(str(i), None, t, None) for i, t in enumerate(texts)])
    assert [tuple(r) for r in TG.keyword_category_counts(posts, entries).collect()] == _brute(texts, entries)


def test_overlaps_prefixes_and_special_characters(spark):
    entries = [("prefix", ["ab"]), ("long", ["abcd", "ABCDE"]), ("inner", ["bc"]), ("signs", [".*", "[x]", "\\E", "a|b", "(", "^$", "?"]), ("same", ["ab"]),
               ("kana", ["天気", "天", "気です"]), ("astral", ["\U0001F600"]), ("none", ["zzzz"]), ("break", ["a\nb"]), ("space", [" "])]
    texts = ["abcde", "xABc", "a.c", "a.*c", "[x]", "a\\Eb", "a|b(", "今日は天気です", "天", "x\U0001F600y", "a\nb", "", "ab cd", "aab", "abc", "気です", "^$?"]
    _check(spark, texts, entries)


def test_a_thousand_terms(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzäöü天気0.-") for _ in range(r.randint(2, 6)))
    entries = [(f"c{i}", [word() for _ in range(50)]) for i in range(20)]
    texts = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(120)]
    _check(spark, texts, entries)


def test_pattern_takes_the_longest_term_at_each_place():
    pattern = TG.terms_pattern(["a", "ab", "abcd", "bc", "z"])
    plain = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern))
    assert [m[1] for m in plain.finditer("abcabcdz")] == ["ab", "bc", "abcd", "bc", "z"]

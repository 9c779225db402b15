"""Answers must not depend on list lengths, settings, splits or ids."""
import itertools
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, make_posts
from postlens.operators import gaps as GP
from postlens.operators import pairs as PR
from postlens.operators import tags as TG
from postlens.operators import tokens as TK
from postlens.plans import catalog
from postlens.sources import csv_ingest as CSV
from postlens.streaming.ingest import start_ingest

ID_ROWS = [("1", ["a", "b", "c"]), ("1", ["a", "b"]), ("2", ["a", "c"]), (None, ["a", "b"]), (None, ["b", "c"]), (None, [])]


def _brute_pairs(rows, least):
    n = {}
    for _, items in rows:
        for p in itertools.combinations(sorted(set(items)), 2):
            n[p] = n.get(p, 0) + 1
    return sorted((-v, *p) for p, v in n.items() if v >= least)


@pytest.mark.parametrize("inline", [1024, 0])
@pytest.mark.parametrize("top_n, least", [(50, 1), (50, 2), (None, 1), (None, 2), (1_000_000, 2)])
def test_pairs_count_rows_not_ids(spark, monkeypatch, inline, top_n, least):
    monkeypatch.setattr(PR, "INLINE_ITEMS", inline)
    df = spark.createDataFrame(ID_ROWS, "tweet_id string, tokens array<string>")
    got = [(-r["count"], r["a"], r["b"]) for r in PR.top_pairs(df, "tweet_id", "tokens", top_n, least, chunk=2).collect()]
    assert got == _brute_pairs(ID_ROWS, least)


TEXTS = [("1", "the cat and the dog"), ("1", "the cat and the dog"), ("2", "the the"), (None, "dog cat bird"), (None, None)]


def test_long_and_short_stop_lists_agree(spark):
    df = spark.createDataFrame(TEXTS, "tweet_id string, text string")
    padding = [f"zz{k}" for k in range(500)]
    for words in (["the"], ["the", "and"]):
        short, long = TK.TextOptions(stopwords=words), TK.TextOptions(stopwords=words + padding)
        a, b = (sorted(map(str, TK.tokenize(df, o).collect())) for o in (short, long))
        assert a == b and "position=0, token='cat'" in a[0]
        a, b = (sorted(map(str, TK.token_arrays(df, o).collect())) for o in (short, long))
        assert a == b and len(a) == len(TEXTS)


def test_lexicon_with_two_classes_keeps_every_post(spark):
    df = spark.createDataFrame(TEXTS, "tweet_id string, text string")
    lex = spark.createDataFrame([("cat", TK.P.POS_NOUN), ("cat", TK.P.POS_VERB), ("dog", TK.POS_ADVERB), ("bird", TK.P.POS_VERB)], "word string, pos string")

    def tokens(pos):
        rows = TK.token_arrays(df, TK.TextOptions(lexicon=lex, pos_filter=pos)).collect()
        assert len(rows) == len(TEXTS)
        return sorted(r["tokens"] for r in rows)

    assert tokens("noun") == [[], [], ["cat"], ["cat"], ["cat"]]
    assert tokens("verb") == [[], [], ["cat"], ["cat"], ["cat", "bird"]]
    assert tokens("noun/verb") == tokens("verb")


@pytest.mark.parametrize("setting", ["spark.sql.exchange.reuse", "spark.sql.adaptive.enabled"])
def test_intervals_do_not_depend_on_settings(spark, setting):
    names = ["interval_lag", "interval_lag_by_author", "session_ids", "posting_interval_summary"]
    want = {n: sorted(map(str, catalog.QUERIES[n](spark, SF_SMALL).collect())) for n in names}
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "false")
        assert want == {n: sorted(map(str, catalog.QUERIES[n](spark, SF_SMALL).collect())) for n in names}
    finally:
        spark.conf.set(setting, before)


def test_posts_without_author(spark):
    rows = [(str(i), f"2024-01-0{1 + i % 7} 0{i % 10}:00:0{i % 9}", "t", None, None if i < 400 else i % 5) for i in range(450)]
    df = make_posts(spark, rows, with_author=True)
    gaps = [r["diff_ms"] for r in GP.ordered_gaps(df, by="author_id", num_partitions=4).collect()]
    assert len(gaps) == 450 and gaps.count(None) == 6 and min(g for g in gaps if g is not None) >= 0


def test_keyword_rules():
    parse = TG.parse_keyword_dictionary
    assert parse("a：b:c,d") == [("a：b", ["c", "d"])]  # the ASCII colon wins
    assert parse("a: b：c") == [("a", ["b：c"])]
    assert parse(": x\nlabel:\nlabel: ,、\nplain") == [] == parse(None)
    assert parse("a: x\nb: y\na: z") == [("a", ["z"]), ("b", ["y"])]


def test_class_filter_rules():
    n = TK.normalize_pos_filter
    assert n(None) == n("") == TK.P.DEFAULT_POS
    assert n(" , / ") == [] and n("Noun, verb/noun") == [TK.P.POS_NOUN, TK.P.POS_VERB] and n("副詞") == ["副詞"]


# ---- CSV --------------------------------------------------------------------------

def _archive(path, encoding, rows):
    with open(path, "wb") as f:
        for r in rows:
            f.write((",".join('"' + v.replace('"', '""') + '"' for v in r) + "\n").encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", ["shift_jis", "euc_jp", "utf-8"])
def test_encoding_is_decided_over_the_whole_file(spark, tmp_path, encoding):
    before = {k: spark.conf.get(k, None) for k in CSV._LEGACY}
    spark.conf.set("spark.sql.legacy.javaCharsets", "false")
    rows = [(f"12345678900{i:02d}", "2024-01-05 10:11:12", f"plain ascii post number {i}" if i < 80 else f"今日は良い天気です、{i} カタカナ", f"https://x.com/s/{i}") for i in range(100)]
    got = {r["tweet_id"]: r["text"] for r in CSV.read_posts_csv(spark, _archive(tmp_path / "a.csv", encoding, rows)).collect()}
    assert got == {r[0]: r[2] for r in rows}
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"
    spark.conf.set("spark.sql.legacy.javaCharsets", before["spark.sql.legacy.javaCharsets"] or "false")


def test_one_large_file_is_split_also_inside_quotes(spark, tmp_path):
    rows = [(f"{10_000_000_000 + i}", "2024-01-05 10:11:12", f"line one of {i}\n\n\"quoted\", line, three\r\n" + "x" * (i % 97), f"https://x.com/s/{i}") for i in range(4000)]
    path = _archive(tmp_path / "big.csv", "utf-8", rows)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert CSV._lines(spark, path).rdd.getNumPartitions() > 5
        got = {r["tweet_id"]: r["text"] for r in CSV.read_posts_csv(spark, path).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {r[0]: r[2] for r in rows}


def test_headers_of_several_files(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    head = ("text", "created_at", "tweet_id", "status_url")
    for k in range(3):
        _archive(tmp_path / "in" / f"{k}.csv", "utf-8", [head, (f"a post with some text {k}", "2024-01-05", f"123456789{k}0", "https://x.com/1")])
    assert sorted(r["text"] for r in CSV.read_posts_csv(spark, str(tmp_path / "in")).collect()) == [f"a post with some text {k}" for k in range(3)]


# ---- streaming --------------------------------------------------------------------

def test_restart_and_tables_of_one_name(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    _archive(tmp_path / "in" / "1.csv", "utf-8", [(f"12345678900{i:02d}", "2024-01-05 10:11:12", f"post number {i} with text", f"https://x.com/s/{i}") for i in range(12)])
    for folder in ("one", "two"):
        table = str(tmp_path / folder / "posts")
        for session in (spark, spark.newSession()):  # the second start finds the first one's progress
            start_ingest(session, str(tmp_path / "in"), table).awaitTermination(120)
            assert spark.read.parquet(table).agg(F.count("*")).head()[0] == 12

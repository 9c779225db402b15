"""Language filters, conversation trie and dataset manifest against brute force and SQL."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import conversation_trie, dataset_manifest, language_id
from postlens.llm.sqltext import crc32_sql

from .helpers import ODD, SCHEMA, documents, words

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(i):
    return zlib.crc32(str(i).encode())


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def test_crc32_in_sql_is_that_of_zlib():
    ids = [0, 7, -3, 12345, 10 ** 15]
    got = duckdb.sql(f"SELECT i, {crc32_sql('i::VARCHAR')} FROM (SELECT unnest({ids}) AS i)").fetchall()
    assert got == [(i, crc(i)) for i in ids]
    assert duckdb.sql(f"SELECT {crc32_sql('NULL::VARCHAR')}").fetchall() == [(None,)]


# ---- 11 language identification ----------------------------------------------------

def plain_grams(text):
    t = text.lower()
    at = lambda k: t[k] if 0 <= k < len(t) and t[k].isalpha() else " "
    return {(at(k - 1), c, at(k + 1), at(k + 2) if at(k + 1) != " " else " ") for k, c in enumerate(t) if c.isalpha()}


def test_grams_are_those_of_a_plain_loop():
    texts = [r[1] or "" for r in ODD] + ["Ça va? OK", "a", "ab", "İstanbul ẞ", "x1y2", " é", "\U0001F600z"]
    grams, text = language_id.letter_grams(texts)
    names = {}
    for i, t in enumerate(texts):
        own = grams[text == i].tolist()
        assert len(own) == len(set(own)) == len(plain_grams(t))
        for g in own:
            names.setdefault(g, set()).add(i)
    for a in range(len(texts)):
        for b in range(a):
            shared = sum({a, b} <= where for where in names.values())
            assert shared == len(plain_grams(texts[a]) & plain_grams(texts[b]))
    assert len(language_id.letter_grams([])[0]) == 0


def test_filter_returns_every_language_of_a_gram(spark):
    """70 languages, so that bits pass the first word; no false negatives, few false positives."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(70):
        for copy in range(3):
            rows.append((k * 10 + copy, " ".join(alphabet[(k * 7 + j * 3) % 26] + alphabet[(k + j) % 26] + alphabet[k % 26] for j in range(8)) + (" common" if k % 2 else ""), f"l{k:02d}", "s", None))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = language_id.learn(docs, F.lit(True))
    assert found.languages == [f"l{k:02d}" for k in range(70)] and found.documents == [3] * 70
    holders = collections.defaultdict(set)
    for _, text, lang, *_ in rows:
        for g in language_id.letter_grams([text])[0].tolist():
            holders[g].add(int(lang[1:]))
    grams = np.array(list(holders), dtype=np.uint64)
    bits = language_id.languages_of(found.masks, grams)
    wrong = 0
    for g, b in zip(grams.tolist(), bits):
        got = {k for k in range(70) if int(b[k >> 6]) >> (k & 63) & 1}
        assert holders[g] <= got
        wrong += len(got - holders[g])
    assert wrong <= 5


def test_decision_equals_exact_sets(spark):
    """The filter decides as sets of grams do, counted without a filter."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = [r for r in docs.collect() if crc(r.doc_id) % 4 != 2 and r.lang is not None]
    df, n = collections.defaultdict(collections.Counter), collections.Counter()
    for r in learned:
        n[r.lang] += 1
        df[r.lang].update(plain_grams(r.text or ""))
    sets = {lang: {g for g, c in df[lang].items() if c >= max(1, language_id.SHARE * n[lang])} for lang in sorted(n)}
    for r in language_id.query(spark, SF).join(docs.select("doc_id", "text"), "doc_id").collect():
        own = plain_grams(r.text or "")
        counts = {lang: len(own & s) for lang, s in sets.items()}
        assert r.held_out == (crc(r.doc_id) % 4 == 2)
        if own:
            assert counts[r.lang_pred] == max(counts.values())
            assert abs(r.score - counts[r.lang_pred] / sum(counts.values())) < 0.01


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in language_id.query(spark, sf).collect() if r.held_out]
    assert len(got) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.98 * len(got)


def test_odd_rows_of_language_id(spark):
    docs = documents(spark, [*ODD, (20, "12 -- 34"), (24, "ω"), (22, "zzzz qqqq")]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.lit("en")))
    docs = docs.withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x")).withColumn("code", F.lit("y"))
    found = language_id.learn(docs, F.col("doc_id").isNotNull())
    got = language_id.predict(docs, found, ["doc_id"]).collect()
    assert len(got) == len(ODD) + 3
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i in (1, 2, 3, 20):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert (by_id[24].lang_pred, by_id[24].score) == ("en", 0.0) and by_id[9].lang_pred == "en" and by_id[9].score == 1.0
    nothing = language_id.learn(docs, F.lit(False))
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, nothing, ["doc_id"]).collect()} == {("und", 0.0)}
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.predict(empty, language_id.learn(empty, F.lit(True)), ["doc_id"]).collect() == []


# ---- 12 conversation prefix trie ----------------------------------------------------

def brute_trie(sequences):
    """sequences: {conv_id: [(role, text)]}"""
    nodes = collections.defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[:len(prefix)] == prefix]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in nodes)
        saved = sum((len(nodes[p]) - 1) * (len(words(p[-1][1])) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(sequences[c]) == len(prefix)))
        out.append((min(members), len(prefix), sha(ends), sum(len(p) == len(prefix) + 1 for p in below), len(members), sum(map(leaf, below)),
                    min(nodes[prefix[:-1]]) if prefix else None, saved))
    return sorted(out, key=repr)


def brute_rebuilt(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), role, sha(f"{len(role.encode())}:{role}{text}"), text))
    plain = {c: [(r, x) for _, r, _, x in sorted(t)] for c, t in convs.items()}
    return {c: plain.get(c - c % 20, [])[:crc(c) % 4] + s[crc(c) % 4:] for c, s in plain.items()}


def a_conversation_table(n):
    rng = np.random.default_rng(n)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t, ["user", "assistant"][t % 2], f"words {rng.integers(0, 3)} of turn" + " more" * int(rng.integers(0, 2))))
    for c in range(n, n + n // 2):  # a third are the same
        rows += [(c, 0, "user", "the same"), (c, 1, "assistant", "to the end"), (c, 2, "user", "and again"), (c, 3, "assistant", "bye")]
    return rows


ODD_TURNS = [
    (1, 0, "user", "hello there"), (1, 1, "assistant", None), (2, None, "user", "x"), (2, 1, None, "hello there"), (2, 1, None, "hello there"),
    (3, 0, None, None), (None, 0, "user", "nobody's"), (None, None, None, None), (20, 5, "user", "a\u0085b \U0001F600 \n c"), (25, 1, "user", "late"), (25, 1, "tool", "late"),
    (25, 1, "user", "early"), (26, 0, "us", "erx"), (27, 0, "user", "x"), (-7, 0, "user", "negative"), (40, 0, "user", "long " * 30_000), (41, 0, "user", "long " * 30_000),
    *((60, t, "user", f"turn {t % 3}") for t in range(300)), *((61, t, "user", f"turn {t % 3}") for t in range(280)),
]


@pytest.mark.parametrize("shard_turns", [1, 7, 1 << 18])
@pytest.mark.parametrize("name", ["many", "odd"])
def test_trie_matches_brute_force_and_sql(spark, name, shard_turns):
    rows = a_conversation_table(90) if name == "many" else ODD_TURNS
    table = spark.createDataFrame(rows, TURNS)
    clashing = table.withColumn("path", F.lit(1)).withColumn("key", F.lit("k")).withColumn("family", F.lit(2)).withColumn("words", F.lit(None))
    got = rows_of(conversation_trie.trie(conversation_trie.rebuilt(clashing), shard_turns))
    assert got == brute_trie(brute_rebuilt(rows))
    if shard_turns == 7:
        assert got == sql_rows(conversation_trie.ORACLE_SQL, conversations=table)


def test_trie_of_conversations_as_they_are(spark):
    rows = a_conversation_table(30)
    plain = collections.defaultdict(list)
    for c, _, role, text in rows:
        plain[c].append((role, text))
    assert rows_of(conversation_trie.trie(conversation_trie.plain(spark.createDataFrame(rows, TURNS)), 5)) == brute_trie(plain)
    assert conversation_trie.trie(conversation_trie.plain(spark.createDataFrame([], TURNS))).collect() == []


def test_median_insertion_balances_the_tree():
    assert sorted(conversation_trie.medians_first(100)) == list(range(100)) and list(conversation_trie.medians_first(0)) == []
    tree = conversation_trie.Ternary()
    for k in conversation_trie.medians_first(1023):
        tree.insert([k, 5])
    deepest, open_ = 0, [(tree.down[0], 1)]
    while open_:
        at, depth = open_.pop()
        if at >= 0:
            deepest = max(deepest, depth)
            open_ += [(tree.lower[at], depth + 1), (tree.higher[at], depth + 1)]
    assert deepest == 10 and len(tree.code) == 1 + 2 * 1023


# ---- 13 dataset manifest -------------------------------------------------------------

def brute_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    def leaf(r, text):
        values = [r[0], r[3], r[2], r[4], text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(digests):
        out = [digests]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k:k + 8])) for k in range(0, len(out[-1]), 8)])
        return out

    def siblings(tree, at):
        out = []
        for level in tree[:-1]:
            run = at // 8 * 8
            out.append((level[run:at], level[at + 1:run + 8]))
            at //= 8
        return out

    by_lang = collections.defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([e[2] for e in sorted(by_lang[x], key=lambda e: e[:3])]) for x in names}
    crown = levels([trees[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for at, (_, _, digest, r) in enumerate(sorted(by_lang[x], key=lambda e: e[:3])):
            proof = siblings(trees[x], at) + siblings(crown, k)
            low = r[1] if r[0] is None or crc(r[0]) % 3 or r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            acc = leaf(r, low)
            for left, right in proof:
                acc = sha("".join([*left, acc, *right]))
            out.append((r[0], acc, digest, sha("".join("".join(a + b) for a, b in proof)), crown[-1][0], trees[x][-1][0], acc == crown[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(name):
    if name == "odd":
        return [(i, t, None if k % 4 == 0 else ("ü" if k % 4 == 1 else "z" * (k % 3)), s, None if t is None else len(t)) for k, (i, t, s) in enumerate(ODD)]
    if name == "one":
        return [(5, "A single Row", None, "s", 12)]
    if name == "languages":
        return [(i, f"Text {i}", f"l{i % 70}", None, i) for i in range(75)]
    sizes = {"en": 600, "de": 513, "fr": 65, "es": 9, None: 1}
    return [(k * 1000 + i, f"Some TEXT {i % 50}", lang, "s", 3) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)] + [(7, "copy", "en", "s", 1)] * 3


@pytest.mark.parametrize("name", ["odd", "one", "languages", "sizes"])
def test_manifest_matches_brute_force_and_sql(spark, name):
    rows = manifest_rows(name)
    docs = spark.createDataFrame(rows, SCHEMA)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    clashing = docs.withColumn("tree", F.lit("t")).withColumn("idx", F.lit(0)).withColumn("digest", F.lit("x")).withColumn("said", F.lit(1))
    got = rows_of(dataset_manifest.audited(clashing, tampered))
    assert got == brute_manifest(rows)
    assert got == sql_rows(dataset_manifest.ORACLE_SQL, documents=docs)


def test_empty_manifest(spark):
    assert dataset_manifest.audited(spark.createDataFrame([], SCHEMA), F.lit(False)).collect() == []


def test_every_third_level_is_stored_and_any_block_proves(spark):
    leaves = spark.range(1200).select(F.lit("t").alias("tree"), "id", dataset_manifest.digest(F.col("id").cast("string")).alias("digest"))
    built = dataset_manifest.build(dataset_manifest.numbered(leaves, "tree", ["id"]), ["id"])
    assert [s.agg(F.sum(F.size("nodes"))).head()[0] for s in built.stored] == [1200, 3, 1]
    only = built._replace(stored=[built.stored[0].where("block = 2"), *built.stored[1:]])
    got = dataset_manifest.proofs(only, ["id"]).withColumn("root", dataset_manifest.folded(F.col("digest"), F.col("proof"))).collect()
    assert sorted(r.id for r in got) == list(range(1024, 1200)) and {r.root for r in got} == {built.tops.head()["top"]}
    assert {len(r.proof) for r in got} == {4}

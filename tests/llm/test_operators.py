"""Every operator against brute force, and on odd rows."""

import collections
import hashlib
import os
import random
import re
import weakref

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from postlens.llm import (bpe_chunks, components, docstats, html_extraction, license_scan, merkle_fingerprints, ngram_join,
                          quality_classifier, quality_rules, registry, source_mixing, substring_dedup, textarrays, token_counts)

from .helpers import ODD, SCHEMA, documents, lower, prose, shingles, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def clashing(docs):
    """Extra columns with the names that operators give to their own."""
    for c in ("score", "size", "row", "n", "cls", "id", "h", "key", "token", "predicted", "unit", "_0"):
        docs = docs.withColumn(c, docs["lang"])
    return docs


# ---- text arrays ------------------------------------------------------------------

def test_words_and_hashes_do_not_depend_on_the_slice():
    import pyarrow as pa

    texts = [r[1] for r in ODD]
    for size in (1, 50, 1 << 20):
        got, seen = [], {}
        for s in textarrays.slices(pa.array(texts), size):
            w = textarrays.words(s.buf, s.offsets)
            raw, h = s.buf.tobytes(), textarrays.span_hashes(s.buf, w.starts, w.ends)
            for i in range(len(s.offsets) - 1):
                own = [raw[a:b].decode() for a, b in zip(w.starts[w.ptr[i]:w.ptr[i + 1]], w.ends[w.ptr[i]:w.ptr[i + 1]])]
                got.append(own)
                for x, y in zip(own, h[w.ptr[i]:w.ptr[i + 1]].tolist()):
                    assert seen.setdefault(x, y) == y
        assert got == [words(t) for t in texts]
        assert len(set(seen.values())) == len(seen)


# ---- 1 substring dedup ------------------------------------------------------------

def test_compact_windows_are_the_large_nodes_of_the_cartesian_tree():
    rng = np.random.default_rng(1)
    for trial in range(60):
        ptr = np.concatenate([[0], np.cumsum(rng.integers(0, 60, size=5))])
        f = rng.integers(0, 1 << 63, size=ptr[-1], dtype=np.uint64) if trial % 2 else rng.integers(0, 8, size=ptr[-1]).astype(np.uint64) << np.uint64(40)
        least = int(rng.integers(2, 20))
        expected = set()
        for d in range(5):
            for k in range(ptr[d], ptr[d + 1]):
                a = b = k
                while a - 1 >= ptr[d] and f[a - 1] > f[k]:
                    a -= 1
                while b + 1 < ptr[d + 1] and f[b + 1] >= f[k]:
                    b += 1
                if b - a + 1 >= least:
                    expected.add((k, a, b))
        assert expected == set(zip(*(x.tolist() for x in substring_dedup.compact_windows(f, ptr, least))))


def test_spans_reach_the_similarity():
    m = np.ones(100, dtype=bool)
    assert substring_dedup.spans_of(m) == [(0, 100)]
    m[50:55] = False  # one edited word
    assert substring_dedup.spans_of(m) == [(0, 100)]
    m[20:80] = False
    assert substring_dedup.spans_of(m) == []


def test_repeated_passages_are_found_and_cut(spark):
    shared, near = prose(1, 60), prose(2, 120).split()
    edited = near[:60] + ["changed"] + near[61:]
    rows = [(1, prose(3, 80) + " " + shared + " " + prose(4, 70)), (2, shared.upper()), (3, prose(5, 90) + "\n" + shared),
            (4, prose(6, 40) + " " + " ".join(near)), (5, " ".join(edited) + " " + prose(7, 30)), (6, prose(8, 400)),
            (7, prose(9, 30) + " " + " ".join(shared.split()[:40]))]
    docs = documents(spark, rows)
    found = {r.doc_id: r for r in substring_dedup.report(docs).collect()}
    assert set(found) == {2, 3, 5}
    assert (found[2].start_word, found[2].end_word, found[2].source_doc_id) == (0, 60, 1)
    assert (found[3].start_word, found[3].end_word) == (90, 150) and found[3].source_doc_id in (1, 2)
    assert (found[5].start_word, found[5].end_word, found[5].source_doc_id) == (0, 120, 4)
    left = {r.doc_id: r for r in substring_dedup.without_repeats(docs).collect()}
    assert left[2].text == "" and left[3].text == prose(5, 90) + "\n" and left[5].text == prose(7, 30)
    assert all(left[i].text == t for i, t in rows if i not in found) and all(r.n_chars == len(r.text) for r in left.values())


def test_exact_repeats_of_the_corpus_are_found(spark, corpus):
    rows = sorted((r.doc_id, words(lower(r.text))) for r in corpus.collect())
    first, truth = {}, collections.defaultdict(set)
    for i, w in rows:
        for k in range(len(w) - 49):
            owner = first.setdefault(tuple(w[k:k + 50]), i)
            if owner != i:
                truth[i] |= set(range(k, k + 50))
    got = collections.defaultdict(set)
    by_id = dict(rows)
    for r in substring_dedup.report(corpus).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
        assert r.source_doc_id < r.doc_id and r.n_words >= 50
        span, source = " ".join(by_id[r.doc_id][r.start_word:r.end_word]), " ".join(by_id[r.source_doc_id])
        a, b = shingles(span, 5), shingles(source, 5)
        assert len(a & b) >= 0.8 * len(a)
    assert set(truth) <= set(got)
    assert sum(len(truth[i] - got[i]) for i in truth) <= 0.01 * sum(map(len, truth.values()))


def repeated_words(rows):
    """Words of exact passages of 50 or more words that an earlier document has: {(id, place)}."""
    first, out = {}, set()
    for i, t in sorted(rows):
        w = words(lower(t))
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k:k + 50]), i) != i:
                out |= {(i, j) for j in range(k, k + 50)}
    return out


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_repeats_among_stock_lines_match_brute_force(spark, parts):
    import random

    r = random.Random(8)
    lines = [prose(1000 + k, 10) for k in range(30)]
    texts = [r.sample(lines, 12) for _ in range(240)]
    for k in range(0, 60, 2):  # passages of six lines that only two texts share
        at, there = r.randrange(7), r.randrange(7)
        texts[239 - k][at:at + 6] = texts[100 + k][there:there + 6]
    rows = [(k, "\n".join(t)) for k, t in enumerate(texts)]
    truth = repeated_words(rows)
    assert len({i for i, _ in truth}) >= 25
    found = substring_dedup.report(documents(spark, rows).repartition(parts)).collect()
    assert truth <= {(x.doc_id, j) for x in found for j in range(x.start_word, x.end_word)}
    by_id = dict(rows)
    for x in found:
        span = shingles(" ".join(words(by_id[x.doc_id])[x.start_word:x.end_word]), 5)
        assert x.source_doc_id < x.doc_id and len(span & shingles(by_id[x.source_doc_id], 5)) >= 0.8 * len(span)


@pytest.mark.parametrize("parts", [1, 4])
def test_a_variant_between_the_first_and_the_previous_is_found(spark, parts):
    passage = prose(31, 100).split()

    def variant(k):  # every twelfth word another
        return " ".join(f"other{k}x{j}" if (j + k) % 12 == 0 else w for j, w in enumerate(passage))

    rows = [(k, prose(100 + k, 30) + " " + variant(k)) for k in range(1, 25)]
    rows += [(12.5, prose(99, 40) + " " + " ".join(passage)), (30, " ".join(passage) + " " + prose(98, 30))]
    rows = [(int(2 * k), t) for k, t in rows]
    found = {x.doc_id: x for x in substring_dedup.report(documents(spark, rows).repartition(parts)).collect()}
    assert (found[60].source_doc_id, found[60].start_word, found[60].end_word) == (25, 0, 100)


def test_strips_are_made_from_the_texts_again(spark):
    """The table of all windows has no strips; those of classes are the token hashes near their centres."""
    rows = substring_dedup.keyed(documents(spark, [(1, prose(1, 80)), (2, prose(2, 300)), (2, prose(2, 300)), (3, "few words"), (4, None)]))
    hs = {r.id: (r.h, r.text) for r in rows.collect()}
    tokens = {i: substring_dedup.tokens(textarrays.Slice(0, buf := np.frombuffer((hs[i][1] or "").encode(), np.uint8), np.array([0, len(buf)])))[0] for i in hs}
    asked = [(9, i, hs[i][0], c) for i in (1, 2) for c in (0, 30, len(tokens[i]) - 1, len(tokens[i]))]
    found = substring_dedup.around(rows, spark.createDataFrame(asked, "minhash long, id long, h int, c int"))
    assert "strip" not in found.columns
    expected = []
    for _, i, h, c in asked:
        if c < len(tokens[i]):
            a = max(0, c - substring_dedup.REACH)
            strip = (tokens[i] >> np.uint64(11)).astype(np.uint16)[a:c + substring_dedup.REACH + 1]
            expected.append((i, c, c - a, strip.tobytes()))
    sides = {(i, c, at, len(strip) // 2): (c >= substring_dedup.HALF) + (c + substring_dedup.HALF < len(tokens[i])) for i, c, at, strip in expected}
    got = collections.Counter((r.id, r.c, r.at, r.n) for r in found.dropDuplicates(["key", "id", "c"]).collect())
    assert got == {k: n for k, n in sides.items() if n}
    classes = spark.createDataFrame([(5, 0, 1, i, h, c) for _, i, h, c in asked], "key long, own int, n int, id long, h int, c int")
    made = substring_dedup.class_strips(rows, classes).collect()
    assert sorted((r.id, r.c, r.at, bytes(r.strip)) for r in made) == sorted(expected)


def test_only_what_can_meet_another_document_is_compared(spark):
    """Min-hashes and keys of one document are left out, keys with the same classes are compared once."""
    of = "struct<id:bigint,h:int,c:int,l:int,r:int>"
    found = spark.createDataFrame([(1, 5, 0, c, 0, 99, None, (5, 0, 0, 0, 99)) for c in (1, 2, 3)] + [(2, i, 0, 7, 0, 99, None, (5, 0, 7, 0, 99)) for i in (6, 7)],
                                  f"minhash long, id long, h int, c int, l int, r int, own {of}, first {of}")
    crowded = substring_dedup.crowded(found)
    assert sorted((r.minhash, r.id, r.c) for r in crowded.collect()) == [(2, 5, 7), (2, 6, 7), (2, 7, 7)]
    assert "Join" not in crowded._jdf.queryExecution().executedPlan().toString()
    classes = [(1, k, 5, 0, k) for k in range(4)] + [(key, k, k, 0, 9) for key in (2, 3) for k in (5, 6)] + [(4, 1, 5, 0, 9), (4, 2, 6, 0, 10)]
    kept = substring_dedup.several(spark.createDataFrame(classes, "key long, cls long, id long, h int, c int")).collect()
    assert sorted((r.key, r.id, r.c) for r in kept) == [(2, 5, 9), (2, 6, 9), (4, 5, 9), (4, 6, 10)]


def block(rows):
    names = ["key", "x", "y", "own", "id", "h", "c", "at", "strip"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table({n: pa.array(v, k) for n, k, v in zip(names, kinds, zip(*rows))})


@pytest.mark.parametrize("two", [False, True])
def test_classes_of_a_block_meet_as_row_by_row(two):
    r = random.Random(11)
    for _ in range(40):
        passage = [r.randrange(1 << 16) for _ in range(91)] if r.random() < 0.7 else [7] * 91
        rows = []
        for _ in range(r.choice([3, 40])):
            i, a = r.randrange(8), r.randrange(30)
            strip = [random.Random(i).randrange(1 << 16)] * a + passage[a:70] + [r.randrange(1 << 16) for _ in range(21)]
            strip[r.randrange(91)] = r.randrange(1 << 16)
            rows.append((1, 0, int(two), r.randrange(2) if two else 0, i, 0, r.randrange(500), 45, np.array(strip, np.uint16).tobytes()))
        rows.sort(key=lambda x: (x[4], x[6]))
        strips = [np.frombuffer(x[8], np.uint16) for x in rows]
        expected = []
        for k, x in enumerate(strips):
            earlier = [o for o in range(k) if rows[o][4] != rows[k][4] and (not two or rows[o][3] != rows[k][3])]
            hits = {o: np.isin(x, strips[o]) for o in earlier}
            covered = np.zeros(len(x), dtype=bool)
            for o in sorted(earlier, key=lambda o: -hits[o].sum()):
                if hits[o].sum() >= 41 and (hits[o] & ~covered).any():
                    for a, b in substring_dedup.spans_of(hits[o]):
                        if not covered[a:b].all():
                            covered[a:b] = True
                            d, base = rows[k][6] - rows[o][6], rows[k][6] - 45
                            expected.append((rows[k][4], 0, rows[o][4], 0, d - 16, d + 16, base + a, base + b - 1))
        assert [tuple(map(int, x)) for x in zip(*substring_dedup.in_block(block(rows), substring_dedup.Spans()))] == expected


def test_alike_windows_of_a_large_group_widen_the_diagonals():
    """A repeated word: any of its windows fits, so all diagonals of the run are asked for."""
    run = np.full(91, 7, np.uint16)
    rows = [(1, 0, 0, 0, 1, 0, c, 45, run.tobytes()) for c in range(100, 160)]
    rows += [(1, 0, 0, 0, 2 + k, 0, 45, 45, run.tobytes()) for k in range(substring_dedup.MANY)]
    _, _, oid, _, lo, hi, _, _ = substring_dedup.in_block(block(rows), substring_dedup.Spans())
    assert set(oid.tolist()) == {1} and set(lo.tolist()) == {45 - 159 - 16} and set(hi.tolist()) == {45 - 100 + 16}


def test_nearest_smaller_ones_and_spans_of_tiles_as_one_by_one():
    """Borders of windows and spans of tiles need no Python step for each place."""
    r = np.random.default_rng(9)
    for n in (0, 1, 7, 300):
        for values in (r.permutation(n), np.arange(n), np.arange(n)[::-1]):
            text = np.sort(r.integers(0, 1 + n // 9, n))
            expected = [max((j for j in range(k) if text[j] == text[k] and values[j] < values[k]), default=-1) for k in range(n)]
            assert substring_dedup.nearest_smaller(values, text).tolist() == expected
    for n in (1, 2, 9, 70):
        for share in (0.3, 0.8, 0.95, 1):
            bits = r.random(64 * n) < share
            bits[r.integers(64 * n):][:30] = False
            masks = np.packbits(bits, bitorder="little").view(np.int64)
            assert substring_dedup.spans_of_tiles(masks) == substring_dedup.spans_of(bits)


def test_groups_of_a_table_meet_at_once_as_one_by_one():
    """Keys with few classes need no pass of their own."""
    r = random.Random(5)
    groups = []
    for key in range(30):
        passage = [r.randrange(1 << 16) for _ in range(91)]
        rows = []
        for _ in range(r.choice([2, 3, 150])):
            strip = list(passage)
            for _ in range(r.randrange(4)):
                strip[r.randrange(91)] = r.randrange(1 << 16)
            rows.append((key, 0, 0, 0, r.randrange(40), 0, r.randrange(500), 45, np.array(strip, np.uint16).tobytes()))
        groups.append(block(sorted(rows, key=lambda x: (x[4], x[6]))))
    one_by_one = [substring_dedup.in_block(g, substring_dedup.Spans()) for g in groups]
    at_once = substring_dedup.in_block(pa.concat_tables(groups), substring_dedup.Spans())
    assert [x.tolist() for x in at_once] == [np.concatenate(x).tolist() for x in zip(*(f for f in one_by_one if f))]


def test_rows_meet_heads_in_turns_as_row_by_row():
    """Rows done in the turns, and those left after them, have the spans that each has by itself."""
    r = np.random.default_rng(3)
    spans = substring_dedup.Spans()
    for n, heads in ((40, 3), (40, 70), (3, 130)):
        hit = r.random((91, n, heads)) < 0.02
        for k in range(n):
            for j in range(heads):
                a = r.integers(0, 45)
                hit[a:a + r.integers(30, 70), k, j] = True
                hit[r.integers(91), k, j] = False
        packed = np.packbits(hit, axis=2, bitorder="little")
        words = np.pad(packed, ((0, 0), (0, 0), (0, -packed.shape[2] % 8))).view(np.uint64)
        rows, word, bit, a, b, _, rest = substring_dedup.row_spans(words, spans)
        left = {k: h[:, :heads] for k, h in rest}
        assert not set(left) & set(rows.tolist())
        for k in range(n):
            expected = [(some[0], p, q) for some, p, q in spans.new_spans(hit[:, k].astype(np.uint8), np.arange(heads))]
            if k in left:
                assert (left[k] == hit[:, k]).all()
            else:
                mine = rows == k
                assert list(zip((64 * word + bit)[mine].tolist(), a[mine].tolist(), b[mine].tolist())) == expected


def test_shared_tokens_of_tiles():
    r = random.Random(5)
    tiles = [[np.array([r.randrange(40) for _ in range(r.choice([1, 30, 64]))], np.uint16) for _ in range(50)] for _ in range(2)]
    masks = substring_dedup.shared_tokens(*(pa.array([x.tobytes() for x in t], pa.binary()) for t in tiles))
    assert masks.tolist() == [sum(1 << k for k, v in enumerate(x) if v in y) for x, y in zip(*tiles)]


# ---- 2 quality rules --------------------------------------------------------------

def brute_stats(t):
    t = t or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(w, w[1:], w[2:]))
    n = collections.Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_statistics_match_brute_force(spark, corpus, odd):
    for docs in (odd, corpus):
        got = quality_rules.apply_rules(docs, quality_rules.DecisionList()).collect()
        texts = [r.text for r in docs.select("doc_id", "text").collect()]
        assert sorted(tuple(r)[1:6] for r in got) == sorted(brute_stats(t) for t in texts)
        for r in got:
            failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert r.base_failed == failed and r.kept == (not failed)


def test_learned_list_rejects_bad_documents_it_has_not_seen(spark):
    out = quality_rules.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    seen = out.where(quality_rules.held_out(out.doc_id)).collect()
    assert np.mean([r.kept == bool(r.quality) for r in seen]) > 0.95


def test_no_labels_keep_all_but_the_base_rule(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.learn(quality_rules.statistics(odd), labels).rules == []
    twice = spark.createDataFrame([(7, 1), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    quality_rules.learn(quality_rules.statistics(odd), twice)


# ---- 3 BPE ------------------------------------------------------------------------

def test_encoding_equals_the_library(spark, corpus, odd):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    for docs in (odd, corpus):
        expected = []
        for r in docs.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            decoded = t.decode(ids, skip_special_tokens=False)
            expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        key = lambda x: (x[0] is None, x)
        for shared in (0, 1 << 15):
            got = [tuple(r) for r in bpe_chunks.digests(docs, max_shared=max(shared, 1)).collect()]
            assert sorted(map(str, got)) == sorted(map(str, expected)), key


def test_encoding_gives_batches_and_pieces_up(monkeypatch):
    """Of the input one batch is held at a time, and the remembered pieces keep to their bound."""
    monkeypatch.setattr(bpe_chunks, "MEMO_BYTES", 40_000)
    codec = bpe_chunks.Codec.get(bpe_chunks.vocabulary())
    codec.forget()
    texts = [[prose(10 * k + j, 60) for j in range(5)] for k in range(8)]
    given, most = [], []

    def batches():
        for k, part in enumerate(texts):
            assert all(ref() is None for ref in given)
            b = pa.RecordBatch.from_arrays([pa.array([10 * k + j for j in range(5)]), pa.array(part)], names=["doc_id", "text"])
            given.append(weakref.ref(b))
            yield b
            del b
            most.append(codec.memo_bytes)
            assert codec.memo_bytes == sum(map(bpe_chunks._kept, codec.memo, codec.memo.values()))

    columns = [("ids", None, pa.binary(), lambda ids, text: ids)]
    found = [bytes(x) for b in bpe_chunks.encoded_batches(batches(), codec, {}, columns) for x in b.column(1).to_pylist()]
    assert found == codec.direct([t.encode() for part in texts for t in part])
    assert max(most) < 3 * 40_000 and len(given) == 8 and not codec.memo


def test_sync_points_never_change_the_encoding():
    import random

    codec = bpe_chunks.Codec.get(bpe_chunks.vocabulary())
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(["a", "Bc", " ", " ", "\n", "\t", "é", " ", "　", "'s", "1", "!", "日", "\U0001F600", "\u0085", "<|endoftext|>"]) for _ in range(40))
        buf = np.frombuffer(text.encode(), dtype=np.uint8)
        for p in bpe_chunks.sync_points(buf, np.array([0, len(buf)])):
            parts = codec.direct([text.encode()[:p], text.encode()[p:]])
            assert b"".join(parts) == codec.direct([text.encode()])[0]


# ---- 4 classifier -----------------------------------------------------------------

def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_classifier.query(spark, sf).cache()
    assert out.count() == 1000 and out.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    held = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_classifier_without_labels_and_with_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_classifier.train(odd, none)
    scored = quality_classifier.score(odd, model).collect()
    assert len(scored) == len(ODD) and {r.score for r in scored} == {0.5}
    assert quality_classifier.score(empty, model).count() == 0
    one_class = spark.createDataFrame([(i, 1) for i in range(1, 14)] + [(None, 1), (3, None)], "doc_id long, quality int")
    again = quality_classifier.score(clashing(odd), quality_classifier.train(odd, one_class)).collect()
    assert all(0 <= r.score <= 1 for r in again)


def test_isotonic_levels_rise():
    x, y = quality_classifier.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([1.0, 0, 3, 4]), np.array([2.0, 2, 4, 4]))
    assert np.allclose(y, [0.25, 0.75, 1.0]) and (np.diff(x) > 0).all()


# ---- 5 licences -------------------------------------------------------------------

def test_licences_match_the_sql(spark, odd, empty):
    rows = [(1, "intro\nLicensed under the Apache License, version 2.0!\nmore"), (2, "Released  under the  MIT license"), (3, "the license of a poet"),
            (4, license_scan.TEMPLATES[5][1].replace(", to ", ",\nto ")), (None, "Licensed under CC BY-NC 4.0."), (5, None), (5, ""),
            (6, "a\n\nRedistribution and use in source and binary\nforms, with or without modification, are permitted\nprovided that the following conditions are met:\n\nb")]
    for docs in (documents(spark, rows), odd, empty):
        got = sorted(map(str, (tuple(r) for r in license_scan.scan(docs).select("doc_id", "license", "n_units", "dice").collect())))
        con = duckdb.connect()
        con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
        assert got == sorted(map(str, con.execute(license_scan.ORACLE_SQL).fetchall()))
        if docs is not odd and docs is not empty:
            assert len(got) == 5


# ---- 6 token counts ---------------------------------------------------------------

def test_counts_equal_a_unigram_model(spark, corpus, odd):
    from tokenizers import models
    import public_tokenizers

    with open(public_tokenizers.path(token_counts.VOCABULARY), "rb") as f:
        unigram = token_counts.Unigram.of_model(f.read())
    model = models.Unigram([("<unk>", 0.0), *unigram.pieces.items()], 0, False)
    memo = {}

    def count(word):
        if word not in memo:
            found = [t.value for t in model.tokenize(token_counts.MARK + word)]
            memo[word] = len(found) if all(x in unigram.pieces for x in found) else None
        return memo[word]

    got = {(r.doc_id, r.n_words): r.n_tokens for r in token_counts.token_counts(corpus).collect()}
    for r in corpus.collect():
        each = [count(w) for w in words(r.text)]
        if None not in each:
            assert got[(r.doc_id, len(each))] == sum(each)
    counted = token_counts.token_counts(odd).collect()
    assert len(counted) == len(ODD) and {r.n_tokens for r in counted if r.n_words == 0} == {0}


def test_shared_prefixes_give_the_scores_of_single_words():
    u = token_counts.Unigram({"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -5.0, "c": -1.0})
    ranked = sorted(["a", "ab", "abc", "abcab", "b", "zz", "azé"])
    assert u.counts(ranked) == [u.counts([w])[0] for w in ranked]
    assert dict(zip(ranked, u.counts(ranked)))["abc"] == 2 and u.counts(["é"]) == [2]


# ---- 7 HTML -----------------------------------------------------------------------

PAGES = {
    "article": ("<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class=ad>Buy now, it is a very long advert text.</div>"
                "<article><header>Site</header><h1>Head &amp; line</h1><p>A  long\n paragraph of <b>text</b> that says something.<p>Short.</article><footer>&copy; foot</footer></body></html>",
                "Head & line\nA long paragraph of text that says something.\nShort."),
    "none": (None, ""), "empty": ("", ""), "plain": ("just &lt;text&gt;", "just <text>"), "unclosed": ("<p>a<p>b<script>x</p>", "a\nb"),
    "main": ("<body><div class='cookie-notice'>We use cookies on this site and you accept it by reading on.</div><div id=wrap><div class=content><p>First paragraph with enough words in it.</p><p>Second one follows here with words.</p></div>"
             "<aside>Sidebar text which is long enough to count as a paragraph.</aside></div><section id=comments><p>I liked this article a lot, thanks for it.</p></section></body>",
             "First paragraph with enough words in it.\nSecond one follows here with words."),
}


def test_main_text(spark):
    pages = spark.createDataFrame([(k, n, h) for k, (n, (h, _)) in enumerate(PAGES.items())], "page_id long, url string, html string")
    got = {r.url: (r.text, r.n_chars) for r in html_extraction.extract(pages).collect()}
    assert got == {n: (t, len(t)) for n, (_, t) in PAGES.items()}
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_articles_of_the_pages(spark):
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") + 9:].split("</article>")[0]
        lines = re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:p|h1)>", "\n", inner)).split("\n")
        expected = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in lines]
        assert html_extraction.main_text(r.html) == "\n".join(x for x in expected if x)


# ---- 8 n-gram join ----------------------------------------------------------------

def test_main_text_drops_only_marked_boilerplate():
    p, q, head = prose(41, 130), prose(42, 45), "A Heading"
    menu = '<nav><a href="/">Home</a></nav>'
    for body, expected in (
        (f"<div id=content><div class=part><p>{p}</p></div><div class=part><p>{q}</p></div></div>", [p, q]),
        (f"<div><h1>{head}</h1><blockquote><p>{p}</p></blockquote><p>{q}</p></div>", [head, p, q]),
        (f"<div><h1>{head}</h1><section><p>{p}</p></section><p>short</p></div>", [head, p, "short"]),
        (f"<div><h1>{head}</h1><ul><li>{p}</li><li>{q}</li></ul><p>short</p></div>", [head, p, q, "short"]),
        (f"<div><h1>{head}</h1><table><tr><td>{p}</td></tr></table><p>{q}</p></div>", [head, p, q]),
        (f"<main><article><p>{p}</p></article><article><p>{q}</p></article></main>", [p, q]),
        (f"<article><p>{p}</p></article><article><p>{q}</p></article>", [p, q]),
        (f'<article><p>{p}</p><ul><li><a href="/a">a source</a></li></ul><p>{q}</p></article>', [p, "a source", q]),
    ):
        html = f"<html><body>{menu}{body}<footer>imprint</footer></body></html>"
        assert html_extraction.main_text(html).split("\n") == expected, body


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_join_matches_brute_force(spark, corpus, odd, width, percent):
    base = prose(11, 200).split()
    near = [(1000 + k, " ".join(base[:k] + [f"w{k}"] + base[k + 1:])) for k in range(0, 200, 5)]  # a hot group of near copies
    for docs in (documents(spark, [r[:2] for r in ODD] + near), corpus):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(clashing(docs), width, percent, buckets=1 << 12).collect()]
        assert sorted(got, key=str) == brute_components(rows, width, percent)


def test_stage_keeps_one_of_each_component(spark):
    base = prose(12, 100)
    rows = [(5, base), (3, base), (3, base), (9, base + " more"), (1, prose(13, 60)), (2, ""), (4, None), (None, "alone without id")]
    docs = documents(spark, rows)
    kept = ngram_join.stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, base), (1, prose(13, 60)), (2, ""), (4, None), (None, "alone without id")], key=str)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(5, 5), (None, 3), (7, 6)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + k: 1000 for k in range(1, 40)}


# ---- 9 mixing ---------------------------------------------------------------------

def test_targets_share_all_words_under_the_caps():
    sizes, weights = np.array([100, 10, 0, 50]), np.array([1.0, 2, 3, 1])
    t = source_mixing.targets(sizes, weights)
    assert np.isclose(t.sum(), 160) and t[1] == 30 and t[2] == 0 and np.isclose(t[0], t[3])


def test_leaf_quotas_part_all_blocks():
    counts = np.array([17, 0, 5, 40])
    for leaves in (1, 3, 8):
        parts = [source_mixing.leaf_quotas(k, leaves, counts, 3) for k in range(leaves)]
        assert (sum(n for _, n in parts) == counts).all()
        for s in range(4):
            at = 0
            for first, n in parts:
                assert n[s] == 0 or first[s] == at
                at += n[s]
        totals = [int(n.sum()) for _, n in parts]
        assert max(totals) - min(totals) <= int(np.ceil(np.log2(leaves))) + 1


def test_mix_is_near_its_targets_and_repeatable(spark, odd):
    sf = "/root/testdata/sf0.01"
    plan = source_mixing.query(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(plan) == len(docs)
    by = collections.defaultdict(list)
    for r in plan:
        assert r.size == len(words(docs[r.doc_id].text)) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by[docs[r.doc_id].source].append(r)
    names = sorted(by)
    sizes = np.array([sum(r.size for r in by[n]) for n in names])
    expected = source_mixing.targets(sizes, np.arange(len(names)) % 3 + 1.0)
    for n, size, target in zip(names, sizes, expected):
        assert {r.source_size for r in by[n]} == {size} and np.isclose(by[n][0].target, target)
        assert abs(sum(r.taken for r in by[n]) - target) <= 0.1 * target
    assert sorted(map(tuple, plan)) == sorted(map(tuple, source_mixing.query(spark, sf).collect()))
    got = source_mixing.planned(odd).collect()
    assert len(got) == len(ODD) and {r.taken for r in got if r.size == 0} == {0}


def test_mix_returns_each_row_as_often_as_planned(spark, odd, empty):
    wide = clashing(odd)
    mixed = source_mixing.mix(wide, block_words=16)
    assert mixed.columns == wide.columns
    n = collections.Counter(str((r.doc_id, r.text)) for r in mixed.collect())
    plan = collections.Counter()
    for r in source_mixing.plan(source_mixing.sized(odd, ["doc_id", "text"]), source_mixing.sized(odd, []).drop("row"), block_words=16).collect():
        plan[str((r["row"]["doc_id"], r["row"]["text"]))] += len(r["copies"])
    assert n == +plan
    assert source_mixing.planned(empty).count() == 0


# ---- 10 fingerprints --------------------------------------------------------------

def test_fingerprints_and_edits_match_brute_force(spark, corpus, odd, empty):
    plain = documents(spark, [r for r in ODD if r[0] is not None and r[0] not in (10, 11)])
    for docs in (plain, corpus, corpus.limit(1), corpus.limit(2)):
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
        single = {r.doc_id: r.fingerprint for r in merkle_fingerprints.fingerprints(docs).collect()}
        got = {r.doc_id: r for r in merkle_fingerprints.edited_fingerprints(docs).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(rows):
            j, after = rows[(k + 1) % len(rows)]
            edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
            r = got[i]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.fingerprint == single[i]
            assert np.isclose(r.near_next, merkle_fingerprints.fingerprint_likeness(single[i], single[j]))
            assert np.isclose(r.near_edited, merkle_fingerprints.fingerprint_likeness(single[i], r.edited_fingerprint))
    assert merkle_fingerprints.edited_fingerprints(empty).count() == 0
    assert merkle_fingerprints.edited_fingerprints(odd).count() == len(ODD)


def test_roots_test_equality_and_branches_locate_edits(spark):
    lines = [prose(100 + k, 40) for k in range(30)]
    changed = lines[:17] + [lines[17] + " new"] + lines[18:]
    a, b, c = (r.fingerprint for r in merkle_fingerprints.fingerprints(documents(spark, [(1, "\n".join(lines)), (2, "\n".join(changed)), (3, "\n".join(lines))])).orderBy("doc_id").collect())
    assert a == c and a[:32] != b[:32] and merkle_fingerprints.differing(a, c) == []
    spots = merkle_fingerprints.differing(a, b)
    assert 0 < len(spots) <= 3 and merkle_fingerprints.fingerprint_likeness(a, b) > 0.9


# ---- all --------------------------------------------------------------------------

def test_whole_texts_with_odd_rows_do_not_crash(spark, odd, empty):
    for docs in (clashing(odd), empty, clashing(empty)):
        n = docs.count()
        assert token_counts.token_counts(docs).count() == n
        assert bpe_chunks.digests(docs).count() == n
        assert ngram_join.join(docs.select("doc_id", "text")).count() == n
        assert substring_dedup.report(docs).count() == 0
        assert substring_dedup.without_repeats(docs).columns == docs.columns
        assert quality_rules.statistics(docs).count() == n
        license_scan.scan(docs).count()


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))
    assert os.path.basename(os.path.dirname(docstats.__file__)) == "llm"

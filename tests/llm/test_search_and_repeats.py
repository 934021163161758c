"""Ranked search, repeated windows and periodic runs against brute force, with nulls, long texts, ties and repeated rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_llm_operators import frame, odd_texts, words

from arbora.llm import blockmax, periodic, superkmers
from arbora.llm import textkit as tk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11


def brute_search(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")
    own = [(d, [w.translate(LOWER) for w in split(t)]) for d, t in docs]
    own = [(d, Counter(w), len(w)) for d, w in own if w]
    n_docs, total = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c, n in own:
            m = 25 + (75 * n * n_docs) // total
            s = 0
            for w in split(text):
                w = w.translate(LOWER)
                if tf := c[w]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return out


def searched(spark, docs, items, block=128, **more):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = blockmax.search(blockmax.build_index(frame(spark, docs), block, 40 * block), bench, **more)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("block", [1, 7, 128])
def test_search_equals_brute_force(spark, block):
    rnd = random.Random(block)
    docs = [(i, words(rnd, rnd.randint(0, 40), "abcd", 3)) for i in range(150)]
    docs += [(500 + i, t) for i, t in enumerate(odd_texts(rnd))]
    docs += [(7, "two rows of one id"), (None, docs[3][1]), (None, "abc abd"), *[(900 - i, "Tied-text, TIED") for i in range(15)]]
    docs += [(300 + i, docs[5][1]) for i in range(12)]
    items = [(i, words(rnd, n, "abcd", 3)) for i, n in enumerate([1, 2, 5, 30, 30, 60])]
    items += [(6, "tied"), (7, None), (8, ""), (9, "nowhere"), (10, "é ÀÉ 日本語"), (11, "a a a A"), (11, "b b"), (11, "b b"), (None, "c"), (12, docs[5][1])]
    assert searched(spark, docs, items, block) == sorted(brute_search(docs, items), key=str)
    assert searched(spark, docs, items, block, k=3) == sorted(brute_search(docs, items, 3), key=str)


def test_search_in_chunks_of_queries(spark, monkeypatch):
    rnd = random.Random(5)
    docs = [(i, words(rnd, 30, "abcdef", 2)) for i in range(60)]
    items = [(i, words(rnd, 4, "abcdef", 2)) for i in range(20)]
    monkeypatch.setattr(blockmax, "CHUNK", 6)
    assert searched(spark, docs, items) == sorted(brute_search(docs, items), key=str)


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, None), (2, " .,")], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []


def test_search_skips_blocks(spark):
    rare = "zebra quagga okapi"
    docs = [(i, f"{'common ' * 5}{rare if i < 20 else 'word'}") for i in range(1000)]
    index = blockmax.build_index(frame(spark, docs).coalesce(1).sortWithinPartitions("doc_id"), block_docs=10)
    rows = blockmax._query_terms(spark.createDataFrame([(1, rare)], "item_id long, text string")).collect()
    own = blockmax.Queries(rows)
    own.weigh(blockmax._document_counts(index, own.terms), 1000)
    found = blockmax._score(index, own, blockmax._thresholds(index, own, 10), 10).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r.doc_id)] == list(range(10))
    assert {r.scored for r in found} == {2}  # of 100 blocks: the first, and that whose bound equals the threshold


def test_impacts_of_huge_corpora_are_exact():
    length = np.array([10**8, 5], dtype=np.int64)
    m = [25 + 75 * int(n) * 10**11 // 10**14 for n in length.tolist()]
    assert blockmax.impacts(np.array([3, 1]), length, 10**11, 10**14).tolist() == [10**9 * t // (1000 * t + 8 * x) for t, x in zip([3, 1], m, strict=True)]


# 12


def brute_windows(docs, size):
    own = [(d, (t or "").encode().split()) for d, t in docs]
    seen = Counter(tuple(w[p : p + size]) for _, w in own for p in range(len(w) - size + 1))
    out = []
    for d, w in own:
        gone = {p + x for p in range(len(w) - size + 1) if seen[tuple(w[p : p + size])] > 1 for x in range(size)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def repeated_docs(rnd, size):
    docs = [(i, words(rnd, rnd.randint(0, 4 * size))) for i in range(40)]
    passage = words(rnd, size + 5)
    docs += [(100 + i, f"{words(rnd, rnd.randint(0, size))} {passage} {words(rnd, rnd.randint(0, size))}") for i in range(30)]
    docs += [(200 + i, f"{words(rnd, 3)}\n{' '.join(passage.split()[: size - 1 + i % 2])}\t{words(rnd, 3)}") for i in range(6)]
    docs += [(300 + i, docs[1][1]) for i in range(5)] + [(300, docs[1][1])] * 3
    docs += [(400 + i, t) for i, t in enumerate(odd_texts(rnd))]
    docs += [(500, "a b " * (2 * size)), (501, "x " * (size - 1)), (502, "y " * size), (503, "z " * (size + 1)), (504, passage.upper()), (7, "two rows of one id"), (None, passage), (None, None)]
    docs += [(600, words(rnd, 3 * size, "ab", 1))]
    return docs


@pytest.mark.parametrize(("size", "hot"), [(5, 512), (5, 2), (35, 512), (1, 512), (80, 4)])
def test_repeated_windows_equal_brute_force(spark, size, hot):
    docs = repeated_docs(random.Random(size), size)
    got = superkmers.remove_repeats(frame(spark, docs), size, hot)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_windows(docs, size), key=str)


def test_repeated_windows_of_empty_tables(spark):
    assert superkmers.remove_repeats(frame(spark, [])).collect() == []
    assert [tuple(r) for r in superkmers.remove_repeats(frame(spark, [(1, None)])).collect()] == [(1, 0, 0, "")]


def test_super_kmers_cover_each_window_once():
    rnd = random.Random(3)
    texts = [words(rnd, n, "ab", 2) for n in (0, 3, 40, 200, 7, 90)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    for size in (1, 4, 35, 70):
        w = tk.Words(data, offsets, 0, len(texts), tk.NONSPACE, lower=False)
        doc, mini, whole, start, n = superkmers.super_kmers(w, size)
        covered = sorted((d, a + i) for d, a, k in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True) for i in range(k))
        assert covered == [(d, p) for d, t in enumerate(texts) for p in range(len(t.split()) - size + 1)]
        assert n.max(initial=0) <= size - superkmers.gram_size(size) + 1 <= 62
        by: dict = {}
        for d, a, k, m, x in zip(doc.tolist(), start.tolist(), n.tolist(), mini.tolist(), whole.tolist(), strict=True):
            own = texts[d].split()
            by.setdefault(tuple(own[a : a + k + size - 1]), set()).add(x)
            for i in range(k):
                by.setdefault(("window", *own[a + i : a + i + size]), set()).add(m)
        assert all(len(v) == 1 for v in by.values())  # equal strings, equal names; equal windows, one bucket


def test_bits_of_a_bucket_are_its_repeated_windows():
    strings = [(1, 3, b"a b c d e"), (1, 2, b"b c d x"), (2, 1, b"q r s"), (1, 1, b"c d y")]
    assert superkmers.repeated_in_bucket(strings, 3) == [0b010, 0b01, 0b1, 0]
    assert superkmers.covered(8, [{"start": 1, "mask": 0b101}], 3).tolist() == [False, True, True, True, True, True, False, False]


# 13


def brute_runs(ids):
    n, out = len(ids), []
    for a in range(n):
        for q in range(1, n // 4 + 1):
            if a and a - 1 + q < n and ids[a - 1] == ids[a - 1 + q]:
                continue
            b = a
            while b + q < n and ids[b] == ids[b + q]:
                b += 1
            length = b - a + q
            own = ids[a : a + length]
            if length >= max(6, 4 * q) and not any(all(own[i] == own[i + p] for i in range(length - p)) for p in range(1, q)):
                out.append((a, length, q))
    return sorted(out)


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for k in range(300):
        letters = rng.choice([1, 2, 3, 50])
        ids = [rng.randrange(letters) for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(len(ids) + 1)
            ids[a:a] = [rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.randint(2, 7)
        own = np.array(ids, dtype=np.int64)
        want = brute_runs(ids)
        assert periodic.find_runs(own) == want, k
        assert periodic.find_runs(own, long_words=0) == want


def test_long_lags_and_few_lags_agree():
    rng = np.random.default_rng(6)
    for period in (63, 64, 65, 200, 700):
        ids = np.concatenate([rng.integers(0, 300, 500), np.tile(rng.integers(0, 300, period), 5)[: 4 * period + 3], rng.integers(0, 300, 400)])
        assert periodic.find_runs(ids) == periodic.find_runs(ids, long_words=10)
        assert any(q == period for _, _, q in periodic.find_runs(ids))


def test_periodic_runs(spark):
    rnd = random.Random(8)
    docs = [(i, words(rnd, rnd.randint(0, 60), "abc", 2)) for i in range(120)]
    docs += [(300 + i, t) for i, t in enumerate(odd_texts(rnd))] + [(5, "z " * 9), (5, "z " * 9), (None, "a b a b a b a b c"), (None, None)]
    docs += [(400, "x x x x x x y y y y y y"), (401, "a b c a b c a b c a b c d d d d d d d")]
    for change in (None, periodic.repeat_tail):
        want = []
        for d, t in docs:
            w = (t or "").encode().split()
            w = change(d, w) if change else w
            runs = brute_runs(w) if len(w) < 1000 else periodic.find_runs(periodic.word_ids(w))
            gone = {i for a, n, q in runs for i in range(a + q, a + n)}
            best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
            want.append((d, len(w), runs, best, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
        got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in periodic.periodic_runs(frame(spark, docs), change).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    rows = {r.doc_id: r for r in periodic.digest(periodic.periodic_runs(frame(spark, docs))).collect()}
    assert (rows[400].n_runs, rows[400].start, rows[400].length, rows[400].period, rows[400].exponent_milli) == (2, 0, 6, 1, 6000)
    assert (rows[401].start, rows[401].exponent_milli) == (12, 7000)
    assert rows[301].start is None and rows[301].exponent_milli is None and rows[301].runs_sha256 == rows[301].collapsed_sha256
    assert periodic.periodic_runs(frame(spark, [])).count() == 0

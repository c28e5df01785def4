"""Spelling variants, vector search and importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strobelake.llm import importance_resampling as ir
from strobelake.llm import spelling_variants as sv
from strobelake.llm import vector_search as vs

DOC = "doc_id long, text string, word string, n long"
LOWER = {k: k + 32 for k in range(65, 91)}


# --- spelling variants ----------------------------------------------------------------


def brute_counts(rows, least, count, one_in):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= count}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def brute_variants(words, ratio=5):
    form = {}
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    for a, others in near.items():
        best = min(others, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= ratio * words[a] else None
    out = {}
    for a in words:
        last = a
        while form[last]:
            last = form[last]
        out[a] = (form[a], last, words[a], len(near[a]), words[form[a]] if form[a] else None)
    return out


def spelt(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def texts_of(seed: int, letters: str, rows: int, width: int) -> list[tuple]:
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(3, width))) for _ in range(40)]

    def word():
        w = list(rng.choice(stems))
        if rng.random() < 0.4:
            p, kind = rng.randrange(len(w)), rng.randrange(3)
            w[p : p + (kind < 2)] = [] if kind == 0 else [rng.choice(letters)]
        return "".join(w)

    return [(rng.choice((k, k, None)), rng.choice(" ,-1\n").join(word() for _ in range(rng.randrange(60))), "w", 1) for k in range(rows)]


@pytest.mark.parametrize("letters,width,key_rows", [("abAB", 6, 20_000), ("abé", 5, 3), ("xyzÀÿß÷", 9, 10), ("a", 12, 1)])
def test_spelling_variants(spark, letters, width, key_rows):
    rows = texts_of(width, letters, 120, width) + [(None, None, None, None), (7, "", "", 0)]
    got = sv.variants(spark.createDataFrame(rows, DOC).repartition(3), 2, 3, 2, 7, key_rows)
    want = brute_variants(brute_counts(rows, 3, 2, 7), 2)
    assert spelt(got) == want and got.count() == len(want)


def test_spelling_variants_with_long_words_and_none(spark):
    long = "ab" * 15_000
    rows = [(k, f"{long} x{long} {long}c winter winters 1 été", "w", 1) for k in range(6)] + [(9, "wintr winter", "w", 1)] * 3
    got = spelt(sv.variants(spark.createDataFrame(rows, DOC), 2, 5, 2, 1 << 31))
    assert got == brute_variants(brute_counts(rows, 5, 2, 1 << 31), 2)
    assert got["winter"][3] == 2 and got[long][3] == 2
    assert sv.variants(spark.createDataFrame([], DOC)).count() == 0
    assert sv.variants(spark.createDataFrame([(1, "too few")], "doc_id long, text string")).count() == 0


def test_hashes_with_prefixes():
    rng = random.Random(3)
    prefixes, words = [b"%d:" % rng.randrange(10**9) for _ in range(50)], [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 90))) for _ in range(80)]
    owner, index = (np.array([rng.randrange(n) for _ in range(500)]) for n in (50, 80))
    assert sv.prefixed_crcs(prefixes, words, owner, index).tolist() == [zlib.crc32(prefixes[a] + words[b]) for a, b in zip(owner, index)]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 300])
def test_wavelet_tree(n):
    rng = np.random.default_rng(n)
    values = rng.permutation(n)
    bounds = np.sort(rng.integers(0, n + 1, (4, 200, 2)), axis=2)
    lo, hi, least, end = bounds[0, :, 0], bounds[0, :, 1], bounds[1, :, 0], bounds[1, :, 1]
    got = sorted(zip(*(x.tolist() for x in sv.WaveletTree(values).report(lo, hi, least, end))))
    assert got == sorted((k, v) for k in range(200) for v in values[lo[k] : hi[k]].tolist() if least[k] <= v < end[k])


def test_hot_keys_are_halved(spark):
    words = [(f"interminable{a}{b}{c}", 5) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    rows = sv.meeting_rows(spark.createDataFrame(words, "word string, n long"), 50)
    assert rows.groupBy("key").count().agg(F.max("count")).first()[0] <= 50
    got = {r["word"]: r["n_near"] for r in sv.near_counts(spark.createDataFrame(words, "word string, n long"), 50).collect()}
    assert got == {w: 21 for w, _ in words}


# --- vector search --------------------------------------------------------------------

VECTOR = "vec_id long, embedding array<float>, label int, rep long, score double"


def brute_nearest(rows, k, every):
    fit = {(i, tuple(np.float32(x) + 0.0 for x in v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for i, v in fit:
        if i % every == 0:
            far = sorted((float(np.sqrt(np.square(np.subtract(v, w, dtype=float)).sum())), j) for j, w in fit if len(w) == len(v) and (j, w) != (i, v))
            out += [(i, rank, s) for rank, (s, _) in enumerate(far[:k], 1)]
    return sorted(out)


def vectors(seed: int, n: int, dim: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((5, dim))
    rows = [(int(k), [float(x) for x in np.float32(centre[k % 5] + 0.3 * rng.standard_normal(dim))], 1, 2, 0.5) for k in range(n)]
    return rows + [(n + k, rows[0][1], 1, 2, 0.5) for k in range(n // 3)]  # a group of copies


@pytest.mark.parametrize("n,dim,k", [(400, 24, 10), (90, 3, 4), (7, 40, 10), (1, 5, 10)])
def test_nearest_vectors(spark, n, dim, k):
    rows = vectors(n, n, dim)
    rows += [(None, rows[0][1], 1, 1, 1.0), (10, None, 1, 1, 1.0), (20, [], 1, 1, 1.0), (30, [0.0] * dim, 1, 1, 1.0), (40, [float("nan")] * dim, 1, 1, 1.0), (50, [None] * dim, 1, 1, 1.0), rows[0], (60, [1.0] * (dim + 1), 1, 1, 1.0)]
    got = vs.nearest(spark.createDataFrame(rows, VECTOR).repartition(3), F.col("vec_id") % 10 == 0, k).collect()
    want = brute_nearest(rows, k, 10)
    found = sorted((r["query_id"], r["rank"], r["score"]) for r in got)
    assert [x[:2] for x in found] == [x[:2] for x in want]
    close = [abs(a[2] - b[2]) <= 1e-9 for a, b in zip(found, want)]
    assert sum(close) >= (1 if n < 100 else 0.95) * len(close)
    exact = {(i, j, r["score"]) for r in got for i, j in [(r["query_id"], r["vec_id"])]}
    assert all(s >= 0 for _, _, s in exact)


def test_ties_go_to_smaller_ids_and_lengths_stay_apart(spark):
    rows = [(k, [1.0, float(k % 2)], 0, 0, 0.0) for k in range(30)] + [(100, [1.0, 0.0, 0.0], 0, 0, 0.0), (101, [1.0, 0.0, 1.0], 0, 0, 0.0)]
    got = vs.nearest(spark.createDataFrame(rows, VECTOR), F.col("vec_id").isin(0, 1, 28, 100), 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, k, 0.0) for k in (2, 4, 6, 8, 10)] + [(1, k, 0.0) for k in (3, 5, 7, 9, 11)] + [(28, k, 0.0) for k in (0, 2, 4, 6, 8)] + [(100, 101, 1.0)]
    assert vs.nearest(spark.createDataFrame([], VECTOR), F.col("vec_id") % 10 == 0).count() == 0
    big = [(0, [1e300, -1e300]), (1, [-1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [2e-300, 1e-300])]
    far = vs.nearest(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") >= 0, 3)
    assert {(r["query_id"], r["vec_id"]): r["score"] for r in far.collect()}[(2, 3)] == pytest.approx(1e-300)


def test_early_abandoning_keeps_what_is_near():
    rng = np.random.default_rng(8)
    x, q = rng.standard_normal((3000, 96)).astype(np.float32) * rng.uniform(0.2, 3, (3000, 1)).astype(np.float32), rng.standard_normal((20, 96)).astype(np.float32)
    exact = np.sqrt(np.square(q[:, None].astype(float) - x[None]).sum(axis=2))
    near = np.sort(exact, axis=1)[:, 9]
    a, b = vs.survivors(vs.column_blocks(q, np.float32(1)), vs.column_blocks(x, np.float32(1)), np.square(near) * 1.1, 10)
    left = set(zip(a.tolist(), b.tolist()))
    wanted = {(k, j) for k in range(20) for j in np.flatnonzero(exact[k] <= near[k]).tolist()}
    assert len(wanted & left) >= 0.99 * len(wanted) and len(left) < 20 * 3000 / 10


# --- importance resampling ------------------------------------------------------------


def brute_sample(docs, bench, longest, buckets=50, percent=30, least=3):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    def totals(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])

    s, t = totals(d[1] for d in docs), totals(bench)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text, *_ in docs:
        words, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least, None])
    eligible = sorted((o for o in out if o[4]), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for k, o in enumerate(eligible[: percent * len(eligible) // 100], 1):
        o[5] = k
    return sorted(((o[0], o[1], o[2], o[3], o[5]) for o in out), key=str)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_importance_resampling(spark, longest, monkeypatch):
    rng = random.Random(longest)
    words = ["alpha", "Beta", "été", "x1", "日本", "the", "of", "a" * 200]
    docs = [(k, rng.choice(" ,\n").join(rng.choice(words) for _ in range(rng.randrange(40))), "w", 1) for k in range(150)]
    docs += [(None, "Alpha beta of the x1", "w", 1), (500, None, "w", 1), (501, "", "w", 1), (502, " ".join(rng.choice(words) for _ in range(50_000)), "w", 1), docs[3], docs[3]]
    bench = ["alpha alpha beta", None, "the été of x1 x1"]
    got = ir.resample(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame([(t,) for t in bench], "text string"), longest, 50, 30, 3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_sample(docs, bench, longest)
    empty = spark.createDataFrame([], DOC)
    assert ir.resample(empty, empty, longest).count() == 0
    assert ir.resample(spark.createDataFrame(docs, DOC), empty, longest, 50).count() == len(docs)


def test_tries_that_begin_anew_give_the_same_sums(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(str(rng.randrange(90)) for _ in range(rng.randrange(30))).encode() for _ in range(60)]
    whole, parts = np.zeros(97, dtype=np.int64), np.zeros(97, dtype=np.int64)
    one, trie = ir.Trie(3, 97), ir.Trie(3, 97)
    one.count(texts)
    one.add_to(whole)
    monkeypatch.setattr(ir, "TRIE_NODES", 40)
    for t in texts:
        trie.count([t])
        if trie.full:
            trie.add_to(parts)
            trie.clear()
    trie.add_to(parts)
    assert (whole == parts).all() and whole.sum() == sum(max(0, len(t.split()) - k) for t in texts for k in range(3))

"""Near-duplicates of texts and vectors against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strobelake.llm import embedding_dedup as ed
from strobelake.llm import simhash_dedup as sd
from strobelake.llm.common import connected_components

DOC = "doc_id long, text string, lang string"


def brute_fingerprint(text: str | None) -> int:
    words = [w for w in (text or "").translate({k: k + 32 for k in range(65, 91)}).translate({k: 32 for k in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(links: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("n,seed", [(0, 0), (1, 1), (60, 2), (400, 3)])
def test_connected_components(spark, n, seed):
    rng = random.Random(seed)
    links = [(k, k + 1) for k in range(0, n // 2)] + [(rng.randrange(n, 3 * n), rng.randrange(n, 3 * n)) for _ in range(n)] + [(7, 7)]
    frame = spark.createDataFrame([*links, (None, 3)], "a long, b long").repartition(5)
    got = {r["id"]: r["component"] for r in connected_components(frame).collect()}
    want = components([x for x in links if x[0] != x[1]], sorted({v for x in links for v in x}))
    assert {k: got.get(k, k) for k in want} == want


def test_hot_component(spark):
    star = spark.range(1, 20_000).selectExpr("id as a", "0L as b")
    got = connected_components(star.repartition(7))
    assert got.count() == 19_999 and got.select("component").distinct().collect()[0][0] == 0


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "One", "a b c", "a b c d", "A B  C\x0bD e", "the the the the the the", "É é Ünï cödé wörds here", "x\xa0y z w v u", "a " * 5000 + "b"]
    rng = random.Random(1)
    texts += [" ".join(rng.choice("alpha beta gamma delta EPS zeta".split()) for _ in range(rng.randrange(1, 600))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fp"] % 2**64 for r in sd.fingerprints(frame).collect()}
    assert got == {k: brute_fingerprint(t) for k, t in enumerate(texts)}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, base = [], [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(120)]
    for k, text in enumerate(base):
        rows.append(text)
        for _ in range(k % 4):
            parts = text.split(" ")
            for _ in range(k % 3):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            rows.append(" ".join(parts))
    hot = base[7]
    rows += [hot] * 40 + ["", None, "   ", "short", "short"] + [hot + " " + rng.choice(words) for _ in range(30)]
    return [(k, t, "en") for k, t in enumerate(rows)]


def test_simhash_groups(spark, corpus):
    got = {r["doc_id"]: r for r in sd.components(spark.createDataFrame(corpus, DOC)).collect()}
    prints = {k: brute_fingerprint(t) for k, t, _ in corpus}
    links = [(a, b) for a, b in combinations(prints, 2) if bin(prints[a] ^ prints[b]).count("1") <= 4]
    want = components(links, list(prints))
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {k: r["component_id"] for k, r in got.items()} == want


def test_simhash_empty_repeated_and_null_rows(spark):
    assert sd.components(spark.createDataFrame([], DOC)).count() == 0
    rows = [(3, "a b c d e", "x"), (3, "a b c d e", "x"), (None, "a b c d e", "x"), (1, None, None), (None, "q r s t u v", "x")]
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in sd.components(spark.createDataFrame(rows, DOC + "").withColumnRenamed("lang", "fp")).collect())
    assert got == [("1", "1"), ("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]


def test_pigeonhole_covers_every_pair_within_the_radius():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**63, 500, dtype=np.int64)
    bits = ((prints[:, None] >> np.arange(64)) & 1).astype(float)
    together = np.rint(bits.T @ bits).astype(np.int64)
    for n in (500, 10**6, 10**9):
        _, plan = sd.allocate(n, together, 4)
        assert sorted(b for bits, _ in plan for b in bits) == sorted({b for bits, _ in plan for b in bits})
        used = {b for bits, _ in plan for b in bits}
        for flips in [rng.choice(64, 4, replace=False) for _ in range(300)]:
            assert any(len(set(flips.tolist()) & set(bits)) <= t for bits, t in plan), (plan, used)


def test_candidate_estimates_of_bits_that_vary_together_agree_with_all_pairs():
    rng = np.random.default_rng(1)
    n = 4000
    hidden = rng.integers(0, 2, (n, 8)).repeat(8, axis=1)
    bits = np.where(rng.random((n, 64)) < 0.15, 1 - hidden, hidden)
    together = np.rint(bits.T.astype(float) @ bits).astype(np.int64)
    for group in sd.correlated_groups(n, together, 4):
        own = bits[:, group].astype(float)
        apart = own @ (1 - own).T
        apart = np.rint(apart + apart.T)[np.triu_indices(n, 1)]
        true = np.array([(apart <= t).mean() for t in range(5)])
        found = sd.distance_odds(n, together, group, 4)
        each = np.diag(together)[group] / n
        alone = sd.distance_odds(n, np.where(np.eye(64, dtype=bool), together, np.outer(np.diag(together), np.diag(together)) / n), group, 4)
        assert 0.1 < each.min() and (abs(np.log(found / true)) < np.log(4)).all()
        assert (abs(np.log(found / true)) < abs(np.log(alone / true)) / 2).all()


def test_candidate_estimates_without_spread():
    zero = np.zeros((64, 64), dtype=np.int64)
    for n, together in ((0, zero), (7, zero), (1, zero + 1), (5, zero + 5)):
        assert (sd.distance_odds(n, together, list(range(16)), 4) == 1).all()
        assert sd.allocate(n, together, 4)[1]
    same = zero + 500  # all bits equal, half the rows set
    odds = sd.distance_odds(1000, same, list(range(16)), 4)
    assert np.allclose(odds, 0.5, atol=1e-3)
    assert np.allclose(sd.distance_odds(1000, same, [3], 4), [0.5, 1, 1, 1, 1])


VEC = "vec_id long, embedding array<float>, label int"


def brute_vectors(rows):
    ok = {k: np.array(v, dtype=np.float64) for k, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a, b in combinations(ok, 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= 0.95]
    degree = {k: 0 for k, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return degree, components(links, [k for k, _ in rows])


def test_vectors_agree_with_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(700, 16)).astype(np.float32)
    near = np.concatenate([base[k] + 0.05 * rng.normal(size=(k % 5, 16)).astype(np.float32) for k in range(60)])
    hot = base[3] + 0.02 * rng.normal(size=(200, 16)).astype(np.float32)
    chain = np.stack([base[9] + 0.3 * k * base[10] for k in range(12)])
    all_rows = np.concatenate([base, near, hot, chain, base[:5], 3 * base[:5]])
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(all_rows)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [1.0, None] * 8), (n + 4, [float("inf")] * 16), (n + 5, []), (n + 6, [1.0, 2.0]), (n + 7, [1.0, 2.0])]
    got = ed.near_duplicates(spark.createDataFrame([(k, v, 0) for k, v in rows], VEC), shard_rows=150, block_rows=300).collect()
    degree, low = brute_vectors(rows)
    found = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows)
    total = sum(degree.values())
    assert sum(r["n_links"] for r in got) >= 0.99 * total and all(r["n_links"] <= degree[r["vec_id"]] for r in got)
    assert sum(found[k]["component_id"] == low[k] for k in low) >= 0.99 * len(low)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_vectors_empty_and_repeated(spark):
    assert ed.near_duplicates(spark.createDataFrame([], VEC)).count() == 0
    got = ed.near_duplicates(spark.createDataFrame([(5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (2, [2.0, 4.0], 1)], VEC)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(2, 2, 2, True), (5, 2, 2, False), (5, 2, 2, False)]


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    unit = ed._unit(x)
    levels = np.floor(-np.log(rng.random(3000)) / np.log(ed.LINKS)).astype(int)
    order = np.argsort(-levels, kind="stable")
    graph = ed.Graph.build(unit[order], levels[order])
    q = ed._unit(rng.normal(size=(100, 24)))
    exact = np.argsort(-(q @ graph.x.T), axis=1)[:, :10]
    found, _ = graph.nearest(q, 96)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact.tolist(), found.tolist())]) > 0.9


def test_links_at_the_least_cosine_are_found():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 48))
    cluster = x[:1] + 0.15 * rng.normal(size=(300, 48))
    x = np.concatenate([x, cluster])
    unit = ed._unit(x)
    levels = np.floor(-np.log(rng.random(len(x))) / np.log(ed.LINKS)).astype(int)
    order = np.argsort(-levels, kind="stable")
    x = x[order]
    graph = ed.Graph.build(unit[order], levels[order])
    v = x[::13] / np.linalg.norm(x[::13], axis=1, keepdims=True)
    side = rng.normal(size=v.shape)
    side -= (side * v).sum(axis=1, keepdims=True) * v
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    q = 0.951 * v + np.sqrt(1 - 0.951**2) * side
    q_ids = np.arange(len(q)) + len(x)
    shard = ed.Shard(np.arange(len(x)), np.ones(len(x), dtype=np.int64), x, graph.sizes, graph.layers)
    found = ed.links_in(shard, q, q_ids, 0.95, 4)
    exact = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T >= 0.95
    assert (found.counts <= exact.sum(axis=1)).all() and found.counts.sum() >= 0.99 * exact.sum() and found.beam >= 4
    assert 0 < found.wanted and ed.LINK_RECALL * found.wanted <= found.got <= found.wanted


def shard_of(x, many=None):
    digest = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, len(x))
    row = ed.pack_shard(np.arange(len(x)) * 7, np.ones(len(x), dtype=np.int64) if many is None else many, x, digest)
    layers = [np.frombuffer(b, dtype=np.int32).reshape(s, -1) for b, s in zip(row["layers"], row["sizes"])]
    return ed.Shard(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["many"], np.int64), ed.scaled(np.frombuffer(row["vectors"]).reshape(x.shape)), row["sizes"], layers)


@pytest.mark.parametrize("recall", [0.99, 1.5])  # as it is, and audits that never pass: the whole shard is compared
def test_counts_and_forest_of_a_block(recall, monkeypatch):
    monkeypatch.setattr(ed, "LINK_RECALL", recall)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 12))
    x = np.concatenate([c + s * rng.normal(size=(n, 12)) for c, s, n in zip(centres, [0.02, 0.1, 0.2, 0.25] * 10, [1, 3, 40, 200] * 10)])
    many = rng.integers(1, 4, len(x))
    shard = shard_of(x, many)
    original = shard.ids // 7
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = unit @ unit.T >= 0.95
    np.fill_diagonal(exact, False)
    found = ed.links_in(shard, ed.scaled(x), np.arange(len(x)) * 7, 0.95, 8)
    assert (found.counts == exact @ many).mean() > 0.97 and (found.counts <= exact @ many).all()
    edges = [(int(a), int(b)) for left, right in found.edges for a, b in zip(left, right)]
    assert len(edges) < 6 * len(x)
    low = components([(a // 7, b // 7) for a, b in edges], range(len(x)))
    want = components(list(zip(*np.nonzero(exact))), range(len(x)))
    assert sum(low[k] == want[k] for k in low) >= 0.99 * len(low) and sorted(original) == list(range(len(x)))


def test_dense_clusters_cost_no_memory_of_pairs():
    """20,000 unequal vectors that all link: 400 million links, in bands."""
    import resource

    rng = np.random.default_rng(6)
    x = rng.normal(size=(1, 32)) + 0.03 * rng.normal(size=(20_000, 32))
    shard = shard_of(x)
    found = ed.links_in(shard, ed.scaled(x), np.arange(len(x)) * 7, 0.95, 16)
    assert (found.counts == len(x) - 1).all() and len(np.unique(shard.root)) == 1
    assert sum(len(a) for a, _ in found.edges) < 3 * len(x)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 3_000_000


def test_vectors_of_any_scale_and_many_lengths(spark):
    rng = np.random.default_rng(7)
    big = [1e200, 1e200], [1e200, 1e200], [1.0, 1.0], [5e-324, 5e-324], [1.7e308, -1.7e308], [-1e-160, 1e-160], [1e308, 1e-308], [0.0, -0.0], [-0.0, 3.0], [0.0, 1.0]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate([*big, *rng.normal(size=(9, 2)), *rng.normal(size=(9, 3)), *rng.normal(size=(2, 2000))])]
    got = ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    unit = [np.array(v) / max(map(abs, v)) if any(v) else None for _, v in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95 * np.linalg.norm(unit[a]) * np.linalg.norm(unit[b])]
    low = components(links, range(len(rows)))
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(k, sum(k in e for e in links), low[k]) for k, _ in rows}
    assert (0, 1) in links and (0, 2) in links and (2, 3) in links


def test_repeated_ids_and_foreign_columns(spark):
    rows = [(5, [1.0, 2.0], 1, 2), (5, [-2.0, 1.0], 1, 2), (2, [2.0, 4.1], 1, 2), (None, [2.0, 4.0], 1, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int, fine int")
    for name in ("v", "k1", "dim", "part", "Low", "n"):
        frame = frame.withColumn(name, F.lit(0))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in ed.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(5, 2, 2, False), (5, 0, 5, True), (2, 2, 2, True), (None, 2, 2, False)], key=str)

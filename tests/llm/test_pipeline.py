"""The pipeline's stages against plain Python on a small table."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from strobelake.llm import pii
from strobelake.llm import sentencepiece_codec as spc
from strobelake.llm.simhash_dedup import fingerprint

DOCS = "doc_id long, text string, lang string, source string, n_chars long, note string"
INSULTS = ("idiot", "moron", "clown", "scum")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, root = random.Random(0), tmp_path_factory.mktemp("corpus")
    vocabulary = ["".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ou")) for _ in range(rng.randint(2, 4))) for _ in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(prose(20))) for k in range(5)]
    rows, labels = [], []
    for k in range(400):
        words = prose(rng.randrange(30, 120))
        if k % 8 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        if k % 8 == 1:
            words += items[k % 5][1].split()
        if k % 8 == 2:
            words.insert(3, f"x{k}@mail.example.com")
        if k % 8 == 3 and k > 8:
            words = rows[k - 8][1].split()
        text = " ".join(words)
        rows.append((k, text, "en", "src0", len(text), "n"))
        labels.append((k, 1, int(k % 8 == 0)))
    rows += [(900, None, None, None, None, None), (901, "", "en", "src1", 0, ""), (None, "rows without id stay", "en", "s", 20, ""), (5, rows[5][1], "en", "src0", rows[5][4], "n")]
    rows += [(12, "one more text " + " ".join(prose(40)), "en", "src0", 9, "second text of an id"), (950, " ".join(prose(30_000)), "en", "src0", 9, "very long")]
    rows += [(951, " ".join(prose(40)) + " 1.2.3." + "0" * 5000 + " and " + "0" * 4400 + ".1.1.1 password=" + "a1/" * 100_000, "en", "src0", 9, "numbers and runs of great length")]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, items


def brute(rows, items):
    rows = [r for r in rows if not any(w in INSULTS for w in (r[1] or "").split())]
    prints = [fingerprint((r[1] or "").encode()) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    kept, seen = [], set()
    for k, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        if r[0] is None or (r[0] == min(ids) and (r[0], group[k]) not in seen):
            seen.add((r[0], group[k]))
            kept.append(r)
    kept = [r for r in kept if not any(t in (r[1] or "") for _, t in items)]
    own, field, out = spc.codec(spc.MODEL), pii.default_field(), []
    for r in kept:
        text, base, more = next(iter(pii.all_spans([(r[1] or "").encode()], field)))
        ids, _ = own.encode([pii.redact(text, base + more).encode()])
        out.append((r[0], ids.tolist()))
    return sorted(out, key=str)


def test_pipeline_agrees_with_plain_python(spark, sf_dir):
    root, rows, items = sf_dir
    got = cp.run(spark, root).collect()
    want = brute(rows, items)
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == want
    assert 200 < len(want) < 330
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    back = spc.codec(spc.MODEL).decode(np.concatenate([r["ids"] for r in got if r["ids"]]).astype(np.int32), np.array([len(r["ids"]) for r in got if r["ids"]]))
    assert any("[EMAIL]" in t for t in back) and not any("@mail" in t for t in back)


def test_stages_keep_the_columns_and_pass_empty_tables(spark, sf_dir):
    root = sf_dir[0]
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name in ("score", "predicted", "_dropped", "gone_id", "Gone_Hash", "own_hash", "ids", "n_tokens", "doc", "kept0", "fp", "m0", "a.b", "label"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, root).columns == docs.columns, name
    assert all(r["a.b"] == "a.b" and r["score"] == "score" for r in cp.drop_near_duplicates(spark, docs, root).select("`a.b`", "score").collect())
    assert cp.encode_pieces(spark, docs, root).count() == docs.count()
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), root).count() == 0, name

"""URL rules and WARC files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from strobelake.llm import url_filter as uf
from strobelake.llm import warc_writer as ww
from strobelake.llm.common import new_path

PAGE = "page_id long, url string, html string"


def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_rules_agree_with_brute_force(spark):
    rng = random.Random(0)
    rules = [*uf.RULES, ("b.example.com", "/e", "block"), ("org", "/a/b", "block"), ("org", "/a/b", "allow"), ("x.y.z.net", "/", "allow")]
    hosts = ["com", "example.com", "www.Example.COM", "a.b.example.com", "notexample.com", "net", "x.y.z.net", "w.x.y.z.net", "a.org", "", "é.com", "com.", "example.com:80", "a..com"]
    paths = ["", "/", "/en/", "/en/x", "/en", "/es/1", "/fr/", "/a/b/c", "/a/b", "?/en/", "/en/?q#f", "/e?x", "#/en/"]
    urls = [f"{s}://{rng.choice(hosts)}{rng.choice(paths)}" for s in ("http", "HTTPS", "x") for _ in range(150)] + [None, "", "no scheme/en/", "://com/", "a://b://com/", "http://com/\nen/", "http://" + "a." * 3000 + "com/" + "x" * 9000]
    rows = [(k % 200, u, None) for k, u in enumerate(urls)]
    got = uf.judge(spark.createDataFrame(rows, PAGE).withColumn("rule", F.lit(1)), uf.rules_table(spark, rules)).collect()
    want = sorted(((k, *brute_verdict(u, rules)) for k, u, _ in rows), key=str)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=str) == want


def test_rules_empty(spark):
    pages = spark.createDataFrame([(1, "http://com/", None)], PAGE)
    assert uf.judge(pages.limit(0), uf.rules_table(spark)).count() == 0
    none = uf.rules_table(spark).limit(0)
    assert [(r["rule"], r["verdict"]) for r in uf.judge(pages, none, default="block").collect()] == [(None, "block")]


def pages_of(n: int = 60) -> list:
    rng = random.Random(1)
    bodies = ["<p>é</p>" * 50, "", "x" * 3000, None]
    rows = [(10 * k, f"http://a.com/{k}\r\nX: y", rng.choice(bodies) if k % 3 else f"own {k} " * rng.randrange(200)) for k in range(n)]
    return [*rows, (None, None, "null id"), (None, "u", "x" * 3000), (30, "http://again", rows[3][2]), (30, "http://again", "another body"), rows[4]]


def brute_records(rows, min_bytes=0):
    seen, out = {}, []
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        first = seen.get(raw) if len(raw) >= min_bytes else None
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if first else "response", first[0] if first else None))
        seen.setdefault(raw, (page_id,))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_warc_round_trip(spark, min_bytes):
    rows = pages_of()
    uri = new_path(spark, "warc-test")
    frame = spark.createDataFrame(rows, PAGE).withColumn("digest", F.lit(0))
    manifest = ww.write_warc(frame, uri, roll_bytes=3000, shard_bytes=20_000, min_bytes=min_bytes)
    got = ww.read_warc(manifest, uri, with_payload=True).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute_records(rows, min_bytes)
    assert {r["payload"].decode() for r in got if r["record_type"] == "response"} == {h or "" for _, _, h in rows}
    assert all("\n" not in r["url"] for r in got)
    fs, root = pyarrow.fs.FileSystem.from_uri(uri)
    files = {f.base_name: f for f in fs.get_file_info(pyarrow.fs.FileSelector(root)) if f.base_name.endswith(".warc.gz")}
    rows_ = manifest.collect()
    assert {r["name"] for r in rows_} == set(files) and len(files) > 3
    for r in rows_:
        raw = fs.open_input_stream(f"{root}/{r['name']}", compression=None).read()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (r["bytes"], r["sha256"])
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert not [f for f in fs.get_file_info(pyarrow.fs.FileSelector(root)) if f.base_name == "_tmp"]


def test_warc_is_deterministic(spark):
    rows, seen = [r for r in pages_of() if r[0] is not None], []
    for parts in (1, 5):
        uri = new_path(spark, "warc-test")
        manifest = ww.write_warc(spark.createDataFrame(rows, PAGE).orderBy(F.rand(parts)).repartition(parts), uri, roll_bytes=3000, shard_bytes=20_000)
        seen.append(sorted((r["name"], r["records"], r["sha256"]) for r in manifest.collect()))
    assert seen[0] == seen[1]


def test_shards_are_even_whatever_ids_are(spark):
    ids = [*range(1000, 1400), -(2**62), 2**62, 2**62 + 1]
    keys = spark.createDataFrame([(i, "d", 100) for i in ids] + [(None, "d", 100), (1000, "e", 100)], "page_id long, digest string, size long").repartition(5)
    ids, weights = sorted(ids), {i: 100 + ww.RECORD_BYTES for i in ids} | {1000: 2 * (100 + ww.RECORD_BYTES)}
    want, held, last = [], 0, -1
    for i in ids:
        if held // 50_000 != last:
            want.append(i)
            last = held // 50_000
        held += weights[i]
    assert ww.shard_starts(keys, 50_000) == want and len(want) > 4
    assert ww.shard_starts(keys.limit(0), 50_000) == []


def test_a_task_holds_one_shard(spark):
    """Each shard is written by one task of its own, and long rows, repeats and clashing columns change nothing."""
    rows = [(k, f"http://a/{k}", "x" * 3000 + str(k)) for k in range(200)] + [(7, "http://again", "x" * 30007), (None, None, None), (999, "http://long", "y" * 3_000_000)]
    frame = spark.createDataFrame(rows, PAGE).withColumns({c: F.lit("z") for c in ("shard", "kind", "data", "first", "digest", "size")})
    uri = new_path(spark, "warc-test")
    manifest = ww.write_warc(frame, uri, shard_bytes=100_000)
    shards = manifest.select("shard").distinct().count()
    assert shards > 5 and ww.read_warc(manifest, uri).count() == len(rows)
    assert len([f for f in pyarrow.fs.FileSystem.from_uri(uri)[0].get_file_info(pyarrow.fs.FileSelector(pyarrow.fs.FileSystem.from_uri(uri)[1])) if f.base_name.startswith("pages-")]) == manifest.count()


def test_a_lost_file_is_not_committed(spark):
    uri = new_path(spark, "warc-test")
    manifest = ww.write_warc(spark.createDataFrame([(1, "http://a", "body")], PAGE), uri)
    fs, root = pyarrow.fs.FileSystem.from_uri(uri)
    rows = manifest.collect()
    assert ww._commit(spark.createDataFrame(rows, ww.MANIFEST), uri).count() == 1  # again
    with fs.open_output_stream(f"{root}/{rows[0]['name']}", compression=None) as out:
        out.write(b"cut")
    with pytest.raises(Exception, match="is not there with its"):
        ww._commit(spark.createDataFrame(rows, ww.MANIFEST), uri)
    fs.delete_file(f"{root}/{rows[0]['name']}")
    with pytest.raises(Exception, match="is not there with its"):
        ww._commit(spark.createDataFrame(rows, ww.MANIFEST), uri)


def test_warc_empty(spark):
    uri = new_path(spark, "warc-test")
    manifest = ww.write_warc(spark.createDataFrame([], PAGE), uri)
    assert manifest.count() == 0 and ww.read_warc(manifest, uri).count() == 0


def test_damaged_files_are_refused(spark):
    uri = new_path(spark, "warc-test")
    manifest = ww.write_warc(spark.createDataFrame([(1, "http://a", "body " * 100)], PAGE), uri)
    fs, root = pyarrow.fs.FileSystem.from_uri(uri)
    name = manifest.first()["name"]
    raw = gzip.decompress(fs.open_input_stream(f"{root}/{name}", compression=None).read()).replace(b"body ", b"bady ")
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
        head, _, tail = raw.partition(b"\r\n\r\nWARC/1.1")
        out.write(gzip.compress(head + b"\r\n\r\n") + gzip.compress(b"WARC/1.1" + tail))
    with pytest.raises(Exception, match="digest does not match"):
        ww.read_warc(manifest, uri).collect()
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(gzip.compress(b"something else"))
    with pytest.raises(Exception, match="no WARC record"):
        ww.read_warc(manifest, uri).collect()

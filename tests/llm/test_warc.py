"""WARC archives: what is written, normalised, indexed and read back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import zlib
from collections import Counter

import pytest

from tallyspark.llm import warc as W

PAGES = "page_id long, url string, html string"
ROWS = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two é😀\r\n\r\nWARC/1.1\r\n</p>"),
        (3, "http://a/3", "<p>one</p>"), (9, "http://a/9", "<p>one</p>"), (4, None, None), (5, "http://a/\r\n5", ""),
        (6, "http://b/6", "x" * 3_000_000), (7, "http://b/7", " "), (8, "http://b/8", "\r\n\r\n"),
        (2, "http://a/2", "<p>two é😀\r\n\r\nWARC/1.1\r\n</p>"), (2, "http://c/2", "another"),
        (None, "http://n/", "<p>one</p>"), (None, "http://n/2", "only here")]


def plain(rows):
    top = {}
    for i, _, html in rows:
        if i is not None:
            top[html or ""] = max(i, top.get(html or "", i))
    out = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        best = top.get(html or "")
        out[(i, len(data), digest, "response" if i == best else "revisit", None if i == best else best)] += 1
    return out


def run(spark, pages, root):
    W.write_archives(pages, f"{root}/raw")
    manifest = W.normalise(spark, f"{root}/raw", f"{root}/normal")
    found = W.read_records(W.index_of(spark, f"{root}/normal"))
    return manifest, found.select(W.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                                  "record_type", W.page_of("refers_to").alias("refers_to"))


def members(path):
    """The gzip members of a file: (offset, length, content)."""
    data, at, out = open(path, "rb").read(), 0, []
    while at < len(data):
        d = zlib.decompressobj(31)
        content = d.decompress(data[at:])
        size = len(data) - at - len(d.unused_data)
        out.append((at, size, content))
        at += size
    return out


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_round_trip(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(W, "BROADCAST_PAYLOADS", broadcast)
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    _, got = run(spark, pages, str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == plain(ROWS)


def test_files_and_index(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES).coalesce(1)
    manifest, _ = run(spark, pages, str(tmp_path))
    raw = [p for p in os.listdir(tmp_path / "raw") if p.endswith(".gz")]
    assert len(members(tmp_path / "raw" / raw[0])) == 1  # monolithic
    (done,) = manifest.collect()
    assert done["n_records"] == len(ROWS)
    parts = members(done["archive"])
    assert len(parts) == len(ROWS)
    index = [json.loads(line) for line in open(done["index"])]
    assert [(x["offset"], x["length"]) for x in index] == [(a, n) for a, n, _ in parts]
    whole = b"".join(c for _, _, c in parts)
    assert whole == gzip.decompress((tmp_path / "raw" / raw[0]).read_bytes())
    assert all(c.startswith(b"WARC/1.1\r\n") and c.endswith(b"\r\n\r\n") for _, _, c in parts)
    big = next(c for _, _, c in parts if b"<urn:page:6>" in c)
    assert b"Content-Length: 3000000\r\n" in big and big.count(b"x") >= 3_000_000
    assert b"http://a/%0D%0A5" in whole and sorted(os.listdir(tmp_path / "normal")) == sorted(
        os.path.basename(done[k]) for k in ("archive", "index"))


def test_a_task_that_runs_again_writes_the_same(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES).coalesce(1)
    (done,) = run(spark, pages, str(tmp_path))[0].collect()
    first = open(done["archive"], "rb").read()
    W.normalise(spark, f"{tmp_path}/raw", f"{tmp_path}/normal").collect()
    assert open(done["archive"], "rb").read() == first
    assert W.read_records(W.index_of(spark, f"{tmp_path}/normal")).count() == len(ROWS)


def test_archives_of_several_members_and_small_pieces(spark, tmp_path, monkeypatch):
    os.makedirs(tmp_path / "raw")
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhi"
    body = (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: %d\r\n\r\n"
            % len(block)) + block + b"\r\n\r\n"
    (tmp_path / "raw" / "x.warc.gz").write_bytes(gzip.compress(body[:40]) + gzip.compress(body[40:] + body))
    monkeypatch.setattr(W, "PIECE", 7)
    done = W._normalised(str(tmp_path / "raw" / "x.warc.gz"), str(tmp_path), 6)
    assert done["n_records"] == 2
    assert [c for _, _, c in members(done["archive"])] == [body, body]


@pytest.mark.parametrize("data", [
    gzip.compress(b"not a record\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nno end"),
    gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\nWARC-Type: x\r\nWARC-Record-ID: y\r\n\r\nshort\r\n\r\n"),
    gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\nWARC-Type: x\r\nWARC-Record-ID: y\r\n\r\nz\r\n\r\n")[:-12]])
def test_broken_archives_are_errors(tmp_path, data):
    (tmp_path / "x.warc.gz").write_bytes(data)
    os.makedirs(tmp_path / "out")
    with pytest.raises(ValueError):
        W._normalised(str(tmp_path / "x.warc.gz"), str(tmp_path / "out"), 6)
    assert not [p for p in os.listdir(tmp_path / "out") if p.endswith((".warc.gz", ".idx"))]


def test_a_changed_payload_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:1], PAGES).coalesce(1)
    (done,) = run(spark, pages, str(tmp_path))[0].collect()
    path = done["archive"]
    changed = gzip.compress(members(path)[0][2].replace(b"<p>one", b"<p>ONE"))
    open(path, "wb").write(changed)
    row = json.loads(open(done["index"]).readline()) | {"length": len(changed)}
    with open(path, "rb") as file, pytest.raises(ValueError, match="digest"):
        W._record(file, row)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES)
    _, none = run(spark, pages.limit(0), str(tmp_path / "none"))
    assert none.count() == 0
    clash = pages.selectExpr("*", "1 as digest", "2 as size", "3 as top", "4 as record", "5 as _n", "6 as _copied")
    assert Counter(tuple(r) for r in run(spark, clash, str(tmp_path / "c"))[1].collect()) == plain(ROWS)

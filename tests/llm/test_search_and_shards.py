"""Top-k search, shards, URL rules and tool calls on small tables with every odd case."""

import json
import math
import random
import zlib

import numpy as np
import pytest

from barlight.llm import chat, sharding, topk, url_filter


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], "x") for i in range(300)]
    rows += [(301, None, "x"), (302, [0.1, None, 0.2], "x"), (303, [float("nan")] * 6, "x"), (304, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x"), (305, [], "x"), (306, [0.5, 0.5], "x")]
    rows += [(400 + i, [0.25] * 6, "x") for i in range(60)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = topk.top_k(df, lambda i: i % 20 == 0, k=7).collect()
    good = {i: [math.floor(64 * v) for v in e] for i, e, _ in rows if i is not None and e is not None and all(v is not None and math.isfinite(v) for v in e)}
    want = []
    for q in sorted(i for i in good if i % 20 == 0):
        s = sorted((-sum(a * b for a, b in zip(good[q], e)), i) for i, e in good.items() if i != q)[:7]
        want += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s)]
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("scale", [1, 1 << 20, 1 << 25])
def test_bounds_hold(scale):
    rng = np.random.default_rng(2)
    x, q = rng.integers(-30, 30, (500, 8)) * scale, rng.integers(-30, 30, (20, 8)) * scale
    ids, own = np.arange(500) * 3, np.arange(20) * 3
    at, row, score = topk.best_of(q, own, x, ids, 5)
    exact = q @ x.T
    for i in range(20):
        best = sorted((-int(s), int(r)) for s, r in zip(exact[i], ids) if r != own[i])[:5]
        assert [(-int(s), int(r)) for s, r in zip(score[at == i], row[at == i])] == best
    lists = topk.SortedLists(x[:50].astype(float))
    for read in (1, 10, 49, 50):
        low, high = lists.bounds(np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float), read)
        assert (low <= exact[:, :50]).all() and (exact[:, :50] <= high).all()


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, lambda i: i % 20 == 0).count() == 0


def test_shards(spark, tmp_path):
    rows = [(i, "é" * (i % 50), i) for i in range(500)] + [(None, "same", 0)] * 40 + [(7, None, 1), (7, None, 1), (8, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = sharding.shard_documents(spark, df, 5, str(tmp_path / "map"), slots=256).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
        assert r.next_shard in (r.shard, 5)
    loads = [sum(r.size for r in v) for v in by.values()]
    for v in by.values():
        assert sorted(r.place for r in v) == list(range(len(v)))
    assert max(loads) <= 1.1 * min(loads)
    texts = sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((r.id is None, r.id or 0, r.size, r.crc) for r in out) == texts
    one, two = sharding.load_map(spark, str(tmp_path / "map"), 1), sharding.load_map(spark, str(tmp_path / "map"), 2)
    assert one.shards == 5 and two.shards == 6 and all(two.shard[v] in (s, 5) for v, s in one.shard.items())
    assert max(two.loads()) <= max(one.loads())


def test_shards_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_documents(spark, df, 3, str(tmp_path / "map")).count() == 0


def test_urls(spark, monkeypatch):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.org", "", "block"), ("b.org", "/ok", "allow"), (None, None, "block"), ("net", "/", "allow")]
    index = url_filter.build_index(spark, spark.createDataFrame(rules, "host string, path string, verdict string"))
    urls = ["http://NET/", "http://x.net?q", "https://a.Example.net/en/1#t", "http://example.net/de", "ftp://b.org", "http://b.org/okay?x", "http://cb.org/", None, "no scheme", "", "http://É.net/ü"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://net/", "h")], "page_id long, url string, host string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(df, index, "page_id", "url").collect()}
    assert got[0] == ("net", "/", "net/", "block") and got[1] == ("x.net", "", None, "allow")
    assert got[2] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[3][2:] == ("net/", "block")
    assert got[4] == ("b.org", "", "b.org", "block") and got[5][2:] == ("b.org/ok", "allow") and got[6][2:] == (None, "allow")
    assert got[7] == got[8] == got[9] == ("", "", "", "block") and got[10] == ("É.net", "/ü", "net/", "block") and got[None][3] == "block"
    empty = url_filter.build_index(spark, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r.verdict for r in url_filter.judged(df, empty, "page_id", "url").collect()} == {"allow"}
    monkeypatch.setattr(url_filter, "MOST_RULES", 1)
    with pytest.raises(ValueError):
        url_filter.build_index(spark, spark.createDataFrame(rules, "host string, path string, verdict string"))


def test_equal_digests():
    a = url_filter.DigestArray.__new__(url_filter.DigestArray)
    a.keys, a.ends = np.array([5, 5, 9], np.uint64), np.array([2, 5, 6])
    a.strings = np.frombuffer(b"xyabcz", np.uint8)
    assert a.find(np.array([5, 5, 5, 9, 1], np.uint64), [b"abc", b"xy", b"no", b"z", b"z"]).tolist() == [1, 0, -1, 2, -1]


def test_tool_calls(spark):
    call = lambda *c: json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), x)) for x in c]})
    done = lambda i, v: json.dumps({"tool_call_id": i, "content": v})
    rows = [
        (1, 5, done("a", {"z": 1, "b": [True, None]})), (1, 1, call(("a", "f", {"y": "q", "x": 3}), ("b", "f", {"x": "@a"}))), (1, 9, call(("c", "f", {"x": 1, "more": "@b"}))),
        (1, 9, call(("a", "f", {"x": 9}))), (1, 11, done("zz", "lost")), (2, 0, call(("p", "f", {"x": 1, "y": "@q"}), ("q", "f", {"x": 1, "y": "@p"}), ("r", "g", {}), ("s", "f", None))),
        (2, 1, None), (2, 2, ""), (2, 3, "plain words"), (None, 0, call((None, "f", {"x": 1}))),
    ]
    tools = spark.createDataFrame([("f", "x", "integer", True), ("f", "y", "string", None)], "name string, parameter string, kind string, required boolean")
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "'clash' as level")
    got = {(r.conv, r.call_id): r for r in chat.link_tool_calls(df, tools).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (1, "zz"), (2, "p"), (2, "q"), (2, "r"), (2, "s"), (None, "turn-0-0")}
    a = got[(1, "a")]
    assert (a.turn, a.result_turn, a.level, a.n_calls, a.n_results, a.errors) == (1, 5, 0, 2, 1, "")
    assert a.json == '{"arguments":{"x":3,"y":"q"},"call_id":"a","errors":[],"level":0,"name":"f","result":{"b":[true,null],"z":1},"result_turn":5,"turn":1}'
    assert got[(1, "b")].level == 1 and got[(1, "b")].errors == "kind x" and got[(1, "c")].level == 2 and got[(1, "c")].errors == "unknown more"
    assert got[(1, "zz")].errors == "no call" and got[(2, "p")].level is None and got[(2, "q")].level is None
    assert got[(2, "r")].errors == "unknown tool" and got[(2, "s")].errors == "arguments" and got[(None, "turn-0-0")].errors == ""
    assert chat.link_tool_calls(df.limit(0), tools).count() == 0

"""Importance resampling against a plain restatement, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barlight.llm import importance

DOCS = "doc_id long, text string"


def _features(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return len(words), [*words, *[f"{a} {b}" for a, b in zip(words, words[1:])]]


def _brute(rows, target, percent, least, buckets, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in _features(t)[1])
    t = Counter(bucket(f) for _, x in target for f in _features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        n, f = _features(x)
        weight = sum(gain[bucket(w)] for w in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize("round_bytes", [1, 4 << 20])
def test_resampled(spark, monkeypatch, round_bytes):
    monkeypatch.setattr(importance, "ROUND_BYTES", round_bytes)
    rng = random.Random(1)
    words = ["The", "a1", "É", "日本", "naïve", "x_y", "don't", "long" * 30, "--", "9", "of", "\t"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(80)] + [(200, None), (201, ""), (202, " ,;"), (203, text(40_000)), (204, "w" * 200_000 + " end"), (None, text(30)), (5, text(30))]
    target = [(text(9) if k else "of 日本 of 日本") for k in range(6)] + [None, ""]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'r' as rank", "1 as th", "2 as key", "3 as row")
    bench = spark.createDataFrame([(t, "z") for t in target], "text string, bucket string")
    got = importance.resampled(df, bench, 40, 5, 97, 3).collect()
    assert sorted(repr((r.id, r.n_words, r.n_features, r.weight, r.score, r["rank"])) for r in got) == _brute(rows, [(0, t) for t in target], 40, 5, 97, 3)
    taken = importance.drawn(df, bench, percent=40, least_words=5, buckets=97, seed=3)
    ranks = {(r.id, r.th) for r in got if r["rank"] is not None}
    assert taken.columns == df.columns and taken.count() == len(ranks)


def test_ties_and_empty_tables(spark):
    rows = [(1, "same words here")] * 4 + [(2, "one")]
    bench = spark.createDataFrame([("words",)], "text string")
    df = spark.createDataFrame(rows, DOCS)
    got = importance.resampled(df, bench, 50, 2, 10, 0)
    assert sorted((r.id, r["rank"] or 0) for r in got.collect()) == [(1, 0), (1, 0), (1, 1), (1, 2), (2, 0)]
    assert importance.resampled(df.limit(0), bench).count() == 0
    none = importance.resampled(df, bench.limit(0), 50, 2, 10, 0).collect()
    assert len(none) == 5 and all(r.score is not None for r in none)


def test_joined_checksums():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randint(0, n))) for n in (90, importance.SHIFTED))
        got = importance._joined_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert int(got[0]) == zlib.crc32(a + b)


def test_features_of_nothing():
    n, of, bucket = importance._features(pa.array(["", " - "], pa.large_string()), 7)
    assert n.tolist() == [0, 0] and len(of) == len(bucket) == 0

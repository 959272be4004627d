"""The n-gram Jaccard join against all pairs, with odd rows."""

import random

import numpy as np
import pytest

from barlight.llm import buckets, jaccard

DOCS = "doc_id long, text string"


def _brute(rows, size, num, den):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    able = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    for a in able:
        for b in able:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                up[top(b)] = top(a)
    least = {}
    for k in able:
        least[top(k)] = min(rows[k][0], least.get(top(k), rows[k][0]))
    return sorted(repr((i, len(sets[k]), least[top(k)] if k in set(able) else i)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("close,block,packed,how", [(8, 1_024, 1 << 20, (3, 90, 100)), (2, 20, 50, (2, 7, 10))])
def test_similar_documents(spark, monkeypatch, close, block, packed, how):
    monkeypatch.setattr(buckets, "CLOSE", close)
    monkeypatch.setattr(buckets, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PACKED", packed)
    rng = random.Random(1)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(n)] for n in (40, 41, 80, 6, 150)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = "new%d" % rng.randint(0, 9)
        rows.append((i, " ".join(w[:rng.choice([len(w), len(w), len(w) - 2])])))
    rows += [(i, " ".join(base[2][:70]) + " " + " ".join("u%d_%d" % (i, k) for k in range(rng.randint(1, 9)))) for i in range(300, 340)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "one"), (404, "ONE"), (405, "one two"), (406, "É two"), (407, "é two"), (None, rows[0][1]), (None, None)]
    rows += [(0, rows[0][1]), (9, "a different text of one id"), (408, "a  different\ttext of ONE id"), (409, "again " * 20_000), (410, "again again again")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as id", "2 as node", "3 as key", "'x' as same")
    size, num, den = how
    got = jaccard.similar_documents(df, shingle=size, num=num, den=den).collect()
    assert sorted(repr((r.id, r.n, r.component)) for r in got) == _brute(rows, size, num, den)
    assert jaccard.similar_documents(df.limit(0)).count() == 0


def test_groups_of_near_copies(spark):
    """A few hundred texts of which all share passages and only some link."""
    rng = random.Random(2)
    base = ["w%d" % k for k in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.sample(range(60), rng.choice([1, 2, 3])):
            w[k] = "x%d" % rng.randint(0, 99)
        rows.append((i * 3, " ".join(w)))
    got = jaccard.similar_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(repr((r.id, r.n, r.component)) for r in got) == _brute(rows, 3, 90, 100)
    assert len({r.component for r in got}) > 20 and len({r.component for r in got}) < 280


def test_packed_numbers():
    x = np.array([0, 1, 2**47, 5], np.uint64)
    assert jaccard._numbers(jaccard._bytes_by_place(x, 6), 6, np.uint64).tolist() == x.tolist()
    y = np.array([-1, 7, 2**30], np.int32)
    assert jaccard._numbers(jaccard._bytes_by_place(y, 4), 4, np.int32).tolist() == y.tolist()

"""Spelling variants against all pairs of words, with odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barlight.llm import spelling


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _brute(rows, drop, least=3):
    n = Counter()
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop and h % drop == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 5:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= least}
    near = {w: [v for v in n if _near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(map(repr, out))


@pytest.mark.parametrize("block,held", [(16_384, 400_000), (3, 5)])
def test_variants(spark, monkeypatch, block, held):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "HELD_WORDS", held)
    rng = random.Random(1)
    stems = ["abcab", "banana", "cabbage", "aaaaaa", "naïveté", "Ångström", "hello", "abababab", "x" * 63 + "y", "z" * 80, "ÿÿÿÿÿ×"]

    def some():
        w = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w[k:k + 1] = rng.choice([[], [rng.choice("abé")], [w[k], rng.choice("abÖ")]])
        return "".join(w)

    rows = [(i, " ".join(some() for _ in range(rng.randint(0, 40)))) for i in range(90)]
    rows += [(200, None), (201, ""), (None, "hello hellp hello-hello_hello"), (3, rows[3][1]), (3, "hello cabbage"), (202, "tiny of a"), (203, "helo " * 5_000), (204, "q" * 300_000 + " " + "q" * 300_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as key", "1 as n", "'w' as word")
    for drop in (0, 7):
        got = spelling.variants(spelling.word_counts(df, drop_every=drop)).collect()
        assert sorted(repr((r.word, r.n, r.n_near, r.form, r.form_n, r.root)) for r in got) == _brute(rows, drop)
    assert spelling.variants(spelling.word_counts(df.limit(0))).count() == 0


def test_chain_of_forms(spark):
    """Sixteen steps of doubling counts, one letter each."""
    words = [("a" * (16 - k) + "b" * (k + 4), 2**k) for k in range(17)]
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {w: (words[k + 1][0] if k < 16 else None, words[-1][0]) for k, (w, _) in enumerate(words)}


def test_pivots_are_disjoint_and_rare():
    rng = random.Random(3)
    for _ in range(500):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(5, 9)))
        ranks = {g: k for k, g in enumerate(rng.sample([a + b for a in "abc" for b in "abc"], 9))}
        prefix, pivots = spelling.prefix_and_pivots(w, ranks)
        pairs = [(p[0] + q[0]) for p in prefix for q in prefix if q[1] - p[1] >= 2]
        assert len(pivots) == 2 and pivots[1][1] - pivots[0][1] >= 2 and pivots[0][0] + pivots[1][0] == min(pairs)
        assert len(prefix) >= 3 and set(pivots) <= set(prefix)


def test_one_edit():
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([5, 6, 7, 63, 64, 65, 66]))) for _ in range(60)]
    words += [w[:-1] for w in words] + [w[:2] + "b" + w[3:] for w in words]
    i, j = np.divmod(np.arange(len(words) ** 2), len(words))
    keep = np.array([words[a] != words[b] for a, b in zip(i, j)])
    i, j = i[keep], j[keep]
    got = spelling._verified(words, i, j)
    assert got.tolist() == [_near(words[a], words[b]) for a, b in zip(i, j)] == [spelling.one_edit(words[a], words[b]) for a, b in zip(i, j)]
    assert got.any()

"""Near and substring de-duplication and decontamination against brute force, with odd rows."""

import random
from collections import Counter

import numpy as np
import pytest

from barlight.llm import anchors, buckets, decontaminate, fm_dedup, repeats, simhash, suffix_dedup
from barlight.llm.components import components
from barlight.llm.induced import BucketQueue, suffix_order

DOCS = "doc_id long, text string"


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in list(up)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("ring", [simhash.STRICT, simhash.Ring(6, 3)])
def test_ring_loses_nothing(ring):
    rng = random.Random(4)
    e = ring.edges()
    for _ in range(3000):
        bits = rng.sample(range(64), rng.randint(0, ring.radius))
        touched = {next(k for k in range(ring.segments) if e[k] <= b < e[k + 1]) for b in bits}
        assert any(not touched & set(key) for key in ring.keys())
        x = np.array([sum(1 << b for b in bits)], dtype=np.uint64)
        assert ring.viable(ring.differences(x))[0]


def _fp(text, size=3):
    return simhash._majority(simhash._hashes((text or "").encode().lower().split(), size)) & (2**64 - 1)


@pytest.mark.parametrize("bucket", [64, 2])
def test_near_duplicates(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 40)) for _ in range(300)] for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(300)] = "new%d" % rng.randint(0, 99)
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (None, rows[0][1]), (0, rows[0][1]), (300, "word " * 30_000)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as fp", "2 as component")).collect()
    assert len(got) == len(rows)
    fps = {}
    for i, t in rows:
        if i is not None:
            fps[_fp(t)] = min(i, fps.get(_fp(t), i))
    up = {i: i for i in fps.values()}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = list(fps)
    for a in range(len(keys)):
        for b in range(a):
            if bin(keys[a] ^ keys[b]).count("1") <= 2:
                p, q = top(fps[keys[a]]), top(fps[keys[b]])
                up[max(p, q)] = min(p, q)
    want = sorted((-1 if i is None else i, _fp(t), -1 if i is None else top(fps[_fp(t)])) for i, t in rows)
    assert sorted((-1 if r.id is None else r.id, r.fp & (2**64 - 1), -1 if r.component is None else r.component) for r in got) == want
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("bucket", [8, 2])
def test_similar_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(buckets, "CLOSE", bucket)
    monkeypatch.setattr(buckets, "BLOCK", 2 * bucket)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, base = [], [[word() for _ in range(150)] for _ in range(5)]
    for i in range(60):
        w = list(base[i % 5])
        w[rng.randrange(150)] = word()
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(word() for _ in range(120))) for i in range(30)] + [(200, None), (201, ""), (None, rows[0][1]), (300, "tiny text"), (301, "Tiny  text")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as component", "1 as _id", "2 as row", "3 as own", "4 as key")
    kept = simhash.one_of_each(df).collect()
    want = {0, 1, 2, 3, 4, 200, 300, None, *range(100, 130)}
    assert {r.doc_id for r in kept} == want and len(kept) == len(want) and kept[0].component == "x"
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_texts_under_one_id_are_documents_of_their_own(spark):
    """Id 7 has a near copy of document 3 and a text that nothing resembles: only the copy goes, and only it is linked."""
    rng = random.Random(15)
    text = lambda: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(120)]
    a, b, c = text(), text(), text()
    rows = [(3, " ".join(a)), (7, " ".join([*a[:-1], "new"])), (7, " ".join(b)), (9, " ".join(c)), (7, " ".join(b))]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted((r.doc_id, r.text) for r in simhash.one_of_each(df).collect()) == sorted([rows[0], rows[2], rows[2], rows[3]])
    got = {r.fp: r.component for r in simhash.near_duplicates(df).where("id = 7").collect()}
    assert got[_fp(rows[2][1]) - (1 << 64) if _fp(rows[2][1]) >> 63 else _fp(rows[2][1])] == 7


def test_suffix_order():
    rng = random.Random(7)
    for _ in range(400):
        t = [rng.randint(0, rng.choice([1, 2, 4, 200])) for _ in range(rng.randint(1, 50))]
        t = t + t[rng.randrange(len(t)):] if rng.random() < 0.5 else t
        cap = rng.choice([3, 8, 100])
        order, lcp = suffix_order(np.array(t), cap)
        heads = [tuple(t[i:i + cap]) for i in order]
        assert heads == sorted(heads) and sorted(order.tolist()) == list(range(len(t)))
        for k in range(1, len(t)):
            a, b = heads[k - 1], heads[k]
            n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert min(int(lcp[k]), cap) == n
    assert len(suffix_order(np.zeros(0, np.int32), 5)[0]) == 0


def test_queue_spills():
    q = BucketQueue(3, most=40)
    for k in range(6):
        q.put(k % 2, np.array([k, k + 10], np.int32), np.array([k, k], np.uint8))
    assert q.file is not None and q.take(2) is None
    at, lcp = q.take(0)
    assert at.tolist() == [0, 10, 2, 12, 4, 14] and lcp.tolist() == [0, 0, 2, 2, 4, 4]
    q.close()


def test_anchors_cover():
    rng = random.Random(8)
    for _ in range(50):
        b = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 300)))
        start, size, key = anchors.runs(anchors.byte_hashes(b), 20, 8, longest=16)
        assert [w for s, n in zip(start, size) for w in range(s, s + n)] == list(range(max(0, len(b) - 19)))
        by = {}
        for s, n, k in zip(start.tolist(), size.tolist(), key.tolist()):
            for w in range(s, s + n):
                assert by.setdefault(b[w:w + 20], k) == k
        counts = dict(zip(*np.unique(anchors.anchor_keys(anchors.byte_hashes(b), 20, 8), return_counts=True)))
        for w in by:
            if b.count(w) > 1:
                assert counts[by[w]] > 1


def _brute(rows, width, words, first):
    seqs = {(i, t): (t or "").encode().split() if words else (t or "").encode() for i, t in rows}
    at = {}
    order = lambda k: (k[0] is not None, k[0] or 0)
    for k, s in seqs.items():
        for i in range(len(s) - width + 1):
            at.setdefault(tuple(s[i:i + width]), []).append((order(k), i))
    out = {}
    for k, s in seqs.items():
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            places = at[tuple(s[i:i + width])]
            if min(places) != (order(k), i) if first else len(places) > 1:
                gone[i:i + width] = [True] * width
        kept = b" ".join(w for w, g in zip(s, gone) if not g) if words else bytes(c for c, g in zip(s, gone) if not g)
        out[k] = (sum(gone), kept)
    return out


@pytest.mark.parametrize("frequent,tokens", [(512, 1_000_000), (3, 300)])
def test_substrings(spark, monkeypatch, frequent, tokens):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    monkeypatch.setattr(repeats, "INDEX_TOKENS", tokens)
    rng = random.Random(9)
    parts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(3, 60))) for _ in range(4)]
    rows = [(i, " ".join(rng.choice([*parts, "zz " * 9, "x%d" % rng.randint(0, 9999), "é ü"]) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, rows[3][1]), (None, rows[3][1]), (7, rows[7][1]), (503, "ab" * 3_000)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'c' as th", "1 as n_removed")
    want = _brute(rows, 8, True, False)
    got = fm_dedup.remove_repeated(df, 8, 4).collect()
    assert len(got) == len(rows) and sorted((r.id or -1, r.n_removed, r.kept) for r in got) == sorted((i or -1, want[(i, t)][0], want[(i, t)][1].decode()) for i, t in rows)
    want = _brute(rows, 20, False, True)
    got = suffix_dedup.remove_earlier(df, 20, 8).collect()
    assert sorted((r.id or -1, r.n_removed, bytes(r.kept)) for r in got) == sorted((i or -1, *want[(i, t)]) for i, t in rows)
    cut = {r.doc_id: r for r in fm_dedup.without_repeats(df, 8, 4).collect()}
    assert cut[501].text == "" and cut[0].th == "c"
    for f in (fm_dedup.remove_repeated, suffix_dedup.remove_earlier):
        assert f(df.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([40, 25, 60, 3, 12])] + [(10, None), (11, "")]
    w = [t.split() if t else [] for _, t in items]
    edit = list(w[0])
    edit[38] = "changed"
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [(1, f"{noise(30)} {items[0][1].upper()} {noise(20)}"), (2, noise(10) + " " + " ".join(edit)), (3, " ".join(w[2][:30])), (4, items[3][1]), (5, items[3][1] + " more"), (6, None), (7, ""),
            (None, items[1][1]), (8, items[1][1] + "\n" + items[4][1]), (8, noise(15)), (9, noise(300)), (1, f"{noise(30)} {items[1][1]}")]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "0 as item", "'y' as start", "1 as _id", "2 as row", "3 as own", "4 as key")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.id or -1, r.item) for r in decontaminate.contaminated(df, bench).collect())
    assert got == [(-1, 1), (1, 0), (1, 1), (2, 0), (4, 3), (5, 3), (8, 1), (8, 4)]
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 8, 9]
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df, spark.createDataFrame([(None, "a b")], "item_id long, text string")).count() == 0


EDITS = {
    "scattered words": lambda w, new, share, rng: [new() if rng.random() < share / 8 else x for x in w],
    "replaced block": lambda w, new, share, rng: [*w[:len(w) // 3], *[new() for _ in range(int(len(w) * share / 2))], *w[len(w) // 3 + int(len(w) * share / 2):]],
    "appended text": lambda w, new, share, rng: [*w, *[new() for _ in range(int(len(w) * share))]],
    "truncation": lambda w, new, share, rng: w[:len(w) - int(len(w) * share)],
}


@pytest.mark.parametrize("edit", EDITS)
def test_similar_pairs_are_found(spark, edit):
    """Recall of at least 0.99 against all pairs, whatever the edit; pairs of each base are alone, so no group helps."""
    rng, drawn = random.Random(12), np.random.default_rng(12)
    new = lambda: "w%d" % drawn.zipf(1.3)
    sets = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    rows, want = [], set()
    for k in range(400):
        w = [new() for _ in range(rng.randint(200, 900))]
        v = EDITS[edit](w, new, rng.uniform(0.1, 0.2), rng)
        a, b = sets(w), sets(v)
        if 5 * len(a & b) >= 4 * len(a | b):
            want.add(2 * k + 1)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    assert len(want) > 200
    found = {r.id for r in simhash.similar_groups(spark.createDataFrame(rows, DOCS)).where("id != component").collect()}
    print(edit, len(found), len(want))
    assert found <= want and len(found) >= 0.99 * len(want)


def test_short_items_inside_documents(spark):
    """Items of one to four words count wherever a window of their size equals them."""
    items = [(1, "solo"), (2, "two words"), (3, "three small words"), (4, "these are Four words"), (5, "five words are one shingle")]
    docs = [(1, "a text of many words that ends in SOLO"), (2, "one, two words"), (3, "here\tthree  small words stand"), (4, "x y z these are four words and more of them"), (5, "two small words, these were four words"),
            (6, "so five words are one shingle."), (7, "so five words are one shingle here"), (8, "solo"), (9, "two"), (None, "solo two words solo"), (10, "solos")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.id or -1, r.item, r.start, r.n_words, r.similarity) for r in got) == [(-1, 1, 0, 1, 1.0), (-1, 2, 1, 2, 1.0), (1, 1, 8, 1, 1.0), (2, 2, 1, 2, 1.0), (3, 3, 1, 3, 1.0), (4, 4, 3, 4, 1.0), (7, 5, 1, 5, 1.0), (8, 1, 0, 1, 1.0)]


def test_items_of_any_length_and_without_id(spark, monkeypatch):
    """Long items meet whole; each text with a null id is an item of its own; words bound a pass."""
    monkeypatch.setattr(decontaminate, "WORDS_A_PASS", 1_500)
    rng = random.Random(13)
    noise = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    items = [(1, noise(2_500)), (2, noise(30)), (None, noise(40)), (None, noise(3)), (None, noise(3_000)), (3, noise(1_900)), (None, None)]
    t = [x for _, x in items]
    cut = t[0].split()
    docs = [(1, noise(50) + " " + t[0] + " " + noise(50)), (2, " ".join(cut[:2_200])), (3, " ".join(cut[:1_800])), (4, f"{t[2]} {t[3]}"), (5, noise(9) + " " + t[4].upper()), (6, t[5]), (7, t[1]), (8, noise(60)), (9, None)]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert sorted((r.id, r.item or 0, r.start, r.n_words) for r in got) == [(1, 1, 50, 2_500), (2, 1, 0, 2_200), (4, 0, 0, 40), (4, 0, 40, 3), (5, 0, 9, 3_000), (6, 3, 0, 1_900), (7, 2, 0, 30)]
    assert {r.similarity for r in got if r.id != 2} == {1.0}
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench).collect()) == [3, 8, 9]


def test_similarity_of_bags(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    rng = random.Random(14)
    pairs = [([rng.choice(["a", "bb", "ccc", "é"]) for _ in range(rng.randint(0, 9))], [rng.choice(["a", "bb", "ccc", "é"]) for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    bag = lambda c: decontaminate.bag_of(F.col(c))
    for r in spark.createDataFrame(pairs, "a array<string>, b array<string>").withColumn("s", decontaminate.similarity(bag("a"), bag("b"))).collect():
        a, b = Counter(r.a), Counter(r.b)
        assert r.s == sum(n * len(x) for x, n in (a & b).items()) / max(1, sum(n * len(x) for x, n in (a | b).items()))


@pytest.mark.parametrize("keep_first", [True, False])
def test_windows_of_frequent_anchors_meet_nothing(spark, keep_first):
    """A passage in many distinct stretches: ranges are those of brute force, few a row, and no join knows the digest of a window."""
    rng = random.Random(21)
    noise = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    law, passage = repeats.Law(20, 8, False, keep_first), noise(60)
    segs = [noise(25) + passage[rng.randint(0, 9):] + noise(25) for _ in range(40)]
    segs += [segs[3], segs[3], segs[5] + segs[5], noise(30)]
    rows = [(7, None if k == 20 else 100 - k, k, 11 * (k % 3), len(s) - 19, s) for k, s in enumerate(segs)]
    df = spark.createDataFrame(rows, "key long, id long, th long, start int, size int, seg binary").repartition(3)
    places = {}
    for _, i, th, start, size, s in rows:
        for k in range(size):
            places.setdefault(s[k:k + 20], []).append((i is not None, i or 0, th, start + k))
    want = set()
    for _, i, th, start, size, s in rows:
        for k in range(size):
            at = places[s[k:k + 20]]
            if len(at) > 1 and (not keep_first or (i is not None, i or 0, th, start + k) > min(at)):
                want |= {(th, start + k + j) for j in range(20)}
    out = repeats._frequent(df, law)
    got = out.collect()
    assert {(r.th, x) for r in got for x in range(r.a, r.b)} == want and len(got) < 4 * len(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "digest" in x]


def test_simhash_links_before_bands(spark, monkeypatch):
    """Without any bucket of bands the fingerprints within two bits alone link what is similar."""
    whole = simhash.links_in_buckets
    monkeypatch.setattr(simhash, "links_in_buckets", lambda rows, entries, num, den, pairs: whole(rows, entries.limit(0), num, den, pairs))
    rng = random.Random(23)
    a = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3_000)]
    rows = [(4, " ".join(a)), (9, " ".join([*a, "more"])), (11, " ".join(a[::-1]))]
    assert bin(_fp(rows[0][1], 5) ^ _fp(rows[1][1], 5)).count("1") <= 2
    assert {r.id: r.component for r in simhash.similar_groups(spark.createDataFrame(rows, DOCS)).collect()} == {4: 4, 9: 4, 11: 11}


def test_large_buckets_are_passed_on_seldom(spark, monkeypatch):
    """Near copies that hardly link keep all their keys; rounds in which a set meets its largest bucket pass on a row a set."""
    passed, whole = [], buckets.reliable_checkpoint

    def counted(df):
        out = whole(df)
        if {"key", "node", "comp"} <= set(df.columns):
            passed.append(out.count())
        return out

    monkeypatch.setattr(buckets, "reliable_checkpoint", counted)
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(200)], []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(200), 6 if i % 5 else 3):
            w[k] = word()
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, DOCS)
    got = {r.id: r.component for r in simhash.similar_groups(df).collect()}
    bands = [b for _, t in rows for b in simhash._bands(np.unique(simhash._hashes(t.encode().split(), 5))).tolist()]
    large = sum(n for n in Counter(bands).values() if n > buckets.CLOSE)
    assert max(passed) > large // 2 > 4 * len(rows) and sum(passed) <= (buckets.ROUNDS + 1) * large + 2 * len(rows) * buckets.ROUNDS
    sets = [{tuple(t.split()[k:k + 5]) for k in range(196)} for _, t in rows]
    bucket = [set(simhash._bands(np.unique(simhash._hashes(t.encode().split(), 5))).tolist()) for _, t in rows]
    up = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bucket[a] & bucket[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and up[a] != up[b]:
                up = [min(up[a], up[b]) if x in (up[a], up[b]) else x for x in up]
    assert got == dict(enumerate(up)) and 20 < len(set(up)) < 140

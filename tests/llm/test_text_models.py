"""Toxicity and pieces on small tables; the pipeline runs through."""

import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barlight.llm import pieces, toxicity

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
needs_model = pytest.mark.skipif(not Path(MODEL).exists(), reason="no model file")


def test_toxicity(spark):
    rng = random.Random(11)
    bad, fine = ["vile", "rotten", "filth"], ["%s%s" % (a, b) for a in "abcdefgh" for b in "klmnop"]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [rng.choice(fine) for _ in range(rng.randint(10, 60))] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(1000, None), (1001, ""), (1002, "r0tten you f1lth!"), (None, "vile you"), (1003, "word " * 20_000), (5, "twice")]
    labels += [(None, 1), (2000, 1), (7, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as label", "'q' as _n")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    learn = lab.where("doc_id is null or doc_id % 4 <> 2")
    model = toxicity.fit(df, learn)
    assert set(bad) <= set(model.strong)
    out = toxicity.scored(df, model).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    truth = dict(labels)
    held = [r for r in out if r.id is not None and r.id < 600 and r.id % 4 == 2]
    assert sum((r.score >= 0.3) == bool(truth[r.id]) for r in held) >= 0.95 * len(held)
    score = {r.id: r.score for r in out}
    assert score[1002] >= 0.3 > score[1001] and score[1000] == score[1001]
    kept = toxicity.accepted(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.id for r in out if r.score < 0.3}
    none = toxicity.fit(df, lab.limit(0))
    assert {r.score for r in toxicity.scored(df, none).collect()} == {0.0} and toxicity.scored(df.limit(0), model).count() == 0
    only = toxicity.fit(df, lab.where("toxic = 1"))
    assert only.prior == 1.0


@needs_model
@pytest.mark.parametrize("chunk", [16_384, 40, 17])
def test_pieces(spark, chunk):
    v = pieces.Vocabulary(MODEL)
    rng = random.Random(12)
    bits = ["a", "the ", " ", "  ", "\n", "é", "梦", "▁", "ing", "\U0001f600", "in", "er", "t", "on", ""]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 120)))) for i in range(150)]
    rows += [(1000, None), (None, "abc"), (1001, "a" * 300), (1001, "a" * 300), (1002, "word" * 100 + " x"), (1003, ""), (None, "long null " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as k", "'s' as pieces")
    model = pieces.ship_model(spark, MODEL)
    got = pieces.decode(pieces.encode(df, model, chunk=chunk), model).collect()
    assert sorted((r.id or -1, r.decoded) for r in got) == sorted((i or -1, t or "") for i, t in rows)

    def best(t):
        s = "".join("\0" if c == "▁" else "▁" if c == " " else c for c in " " + t) if t else ""
        out = [0] + [pieces.NEVER] * len(s)
        for p in range(len(s)):
            if s[p] == "\0":
                out[p + 1] = max(out[p + 1], out[p] + 3 * v.byte_score)
                continue
            for q in range(p + 1, min(len(s), p + v.longest) + 1):
                if s[p:q] in v.score:
                    out[q] = max(out[q], out[p] + v.score[s[p:q]][0])
            if s[p] not in v.score:
                out[p + 1] = max(out[p + 1], out[p] + v.byte_score * len(s[p].encode()))
        return out[-1]

    bytes_ = set(v.byte.values())
    for r in got:
        assert sum(v.byte_score if i in bytes_ else v.score[v.text[i]][0] for i in r.pieces) == best(r.decoded)
    assert pieces.encode(df.limit(0), model).count() == 0


@needs_model
@pytest.mark.parametrize("chunk", [16_384, 17])
def test_pieces_are_checked_where_they_are_made(spark, chunk):
    rows = [(1, None), (None, "abc"), (2, "a" * 300), (2, "a" * 300), (3, "word  \n" * 30 + "\u2581 x \U0001f600"), (4, ""), (None, "long null " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pieces.ship_model(spark, MODEL)
    out = pieces.encode(df, model, chunk=chunk, checked=True)
    assert out.columns == ["id", "th", "pieces", "round_trip"] and all(r.round_trip for r in out.collect())
    plain = pieces.encode(df, model, chunk=chunk)
    assert sorted(map(str, out.drop("round_trip").collect())) == sorted(map(str, plain.collect()))
    assert pieces.encode(df.limit(0), model, checked=True).count() == 0


@needs_model
def test_pipeline_tasks_hold_little_outside_the_heap(spark):
    """Whole texts do not fill batches of 10,000 rows, and the last stage asks for one Python worker a task, not for two at once."""
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    try:
        out = corpus_pipeline.encode_pieces(spark, spark.range(3).selectExpr("id as doc_id", "'some text' as text"), "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert 0 <= plan.index("Union") < plan.index("MapInArrow")
        wide = spark.range(0, 4_000, 1, 1).selectExpr("id", "repeat('x', 4000) as text")
        sizes = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"b": [x.nbytes], "n": [x.num_rows]}) for x in batches), "b long, n long").collect()
        assert max(r.b for r in sizes) <= 6 << 20 and sum(r.n for r in sizes) == 4_000
    finally:
        spark.conf.unset(name)


def test_scan_is_associative():
    import numpy as np

    rng = np.random.default_rng(13)
    a, b, c = (rng.integers(-50, 0, (3, 4, 4)) for _ in range(3))
    assert (pieces.combined(pieces.combined(a, b), c) == pieces.combined(a, pieces.combined(b, c))).all()


@needs_model
@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="driver tables not here")
def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() <= docs.count() and out.where(~F.col("round_trip")).count() == 0

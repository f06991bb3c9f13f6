"""Attention over passages: features, gradients, planted passages and held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tradescope.llm import mil


def test_features_equal_loops():
    r = np.random.default_rng(1)
    texts = ["", None, "  ", "one", "a b a b a b a", "Zwölf 12 ### Boxkämpfer!\n\nx", " ".join(f"w{r.integers(30)}" for _ in range(200)), "x" * 500]
    x, base = mil.passages(pa.array(texts))
    at = 0
    for text, start in zip(texts, base.tolist(), strict=True):
        assert start == at
        words = [w for w in (text or "").encode().split()]
        parts = [words[i : i + mil.WORDS] for i in range(0, len(words), mil.WORDS)] or [[]]
        seen, triples, place = set(), set(), 0
        for part in parts:
            again = again3 = 0
            for w in part:
                again += w in seen
                seen.add(w)
                if place + 2 < len(words):
                    triple = tuple(words[place : place + 3])
                    again3 += triple in triples
                    triples.add(triple)
                place += 1
            n = max(len(part), 1)
            assert np.allclose(x[at, -4:], [np.log1p(len(part)), sum(map(len, part)) / n / 10, again / n, again3 / n], atol=1e-6)
            at += 1
        assert np.allclose((x[start:at, : mil.BUCKETS] ** 2).sum(axis=1), [1 if len((text or "").encode()) > 2 else 0] * (at - start), atol=1e-5)
    assert at == len(x)
    alone = np.concatenate([mil.passages(pa.array([t], pa.string()))[0] for t in texts])
    assert np.allclose(alone, x)
    assert np.allclose(mil.passages(pa.array(["zz", *texts]).slice(1))[0], x)


def test_gradients_equal_differences():
    g = np.random.default_rng(0)
    x, starts, y, weight = g.normal(size=(20, mil.FEATURES)), np.array([0, 3, 10]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    model = mil.Attention()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        s = model.forward(x, starts)["score"]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean()

    for name, grad in model.gradients(x, starts, y, weight).items():
        for index in [tuple(g.integers(0, n) for n in grad.shape) for _ in range(3)]:
            kept = model.p[name][index]
            ends = []
            for step in (1e-5, -1e-5):
                model.p[name][index] = kept + step
                ends.append(loss())
            model.p[name][index] = kept
            assert abs((ends[0] - ends[1]) / 2e-5 - grad[index]) < 1e-7


def test_attention_finds_the_passage_that_spoils_a_document(spark):
    g = np.random.default_rng(3)
    words = np.array("river market town people letter winter garden morning house music".split())
    passage = lambda bad: " ".join(g.choice(words, mil.WORDS) + ("###" if bad else ""))
    rows, labels, where = [], [], {}
    for i in range(240):
        n = int(g.integers(2, 9))
        spoilt = int(g.integers(n)) if i % 3 == 0 else -1
        where[i] = spoilt
        rows.append((i, " ".join(passage(k == spoilt) for k in range(n))))
        labels.append((i, int(spoilt < 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = mil.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("doc_id") < 160, with_attention=True).collect()
    late = [r for r in found if r["doc_id"] >= 160]
    assert np.mean([r["predicted"] == labels[r["doc_id"]][1] for r in late]) >= 0.95
    spoilt = [r for r in late if where[r["doc_id"]] >= 0]
    assert np.mean([int(np.argmax(r["attention"])) == where[r["doc_id"]] for r in spoilt]) > 0.8
    assert all(abs(sum(r["attention"]) - 1) < 1e-5 and 0 <= r["score"] <= 1 for r in found)


def test_held_out_documents(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = mil.score_quality(docs, labels, ~held).join(labels, "doc_id").select("doc_id", "score", "predicted", "quality").collect()
    test = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(test) > 50 and np.mean([r["predicted"] == r["quality"] for r in test]) >= 0.95


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, quality int")
    assert {(r["score"], r["predicted"]) for r in mil.score_quality(docs, labels).collect()} == {(0.5, 1)}
    assert mil.score_quality(docs, labels, with_attention=True).filter("attention IS NULL").count() == 3

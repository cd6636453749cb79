"""Retrieval against all scores worked out one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import retrieve

INDEX = "doc_id {kind}, ord long, embedding array<float>"


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def brute(chunks, asked, k, per_document=None):
    out = {}
    for q, v in asked:
        rows = sorted((-round(dot(v, e), 6), d, o) for d, o, e in chunks if d is not None and e and None not in e and len(e) == len(v))
        if per_document is not None:
            rows = [r for i, r in enumerate(rows) if sum(x[1] == r[1] for x in rows[:i]) < per_document]
        out[q] = [(n + 1, d, o, -s + 0.0) for n, (s, d, o) in enumerate(rows[:k])]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["qid"], []).append((r["rank"], r["doc_id"], r["ord"], r["score"] + 0.0))
    return {q: sorted(rows) for q, rows in out.items()}


@pytest.fixture(scope="module", params=["long", "string"])
def made(request, spark):
    rng = random.Random(2)
    label = (lambda d: d) if request.param == "long" else (lambda d: f"d{d:02}")
    vector = lambda: [float(rng.randrange(-3, 4)) for _ in range(4)]  # noqa: E731  many ties
    chunks = [(label(0 if rng.random() < 0.4 else rng.randrange(20)), i, vector()) for i in range(400)]  # a third in one document
    odd = [(label(1), 900, None), (label(1), 901, []), (label(1), 902, [1.0, 2.0]), (None, 903, [9.0] * 4), (label(2), 904, [1.0, None, 1.0, 1.0])]
    asked = [(q, vector()) for q in range(37)]
    index = spark.createDataFrame(chunks + odd, INDEX.format(kind=request.param)).withColumns({"qid": F.lit(1), "score": F.lit("x"), "dim": F.lit(2)}).repartition(6).cache()
    questions = spark.createDataFrame([*asked, (99, None)], "qid long, q array<double>").cache()
    return chunks + odd, asked, index, questions


@pytest.mark.parametrize("blocks", [(512, 1024, 32), (5, 16, 2)])
def test_best_chunks(made, monkeypatch, blocks):
    """One block of questions that is sent, and many blocks that are dealt out: the same rows."""
    for name, n in zip(("QUESTION_BLOCK", "CHUNK_BLOCK", "SENT_BLOCKS"), blocks, strict=True):
        monkeypatch.setattr(retrieve, name, n)
    chunks, asked, index, questions = made
    assert found(retrieve.top(index, questions, 5)) == brute(chunks, asked, 5)
    assert found(retrieve.top(index, questions, 10_000)) == brute(chunks, asked, 10_000)
    assert found(retrieve.top_across(index, questions, 5, 2)) == brute(chunks, asked, 5, 2)
    per = {}
    for r in retrieve.top_in_document(index, questions, 3).collect():
        per.setdefault((r["qid"], r["doc_id"]), []).append((r["rank"], r["ord"], r["score"]))
    for (q, d), rows in per.items():
        own = brute([c for c in chunks if c[0] == d], [a for a in asked if a[0] == q], 3)[q]
        assert sorted(rows) == [(n, o, s) for n, _, o, s in own]
    assert len(per) == len(asked) * len({c[0] for c in chunks if c[0] is not None})
    plan = retrieve.top(index, questions, 5)._jdf.queryExecution().toString()
    assert ("CartesianProduct" in plan) == (blocks[0] == 5)
    scores = retrieve.score(index, questions)
    assert scores.count() == len(asked) * 400


def test_few_rows_leave_a_partition(made):
    """k rows for each question and partition, however many chunks there are."""
    _, asked, index, questions = made
    for most in (None, 3):
        n = retrieve.candidates(index, questions, 5, most)
        per = n.withColumn("p", F.spark_partition_id()).groupBy("qid", "p").count().agg(F.max("count"), F.count("*")).first()
        assert per[0] == 5 and per[1] <= len(asked) * n.rdd.getNumPartitions()


def test_nothing_to_find(made):
    _, _, index, questions = made
    assert retrieve.top(index.limit(0), questions).collect() == [] and retrieve.top(index, questions.limit(0)).collect() == []


def test_a_large_k_is_not_remembered_by_a_task(spark, monkeypatch):
    """Of a k beyond a block, rows go on in parts of bounded size; what comes out is the same."""
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (40, 3)).astype(float).tolist()
    index = spark.createDataFrame([(i % 7, i, v) for i, v in enumerate(vectors)], "doc_id int, ord int, embedding array<double>").repartition(3)
    questions = spark.createDataFrame([(i, v) for i, v in enumerate(vectors[:9])], "qid int, q array<double>")
    show = lambda df: sorted(map(tuple, df.select("qid", "rank", "doc_id", "ord", "score").collect()))
    small = [show(f(index, questions, 12)) for f in (retrieve.top, retrieve.top_across)]
    monkeypatch.setattr(retrieve, "CHUNK_BLOCK", 8)
    monkeypatch.setattr(retrieve, "PIECE", 16)
    assert [show(f(index, questions, 12)) for f in (retrieve.top, retrieve.top_across)] == small
    sizes = [s.shape for *_, s in retrieve._parts(iter([(0, list(range(9)), [], [], np.zeros((9, 8)))]))]
    assert sizes == [(2, 8)] * 4 + [(1, 8)]


@pytest.mark.parametrize("k", [1, 7, 60, 399, 400, 10_000])
@pytest.mark.parametrize("steps", [1, 8, 512])
def test_best_are_the_rows_of_top(made, monkeypatch, k, steps):
    """Ties and steps that hold the k-th and more: the same rows, without ranks."""
    monkeypatch.setattr(retrieve, "STEPS", steps)
    chunks, asked, index, questions = made
    got = {}
    for r in retrieve.best(index, questions, k).collect():
        got.setdefault(r["qid"], []).append((-r["score"], r["doc_id"], r["ord"]))
    expected = {q: [(-s, d, o) for _, d, o, s in rows] for q, rows in brute(chunks, asked, k).items()}
    assert {q: sorted((s + 0.0, d, o) for s, d, o in rows) for q, rows in got.items()} == {q: sorted((s + 0.0, d, o) for s, d, o in rows) for q, rows in expected.items()}


def test_best_shuffles_one_step(spark):
    """Rows that are surely among the best aren't shuffled."""
    vectors = [[math.cos(i), math.sin(i)] for i in range(2000)]
    index = spark.createDataFrame([(i % 7, i, v) for i, v in enumerate(vectors)], "doc_id int, ord int, embedding array<double>").repartition(3)
    questions = spark.createDataFrame([(i, v) for i, v in enumerate(vectors[:9])], "qid int, q array<double>")
    found = retrieve.best(index, questions, 1500)
    assert {r["n"] for r in found.groupBy("qid").agg(F.count("*").alias("n")).collect()} == {1500}
    sure, ranked = found._jdf.queryExecution().optimizedPlan().children().apply(0), found._jdf.queryExecution().optimizedPlan().children().apply(1)
    assert "Window" not in sure.toString() and "Window" in ranked.toString()

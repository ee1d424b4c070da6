"""Approximate search: recall, exact scores, ties, copies, and odd inputs."""

import numpy as np
import pytest

from tidemark.operators import retrieve, similar


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def clustered():
    """Vectors around 40 centres, many equal ones, a zero vector; questions near the centres."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    docs = centres[rng.integers(0, 40, 1500)] + 0.25 * rng.normal(size=(1500, 24))
    docs[600:1100] = docs[0]  # a third are equal
    docs[1200] = 0
    asked = centres[:20] + 0.2 * rng.normal(size=(20, 24))
    return docs.round(4), asked.round(4)


def test_recall_scores_and_few_pairs(spark, clustered):
    vectors, asked = clustered
    docs = frame(spark, [(i, v.tolist()) for i, v in enumerate(vectors)] + [(9000, None)], "id long, vector array<double>").repartition(5)
    questions = frame(spark, [(i, v.tolist(), 5 + i % 7) for i, v in enumerate(asked)] + [(99, None, 3)], "qid long, vector array<double>, k int")
    index = similar.fit_filters(docs, questions)
    got = {(r["qid"], r["id"]): (r["rank"], r["score"]) for r in similar.knn_lsh(docs, questions, filters=index).collect()}
    want = {(r["qid"], r["id"]): (r["rank"], r["score"]) for r in retrieve.knn(docs, questions).collect()}
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    for key in got.keys() & want.keys():
        assert abs(got[key][1] - want[key][1]) < 1e-8
    heads = docs.where("vector IS NOT NULL").dropDuplicates(["vector"])
    pairs = similar.candidates(heads, questions.where("vector IS NOT NULL"), index)
    assert pairs.count() < 0.2 * heads.count() * 20
    assert pairs.count() == pairs.distinct().count()
    again = {(r["qid"], r["id"]): (r["rank"], r["score"]) for r in similar.knn_lsh(docs.repartition(2), questions, filters=index).collect()}
    assert again == got


def test_equal_vectors_give_the_smallest_ids(spark):
    docs = frame(spark, [(i, [1.0, 2.0, 0.0, 1.0]) for i in range(50)] + [(77, [-1.0, 0.0, 3.0, 0.0])], "id long, vector array<double>")
    asked = frame(spark, [("a", [1.0, 2.0, 0.0, 1.0], 4)], "qid string, vector array<double>, k int")
    got = [(r["rank"], r["id"], r["score"]) for r in similar.knn_lsh(docs, asked).orderBy("rank").collect()]
    assert got == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0)]


def test_empty_tables(spark):
    docs = frame(spark, [(1, [1.0, 0.0]), (2, None)], "id long, vector array<double>")
    asked = frame(spark, [(1, [1.0, 0.0], 2)], "qid long, vector array<double>, k int")
    for d, q in ((docs.where("false"), asked), (docs, asked.where("false")), (docs.where("id = 2"), asked)):
        out = similar.knn_lsh(d, q)
        assert out.columns == ["qid", "rank", "id", "score"] and out.count() == 0
    assert [r["id"] for r in similar.knn_lsh(docs, asked).collect()] == [1]


def test_probes_reach_the_stated_chance():
    """Of vectors at the stated cosine about the stated share is met, however many dimensions."""
    rng = np.random.default_rng(8)
    for dims, like in ((32, 0.8), (64, 0.6), (7, 0.9)):
        filters = similar.Filters(dims, 2048, 2.3, like, 0.95)
        q = rng.normal(size=(300, dims))
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        other = rng.normal(size=q.shape)
        other -= (other * q).sum(axis=1, keepdims=True) * q
        other /= np.linalg.norm(other, axis=1, keepdims=True)
        near = like * q + np.sqrt(1 - like**2) * other
        rows, which = filters.passed(near)
        lists = [set(which[rows == i]) for i in range(len(q))]
        met = np.mean([bool(lists[i] & set(p.tolist())) for i, p in enumerate(filters.probes(q))])
        assert met >= 0.85, (dims, like, met)
        far, which = filters.passed(-near)
        assert not np.mean([bool(set(which[far == i]) & set(p.tolist())) for i, p in enumerate(filters.probes(q))])


def test_sizes_follow_from_the_likeness_of_neighbours(clustered):
    vectors, asked = clustered
    units = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    near = similar.sized(units(asked), np.full(20, 5), units(np.unique(vectors, axis=0)), 0.9, 0.2)
    rng = np.random.default_rng(1)
    far = similar.sized(units(rng.normal(size=(20, 24))), np.full(20, 20), units(rng.normal(size=(800, 24))), 0.9, 0.2)
    assert near.like > far.like and near.directions < far.directions

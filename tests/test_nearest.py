"""The vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlog.operators import nearest
from cairnlog.operators.chunks import search_similar, similar_batch, similar_to_chunk


def clustered(seed=4, groups=12, size=150, width=16, spread=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    vectors = np.repeat(centres, size, axis=0) + rng.normal(size=(groups * size, width)) * spread
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[5] = vectors[4]  # ties
    vectors[len(vectors) // 2] = vectors[4]
    return vectors


def corpus(spark, vectors):
    rows = [(i, f"file{i % 3}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "chunk_index long, file string, vec array<double>").repartition(5)


def best(vectors, query, k, without=None, minimum=-9.0):
    similar = vectors @ query
    order = sorted((-round(s, 12), i) for i, s in enumerate(similar) if i != without and s >= minimum)
    return [i for _, i in order[:k]]


@pytest.mark.parametrize("cells, task_numbers, ring", [(256, 4_194_304, 256), (10, 3_000, 8), (1, 500, 3)])
def test_index_finds_what_a_scan_finds(spark, monkeypatch, tmp_path, cells, task_numbers, ring):
    monkeypatch.setattr(nearest, "TASK_NUMBERS", task_numbers)
    monkeypatch.setattr(nearest, "RING", ring)
    vectors = clustered()
    whole = corpus(spark, vectors)
    built = nearest.build_index(whole, str(tmp_path / "index"), cells=cells)
    again = nearest.read_index(spark, str(tmp_path / "index"))
    queries = whole.where("chunk_index % 37 = 4").select(F.col("chunk_index").alias("query_id"), "vec")
    for index in (built, again):
        found, report = index.search(queries, 6, others_only=True)
        got = {}
        for row in found.collect():
            got.setdefault(row["query_id"], {})[row["rank"]] = row["chunk_index"]
        wanted = range(4, len(vectors), 37)
        assert {q: [own[r] for r in sorted(own)] for q, own in got.items()} == {
            q: best(vectors, vectors[q], 6, without=q) for q in wanted
        }
        scored = report.collect()
        assert len(scored) == len(wanted) and all(row["total"] == len(vectors) for row in scored)
    if cells > 1:
        # Most rows are in cells, or rings, that cannot hold one of the best.
        assert sum(row["scored"] for row in scored) < 0.4 * len(scored) * len(vectors)


def test_minimum_more_than_there_are_and_nothing(spark):
    vectors = clustered(groups=3, size=20)
    whole = corpus(spark, vectors)
    index = nearest.build_index(whole, cells=4)
    query = [float(x) for x in vectors[4]]
    for minimum in (0.99, -2.0):
        found = search_similar(whole, query, 500, minimum, index=index).collect()
        plain = search_similar(whole, query, 500, minimum).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, plain))
        assert {row["chunk_index"] for row in found} == set(best(vectors, vectors[4], 500, minimum=minimum))
    found = similar_to_chunk(whole, 4, 3, index=index).collect()
    assert sorted(row["chunk_index"] for row in found) == sorted(best(vectors, vectors[4], 3, without=4))
    none = nearest.build_index(whole.where("chunk_index < 0"))
    assert none.nearest(whole.select(F.col("chunk_index").alias("query_id"), "vec")).count() == 0
    blank = spark.createDataFrame([(1, None), (2, [1.0])], "query_id long, vec array<double>")
    assert index.nearest(blank).count() == 0


def test_vectors_of_other_lengths_than_one(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(400, 6)) * rng.choice([0.0, 0.1, 1, 50], size=(400, 1))
    whole = corpus(spark, vectors)
    queries = whole.where("chunk_index < 20").select(F.col("chunk_index").alias("query_id"), "vec")
    found = nearest.build_index(whole, cells=8).nearest(queries, 5)
    got = {}
    for row in found.orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["chunk_index"])
    for q in range(20):
        assert np.allclose(sorted(vectors[got[q]] @ vectors[q]), sorted(np.sort(vectors @ vectors[q])[-5:]))


def test_queries_are_a_table(spark):
    vectors = clustered(groups=4, size=30)
    whole = corpus(spark, vectors)
    places = whole.where("chunk_index % 10 = 0").select("chunk_index")
    found = similar_batch(whole, places, 3)
    assert found.count() == 3 * 12
    with pytest.raises(IndexError, match="999"):
        similar_batch(whole, [3, 999], 2)
    assert similar_batch(whole, [], 2).count() == 0

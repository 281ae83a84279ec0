"""Batch search in slices of the points against brute force, with ties."""

import random

import numpy as np

from graphloom.operators import vector


def test_slices_give_the_same_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vector, "SCORES", 60)  # six points at a time for ten queries
    draw = random.Random(2)
    rows = [(i, [float(draw.randrange(-2, 3)) for _ in range(3)]) for i in range(70)]
    points = spark.createDataFrame(rows, "id bigint, vector array<float>").coalesce(1)
    queries = points.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    unit = {i: np.array(v) / max(1e-300, np.linalg.norm(v)) for i, v in rows}
    want = {}
    for q in range(0, 70, 7):
        near = sorted(((-round(float(unit[q] @ unit[i]), 9), i) for i in unit if i != q))[:4]
        want[q] = [s for s, _ in near]
    got = {}
    for r in vector.batch_search(points, queries, 4).orderBy("query_id", "rank").collect():
        assert r.id != r.query_id and abs(float(unit[r.query_id] @ unit[r.id]) - r.score) < 1e-9
        got.setdefault(r.query_id, []).append(-round(r.score, 9))
    assert got == want

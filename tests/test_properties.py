"""Graph operators against plain searches on random graphs."""

import itertools
import random
from collections import deque

import pytest

from graphloom.operators import paths


def graph_of(seed):
    rng = random.Random(seed)
    return sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(14)})


def distances(edges, start, backwards=False):
    near = {}
    for a, b in edges:
        near.setdefault(b if backwards else a, set()).add(a if backwards else b)
    found, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for y in near.get(x, ()):
            if y not in found:
                found[y] = found[x] + 1
                todo.append(y)
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_searches(spark, seed):
    edges = graph_of(seed)
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    one = lambda x: spark.createDataFrame([(x,)], "id bigint")
    start, end = edges[0][0], edges[-1][1]
    want = {k: d for k, d in distances(edges, end, backwards=True).items() if 0 < d <= 3}
    assert {r.id: r.distance for r in paths.ripple(df, one(end), depth=2).collect()} == want
    got = paths.shortest_path(df, one(start), one(end)).collect()
    d = distances(edges, start).get(end)
    assert [r.distance for r in got] == ([] if d is None else [d])
    if got:
        assert all((a, b) in edges for a, b in itertools.pairwise(got[0].path))


def trails(edges, most):
    found = [[e] for e in edges]
    for _ in range(most):
        yield from found
        found = [t + [e] for t in found for e in edges if t[-1][1] == e[0] and e not in t]


@pytest.mark.parametrize("seed", [4, 5])
def test_cycles(spark, seed):
    edges = [e for e in graph_of(seed) if e[0] != e[1]]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    best = {}
    for t in trails(edges, 4):
        if len(t) >= 2 and t[0][0] == t[-1][1]:
            path = [e[0] for e in t] + [t[-1][1]]
            key = tuple(sorted(set(path)))
            best[key] = min(best.get(key, (99, [])), (len(t), path))
    assert sorted((r.length, r.path) for r in paths.cycles(df, 2, 4, limit=None).collect()) == sorted(best.values())
    walks = {tuple([t[0][0]] + [e[1] for e in t]) for t in trails(edges, 3)} | {(x,) for x in {a for a, _ in edges}}
    starts = spark.createDataFrame([(x,) for x in {a for a, _ in edges}], "id bigint")
    assert sorted(tuple(r.path) for r in paths.bounded_paths(df, starts, 3).collect()) == sorted(walks)

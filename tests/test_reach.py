import random
from collections import deque

import pytest

from histora.operators import graph


def queued(edges, seed, depth, most, skipped):
    """The walk of a queue, layer by layer, that stops as soon as it has enough."""
    near = {}
    for a, b, pos in sorted(edges, key=lambda e: (e[2], e[1])):
        if b not in near.setdefault(a, []):
            near[a].append(b)
    visited, frontier, out = [seed], deque([seed]), [(seed, seed, 0, 1)]
    for d in range(1, depth + 1):
        following = deque()
        while frontier and len(visited) < most:
            for n in near.get(frontier.popleft(), []):
                if n not in visited and n not in skipped:
                    visited.append(n)
                    following.append(n)
                    out.append((seed, n, d, len(visited)))
                    if len(visited) >= most:
                        break
        frontier = following
    return out


@pytest.mark.parametrize("seed,depth,most", [(1, 3, 8), (2, 3, 8), (3, 5, 4), (4, 2, 1), (5, 4, 30)])
def test_visits_as_a_queue_does(spark, seed, depth, most):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    r = random.Random(seed)
    edges = [(r.randrange(25), r.randrange(25), r.randrange(4)) for _ in range(120)] + [(0, k, 0) for k in range(25)]
    skipped = {3, 4}
    got = graph.reach_in_order(
        spark.createDataFrame(edges, "importer long, target long, pos int"), spark.createDataFrame([(k, k) for k in range(25)], "seed long, node long"), depth, most, spark.createDataFrame([(k,) for k in skipped], "node long")
    )
    assert sorted(map(tuple, got.select("seed", "node", "depth", "place").collect())) == sorted(x for k in range(25) for x in queued(edges, k, depth, most, skipped))


def test_reach_ends_with_an_empty_layer(spark, monkeypatch):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    edges, seeds = spark.createDataFrame([("a", "b", 0)], "importer string, target string, pos int"), spark.createDataFrame([("s", "a")], "seed string, node string")
    assert sorted(map(tuple, graph.reach(edges, seeds, 40).collect())) == [("s", "a", 0), ("s", "b", 1)]
    assert sorted(map(tuple, graph.reach_in_order(edges, seeds, 40).collect())) == [("s", "a", 0, 1), ("s", "b", 1, 2)]

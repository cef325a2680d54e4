"""Shortest paths, their trees and betweenness against a plain search."""

import heapq
import math
import random
from collections import Counter

import pytest

from popspark.operators import graphs


def graph(spark, n, arcs):
    nodes = spark.createDataFrame([(f"n{i}", n - i) for i in range(n)], "id string, ordinal int")
    edges = spark.createDataFrame([(k, f"n{a}", f"n{b}", float(w)) for k, (a, b, w) in enumerate(arcs)], "edge_ord int, src string, dst string, weight double")
    return nodes, edges


def plainly(n, arcs, source):
    """{node: (distance, path)} by the rule of path_forest, nodes ranked n - i."""
    out = {}
    for a, b, w in arcs:
        if a != b:
            out.setdefault(a, {})[b] = min(w, out.get(a, {}).get(b, math.inf))
    dist, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, a = heapq.heappop(heap)
        if d > dist[a]:
            continue
        for b, w in out.get(a, {}).items():
            if d + w < dist.get(b, math.inf):
                dist[b] = d + w
                heapq.heappush(heap, (d + w, b))
    pred = {}
    for b in dist:
        tails = [(dist[a], n - a, a) for a in dist if b in out.get(a, {}) and dist[a] + out[a][b] == dist[b]]
        if b != source:
            pred[b] = min(tails)[2]

    def path(b):
        return [source] if b == source else [*path(pred[b]), b]

    return {b: (dist[b], path(b)) for b in dist}


@pytest.mark.parametrize("seed", range(2))
def test_paths_and_betweenness_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    n = 14
    arcs = [(rng.randrange(n), rng.randrange(n), rng.choice((1, 1, 2, 5))) for _ in range(34)] + [(0, 1, 3), (0, 1, 1)]
    nodes, edges = graph(spark, n, arcs)
    got = {(r.src, r.dst): (r.distance, r.path) for r in graphs.shortest_paths(nodes, edges).collect()}
    want = {(f"n{s}", f"n{b}"): (d, [f"n{x}" for x in p]) for s in range(n) for b, (d, p) in plainly(n, arcs, s).items()}
    assert got == want
    inner = Counter(x for _, p in want.values() for x in p[1:-1])
    between = {r.id: r.betweenness for r in graphs.betweenness(nodes, graphs.path_forest(nodes, edges)).collect()}
    assert all(math.isclose(between[f"n{i}"], inner[f"n{i}"] / ((n - 1) * (n - 2))) for i in range(n))


def test_long_chains_double_and_buckets_wait(spark):
    n = 40
    arcs = [(i, i + 1, 1) for i in range(n - 1)] + [(0, n - 1, 500)]
    nodes, edges = graph(spark, n, arcs)
    one = nodes.where("id = 'n0'")
    got = {r.dst: r for r in graphs.shortest_paths(nodes, edges, one).collect()}
    assert len(got) == n and got["n39"].distance == 39 and got["n39"].path == [f"n{i}" for i in range(n)]
    between = {r.id: r.betweenness * (n - 1) * (n - 2) for r in graphs.betweenness(nodes, graphs.path_forest(nodes, edges, one)).collect()}
    assert all(math.isclose(between[f"n{i}"], 0 if i == 0 else n - 1 - i, abs_tol=1e-9) for i in range(n))


def test_steps_without_weight_never_lead_back(spark):
    arcs = [(0, 1, 2), (1, 2, 0), (2, 1, 0), (2, 3, 0), (3, 1, 0), (3, 0, 0)]
    nodes, edges = graph(spark, 4, arcs)
    got = {(r.src, r.dst): (r.distance, r.path) for r in graphs.shortest_paths(nodes, edges).collect()}
    assert got["n0", "n3"] == (2, ["n0", "n1", "n2", "n3"]) and got["n1", "n0"] == (0, ["n1", "n2", "n3", "n0"]) and got["n0", "n0"] == (0, ["n0"])


def test_no_edges_and_no_nodes(spark):
    nodes, edges = graph(spark, 2, [(0, 1, 1)])
    assert sorted(map(tuple, graphs.shortest_paths(nodes, edges.limit(0)).collect())) == [("n0", "n0", 0.0, ["n0"]), ("n1", "n1", 0.0, ["n1"])]
    assert graphs.path_forest(nodes.limit(0), edges).collect() == [] and {r.betweenness for r in graphs.betweenness(nodes, graphs.path_forest(nodes, edges)).collect()} == {0.0}

"""Components, longest chains and simple cycles against brute force, on many small graphs at once and on long chains."""

import random
import sys

import pytest

from archspark.operators import graph
from archspark.operators.contraction import connected, jump

EDGES = "repo_id string, src int, dst int"


def _shapes(seed):
    """Graphs of all kinds: sparse, dense, mutual, trees, rings with tails, chains between cycles, loops."""
    rnd = random.Random(seed)
    out = {}
    for g in range(24):
        n = rnd.randrange(2, 22)
        kind = g % 6
        r = lambda: rnd.randrange(n)
        if kind == 0:
            e = {(r(), r()) for _ in range(rnd.randrange(1, 2 * n))}
        elif kind == 1:
            e = {(r(), r()) for _ in range(n)}
            e |= {(b, a) for a, b in e if rnd.random() < 0.5}
        elif kind == 2:
            e = {(rnd.randrange(v), v) if rnd.random() < 0.5 else (v, rnd.randrange(v)) for v in range(1, n)}
        elif kind == 3:
            ring = rnd.sample(range(n), max(2, n // 2))
            e = set(zip(ring, ring[1:] + ring[:1])) | {(r(), r()) for _ in range(n // 3)}
        elif kind == 4:
            order = rnd.sample(range(n), n)
            e = set(zip(order, order[1:])) | ({(order[-1], order[0])} if rnd.random() < 0.5 else set()) | {(r(), r()) for _ in range(2)}
        else:
            e = {(a, a) for a in range(0, n, 3)} | {(a, b) for a, b in ((r(), r()) for _ in range(n)) if a < b}
        out[f"g{g}"] = e
    return out


def _components(edges):
    sys.setrecursionlimit(100_000)
    nodes = {x for e in edges for x in e}
    reach = {}
    for s in nodes:
        seen, todo = set(), [s]
        while todo:
            v = todo.pop()
            for a, b in edges:
                if a == v and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[s] = seen
    return {v: {v} | {u for u in reach[v] if v in reach[u]} for v in nodes}, reach


def _depths(edges):
    comp, _ = _components(edges)
    memo = {}

    def depth(v):
        c = min(comp[v])
        if c not in memo:
            memo[c] = len(comp[v]) + max((depth(b) for a, b in edges if a in comp[v] and b not in comp[v]), default=0)
        return memo[c]
    return {v: depth(v) for v in comp}


def _cycles(edges, longest):
    found = set()

    def walk(path):
        for a, b in edges:
            if a == path[-1]:
                if b == path[0]:
                    found.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < longest:
                    walk([*path, b])
    for s in {x for e in edges for x in e}:
        walk([s])
    return found


def _check(spark, graphs, small_cycles, small_depth):
    df = spark.createDataFrame([(k, a, b) for k, es in graphs.items() for a, b in es], EDGES).repartition(3)
    want_comp, want_depth = {}, {}
    for k, es in graphs.items():
        comp, reach = _components(es)
        want_comp |= {(k, v): (min(c), len(c)) for v, c in comp.items() if v in reach[v]}
        want_depth |= {(k, v): d for v, d in _depths(es).items()}
    assert {(r.repo_id, r.node): (r.component, r.component_size) for r in graph.cycle_components(df, small=small_cycles).collect()} == want_comp
    rows = graph.dependency_depth(df, small=small_depth).collect()
    assert len(rows) == len(want_depth) and {(r.repo_id, r.node): r.depth for r in rows} == want_depth


def test_graphs_each_in_one_task(spark):
    _check(spark, {f"{seed}{k}": es for seed in range(4) for k, es in _shapes(seed).items()}, 10**6, 10**6)


def test_graphs_by_contraction(spark):
    """Cycles until at most 12 edges are left, depth to the end."""
    _check(spark, dict(list(_shapes(0).items())[:12]), 12, 0)


@pytest.mark.parametrize("longest", [1, 5])
def test_simple_cycles(spark, longest):
    graphs = _shapes(7)
    df = spark.createDataFrame([(k, a, b) for k, es in graphs.items() for a, b in es], EDGES)
    rows = graph.simple_cycles(df, longest).collect()
    want = {(k, c) for k, es in graphs.items() for c in _cycles(es, longest)}
    assert len(rows) == len(want) and {(r.repo_id, tuple(r.cycle)) for r in rows} == want
    assert all(r.length == len(r.cycle) for r in rows)


def test_rounds_follow_the_logarithm(spark):
    """A chain and a ring of 10,000 nodes: one round for each halving, for components and for depth."""
    n = 10_000
    order = random.Random(4).sample(range(n), n)
    df = spark.createDataFrame([("chain", a, b) for a, b in zip(order, order[1:])] + [("ring", a, b) for a, b in zip(order, order[1:] + order[:1])], EDGES)
    stats = {}
    depth = {(r.repo_id, r.node): r.depth for r in graph.dependency_depth(df, stats=stats, small=0).collect()}
    assert depth == {("chain", v): n - i for i, v in enumerate(order)} | {("ring", v): n for v in order}
    print("rounds", stats)
    assert stats["rounds"] <= 36


def test_nothing_and_names(spark):
    empty = spark.createDataFrame([], EDGES)
    assert graph.cycle_components(empty).collect() == graph.dependency_depth(empty).collect() == graph.simple_cycles(empty, 3).collect() == []
    names = spark.createDataFrame([("r", "b", "a"), ("r", "a", "b"), ("r", "b", "c"), ("r", "c", "d"), ("r", "d", "b"), ("s", "a", "b")],
                                  "repo_id string, src string, dst string")
    assert {(r.node, r.component) for r in graph.cycle_components(names).collect()} == {(x, "a") for x in "abcd"}
    assert {tuple(r.cycle) for r in graph.simple_cycles(names, 4).collect()} == {("a", "b"), ("b", "c", "d")}
    assert {r.node: r.depth for r in graph.dependency_depth(names.where("repo_id = 's'")).collect()} == {"a": 2, "b": 1}


def test_connected_and_jump(spark):
    pairs = spark.createDataFrame([("k", 3, 2), ("k", 2, 9), ("k", 5, 6), ("j", 3, 1)], "repo_id string, u int, v int")
    assert {(r.repo_id, r.node, r.rep) for r in connected(pairs, "repo_id").collect()} == {
        ("k", 2, 2), ("k", 3, 2), ("k", 9, 2), ("k", 5, 5), ("k", 6, 5), ("j", 1, 1), ("j", 3, 1)}
    steps = spark.createDataFrame([("k", 1, 2), ("k", 2, 3), ("k", 3, 99), ("k", 5, 6), ("k", 6, 7), ("k", 7, 5)], "repo_id string, node int, nxt int")
    got = {r.node: r for r in jump(steps, "repo_id").collect()}
    assert {(v, got[v].nxt, got[v].tail, got[v].ring) for v in (1, 2, 3)} == {(v, 99, 3, False) for v in (1, 2, 3)}
    assert {(v, got[v].low, got[v].ring) for v in (5, 6, 7)} == {(v, 5, True) for v in (5, 6, 7)}


def test_hops_and_sketches(spark):
    rnd = random.Random(6)
    edges = {(rnd.randrange(300), rnd.randrange(300)) for _ in range(700)}
    df = spark.createDataFrame([("r", a, b) for a, b in edges], EDGES)
    near = {v: {v: 0} for e in edges for v in e}
    for v, found in near.items():
        for step in (1, 2, 3):
            for u in [u for u, d in found.items() if d == step - 1]:
                for a, b in edges:
                    if a == u:
                        found.setdefault(b, step)
    want = {(v, u, d) for v, found in near.items() for u, d in found.items() if u != v}
    assert {(r.src, r.dst, r.hops) for r in graph.hop_distances(df, 3).collect()} == want
    count = {v: len(found) - 1 for v, found in near.items()}
    for r in graph.reach_estimates(df, 3).collect():
        assert abs(r.reach - count[r.node]) <= max(1, 0.05 * count[r.node])

"""Searches in graphs against plain ones, and their number of rounds on long rings and chains."""

import random
from collections import deque

import pytest
from flowscope.operators import graph as g
from pyspark.sql import functions as F


def reach(edges, start):
    out, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in out:
                out.add(b)
                todo.append(b)
    return out


def plain_components(edges):
    states = {x for e in edges for x in e}
    to = {x: reach(edges, x) for x in states}
    found = {frozenset(y for y in to[x] if x in to[y]) for x in states}
    return {(min(c), len(c)) for c in found if len(c) > 1 or (min(c), min(c)) in edges}


def frame(spark, edges):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src string, dst string, pos long")


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_plain_reach(spark, seed):
    rng = random.Random(seed)
    edges = set()
    for k in range(6):  # rings, chains, self-loops and noise, tied together at random
        names = [f"{k}{i:02d}" for i in range(rng.randrange(1, 9))]
        edges |= set(zip(names, names[1:]))
        if rng.random() < 0.6:
            edges.add((names[-1], names[0]))
    states = sorted({x for e in edges for x in e} | {"500"})
    edges |= {(rng.choice(states), rng.choice(states)) for _ in range(rng.randrange(8))}
    assert {(r.component, r.states) for r in g.cyclic_components(frame(spark, sorted(edges))).collect()} == plain_components(edges)


def test_long_rings_and_chains_take_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(g, "with_cut", lambda df, f=g.with_cut: cuts.append(1) or f(df))
    n = 30_000
    name = lambda c: F.format_string("%06d", c)
    steps = spark.range(n).select(name(F.col("id")).alias("src"), name((F.col("id") + 1) % n).alias("dst"))
    chain = steps.filter("src < dst")
    assert [tuple(r) for r in g.cyclic_components(steps).collect()] == [("000000", n)] and len(cuts) < 60
    cuts.clear()
    assert g.cyclic_components(chain).collect() == [] and len(cuts) < 60


def plain_path(edges, start, end):
    """Of the shortest paths the least by its states, by keeping every level's best path."""
    best, level = {start: [start]}, {start: [start]}
    while level and end not in best:
        new = {}
        for a, b in edges:
            if a in level and b not in best:
                new[b] = min(new.get(b, level[a] + [b]), level[a] + [b])
        best |= new
        level = new
    return best.get(end)


def test_paths_equal_plain_search(spark, monkeypatch):
    monkeypatch.setattr(g, "LEVELS", 3)
    rng = random.Random(1)
    states = [f"{c}{i}" for c in "abcdef" for i in range(4)]
    edges = {(rng.choice(states), rng.choice(states)) for _ in range(45)} | {(f"z{i}", f"z{i + 1}") for i in range(9)} | {("a0", "z0")}
    df = frame(spark, sorted(edges))
    far, todo = {"a0": 0}, deque(["a0"])
    while todo:
        x = todo.popleft()
        for a, b in edges:
            if a == x and b not in far:
                far[b] = far[x] + 1
                todo.append(b)
    assert {r.state: r.distance for r in g.distances(df, "a0").collect()} == far
    for end in ("z9", rng.choice(states), "nowhere"):
        got = g.shortest_path(df, "a0", end).collect()
        want = plain_path(edges, "a0", end)
        assert [(r.path, r.distance) for r in got] == ([(want, len(want) - 1)] if want else [])
    assert g.shortest_path(df, "nowhere", "nowhere").collect() == []

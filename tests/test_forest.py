"""Depths and roots of forests by jumps against whole lineages."""

from __future__ import annotations

import random

import pytest

from procscope.operators import graph

NODE = "host string, pid long, start long"
LINK = f"{NODE}, parent_pid long, parent_start long"


def shape(rng, kind):
    """{node: parent or None}: a node's parent may be missing from the nodes."""
    if kind == "chain":
        return {k: k - 1 if k else None for k in range(40)}
    if kind == "hub":
        return {k: 0 if k else 99 for k in range(40)}
    if kind == "rings":  # with tails, and a node that is its own parent
        return {k: (k + 1) % 7 if k < 7 else rng.randrange(k) for k in range(30)} | {40: 40, 41: 40, 42: 43, 43: 42}
    return {k: rng.choice([None, 99, *range(k)]) if k else None for k in range(40)}


def tables(spark, parents):
    nodes = [(h, p, p % 3) for h in ("a", "b") for p in parents]
    links = [(h, p, p % 3, q, q % 3) for h, p, _ in nodes if (q := parents[p]) is not None]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(links, LINK)


@pytest.mark.parametrize("kind", ["chain", "hub", "rings", "mixed"])
def test_forest_without_paths(spark, kind):
    nodes, links = tables(spark, shape(random.Random(5), kind))
    whole = graph.forest(nodes, links, paths=True).collect()
    want = {(r.host, r.pid, r.start): (r.depth, r.root, r.path[0]) for r in whole}
    got = {(r.host, r.pid, r.start): (r.depth, r.root, r.root) for r in graph.forest(nodes, links).collect()}
    assert got == want and len(got) == nodes.count()


def test_forest_of_nodes_with_two_parents(spark):
    nodes = spark.createDataFrame([("a", k, 0) for k in range(5)], NODE)
    links = spark.createDataFrame([("a", a, 0, b, 0) for a, b in ((1, 0), (2, 1), (3, 2), (3, 0), (4, 3))], LINK)
    want = {r.pid: (r.depth, r.root) for r in graph.forest(nodes, links, paths=True).collect()}
    assert {r.pid: (r.depth, r.root) for r in graph.forest(nodes, links).collect()} == want
    assert {k: d for k, (d, _) in want.items()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 3}


def test_deep_trees_take_a_row_a_node(spark, monkeypatch):
    """A chain of n nodes has n * n / 2 ancestors; none of them is written."""
    rows, counted = [], graph.materialize_counted

    def write(d, label):
        out, n = counted(d, label)
        rows.append(n)
        return out, n

    monkeypatch.setattr(graph, "materialize_counted", write)
    monkeypatch.setattr(graph, "materialize", lambda d, label: write(d, label)[0])
    nodes, links = tables(spark, {k: k - 1 if k else None for k in range(200)})
    depths = {(r.host, r.pid): r.depth for r in graph.forest(nodes, links).collect()}
    assert depths == {(h, k): k for h in "ab" for k in range(200)}
    assert max(rows) == 400, rows

import random

from conftest import rows
from nebulith.llm.components import connected_groups, link_edges


def brute(edges):
    up = {}

    def find(v):
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return sorted((find(v), v) for v in up)


def groups(spark, edges):
    return rows(connected_groups(spark.createDataFrame(edges, "a long, b long")))


def test_random_graph_chain_and_star(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(600), rng.randrange(600)) for _ in range(420)]
    edges += [(i, i + 1) for i in rng.sample(range(2000, 2200), 200)]  # a long chain, shuffled
    edges += [(5000, 5001 + i) for i in range(3000)]  # one vertex with most links
    edges += [(b, a) for a, b in edges[:50]] + [(7, 7), (None, 3), (3, None), (-9, 4)]
    assert groups(spark, edges) == brute(edges)


def test_empty_and_self_links(spark):
    assert groups(spark, []) == []
    assert groups(spark, [(1, 1), (None, None), (2, None)]) == []


def test_ends_are_resolved_within_their_snapshot(spark):
    members = [(1, 0, 100, "x"), (1, 1, 101, "x"), (2, 0, 200, "x"), (2, 1, 201, "x"), (1, 0, 100, "y"), (1, 2, 102, "x")]
    links = [(1, 0, 1, "b"), (1, 1, 0, "b"), (2, 0, 1, "b"), (2, 0, 2, "b"), (1, 2, 2, "b"), (1, None, 2, "b"), (None, 0, 1, "b")]
    edges = link_edges(spark.createDataFrame(links, "snap_step long, local_index_a long, local_index_b long, p string"), spark.createDataFrame(members, "snap_step long, local_index long, particle_id long, a string"))
    assert rows(connected_groups(edges)) == [(100, 100), (100, 101), (200, 200), (200, 201)]


def test_hubs_of_every_kind(spark):
    """Vertices with half of all links: as the least of their group, as the greatest, and as the middle of two layers."""
    edges = [(0, 1 + i) for i in range(400)] + [(10_000, 2000 + i) for i in range(400)] + [(3500, 3000 + i) for i in range(400)] + [(3000 + i, 4000 + i) for i in range(400)]
    assert groups(spark, edges) == brute(edges)


def test_a_member_with_many_links(spark):
    members = spark.createDataFrame([(1, i, 100 + i) for i in range(300)], "snap_step long, local_index long, particle_id long")
    links = spark.createDataFrame([(1, 7, i) for i in range(300)] + [(1, i, i + 1) for i in range(0, 100, 10)], "snap_step long, local_index_a long, local_index_b long")
    assert sorted(tuple(sorted(r)) for r in link_edges(links, members).collect()) == sorted([(min(107, 100 + i), max(107, 100 + i)) for i in range(300) if i != 7] + [(100 + i, 101 + i) for i in range(0, 100, 10)])

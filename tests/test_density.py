import random
from collections import defaultdict

import numpy as np
import pytest

from voxlake.operators.density import density, tree_clusters


def brute(edges, weights, least):
    """Top down: the groups at every weight, from the loosest on. `(point: frozenset of its cluster or None)`."""
    def groups(points, above):
        parent = {p: p for p in points}

        def find(p):
            while parent[p] != p:
                p = parent[p]
            return p

        for a, b, w in edges:
            if a in parent and b in parent and above(w):
                parent[find(a)] = find(b)
        out = defaultdict(set)
        for p in points:
            out[find(p)].add(p)
        return [frozenset(g) for g in out.values()]

    size = lambda g: sum(weights[p] for p in g)
    steps = sorted({w for _, _, w in edges})
    copies = density(np.array([1.0]))[0]

    def best(group, start):
        """Worth and chosen groups of a branch that begins at a density."""
        worth, inside = 0.0, set(group)
        for w in steps:
            d = density(np.array([w]))[0]
            parts = groups(inside, lambda x: x > w)
            if len(parts) == 1:
                continue
            large = [g for g in parts if size(g) >= least]
            worth += sum(size(g) for g in parts if size(g) < least) * (d - start)
            if len(large) != 1:
                worth += sum(size(g) for g in large) * (d - start)
                below = [best(g, d) for g in large]
                total = sum(b for b, _ in below)
                return (worth, [group]) if worth >= total * (1 - 1e-9) else (total, [c for _, cs in below for c in cs])
            inside = set(large[0])
        return worth + size(inside) * (copies - start), [group]

    roots = [g for g in groups(list(weights), lambda w: True) if size(g) >= least]
    chosen = []
    for root in roots:
        if len(roots) > 1:
            chosen += best(root, 0.0)[1]
            continue
        inside = set(root)
        for w in steps:  # the whole is no cluster: begin with its parts
            parts = [g for g in groups(inside, lambda x: x > w) if size(g) >= least]
            if len(parts) != 1:
                chosen += [c for g in parts for c in best(g, density(np.array([w]))[0])[1]]
                break
            inside = set(parts[0])
    return {p: g for g in chosen for p in g}


def tree(seed, n, ties, heavy=False):
    rng = random.Random(seed)
    weights = {i: rng.choice([1, 1, 1, 2, 9 if heavy else 3]) for i in range(n)}
    weight = lambda: rng.randint(1, 12) / 16 if ties else rng.random() * 0.98
    shape = rng.choice(["path", "random", "stars"])
    link = {"path": lambda i: i - 1, "random": lambda i: rng.randrange(i), "stars": lambda i: i // 9 * 9 if i % 9 else rng.randrange(i)}[shape]
    edges = [(link(i), i, weight()) for i in range(1, n)]
    edges += [(a, b, min(w, 0.01)) for a, b, w in ((rng.randrange(n), rng.randrange(n), weight()) for _ in range(5)) if a != b]  # not of the forest
    return edges, weights


@pytest.mark.parametrize(("seed", "ties", "problem", "heavy"), [(1, False, 1000, False), (2, True, 1000, True), (3, False, 9, False), (4, True, 9, True), (5, True, 4, False)])
def test_clusters_equal_single_linkage_from_the_top(spark, seed, ties, problem, heavy):
    edges, weights = tree(seed, 70, ties, heavy)
    # Several trees in one table make a forest with more than one whole.
    if seed == 5:
        more, others = tree(50, 40, ties)
        edges += [(a + 100, b + 100, w) for a, b, w in more]
        weights |= {p + 100: n for p, n in others.items()}
    want = brute(edges, weights, 6)
    got = tree_clusters(spark.createDataFrame(edges, "src long, dst long, cosine double"), spark.createDataFrame(list(weights.items()), "id long, weight long"), 6, problem)
    groups = defaultdict(set)
    for r in got.collect():
        groups[r["branch"]].add(r["id"])
    assert {p: frozenset(g) for g in groups.values() for p in g} == want and want


def test_no_points_and_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long, cosine double")
    assert tree_clusters(none, spark.createDataFrame([], "id long, weight long"), 5).collect() == []
    assert tree_clusters(none, spark.createDataFrame([(1, 1), (2, 4)], "id long, weight long"), 5).collect() == []

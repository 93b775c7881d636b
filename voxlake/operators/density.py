"""Density clusters off the merge tree of a spanning forest, by divide and conquer over its edge weights.

With one-neighbour core distances hierarchical density clustering is single linkage, whose merge tree follows from a spanning
forest. The edges are split at their median weight: the components of the near half are problems of their own, the far half
links these components, and so on for all problems of a level at once, until each fits a task. A task then merges along the
sorted weights, all edges of one weight together, so that ties need no order. Roots and members of problems are put together
by joins, one for each level of splitting. Their sides are read from checkpoints, whose sizes are guesses, so sides that grow with
the points are merged by hint and not sent through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.graph import connected_components
from voxlake.session import settle

#: Edges of a problem that one task merges.
PROBLEM_EDGES = 1 << 17
#: Nearer than this counts as this near, so that copies have a finite density.
NEAREST = 0.9999


def density(cosine: np.ndarray) -> np.ndarray:
    """The inverse of the distance of unit vectors."""
    return 1 / np.sqrt(2 - 2 * np.minimum(cosine, NEAREST))


def _key(problem: str, node: str) -> Column:
    return F.concat_ws("|", F.col(problem), F.col(node))


def _split(edges: DataFrame, nodes: DataFrame, problem_edges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Problems of bounded size: `edges (s, a, b, w)`, `nodes (s, node, size)` and `up (s, parent, node)`, which says as what
    node of another problem the components of problem s stand there. A problem of one weight alone is not split."""
    spark = edges.sparkSession
    up = spark.createDataFrame([], "s string, parent string, node string")
    while True:
        sizes = edges.groupBy("s").agg(F.count("*").alias("n"), F.min("w").alias("low"), F.max("w").alias("high"), F.percentile_approx("w", 0.5).alias("mid"))
        large = settle(sizes.where((F.col("n") > problem_edges) & (F.col("low") < F.col("high"))).select("s", "mid", "high"))
        if large.isEmpty():
            return edges, nodes, up
        marked = settle(edges.join(large, "s", "left").withColumn("near", (F.col("w") > F.col("mid")) | ((F.col("mid") == F.col("high")) & (F.col("w") == F.col("high")))))
        near = marked.where("near")
        found = connected_components(near.select(_key("s", "a").alias("src"), _key("s", "b").alias("dst")))
        moved = settle(nodes.withColumn("key", _key("s", "node")).join(found.withColumnRenamed("node", "key").hint("merge"), "key").select("s", "node", "size", "component"))
        at = lambda end: moved.select("s", F.col("node").alias(end), F.col("component").alias(f"{end}_in")).hint("merge")
        of_near = near.join(at("a"), ["s", "a"]).select(F.col("a_in").alias("s"), "a", "b", "w")
        rest = marked.where("near is null or not near").join(at("a"), ["s", "a"], "left").join(at("b"), ["s", "b"], "left")
        renamed = rest.select("s", F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"), "w").where("a != b")
        edges = settle(of_near.unionByName(renamed))
        kept = nodes.join(moved.select("s", "node").hint("merge"), ["s", "node"], "left_anti")
        joined = moved.groupBy("s", F.col("component").alias("node")).agg(F.sum("size").alias("size"))
        nodes = settle(moved.select(F.col("component").alias("s"), "node", "size").unionByName(kept).unionByName(joined))
        new = moved.select(F.col("component").alias("s"), F.col("s").alias("parent"), F.col("component").alias("node")).distinct()
        again = moved.select(F.col("s").alias("parent"), "node", "component")
        up = up.join(again.hint("merge"), ["parent", "node"], "left").select("s", F.coalesce("component", "parent").alias("parent"), "node")
        up = settle(up.unionByName(new))


def merge(edges: pd.DataFrame, sizes: dict[str, int], least: int, problem: str) -> Iterator[tuple]:
    """Rows `(kind, x, branch, w, size)` of one problem's merging, from the nearest edges to the farthest.

    kind `join`: the points of node x enter a branch at weight w; `merge`: branch x goes on in another one from w on; `root`: a
    branch that is left. Branches are groups of `least` points or more. A node that has so many is the branch `?problem|node`.
    """
    parent = {x: x for x in sizes}
    size, members = dict(sizes), {x: [x] for x in sizes}
    branch = {x: f"?{problem}|{x}" for x, n in sizes.items() if n >= least}
    made = 0

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for w, tied in edges.sort_values("w", ascending=False, kind="stable").groupby("w", sort=False):
        before: dict[str, list[str]] = {}  # a group of now: the groups that it is made of
        for a, b in zip(tied["a"], tied["b"]):
            a, b = find(a), find(b)
            if a != b:
                if len(before.get(a, [a])) < len(before.get(b, [b])):
                    a, b = b, a
                parent[b] = a
                before[a] = before.pop(a, [a]) + before.pop(b, [b])
        for top, parts in before.items():
            large = [x for x in parts if x in branch]
            total = sum(size[x] for x in parts)
            entering = [x for x in parts if x not in branch]
            if total >= least:
                if len(large) == 1:
                    name = branch[large[0]]
                else:
                    name, made = f"{problem}/{made}", made + 1
                    for x in large:
                        yield "merge", branch[x], name, float(w), size[x]
                for x in entering:
                    for node in members.pop(x):
                        yield "join", node, name, float(w), sizes[node]
            else:
                name = None
                parts = sorted(parts, key=lambda x: -len(members[x]))
                for x in parts[1:]:
                    members[parts[0]] += members.pop(x)
                members[top] = members.pop(parts[0])
            for x in parts:
                branch.pop(x, None)
            size[top] = total
            if name is not None:
                branch[top] = name
    for x, name in branch.items():
        if parent[x] == x:
            yield "root", "", name, 0.0, size[x]


def select_branches(rows: pd.DataFrame) -> pd.DataFrame:
    """`(branch, chosen)`: the branch by which each is clustered, or none. In: `(kind, x, branch, w, size)` without nodes.

    A branch is worth the density that its points hold beyond its own beginning. It is chosen if that is at least what the
    chosen ones in it are worth together. A branch that never merges and holds all is everything, and no cluster.
    """
    merges, joins, roots = (rows[rows["kind"] == k] for k in ("merge", "join", "root"))
    parent = dict(zip(merges["x"], merges["branch"]))
    starts = {**{b: 0.0 for b in roots["branch"]}, **dict(zip(merges["x"], density(merges["w"].to_numpy())))}
    worth = {b: 0.0 for b in starts}
    for table in (joins, merges):
        for b, w, n in zip(table["branch"], density(table["w"].to_numpy()), table["size"]):
            worth[b] += n * (w - starts[b])
    children: dict[str, list[str]] = {}
    for child, b in parent.items():
        children.setdefault(b, []).append(child)
    order = list(roots["branch"])
    for b in order:
        order += sorted(children.get(b, []))
    best, own = {}, {}
    for b in reversed(order):
        below = sum(best[c] for c in children.get(b, []))
        own[b] = not (b not in parent and len(roots) == 1) and worth[b] >= below * (1 - 1e-9)
        best[b] = worth[b] if own[b] else below
    chosen: dict[str, str | None] = {}
    for b in order:
        above = chosen.get(parent.get(b))
        chosen[b] = above or (b if own[b] else None)
    return pd.DataFrame({"branch": list(chosen), "chosen": list(chosen.values())})


def tree_clusters(edges: DataFrame, points: DataFrame, least: int, problem_edges: int = PROBLEM_EDGES) -> DataFrame:
    """`(id, branch)` of the points that belong to a cluster. In: `edges (src, dst, cosine)` that hold a maximum spanning
    forest of the points, and `points (id, weight)`, of which copies are one with a weight. Groups have `least` points."""
    name = lambda c: F.col(c).cast("string")
    start = settle(edges.select(F.lit("").alias("s"), name("src").alias("a"), name("dst").alias("b"), F.col("cosine").alias("w")))
    leaves = settle(points.select(F.lit("").alias("s"), name("id").alias("node"), F.col("weight").cast("long").alias("size")))
    parts, nodes, up = _split(start, leaves, problem_edges)

    def solve(key: tuple, edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        rows = merge(edges, dict(zip(nodes["node"], nodes["size"])), least, key[0])
        return pd.DataFrame(rows, columns=["kind", "x", "branch", "w", "size"]).assign(s=key[0])

    # Nodes without an edge are left as they are, in no problem.
    linked = parts.select("s", F.col("a").alias("node")).union(parts.select("s", "b")).distinct()
    inside = nodes.join(linked.hint("merge"), ["s", "node"])
    out = "kind string, x string, branch string, w double, size long, s string"
    told = settle(parts.groupBy("s").cogroup(inside.groupBy("s")).applyInPandas(solve, out))

    # A large node stands for the branch that its own problem ended with, or is a point with many copies.
    roots = told.where("kind = 'root'").select("s", "branch")
    ends = roots.join(up.hint("merge"), "s").select(F.concat(F.lit("?"), _key("parent", "node")).alias("name"), F.col("branch").alias("real"))
    while True:
        onward = ends.select(F.col("name").alias("real"), F.col("real").alias("last"))
        following = settle(ends.join(onward, "real", "left").select("name", F.coalesce("last", "real").alias("real")))
        if following.exceptAll(ends).isEmpty():
            break
        ends = following
    of = lambda c: ends.select(F.col("name").alias(c), F.col("real").alias(f"{c}_real"))
    named = told.join(of("branch").hint("merge"), "branch", "left").join(of("x").hint("merge"), "x", "left")
    named = settle(named.select("kind", F.coalesce("x_real", "x").alias("x"), F.coalesce("branch_real", "branch").alias("branch"), "w", "size", "s"))

    # One row a branch and way of changing it: as many as there are branches, 2 points / least at most, meet in one task.
    # A branch that goes on in no other one is a root.
    merged = named.where("kind = 'merge'").select("kind", "x", "branch", "w", "size")
    joins = named.where("kind = 'join'")
    by_weight = joins.groupBy("branch", "w").agg(F.sum("size").alias("size"))
    worth = by_weight.groupBy("branch").agg(F.sum("size").alias("size"), F.sum(F.col("size") / F.sqrt(2 - 2 * F.least("w", F.lit(NEAREST)))).alias("d"))
    # A single row that is worth the same: all points at their mean density.
    mean = (1 - F.pow(F.col("size") / F.col("d"), 2) / 2).alias("w")
    copies = points.where(F.col("weight") >= least).select(name("id").alias("node"))
    held = nodes.join(copies.hint("merge"), "node", "left_semi").select("s", "node", "size", F.concat(F.lit("?"), _key("s", "node")).alias("branch"))
    held = settle(held)
    every = named.select("branch").union(held.select("branch")).distinct()
    tops = every.join(merged.select(F.col("x").alias("branch")), "branch", "left_anti")
    blank = lambda kind: [F.lit(kind).alias("kind"), F.lit("").alias("x")]
    rows = merged.unionByName(worth.select(*blank("join"), "branch", mean, "size"))
    rows = rows.unionByName(held.select(*blank("join"), "branch", F.lit(1.0).alias("w"), "size"))
    rows = rows.unionByName(tops.select(*blank("root"), "branch", F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("size")))
    choice = rows.groupBy().applyInPandas(select_branches, "branch string, chosen string")
    choice = settle(choice.where("chosen is not null"))

    # Members: a point enters where it stands, or where the group that its problem ended as enters later.
    entered = settle(joins.select("s", F.col("x").alias("node"), "branch").unionByName(held.select("s", "node", "branch")))
    standing = nodes.join(leaves.select("node").hint("merge"), "node", "left_semi").select(F.col("node").alias("point"), "s", "node")
    done = None
    while True:
        here = settle(standing.join(entered.hint("merge"), ["s", "node"], "left").join(up.select("s", F.col("parent").alias("next"), F.col("node").alias("as")), "s", "left"))
        found = here.where("branch is not null").select("point", "branch")
        done = found if done is None else done.unionByName(found)
        standing = here.where("branch is null and next is not null").select("point", F.col("next").alias("s"), F.col("as").alias("node"))
        if standing.isEmpty():
            break
    labelled = done.join(choice, "branch").select("point", F.col("chosen").alias("branch"))
    return points.select("id", name("id").alias("point")).join(labelled.hint("merge"), "point").select("id", "branch")

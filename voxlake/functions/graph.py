"""Exact similarity search over vectors and connected components, as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from voxlake.session import settle

MAX_PIVOTS = 1024
#: Below this cosine nearly every vector is in reach of every cell, so that space is not cut.
PRUNES = 0.9
#: Rows of a block where space is cut, and blocks otherwise, until these have too many rows for a task.
BLOCK_ROWS, BLOCKS, MOST_ROWS = 2048, 16, 1 << 15
#: Vectors that are held against all pivots at once, and rows that are given out at once.
IN_ROWS, OUT_ROWS = 1024, 4096
#: Rows of either side that are multiplied at once.
STEP_ROWS = 2048
#: Pairs of a vector, on average, that a forest begins with.
NEAR = 16
#: Sides of a pair of blocks that a vector stands on.
LEFT, RIGHT, BOTH = 0, 1, 2


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, zero rows as they are; squares are summed in order, as `similarity.unit` does."""
    x = np.asarray(vectors, dtype=float)
    norm = np.sqrt(np.cumsum(x * x, axis=1)[:, -1:]) if x.size else np.ones((len(x), 1))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _choose_pivots(vectors: DataFrame, k: int) -> np.ndarray:
    """A bounded, deterministic sample of vectors to split the space by; at most 1,024 of them reach the driver."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(k).select("vector").collect()
    return _units(np.array([r["vector"] for r in rows], dtype=float).reshape(len(rows), -1))


def _cells(pivots: np.ndarray, radius: float):
    """Batch function: each vector in the cell of its nearest pivot, and in every lower cell whose border is in reach."""
    square = (pivots**2).sum(axis=1)
    apart = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * pivots @ pivots.T, 0.0))
    order = np.arange(len(pivots))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole, at in ((b, i) for b in batches for i in range(0, len(b), IN_ROWS)):
            batch = whole.iloc[at : at + IN_ROWS]
            x = _units(np.stack(batch["vector"].to_numpy()))
            to = (x**2).sum(axis=1)[:, None] + square[None, :] - 2 * x @ pivots.T
            home = to.argmin(axis=1)
            lead = to - to[np.arange(len(x)), home][:, None]
            near = (lead <= 2 * radius * apart[home] + 1e-9) & (order[None, :] < home[:, None])
            near[np.arange(len(x)), home] = True
            # A vector may visit every lower cell, so what is given out at once is bounded, not what a batch becomes.
            row, cell = np.nonzero(near)
            for at in range(0, len(row), OUT_ROWS):
                r, c = row[at : at + OUT_ROWS], cell[at : at + OUT_ROWS]
                out = batch.iloc[r].reset_index(drop=True)
                yield out.assign(cell=c.astype("int32"), home=c == home[r])

    return place


def _block_pairs(vectors: DataFrame, min_cosine: float, block_rows: int | None) -> DataFrame:
    """Place vectors into bounded blocks so that every pair within reach meets in exactly one pair of blocks, `(cell, tile)`,
    in which a vector's `side` is the left one, the right one or, in a block with itself, both.

    Space is cut by pivots; a vector lives in its nearest pivot's cell and visits a lower cell only if a vector there
    could be close enough (distance to the separating hyperplane, as in ClusterJoin, Das Sarma et al. 2014). Large
    cells are cut into blocks of about `block_rows`, so a crowded region becomes many tasks, not one. At a low cosine all is
    one cell: vectors would visit nearly all others, and what is moved is a copy of each vector for each of its cell's blocks.
    Unless given, there are about 16 blocks then, and more only beyond 32,768 rows a block, so that this grows with the rows.
    """
    size = vectors.count()
    cut = min_cosine >= PRUNES
    rows = block_rows or (BLOCK_ROWS if cut else min(MOST_ROWS, max(BLOCK_ROWS, -(-size // BLOCKS))))
    if cut:
        radius = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
        pivots = _choose_pivots(vectors, int(min(MAX_PIVOTS, max(1, -(-size // rows)))))
        kinds = [vectors.schema[c].dataType.simpleString() for c in ("id", "vector")]
        placed = settle(  # used for the cell sizes and for the tiles
            vectors.mapInPandas(_cells(pivots, radius), f"id {kinds[0]}, vector {kinds[1]}, cell int, home boolean")
        )
        # One row per cell: at most 1,024.
        sizes = placed.groupBy("cell").agg(
            F.greatest(F.lit(1), F.ceil(F.count_if(F.col("home")) / rows)).cast("int").alias("n_home"),
            F.ceil(F.count_if(~F.col("home")) / rows).cast("int").alias("n_away"),
        )
        mine = placed.join(F.broadcast(sizes), "cell")
    else:
        whole = {"cell": 0, "home": True, "n_home": max(1, -(-size // rows)), "n_away": 0}
        mine = vectors.select("id", "vector", *[F.lit(v).alias(k) for k, v in whole.items()])
    count = F.when(F.col("home"), F.col("n_home")).otherwise(F.col("n_away"))
    mine = mine.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), count).cast("int"))
    all_home = F.sequence(F.lit(0), F.col("n_home") - 1)
    all_away = F.when(F.col("n_away") > 0, F.sequence(F.lit(0), F.greatest(F.col("n_away") - 1, F.lit(0))))
    tile = lambda low, kind, other: F.struct(low.alias("low"), F.lit(kind).alias("kind"), other.alias("other"))
    at_home = F.concat(
        F.transform(all_home, lambda b: tile(F.least(b, F.col("block")), "h", F.greatest(b, F.col("block")))),
        F.coalesce(
            F.transform(all_away, lambda b: tile(F.col("block"), "a", b)),
            F.array().cast("array<struct<low:int,kind:string,other:int>>"),
        ),
    )
    away = F.transform(all_home, lambda b: tile(b, "a", F.col("block")))
    tiles = F.when(F.col("home"), at_home).otherwise(away)
    own = F.col("home") & (F.col("block") == F.col("tile.low"))
    with_itself = (F.col("tile.kind") == "h") & (F.col("tile.low") == F.col("tile.other"))
    side = F.when(with_itself, BOTH).when(own, LEFT).otherwise(RIGHT).cast("tinyint")
    return mine.select("id", "vector", "home", "cell", "block", F.explode(tiles).alias("tile")).select("cell", "tile", "id", "vector", side.alias("side"))


class _Tile:
    """One pair of blocks: `left` and `right` are places in `ids` and unit vectors `x`; the same ones in a block with itself."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        self.ids = rows.column("id").combine_chunks()
        self.x = _units(rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(self.ids), -1))
        side = rows.column("side").to_numpy()
        self.same = bool(len(side)) and side[0] == BOTH
        self.left, self.right = np.flatnonzero(side != RIGHT), np.flatnonzero(side != LEFT)

    def products(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """`(places on the left, on the right, cosines)` by bounded parts, each pair once and with itself never above -inf."""
        for i in range(0, len(self.left), STEP_ROWS):
            a = self.left[i : i + STEP_ROWS]
            for j in range(i if self.same else 0, len(self.right), STEP_ROWS):
                b = self.right[j : j + STEP_ROWS]
                cosines = self.x[a] @ self.x[b].T
                if self.same and i == j:
                    cosines[np.tril_indices(len(a))] = -np.inf
                yield a, b, cosines

    def edges(self, a: np.ndarray, b: np.ndarray, cosines: np.ndarray) -> pa.RecordBatch:
        one, two = self.ids.take(pa.array(a)), self.ids.take(pa.array(b))
        return pa.RecordBatch.from_arrays([pc.min_element_wise(one, two), pc.max_element_wise(one, two), pa.array(cosines, pa.float64())], ["src", "dst", "cosine"])


def similar_pairs(vectors: DataFrame, min_cosine: float, block_rows: int | None = None) -> DataFrame:
    """Every pair `(src < dst)` with cosine at least `min_cosine`. Exact: no bucket is dropped or capped."""
    kind = vectors.schema["id"].dataType.simpleString()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = _Tile(batches)
        for a, b, cosines in tile.products():
            i, j = np.nonzero(cosines >= min_cosine)
            yield tile.edges(a[i], b[j], cosines[i, j])

    tiles = _block_pairs(vectors.select("id", "vector"), min_cosine, block_rows)
    return tiles.groupBy("cell", "tile").applyInArrow(match, f"src {kind}, dst {kind}, cosine double")


def _kruskal(group: np.ndarray, one: np.ndarray, two: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the edges make a maximum spanning forest on top of groups, as places, and the groups after that."""
    parent = np.arange(len(group)).tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order, taken = np.argsort(-cosines, kind="stable"), []
    for part in (order[i : i + STEP_ROWS] for i in range(0, len(order), STEP_ROWS)):
        for at, a, b in zip(part.tolist(), group[one[part]].tolist(), group[two[part]].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[a] = b
                taken.append(at)
    return np.array(taken, dtype="int64"), np.array([root(x) for x in range(len(parent))], dtype="int64")[group]


def _forest(tile: _Tile, min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A maximum spanning forest of the pairs of a tile with a cosine of `min_cosine` or more.

    The nearest pairs, about `NEAR` a vector, are joined first, from the nearest on. What is left outside the largest group
    then looks for its best edge among all pairs, round by round (Boruvka's algorithm).
    """
    n, x = len(tile.ids), tile.x
    group, pool, held = np.arange(n), [tuple(np.zeros(0, k) for k in ("int64", "int64", "float64"))], 0
    seen = x[tile.left[:: max(1, len(tile.left) // 64)]] @ x[tile.right].T
    # Pairs that are at least so near count first; with fewer vectors than that, all do.
    place = seen.size - min(seen.size, NEAR * len(seen))
    low = max(min_cosine, np.partition(seen.ravel(), place)[place] if place else -np.inf)

    def merged() -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        every = tuple(np.concatenate(c) for c in zip(*pool))
        taken, group = _kruskal(np.arange(n), *every)
        return tuple(c[taken] for c in every), group

    for a, b, cosines in tile.products():
        i, j = np.nonzero(cosines >= low)
        pool.append((a[i], b[j], cosines[i, j]))
        held += len(i)
        if held > 4 * NEAR * n:
            pool = [merged()[0]]
            held = len(pool[0][0])
    found, group = merged()
    edges = [found]
    while low > min_cosine:
        best, link = np.full(n, -np.inf), np.full(n, -1)
        outside = group != np.bincount(group).argmax()
        for own, others in ((tile.left, tile.right), (tile.right, tile.left))[: 1 if tile.same else 2]:
            seeking = own[outside[own]]
            for a in (seeking[i : i + STEP_ROWS] for i in range(0, len(seeking), STEP_ROWS)):
                for b in (others[j : j + STEP_ROWS] for j in range(0, len(others), STEP_ROWS)):
                    cosines = x[a] @ x[b].T
                    cosines[(group[a][:, None] == group[b][None, :]) | (cosines < min_cosine)] = -np.inf
                    at = cosines.argmax(axis=1)
                    top = cosines[np.arange(len(a)), at]
                    better = top > best[a]
                    best[a[better]], link[a[better]] = top[better], b[at[better]]
        order = np.argsort(-best, kind="stable")
        order = order[link[order] >= 0]
        # The best edge of each group; one that closes a circle of equal ones is not needed.
        order = order[np.unique(group[order], return_index=True)[1]]
        if not len(order):
            break
        taken, group = _kruskal(group, order, link[order], best[order])
        edges.append((order[taken], link[order[taken]], best[order[taken]]))
    return tuple(np.concatenate(c) for c in zip(*edges))


def spanning_edges(vectors: DataFrame, min_cosine: float, block_rows: int | None = None) -> DataFrame:
    """Edges that contain a maximum spanning forest of the graph of pairs with cosine >= `min_cosine`.

    Each pair of blocks returns only the forest of its own pairs, which is linear in its rows: an edge that is not needed
    there is not needed overall.
    """
    kind = vectors.schema["id"].dataType.simpleString()

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = _Tile(batches)
        yield tile.edges(*_forest(tile, min_cosine))

    tiles = _block_pairs(vectors.select("id", "vector"), min_cosine, block_rows)
    return spanning_forest(tiles.groupBy("cell", "tile").applyInArrow(forest, f"src {kind}, dst {kind}, cosine double"))


def _codes(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct nodes of edges in order, and both ends of each edge as places among them."""
    ends = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    codes = rank[ends.indices.to_numpy()]
    return ends.dictionary.take(order), codes[: table.num_rows], codes[table.num_rows :]


def _whole_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task that make a maximum spanning forest of them."""
    table = pa.Table.from_batches(list(batches))
    if table.num_rows:
        nodes, one, two = _codes(table)
        yield from table.take(pa.array(_kruskal(np.arange(len(nodes)), one, two, table.column(2).to_numpy())[0])).to_batches()


#: Edges of which one task makes a forest, at 24 bytes each.
FOREST_EDGES = 1 << 22


def spanning_forest(edges: DataFrame, forest_edges: int = FOREST_EDGES) -> DataFrame:
    """Edges `(src, dst, cosine)` that contain a maximum spanning forest of the given ones, as few as parts of bounded size tell.

    A part gives the forest of its own edges; parts are put together and thinned out again, until one is left or what they
    give is no longer half of what they take. Up to `forest_edges` edges become one forest.
    """
    edges = settle(edges)
    n = edges.count()
    while n:
        parts = -(-n // forest_edges)
        edges = settle(edges.coalesce(parts).mapInArrow(_whole_forest, edges.schema))
        n, before = edges.count(), n
        if parts == 1 or 2 * n > before:
            break
    return edges


#: So many edges, in codes of 8 bytes, are few enough for one task to finish.
FINISH_EDGES = 1 << 18
#: With more rows than these, nodes are not sent through the driver, whatever size Catalyst takes a checkpoint for.
SENT_ROWS = 1 << 16


def unsent(side: DataFrame, rows: int) -> DataFrame:
    """A side of a join that is merged if it has many rows."""
    return side.hint("merge") if rows > SENT_ROWS else side


def _whole_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of one task, by their smallest nodes: each node takes the least label around it and then that
    label's own."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    nodes, a, b = _codes(table)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        following = label.copy()
        for end in (a, b):
            np.minimum.at(following, end, low)
            np.minimum.at(following, label[end], low)
        following = following[following]
        if (following == label).all():
            break
        label = following
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], ["node", "root"])


def connected_components(edges: DataFrame, finish_edges: int = FINISH_EDGES, rounds: list[int] | None = None) -> DataFrame:
    """`(node, component)` with component = smallest node reachable. In: `src, dst`, any comparable type; loops don't count.

    Contraction: in each round a seeded hash orders the nodes, every node joins the least of its closed neighbourhood, and
    the edges are renamed to these representatives and made distinct, so that a constant share of the nodes goes whatever
    the shape of the graph. The number of rounds grows with the logarithm of the number of nodes. Minima are combined
    before the shuffle, and joins read both sides from reliable checkpoints, so that a node with very many edges is split
    at run time. The last `finish_edges` edges are finished in one task. `rounds` takes the number of edges of each round.
    """
    kind = edges.schema["src"].dataType
    src, dst = F.col("src"), F.col("dst")
    left = settle(edges.where("src != dst").select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct())
    steps, most = [], 0
    while n := left.count():
        most = max(most, n)
        if rounds is not None:
            rounds.append(n)
        if n <= finish_edges and not isinstance(kind, (StructType, ArrayType)):
            steps.append(settle(left.coalesce(1).mapInArrow(_whole_components, StructType().add("node", kind).add("root", kind))))
            if len(steps) == 1:  # nothing was renamed, so the roots are the smallest nodes
                return steps[0].withColumnRenamed("root", "component")
            break
        order = lambda c: F.xxhash64(F.lit(len(steps)), c)
        around = left.union(left.select("b", "a")).groupBy("a").agg(F.min_by("b", order("b")).alias("root"), F.min(order("b")).alias("least"))
        step = settle(around.select(F.col("a").alias("node"), F.when(F.col("least") < order("a"), F.col("root")).otherwise(F.col("a")).alias("root")))
        at = lambda end: unsent(step.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), n)
        renamed = left.join(at("a"), "a").join(at("b"), "b").where("root_a != root_b")
        least, greatest = F.least("root_a", "root_b"), F.greatest("root_a", "root_b")
        left = settle(renamed.select(least.alias("a"), greatest.alias("b")).distinct())
        steps.append(step)
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("a").alias("component"))
    roots = steps.pop()
    for step in reversed(steps):
        upper = unsent(roots.select(F.col("node").alias("root"), F.col("root").alias("last")), most)
        roots = settle(step.join(upper, "root", "left").select("node", F.coalesce("last", "root").alias("root")))
    smallest = unsent(roots.groupBy("root").agg(F.min("node").alias("component")), most)
    return settle(roots.join(smallest, "root").select("node", "component"))


def merged_components(known: DataFrame, links: DataFrame) -> DataFrame:
    """`known`, as `connected_components` gives it, after more links `src, dst`: only these are contracted, by component."""
    at = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}"))
    named = links.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    named = settle(named.select("src", "dst", "component_src", "component_dst"))
    joined = connected_components(named.select(F.coalesce("component_src", "src").alias("src"), F.coalesce("component_dst", "dst").alias("dst")))
    ends = [F.struct(F.col(x).alias("node"), F.col(f"component_{x}").alias("component")) for x in ("src", "dst")]
    new = named.select(F.inline(F.array(*ends))).where("component is null").select("node").distinct()
    nodes = known.unionByName(new.select("node", F.col("node").alias("component")))
    upper = joined.select(F.col("node").alias("component"), F.col("component").alias("last"))
    return settle(nodes.join(upper, "component", "left").select("node", F.coalesce("last", "component").alias("component")))

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_density import brute
from voxlake.functions import graph
from voxlake.operators import issues
from voxlake.plans.registry import QUERIES


def planted(seed=1, groups=4, size=12, noise=10, dims=24, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = np.linalg.qr(rng.normal(size=(dims, dims)))[0][:groups]
    rows, i = [], 0
    for g in range(groups):
        for _ in range(size):
            rows.append((i, (centres[g] + rng.normal(scale=spread, size=dims) / np.sqrt(dims) * 2).tolist(), g))
            i += 1
    for _ in range(noise):
        rows.append((i, rng.normal(size=dims).tolist(), -1))
        i += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1]) for r in rows], "id int, vector array<double>")


@pytest.fixture(scope="module")
def rows():
    return planted()


@pytest.mark.parametrize("block", [5, 16, 1000])
@pytest.mark.parametrize("level", [0.2, 0.6])
def test_pairs_are_exact_whatever_the_blocks(spark, rows, block, level):
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= level}
    got = [(r["src"], r["dst"]) for r in graph.similar_pairs(frame(spark, rows), level, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_equal_union_find(spark, rows):
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(x @ x.T >= 0.35)):
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    got = {r["id"]: r["component"] for r in issues.components_at(frame(spark, rows), 0.35, 9).collect()}
    assert got == {i: find(i) for i in range(len(x))}


def shapes():
    rng = np.random.default_rng(4)
    ids = rng.permutation(500).tolist()
    path, star, ring, hub = ids[:100], ids[100:200], ids[200:250], ids[250:]
    links = list(zip(path, path[1:])) + [(star[0], x) for x in star[1:]] + list(zip(ring, ring[1:] + ring[:1]))
    links += [(hub[0], x) for x in hub[1:225]] + list(zip(hub[224:], hub[225:])) + [(5000, 5000)]
    return links, {x: min(part) for part in (path, star, ring, hub) for x in part}


@pytest.mark.parametrize(("finish", "kind"), [(0, "long"), (100, "string"), (1 << 18, "string")])
def test_components_of_paths_stars_rings_and_hubs(spark, finish, kind):
    links, want = shapes()
    if kind == "string":
        links = [(f"{a:05d}", f"{b:05d}") for a, b in links]
        want = {f"{a:05d}": f"{b:05d}" for a, b in want.items()}
    edges = spark.createDataFrame(links, f"src {kind}, dst {kind}").repartition(3)
    assert {r["node"]: r["component"] for r in graph.connected_components(edges, finish).collect()} == want


def test_components_without_edges(spark):
    assert graph.connected_components(spark.createDataFrame([(1, 1)], "src long, dst long")).collect() == []


def test_a_shuffled_path_takes_few_rounds(spark):
    n = 100_000
    ids = np.random.default_rng(8).permutation(n).tolist()
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")
    rounds = []
    found = graph.connected_components(edges, 1000, rounds)
    assert found.count() == n and found.where("component != 0").isEmpty()
    assert all(b < 0.7 * a for a, b in zip(rounds, rounds[1:]))  # so the rest takes 20 rounds more at most


def test_more_links_merge_known_components(spark):
    links, want = shapes()
    frame_of = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    known = graph.connected_components(frame_of(links[::2]))
    found = graph.merged_components(known, frame_of(links[1::2] + [(7000, 7001)]))
    assert {r["node"]: r["component"] for r in found.collect() if r["node"] < 5000} == want
    assert {r["node"]: r["component"] for r in found.where("node > 5000").collect()} == {7000: 7000, 7001: 7000}


@pytest.fixture(scope="module")
def clustered(spark, rows):
    return {r["id"]: r["cluster_id"] for r in issues.density_clusters(frame(spark, rows), min_size=5).collect()}


def test_planted_groups_are_found(rows, clustered):
    for g in range(4):
        members = [r[0] for r in rows if r[2] == g]
        labels = [clustered[m] for m in members]
        assert len(set(labels)) == 1 and labels[0] == min(members)
    assert len({c for c in clustered.values() if c is not None}) == 4


def test_clusters_equal_single_linkage_over_all_pairs(rows, clustered):
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    want = brute([(i, j, s[i, j]) for i in range(len(x)) for j in range(i)], {i: 1 for i in range(len(x))}, 5)
    assert {i: c for i, c in clustered.items() if c is not None} == {i: min(g) for i, g in want.items()}


def test_clusters_do_not_depend_on_order_or_partitions(spark, rows, clustered):
    shuffled = frame(spark, rows[::-1]).repartition(7)
    got = {r["id"]: r["cluster_id"] for r in issues.density_clusters(shuffled, min_size=5, block_rows=10).collect()}
    assert got == clustered


def test_copies_count_as_members(spark, rows):
    base = [r for r in rows if r[2] in (0, 1)] + [(1000 + k, rows[-1][1], 9) for k in range(8)]
    got = {r["id"]: r["cluster_id"] for r in issues.density_clusters(frame(spark, base), min_size=5).collect()}
    assert {got[1000 + k] for k in range(8)} == {1000}


def test_too_few_vectors_are_noise(spark, rows):
    got = issues.density_clusters(frame(spark, rows[:4])).collect()
    assert len(got) == 4 and all(r["cluster_id"] is None for r in got)


def test_similar_centroids_merge_transitively(spark):
    angle = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    v = spark.createDataFrame([(1, angle(0)), (2, angle(20)), (3, angle(40)), (4, angle(120)), (5, angle(200))], "id int, vector array<double>")
    labels = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40), (5, None)], "id int, cluster_id int")
    got = {r["id"]: r["cluster_id"] for r in issues.merge_similar(v, labels).collect()}
    assert got == {1: 10, 2: 10, 3: 10, 4: 40, 5: None}


def test_names(spark):
    texts = [(i, "pay electric bill", 1) for i in range(3)] + [(i + 10, "reset password link", 2) for i in range(3)] + [(20, "pay nothing", None)]
    texts += [(30, "alpha", 3), (31, "beta", 3), (32, "gamma", 3), (33, "delta", 3)]
    got = {r["cluster_id"]: r["label"] for r in issues.name_clusters(spark.createDataFrame(texts, "id int, text string, cluster_id int")).collect()}
    assert got == {1: "bill / electric / pay", 2: "link / password / reset", 3: "alpha / beta / delta"}


def test_naming_reads_the_texts_once_and_a_refresh_names_once(spark, monkeypatch, tmp_path):
    texts = spark.createDataFrame([(i, f"router {'offline' if i % 2 else 'slow'} word{i}", i % 2) for i in range(40)], "id long, text string, cluster_id long")
    plan = issues.name_clusters(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    spark.createDataFrame([(i, f"text about thing {i}") for i in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked, name = [], issues.name_clusters
    monkeypatch.setattr(issues, "name_clusters", lambda t: asked.append(1) or name(t))
    assert QUERIES["clusters_refreshed"](spark, str(tmp_path)).count() == 8 and len(asked) == 1


def test_placing_gives_bounded_slices_and_loses_no_vector():
    rng = np.random.default_rng(4)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 16)))
    batch = pd.DataFrame({"id": np.arange(3000), "vector": list(unit(3000))})
    parts = list(graph._cells(unit(40), np.sqrt(2 - 2 * 0.2))(iter([batch, batch[:0]])))
    every = pd.concat(parts)
    assert max(map(len, parts)) <= 4096 < len(every)
    assert sorted(every[every["home"]]["id"]) == list(range(3000)) and not every.duplicated(["id", "cell"]).any()


def test_vectors_do_not_go_through_the_driver(spark):
    vectors = spark.range(60).select("id", F.array(F.cos(F.col("id") % 20), F.sin(F.col("id") % 20)).alias("vector"))
    plans = [issues.density_clusters(vectors, min_size=5), issues.components_at(vectors, 0.9)]
    assert not [p for p in plans if "BroadcastHashJoin" in p._jdf.queryExecution().executedPlan().toString()]


def test_a_vector_is_moved_for_as_many_blocks_however_many_vectors_there_are(spark):
    vectors = lambda n: spark.range(n).select("id", F.array(F.cos("id"), F.sin("id"), F.cos(F.col("id") * 3)).alias("vector"))
    for n in (40_000, 80_000):
        tiles = graph._block_pairs(vectors(n), 0.36, None)
        assert tiles.count() <= 17 * n
        assert tiles.groupBy("cell", "tile").count().agg(F.max("count")).first()[0] < 3 * n / 16


@pytest.mark.parametrize("left,right,dims,level", [(200, 0, 8, -1.0), (150, 90, 8, -1.0), (120, 0, 3, 0.9), (80, 130, 64, 0.2), (1, 0, 4, -1.0), (1, 7, 4, -1.0)])
@pytest.mark.parametrize("near", [1, 16])
def test_forests_of_blocks_equal_brute_force(monkeypatch, left, right, dims, level, near):
    monkeypatch.setattr(graph, "NEAR", near)
    monkeypatch.setattr(graph, "STEP_ROWS", 48)
    rng, n = np.random.default_rng(left), left + right
    side = np.array([graph.LEFT] * left + [graph.RIGHT] * right if right else [graph.BOTH] * left, "int8")
    vectors = pa.array(list(rng.normal(size=(n, dims))), pa.list_(pa.float64()))
    tile = graph._Tile(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(n)), vectors, pa.array(side)], ["id", "vector", "side"])]))
    cosines, parent = tile.x @ tile.x.T, list(range(n))

    def root(v):
        return v if parent[v] == v else root(parent[v])

    want = []
    for w, i, j in sorted(((cosines[i, j], i, j) for i in tile.left for j in tile.right if (right or i < j) and cosines[i, j] >= level), reverse=True):
        if root(i) != root(j):
            parent[root(i)] = root(j)
            want.append(w)
    assert sorted(graph._forest(tile, level)[2], reverse=True) == pytest.approx(want)


def test_edges_are_thinned_to_a_forest_before_they_are_split(spark):
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 900), rng.integers(40, 90, 900), rng.random(900))], "src long, dst long, cosine double").repartition(6)
    whole = graph.spanning_forest(edges).collect()
    parts = graph.spanning_forest(edges, 300).collect()
    assert len(whole) == 89 and len(parts) <= 3 * 89
    assert sum(r["cosine"] for r in graph.spanning_forest(spark.createDataFrame(parts)).collect()) == pytest.approx(sum(r["cosine"] for r in whole))
    assert graph.spanning_forest(edges.limit(0)).collect() == []

"""MinHash near-duplicate detection by chosen-path set similarity join.

A document is the set of its word shingles; equal sets are folded into one. Independent trees branch the sets by selected
minwise tokens: two sets of similarity s stay together at a token with probability s. Every node first compares its members
with its smallest one and a few others. Links join components, and what a node still has to compare are members of different components:
where that is little for its size it is done exhaustively, whatever the size; else the node branches on, each member into
two children, so that similar sets hardly get lost. The number of trees follows from the recall that is asked for. Sketches
of one bit a token throw out unlike pairs, and so do parity bitmaps of the sets, which lose no link: a shingle that only one of
two sets has flips one bit, so that bitmaps differ in at most as many bits as the sets do in shingles. What is left is
confirmed on the full sets, from the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.graph import SENT_ROWS, unsent
from voxlake.llm.batches import RollingHash, mix, pieces
from voxlake.llm.components import components
from voxlake.llm.filters import bitmap_of, passes
from voxlake.session import settle

TOKENS = 128
#: 64-bit words of a set's parity bitmap. Up to about 1,000 shingles it tells most pairs below the similarity asked for.
BITMAP = 8
PARITY = tuple(f"p{i}" for i in range(BITMAP))
#: A node compares exhaustively if that takes so many pairs a member at most.
PAIRS_A_MEMBER = 512
#: Members of a node, on average, that all others of it are compared with first.
ANCHORS = 4
#: Rows of a round, and pairs, that a task reads at least: small rounds don't take a task for each partition.
ROWS_A_TASK, PAIRS_A_TASK = 20_000, 5_000
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STEP = np.uint64(0x9FB21C651E98DF25)
_ODD = mix(np.arange(1, TOKENS + 1, dtype="uint64")) | np.uint64(1)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; of fewer words, all together are one shingle."""
    data = b"\n".join(texts).lower() + b"\n"
    blank = _SPACE[np.frombuffer(data, "uint8")]
    edges = np.diff(np.concatenate([[True], blank]).astype("int8"))
    start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    words = RollingHash(data).of(start, end)
    bounds = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))
    n = len(words)
    joined = np.zeros(max(0, n - size + 1), dtype="uint64")
    for i in range(size):
        joined = joined * _STEP + words[i : i + len(joined)]
    joined = mix(joined)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        else:
            whole = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    whole = whole * _STEP + w
            out.append(mix(np.array([whole + np.uint64(b - a)] if b > a else [], dtype="uint64")))
    return out


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The smallest of the shingles' values under each of the hash functions."""
    out = np.full(TOKENS, 0xFFFFFFFF, dtype="uint64")
    for i in range(0, len(shingles), 2048):
        np.minimum(out, ((shingles[None, i : i + 2048] * _ODD[:, None]) >> np.uint64(32)).min(axis=1), out=out)
    return out


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each bit that shingles fall on, whether an odd number of them does, as 64-bit words."""
    odd = np.bincount((shingles >> np.uint64(64 - (64 * BITMAP - 1).bit_length())).astype("int64"), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype("uint8")).view("<i8")


def _survival(similar: float) -> float:
    """The chance that a link of this similarity is in some descendant, however often a node with it branches into two."""
    lost = 0.0
    for _ in range(200):
        lost = (1 - similar + similar * lost) ** 2
    return 1 - lost


def _choice(tree: int) -> np.ndarray:
    """The tokens in the order in which a tree chooses them."""
    rest = np.random.default_rng(99).permutation(TOKENS)
    return np.roll(rest, -2 * tree)


def _signed(docs: DataFrame, size: int, trees: int) -> DataFrame:
    """`(doc_id, n, f1, f2, s1, s2, p0, p1, ..., tokens, paths)`: size of the set, its fingerprint, the sketch, its parity
    bitmap, its tokens, and where the first two choices of each tree lead."""
    order = np.stack([_choice(t)[:2] for t in range(trees)])
    salt = np.arange(1, trees + 1, dtype="uint64") * _STEP

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            sets = shingle_sets(texts, size)
            tokens = np.array([minwise(s) for s in sets])
            bits = np.packbits(tokens.astype("uint8") & 1, axis=1).view("<i8")
            paths = mix((tokens[:, order[:, 0]] << np.uint64(32) | tokens[:, order[:, 1]]) * _STEP + salt)
            odd = np.array([parity(s) for s in sets])
            total = np.array([s.sum() if len(s) else 0 for s in sets], dtype="uint64").view("int64")
            crossed = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], dtype="uint64").view("int64")
            offset = lambda width: pa.array(np.arange(len(sets) + 1, dtype="int32") * width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(total),
                    pa.array(crossed),
                    pa.array(bits[:, 0].copy()),
                    pa.array(bits[:, 1].copy()),
                    *[pa.array(odd[:, i].copy()) for i in range(BITMAP)],
                    pa.ListArray.from_arrays(offset(TOKENS), pa.array(tokens.astype("uint32").view("int32").ravel())),
                    pa.ListArray.from_arrays(offset(trees), pa.array(paths.view("int64").ravel())),
                ],
                ["doc_id", "n", "f1", "f2", "s1", "s2", *PARITY, "tokens", "paths"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in ("n", "f1", "f2", "s1", "s2", *PARITY))
    return docs.mapInArrow(sign, f"doc_id {kind}, {longs}, tokens array<int>, paths array<long>")


def _alike(a: str, b: str, percent: int, unlike_bits: int) -> Column:
    """Whether sizes, sketches and parity bitmaps allow the similarity."""
    c = lambda side, name: F.col(f"{side}.{name}")
    apart = F.bit_count(c(a, "s1").bitwiseXOR(c(b, "s1"))) + F.bit_count(c(a, "s2").bitwiseXOR(c(b, "s2")))
    near = (F.least(c(a, "n"), c(b, "n")) * 100 >= F.greatest(c(a, "n"), c(b, "n")) * percent) & (apart <= unlike_bits)
    odd = reduce(Column.__add__, [F.bit_count(c(a, p).bitwiseXOR(c(b, p))) for p in PARITY])
    # Sets with intersection / union >= percent / 100 differ in (100 - percent) / (100 + percent) of their sizes' sum at most.
    return near & (odd * (100 + percent) <= (c(a, "n") + c(b, "n")) * (100 - percent))


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough. A pair's texts meet in one row; a popular side is split at run time."""
    hashed = F.xxhash64("doc_id").alias("h")
    needed = bitmap_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).select(hashed), "h")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([1, 2]).filter(pa.array(passes(needed, batch.column(0).to_numpy())))

    own = texts.select(hashed, "doc_id", "text").mapInArrow(likely, texts.schema)
    with_b = pairs.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, left in pieces(batches, "text_a"):
            right = [x or b"" for x in batch.column(3).cast(pa.large_binary()).to_pylist()]
            one, two = shingle_sets(left, size), shingle_sets(right, size)
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two)])
            union = np.array([len(x) + len(y) for x, y in zip(one, two)]) - shared
            yield batch.select([0, 1]).filter(pa.array((100 * shared >= percent * union) & (union > 0)))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, f"a {kind}, b {kind}")


def _tokens_of(sets: DataFrame, filled: DataFrame) -> DataFrame:
    """`(f1, tokens)` of the given sets, one row each. Rows of other sets hardly leave their tasks."""
    needed = bitmap_of(sets, "f1")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(needed, batch.column(0).to_numpy())))

    own = filled.select("f1", "tokens")
    return own.mapInArrow(likely, own.schema).groupBy("f1").agg(F.first("tokens").alias("tokens"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, recall: float = 1 - 1e-7) -> DataFrame:
    """`(doc_id, n_shingles, component_id, kept)` for each row: the size of its set, the smallest id that links reach, and
    whether that is its own.

    Words are what stands between blanks of ASCII, with A-Z in lower case, of the whole text. Sets are linked if their
    intersection is at least `percent` of their union. A null text or one without words has an empty set and is linked
    with nothing. Repeated rows are in one component, and where they share its id all are kept. A row without an id is in
    the component of rows with an equal set, or else in none, and then kept. An empty table gives an empty one; only the
    two columns named are read. A link at exactly `percent` is missed with a probability of about
    1 - `recall`, also in nodes that branch again and again.
    """
    similar = percent / 100
    # Two sets stay together over the first two choices, and then for ever with the survival of branching into two children.
    lasting = similar**2 * _survival(similar)
    trees = min(TOKENS // 2, math.ceil(math.log(1 - recall) / math.log(1 - lasting)))
    mean, spread = TOKENS * (1 - similar) / 2, math.sqrt(TOKENS * (1 - similar) / 2 * (1 + similar) / 2)
    unlike = math.ceil(mean + 6.5 * spread)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = settle(_signed(rows, shingle, trees))
    filled = signed.where("n > 0")
    # What tells a set is the same in all of its rows; rows move with it only where a node has others to compare with.
    attributes = ["n", "s1", "s2", *PARITY]
    once = [F.first(c).alias(c) for c in ("s1", "s2", *PARITY, "paths")]
    folded = settle(filled.drop("tokens").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), *once))
    members = folded.where("rep is not null").withColumnRenamed("rep", "id")
    told = members.select("id", "f1", *attributes)
    placed = members.select("id", "f1", F.col("id").alias("component"), F.posexplode("paths").alias("tree", "node"))
    known, level = None, 2

    def described(rows: DataFrame, n: int) -> DataFrame:
        """At most n rows with what tells their sets. The sets' size is a guess, so they are never what is sent to all tasks."""
        return rows.join(told.hint("merge"), ["id", "f1"]) if n > SENT_ROWS else told.join(F.broadcast(rows), ["id", "f1"])

    def linked(pairs: DataFrame, known: DataFrame | None) -> DataFrame | None:
        """The components after what is similar enough of more pairs."""
        if not (n := pairs.count()):
            return known
        links = settle(_confirmed(pairs.coalesce(-(-n // PAIRS_A_TASK)), rows, shingle, percent))
        return known if links.isEmpty() else components(links, known)

    while True:
        sizes = settle(placed.groupBy("node").agg(F.count("*").alias("m"), F.min("id").alias("pivot")).where("m > 1"))
        n = sizes.agg(F.sum("m")).first()[0]
        if not n:
            break
        tasks = -(-n // ROWS_A_TASK)
        crowd = settle(described(placed.join(unsent(sizes, n), "node"), n).coalesce(tasks))
        side = lambda name: F.struct("id", *attributes, "component").alias(name)
        # Every member meets the smallest one and some others, of whom a hash of the id chooses about ANCHORS a node.
        chosen = (F.col("id") == F.col("pivot")) | (F.pmod(F.xxhash64("id", F.lit(level)), F.greatest(F.lit(1), F.expr(f"m div {ANCHORS}"))) == 0)
        anchors = crowd.where(chosen).select("node", side("x"))
        stars = crowd.select("node", side("y")).join(anchors, "node").where("y.id != x.id and y.component != x.component")
        ordered = stars.where(_alike("x", "y", percent, unlike)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        star_pairs = settle(ordered.distinct())
        # Every step costs a task a partition, also over no rows, so what can't add a link isn't begun.
        known = linked(star_pairs, known)

        # Members by component. What is left to compare in a node are pairs across its components.
        named = crowd.select("id", "f1", "tree", "node")
        if known is None:
            named = named.withColumn("component", F.col("id"))
        else:
            named = named.join(known.select(F.col("node").alias("id"), "component"), "id", "left")
        named = settle(named.withColumn("component", F.coalesce("component", "id")).coalesce(tasks))
        parts = named.groupBy("node", "component").agg(F.count("*").alias("c"))
        work = parts.groupBy("node").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max_by("component", "c").alias("largest"))
        work = settle(work.withColumn("pairs", F.expr("(m * m - squares) div 2")).where("pairs > 0").drop("squares").coalesce(tasks))
        if work.isEmpty():
            break
        last = level + 2 > TOKENS  # no token is left to branch by: all of the node is compared
        small = F.lit(last) | (F.col("pairs") <= F.col("m") * PAIRS_A_MEMBER)
        inside = settle(described(named.join(work.where(small).select("node", "largest"), "node"), n).coalesce(tasks))
        outside = inside.where("component != largest").select("node", "largest", side("x"))
        # A pair of two outsiders is met twice and taken once.
        across = outside.join(inside.select("node", side("y")), "node").where("x.component != y.component and (y.component = largest or x.id < y.id)")
        ordered = across.where(_alike("x", "y", percent, unlike)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        rest = settle(ordered.join(star_pairs, ["a", "b"], "left_anti"))
        known = linked(rest, known)

        large = work.where(~small).select("node")
        if last or large.isEmpty():
            break
        going = settle(named.join(large, "node", "left_semi").select("id", "f1", "component", "tree", "node").coalesce(tasks))
        # Two children for each member, by the next two tokens of the tree.
        choices = F.lit([_choice(t).tolist() for t in range(trees)])
        child = lambda n: F.xxhash64("node", F.lit(n), F.get("tokens", F.get(F.get(choices, F.col("tree")), F.lit(n))))
        tokens = unsent(_tokens_of(going.select("f1"), filled), n * TOKENS // 16)
        placed = settle(going.join(tokens, "f1").select("id", "f1", "component", "tree", F.explode(F.array(child(level), child(level + 1))).alias("node")).coalesce(tasks))
        level += 2

    joined = signed.select("doc_id", "n", "f1", "f2").join(folded.select("f1", "f2", "n", "rep").hint("merge"), ["f1", "f2", "n"], "left")
    if known is None:
        result = joined.withColumn("component", F.lit(None).cast(rows.schema["doc_id"].dataType))
    else:
        result = joined.join(known.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left")
    component = F.coalesce("component", "rep", F.when(F.col("n") == 0, F.col("doc_id")))
    return result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )

"""Approximate nearest neighbours by largest inner product, over a hierarchical k-means tree.

Vectors get one more coordinate, so that the largest inner product is the least distance. The
tree is fitted on a bounded sample, with more leaves the more vectors there are; every vector
goes down it to a leaf. A query visits leaves best-bin first: a priority queue holds the nodes
seen so far by distance, and each step opens the nearest. After its first leaves a query knows
how far its k-th best vector is; it widens its visits until the queue's nearest node is further
than a multiple of that. The multiple is calibrated: exact neighbours of a few queries show how
far one must go to meet the wanted share of them. Vectors of each dimension are searched among
themselves.
"""

from __future__ import annotations

import heapq
import logging
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.llm.common import settle

#: Vectors that a tree is fitted on, at most about, and their values.
FIT_ROWS, FIT_VALUES = 65_536, 4 << 20
#: Queries whose exact neighbours calibrate the visits, at most about.
CALIBRATION_ROWS = 256
BRANCH = 8
#: Vectors in a leaf, about, and sampled vectors in a leaf at least. Leaves grow in number with
#: the table up to FIT_ROWS / LEAF_SAMPLE, and beyond that in size.
LEAF_ROWS, LEAF_SAMPLE = 256, 8
#: Vectors and queries that meet in one task's group, at most.
CHUNK, QUERY_CHUNK = 16_384, 1024
#: Dimensions with fewer vectors than this are one leaf each, and searched whole.
SMALL = 1024
_PLACES = 1 << 30
_LOG = logging.getLogger(__name__)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec array<float>, d int) of rows with an id and a vector that is not null, empty or
    zero and has no null or non-finite component; d is its dimension."""
    v = F.col(vector_col)
    good = vectors.where(
        F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists(v, lambda x: x != 0)
    )
    return good.select(F.col(id_col).cast("long").alias("id"), v.alias("vec"), F.size(v).alias("d"))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


class Tree:
    """Centroids of all nodes; `children[n]` is empty for a leaf, `leaf[n]` its number."""

    def __init__(self, sample: np.ndarray, top_norm: float, leaf_rows: int, seed: int = 7):
        self.top, self.leaf_rows = top_norm, leaf_rows
        points = self.lift(sample)
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(points, leaf_rows, rng)
        self.centres = np.array(self.centres)
        self.squares = (self.centres**2).sum(axis=1)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.top**2 - (x**2).sum(axis=1)))
        return np.hstack([x, rest[:, None]])

    def _grow(self, points, leaf_rows, rng) -> int:
        me = len(self.centres)
        self.centres.append(points.mean(axis=0))
        self.children.append([])
        self.leaf.append(-1)
        parts = self._split(points, rng) if len(points) > leaf_rows else []
        if len(parts) < 2:
            self.leaf[me] = self.leaves
            self.leaves += 1
        else:
            self.children[me] = [self._grow(p, leaf_rows, rng) for p in parts]
        return me

    def _split(self, points, rng, rounds: int = 10) -> list[np.ndarray]:
        different = np.unique(points, axis=0)
        if len(different) < 2:
            return []
        parts = min(BRANCH, len(different), -(-len(points) // self.leaf_rows))
        centres = different[rng.choice(len(different), parts, replace=False)]
        for _ in range(rounds):
            near = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
            centres = np.array([points[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
        near = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        return [points[near == k] for k in range(len(centres)) if (near == k).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, down the nearest child each time."""
        points, out = self.lift(x), np.empty(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            near = (self.squares[kids] - 2 * points[rows] @ self.centres[kids].T).argmin(axis=1)
            todo += [(kid, rows[near == k]) for k, kid in enumerate(kids) if (near == k).any()]
        return out

    def visits(self, query: np.ndarray):
        """(leaf, reach) best bin first: reach is how far, squared, the queue had to go."""
        wide, reach, queue = np.append(query, 0.0), 0.0, [(0.0, 0)]
        size = float(query @ query)
        while queue:
            far, node = heapq.heappop(queue)
            reach = max(reach, far)
            kids = self.children[node]
            if not kids:
                yield self.leaf[node], reach
                continue
            for far, kid in zip((self.squares[kids] - 2 * self.centres[kids] @ wide + size).tolist(), kids):
                heapq.heappush(queue, (far, kid))

    def first(self) -> int:
        """How many leaves every query visits before it widens."""
        return min(self.leaves, 1 + round(self.leaves**0.5))

    def distance(self, query: np.ndarray, score) -> float:
        """Squared distance of a vector with that inner product."""
        return float(query @ query) + self.top**2 - 2 * score


def best(query_ids, queries, ids, points, k: int, rows: int = 128):
    """`_best` for a few queries at a time, which bounds the matrix of scores."""
    parts = [_best(query_ids[i : i + rows], queries[i : i + rows], ids, points, k) for i in range(0, len(queries), rows)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    shift = np.repeat(np.arange(0, len(queries), rows), [len(p[0]) for p in parts])
    q, vec_id, score = (np.concatenate(x) for x in zip(*parts))
    return q + shift, vec_id, score


def _best(query_ids, queries, ids, points, k: int):
    """(query position, id, score) of each query's k best points, its own id aside: largest
    score, then smallest id. A matrix product finds who may be among them; scores are then
    summed pair by pair, so that equal vectors have equal scores."""
    rough = queries @ points.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    if rough.shape[1] > k:
        floor = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
    else:
        floor = np.full(len(rough), -np.inf)
    scale = np.abs(queries).sum(axis=1) * (np.abs(points).max() if points.size else 0.0)
    q, p = np.nonzero((rough >= (floor - 1e-9 * (scale + 1e-300))[:, None]) & (rough > -np.inf))
    score = np.concatenate([(queries[q[i : i + 65536]] * points[p[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)]) if len(q) else np.empty(0)
    order = np.lexsort((ids[p], -score, q))
    q, p, score = q[order], p[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], ids[p[keep]], score[keep]


def _sampled(rows: DataFrame, share: float, most: int, salt: int) -> pa.Table:
    """About that share of (id, vec), by a hash of both; equal rows count once, and never more
    than `most` rows come."""
    place = F.xxhash64("id", "vec", F.lit(salt))
    held = rows.select("id", "vec", place.alias("place")).where(F.pmod("place", F.lit(_PLACES)) < max(1, int(share * _PLACES)))
    return held.groupBy("place").agg(F.first("id").alias("id"), F.first("vec").alias("vec")).orderBy("place").limit(most).select("id", "vec").toArrow()


def fit(points: DataFrame, n: int, fit_rows: int = FIT_ROWS) -> Tree:
    """A tree over n rows (id, vec) of one dimension, at least one of them."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    row = points.agg(F.max(norm).alias("top"), F.first("vec").alias("any"), F.first("id").alias("id")).first()
    most = max(LEAF_SAMPLE, min(fit_rows, FIT_VALUES // len(row["any"])))
    sample = matrix(_sampled(points, min(1.0, most / n), 2 * most, 0).column("vec"))
    if not len(sample):
        sample = np.array([row["any"]], np.float64)
    leaves = max(1, min(n // LEAF_ROWS, len(sample) // LEAF_SAMPLE))
    return Tree(sample, row["top"] * (1 + 1e-9), -(-len(sample) // leaves))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(points: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """Brute force for a bounded set of queries: (query_id, rank, vec_id, score)."""
    held = points.sparkSession.sparkContext.broadcast((queries.column("id").to_numpy(), matrix(queries.column("vec"))))

    def work(batches):
        ids, vectors = held.value
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                q, vec_id, score = best(ids, vectors, part.column(0).to_numpy(), matrix(part.column(1)), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(vec_id), pa.array(score)], names=["query_id", "vec_id", "score"])

    return _ranked(points.select("id", "vec").mapInArrow(work, "query_id long, vec_id long, score double"), k)


def _meet(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): for each row (id, vec, d, leaf, floor) of asked, its k best
    of the leaf's points (id, vec, d, leaf), none below floor."""
    # Both sides of a leaf are cut into chunks, and each pair of chunks meets in one group.
    asked_sizes = asked.groupBy("d", "leaf").agg(F.count("*").alias("asked"))
    sizes = points.groupBy("d", "leaf").count().join(asked_sizes, ["d", "leaf"]).select(
        "d", "leaf", F.ceil(F.col("count") / CHUNK).cast("int").alias("np"), F.ceil(F.col("asked") / QUERY_CHUNK).cast("int").alias("nq")
    )  # a row per leaf: no more than the sample bears
    sizes = F.broadcast(sizes)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = points.join(sizes, ["d", "leaf"]).withColumn("p", F.pmod(F.xxhash64("id", "vec", "nth"), "np").cast("int")).withColumn("q", every("nq"))
    right = asked.join(sizes, ["d", "leaf"]).withColumn("q", F.pmod(F.xxhash64("id"), "nq").cast("int")).withColumn("p", every("np"))
    cut = ["d", "leaf", "p", "q"]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = b.column("id").to_numpy()
        q, vec_id, score = best(ids, matrix(b.column("vec")), a.column("id").to_numpy(), matrix(a.column("vec")), k)
        keep = score >= b.column("floor").to_numpy()[q]
        return pa.table({"query_id": pa.array(ids[q[keep]]), "vec_id": pa.array(vec_id[keep]), "score": pa.array(score[keep])})

    return left.select(*cut, "id", "vec").groupBy(*cut).cogroup(right.select(*cut, "id", "vec", "floor").groupBy(*cut)).applyInArrow(meet, "query_id long, vec_id long, score double")


def calibrate(tree: Tree, points: DataFrame, queries: DataFrame, near: DataFrame, k: int, recall: float) -> tuple[float, float]:
    """(multiple, share of leaves): how many times as far (squared) as its k-th best vector of
    the first leaves a query must go, so that sampled queries meet that share of their exact
    neighbours, and what share of the leaves they visit then. `near`: (id, floor), the score of
    that k-th best vector."""
    n = queries.count()
    sample = _sampled(queries.select("id", "vec"), min(1.0, CALIBRATION_ROWS / max(1, n)), 2 * CALIBRATION_ROWS, 3)
    if not sample.num_rows:
        return float("inf"), 1.0
    vectors = dict(zip(sample.column("id").to_pylist(), matrix(sample.column("vec"))))
    spark = points.sparkSession
    ids = spark.createDataFrame([(i,) for i in vectors], "id long")
    floors = {r["id"]: r["floor"] for r in near.join(F.broadcast(ids), "id").collect()}
    exact_ = exact(points, sample, k).select("query_id", F.col("vec_id").alias("id"))
    met = exact_.join(points.select("id", "leaf").distinct(), "id").groupBy("query_id", "leaf").agg(F.countDistinct("id").alias("n")).collect()
    reach = {i: dict(tree.visits(v)) for i, v in vectors.items()}
    base = {i: max(tree.distance(v, floors[i]), 1e-300) if floors.get(i) is not None else None for i, v in vectors.items()}
    first = {i: set(list(reach[i])[: tree.first()]) for i in vectors}
    need = [0.0 if r["leaf"] in first[r["query_id"]] or base[r["query_id"]] is None else reach[r["query_id"]][r["leaf"]] / base[r["query_id"]] for r in met for _ in range(r["n"])]
    need.sort()
    multiple = need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)] if need else 0.0
    visited = [sum(base[i] is None or leaf in first[i] or far <= multiple * base[i] for leaf, far in reach[i].items()) for i in vectors]
    return multiple, float(np.mean(visited)) / tree.leaves


def _searched(points: DataFrame, wanted: DataFrame, d: int, n: int, k: int, recall: float) -> DataFrame:
    """(query_id, vec_id, score) of one dimension's points; each query's k best are among them."""
    spark = points.sparkSession
    vec_type = points.schema["vec"].dataType.simpleString()
    tree = fit(points, n)
    held = spark.sparkContext.broadcast(tree)

    def down(batches):
        for batch in batches:
            leaf = held.value.assign(matrix(batch.column(1))) if batch.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["id", "vec", "d", "leaf"])

    placed = settle(points.mapInArrow(down, f"id long, vec {vec_type}, d int, leaf int").withColumn("nth", F.monotonically_increasing_id()), "points")
    queries = settle(placed.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("vec").alias("vec")), "queries")

    def visit(multiple, rest):
        def work(batches):
            tree = held.value
            for batch in batches:
                owner, leaves = [], []
                floor = batch.column(2).to_pylist() if rest else [None] * batch.num_rows
                for i, v in enumerate(matrix(batch.column(1))):
                    far = float("inf") if floor[i] is None else multiple * max(tree.distance(v, floor[i]), 1e-300)
                    for at, (leaf, reach) in enumerate(tree.visits(v)):
                        if rest and at >= tree.first() and reach > far or not rest and at >= tree.first():
                            break
                        if not rest or at >= tree.first():
                            owner.append(i)
                            leaves.append(leaf)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), pa.array(leaves, pa.int32())], names=["id", "leaf"])

        return work

    def asked(rows, multiple, rest):
        made = rows.mapInArrow(visit(multiple, rest), "id long, leaf int")
        return settle(made.join(rows, "id").select("id", "vec", F.lit(d).alias("d"), "leaf", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")), "asked")

    begun = queries.withColumn("floor", F.lit(None).cast("double"))
    found = settle(_ranked(_meet(placed, asked(begun, 0.0, False), k), k), "first")
    if tree.first() == tree.leaves:
        return found.select("query_id", "vec_id", "score")
    near = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    multiple, share = calibrate(tree, placed, queries, near, k, recall)
    _LOG.info("dimension %d: %d vectors, %d leaves, %.3f of them visited for a recall of %.3f on sampled queries", d, n, tree.leaves, share, recall)
    widened = queries.join(near, "id", "left").select("id", "vec", "floor")
    more = _meet(placed, asked(widened, multiple, True), k)
    return found.select("query_id", "vec_id", "score").union(more)


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, recall: float = 0.94) -> DataFrame:
    """(query_id long, rank int from 1, vec_id long, score double): each query's k nearest
    found, all rows but its own id being candidates; fewer where there are fewer.

    Queries are the rows where `is_query` (a condition on vectors) holds. Unusable vectors
    (see `usable`) take no part; a vector's candidates are those of its dimension. Ties go to
    the smaller id; repeated vectors under different ids are all candidates; rows that repeat
    an id count as separate candidates, and one of them is the query. Other columns are not
    read. An empty table gives no rows. Dimensions with fewer than SMALL vectors are searched
    whole, all in one pass; each other one (there are at most rows / SMALL) has its own tree.
    """
    spark = vectors.sparkSession
    wanted = vectors.where(is_query).select(F.col(id_col).cast("long").alias("id")).distinct()
    clean = usable(vectors, id_col, vector_col)
    sizes = clean.groupBy("d").count()
    large = {r["d"]: r["count"] for r in sizes.where(F.col("count") >= SMALL).collect()}
    parts = [_searched(clean.where(F.col("d") == d), wanted, d, n, k, recall) for d, n in sorted(large.items())]
    few = sizes.where(F.col("count") < SMALL).select("d")
    if few.limit(1).count():
        small = settle(clean.join(few, "d", "left_semi").select("id", "vec", "d", F.lit(0).alias("leaf"), F.monotonically_increasing_id().alias("nth")), "points")
        asking = small.join(wanted, "id", "left_semi").groupBy("id", "d").agg(F.first("vec").alias("vec"))
        parts.append(_meet(small, settle(asking.select("id", "vec", "d", F.lit(0).alias("leaf"), F.lit(float("-inf")).alias("floor")), "asked"), k))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return _ranked(reduce(DataFrame.union, parts), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

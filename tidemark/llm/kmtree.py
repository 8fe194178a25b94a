"""Nearest neighbours by a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every row is then indexed under its leaf. A query walks the
tree with a priority queue of unopened branches, nearest centre first, and so orders the leaves. How
many leaves it visits is calibrated: the visits widen until a bounded set of queries, whose exact
neighbours come from a scan of all rows in blocks, reaches the wanted recall. Visits also go on until
the leaves hold enough rows for the answer.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage

#: Rows that the tree is fitted on, children per node, rows of the sample per leaf at most.
SAMPLE, BRANCH, LEAF_ROWS = 20_000, 12, 100
#: Queries with exact neighbours, and the mean recall that they must reach.
CALIBRATION, RECALL = 128, 0.95
#: Rows (vectors or queries) of one search block.
BLOCK = 4096


class Tree:
    """Flat nodes: centres of the children of each inner node, or a leaf number."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS, seed: int = 5):
        self.children: list[tuple[np.ndarray, list[int]] | None] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(sample, branch, leaf_rows, np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, branch: int, leaf_rows: int, rng) -> int:
        me = len(self.children)
        self.children.append(None)
        self.leaf.append(-1)
        centres = _kmeans(x, branch, rng) if len(x) > leaf_rows else x[:1]
        if len(centres) < 2:
            self.leaf[me] = self.leaves
            self.leaves += 1
            return me
        part = _nearest(x, centres)
        self.children[me] = centres, [self._grow(x[part == k], branch, leaf_rows, rng) for k in range(len(centres))]
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: down the nearest centres."""
        node = np.zeros(len(x), np.int64)
        done = np.array([self.leaf[n] >= 0 for n in node], bool)
        while not done.all():
            for n in np.unique(node[~done]):
                at = np.flatnonzero((node == n) & ~done)
                centres, below = self.children[n]
                node[at] = np.array(below)[_nearest(x[at], centres)]
            done = np.array(self.leaf)[node] >= 0
        return np.array(self.leaf)[node]

    def order(self, q: np.ndarray, most: int | None = None):
        """Leaves of one query, best bin first."""
        queue, given = [(0.0, 0)], 0
        while queue and (most is None or given < most):
            _, n = heapq.heappop(queue)
            while self.children[n] is not None:
                centres, below = self.children[n]
                d = ((centres - q) ** 2).sum(axis=1)
                best = int(np.argmin(d))
                for k, child in enumerate(below):
                    if k != best:
                        heapq.heappush(queue, (float(d[k]), child))
                n = below[best]
            given += 1
            yield self.leaf[n]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1) - 2 * x @ centres.T, axis=1)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        part = _nearest(x, centres)
        n = np.bincount(part, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, part, x)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return np.unique(centres[np.bincount(_nearest(x, centres), minlength=k) > 0], axis=0)


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def nearest_block(ids, x, q_ids, q, k: int, open_to=None):
    """(query, id, distance) of the k nearest of ``x`` to each query, the row of the query's id left out.

    ``open_to(i)`` is the mask of the rows that query i may see.

    Candidates come from a product form whose error is bounded; distances are then taken of the
    differences themselves, so order and ties are those of the exact distances.
    """
    out = []
    norm = (x ** 2).sum(axis=1)
    for at in range(0, len(q), 256):
        part = q[at:at + 256]
        approx = norm - 2 * part @ x.T + (part ** 2).sum(axis=1)[:, None]
        slack = 1e-9 * (norm.max(initial=0) + (part ** 2).sum(axis=1))
        for i in range(len(part)):
            a = approx[i]
            a[ids == q_ids[at + i]] = np.inf
            if open_to is not None:
                a[~open_to(at + i)] = np.inf
            kth = np.partition(a, k - 1)[k - 1] if len(a) >= k else np.inf
            near = np.flatnonzero((a <= kth + slack[i]) & np.isfinite(a))
            d = np.sqrt(((x[near] - part[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], d))[:k]
            out.append(pd.DataFrame({"query_id": q_ids[at + i], "vec_id": ids[near][best], "score": d[best]}))
    return out


_FOUND = "query_id long, vec_id long, score double"


def _search(k: int):
    def run(_, rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asking):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        leaves, of = np.unique(rows["leaf"].to_numpy(), return_inverse=True)
        visited = [np.isin(leaves, seen) for seen in asking["leaves"]]
        return pd.concat(nearest_block(rows["vec_id"].to_numpy(), _matrix(rows["vec"]), asking["query_id"].to_numpy(),
                                       _matrix(asking["qvec"]), k, lambda i: visited[i][of]), ignore_index=True)

    return run


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of all blocks of a query; each task keeps k a query before the shuffle."""
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec double array) of the rows that take part.

    Left out: null ids, null, empty or zero vectors, vectors with a null or non-finite component, and
    vectors whose length is not the table's commonest (the larger one on a tie). Of repeated ids the
    rows stay as they are; each is a candidate.
    """
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    ok = F.expr("vec_id IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> coalesce(NOT isnan(x) AND abs(x) < double('inf'), false)) "
                "AND exists(vec, x -> x <> 0)")
    v = v.where(ok)
    width = v.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return v.where(F.size("vec") == (width["w"] if width else 0))


def nearest(rows: DataFrame, is_query, k: int = 10, recall: float = RECALL, sample: int = SAMPLE,
            calibration: int = CALIBRATION, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row among all other rows.

    ``rows`` as from valid_vectors; ``is_query`` a condition on vec_id. Candidates of a query are all
    rows but those with its own id; with at most k of them all are returned. Nearest first, ties to
    the smaller vec_id. A repeated query id asks once, with its smallest vector. No queries or no rows give no rows.
    """
    spark = rows.sparkSession
    rows = stage(rows, "ann-vectors")
    fit = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample).toPandas()  # bounded
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(fit):
        return empty
    tree = Tree(_matrix(fit["vec"]), branch, leaf_rows)

    def place(batches):
        for b in batches:
            yield b.assign(leaf=tree.assign(_matrix(b["vec"])))

    index = stage(rows.mapInPandas(place, "vec_id long, vec array<double>, leaf long"), "ann-index")
    held = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row a leaf
    queries = index.where(is_query).select(F.col("vec_id").alias("query_id"), "vec").groupBy("query_id").agg(F.min("vec").alias("qvec"))
    # neighbouring leaves share a block of about BLOCK rows; a leaf with more rows has a block of several parts
    block_of, parts, block, size = {}, {}, 0, 0
    for leaf in sorted(held):
        if size and size + held[leaf] > BLOCK:
            block, size = block + 1, 0
        block_of[leaf], size = block, size + held[leaf]
        parts[block] = math.ceil(size / BLOCK)
    visits = _calibrate(index, queries, tree, held, k, recall, calibration)

    def leaves(batches):
        for b in batches:
            rows_of, blocks, seen_in = [], [], []
            for q in _matrix(b["qvec"]):
                seen, n, visited = {}, 0, 0
                for leaf in tree.order(q):
                    if visited >= visits and n > k:
                        break
                    if held.get(leaf):
                        seen.setdefault(block_of[leaf], []).append(leaf)
                        visited, n = visited + 1, n + held[leaf]
                rows_of.append(len(seen))
                blocks += seen
                seen_in += seen.values()
            yield b.loc[b.index.repeat(rows_of)].assign(block=blocks, leaves=seen_in)

    asked = queries.mapInPandas(leaves, "query_id long, qvec array<double>, block long, leaves array<long>")
    places = spark.createDataFrame([(leaf, blk, parts[blk]) for leaf, blk in block_of.items()], "leaf long, block long, nv int")
    return _merge(_blocks(index, asked, places, k), k)


def _blocks(index: DataFrame, asked: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """Block by block, BLOCK queries at a time; a crowded leaf is many parts."""
    asking = asked.groupBy("block").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("nq"))
    places = stage(places.join(asking, "block"), "ann-blocks")  # one row a leaf: bounded by the sample
    left = (index.join(F.broadcast(places), "leaf").withColumn("bv", F.pmod(F.xxhash64("vec_id"), F.col("nv")).cast("int"))
            .withColumn("bq", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select("block", "bv", "bq", "leaf", "vec_id", "vec"))
    counts = F.broadcast(places.select("block", "nv", "nq").distinct())
    right = (asked.join(counts, "block").withColumn("bq", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int"))
             .withColumn("bv", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))
             .select(F.col("block").alias("qblock"), F.col("bv").alias("qbv"), F.col("bq").alias("qbq"), "query_id", "qvec", "leaves"))
    return (left.groupBy("block", "bv", "bq").cogroup(right.groupBy("qblock", "qbv", "qbq"))
            .applyInPandas(_search(k), _FOUND))


def exact_nearest(rows: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """Brute force: a bounded frame of queries (query_id, qvec) against all rows, block by block."""
    ids, q = queries["query_id"].to_numpy(), _matrix(queries["qvec"])

    def run(batches):
        for b in batches:
            if len(b):
                yield from nearest_block(b["vec_id"].to_numpy(), _matrix(b["vec"]), ids, q, k)

    return _merge(rows.select("vec_id", "vec").mapInPandas(run, _FOUND), k)


def _calibrate(index: DataFrame, queries: DataFrame, tree: Tree, held, k: int, recall: float, calibration: int) -> int:
    """Leaf visits at which a bounded set of queries reaches the wanted mean recall."""
    some = queries.orderBy(F.xxhash64("query_id", F.lit(9)), "query_id").limit(calibration).toPandas()  # bounded
    if not len(some):
        return 1
    true = exact_nearest(index, some, k).join(index.select("vec_id", "leaf").distinct(), "vec_id").select("query_id", "leaf").toPandas()
    need = []  # the visit at which each true neighbour is met
    for q_id, vec in zip(some["query_id"], _matrix(some["qvec"]), strict=True):
        rank = {leaf: i for i, leaf in enumerate(x for x in tree.order(vec) if held.get(x))}
        need += [rank[leaf] + 1 for leaf in true.loc[true["query_id"] == q_id, "leaf"]]
    if not need:
        return 1
    need.sort()
    return need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)]


def op3(spark, sf_dir: str) -> DataFrame:
    rows = valid_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(rows, F.col("vec_id") % 100 == 0, k=10)

"""Exact top-k inner-product search: ball-tree branch and bound per shard.

Vectors are dealt over shards of about SHARD rows by a hash of their ids. A task builds the ball tree of its shard
(centre, radius, halves along the widest direction) and takes the queries down it together: a node is entered by
the queries whose upper bound `q . centre + |q| * radius` reaches their current kth score, the child with the
larger bound first. A first pass answers each query within its own shard only; the kth score found there is a
lower bound that all other shards start from, and each lowers its own work further as it finds better ones.
Queries go to all shards in blocks of about BLOCK, vectors once per block; what a shard returns is at most k rows per
query, and the k best of all shards are the result.

Components become integers floor(SCALE * x); scores are exact: a shard and block whose products could leave the
range in which doubles hold integers is scored in arbitrary precision, and scores beyond 64 bits end at its limits.
Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows without
an id; vectors meet those of their own length only; equal scores rank by smaller id; rows that repeat an id are all
candidates of other ids, and of a repeated query one row asks; an empty table gives an empty one.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.session import cut_lineage

SCALE = 1024
K = 10
SHARD = 8_192
BLOCK = 8_192
LEAF = 64
_EXACT = float(2**53)
_LIMIT = 2**63 - 1
_FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Balls around the rows of a matrix; leaves hold at most LEAF rows unless these are all equal."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left child, right child
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = points[self.order[a:b]]
            centre = rows.mean(axis=0)
            gaps = rows - centre
            here = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            self.centres.append(centre)
            self.radii.append(float(np.sqrt((gaps * gaps).sum(axis=1).max())))
            if parent >= 0:
                x, y, left, right = self.nodes[parent]
                self.nodes[parent] = (x, y, here, right) if side == 0 else (x, y, left, here)
            if b - a > LEAF and self.radii[-1] > 0:
                far = gaps[(gaps * gaps).sum(axis=1).argmax()]  # from the centre to its farthest row
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(gaps @ far, half)]
                todo += [(a + half, b, here, 1), (a, a + half, here, 0)]
        self.points = points[self.order]


def _exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; both hold integers as doubles."""
    if len(a) == 0 or len(b) == 0 or a.shape[1] == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object)
    scores = whole(a) @ whole(b).T
    return np.array([[max(-_LIMIT - 1, min(_LIMIT, x)) for x in row] for row in scores.tolist()], dtype=np.int64)


class Search:
    """The k best rows of a shard for each query of a block; `floor` holds their kth scores so far."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                 floor: np.ndarray, k: int):
        by_id = np.argsort(ids, kind="stable")
        self.tree = BallTree(points[by_id])
        self.ids = ids[by_id][self.tree.order]
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.floor = floor.astype(float)
        self.best_ids = np.full((len(queries), k), _LIMIT, np.int64)
        self.best = np.full((len(queries), k), -_LIMIT - 1, np.int64)
        self.held = np.zeros((len(queries), k), bool)
        self.norms = np.sqrt((queries * queries).sum(axis=1))
        self.visited = 0

    def bounds(self, node: int, who: np.ndarray) -> np.ndarray:
        centre, radius = self.tree.centres[node], self.tree.radii[node]
        at = self.queries[who] @ centre
        size = np.sqrt((centre * centre).sum())
        return at + self.norms[who] * (radius * (1 + 1e-9) + size * 1e-9) + 1e-6

    def run(self) -> None:
        todo = [(0, np.arange(len(self.queries)))] if len(self.tree.points) else []
        while todo:
            node, who = todo.pop()
            who = who[self.bounds(node, who) >= self.floor[who]]  # again: the floor may have risen
            if not len(who):
                continue
            a, b, left, right = self.tree.nodes[node]
            if left < 0:
                self.visited += len(who)
                for start in range(a, b, 4 * LEAF):  # equal rows may fill a large leaf
                    self.offer(who, start, min(b, start + 4 * LEAF))
                continue
            lefts, rights = self.bounds(left, who), self.bounds(right, who)
            first = lefts >= rights
            for group, near, far in ((who[first], left, right), (who[~first], right, left)):
                if len(group):
                    todo += [(far, group), (near, group)]  # the nearer one is taken next

    def offer(self, who: np.ndarray, a: int, b: int) -> None:
        ids = np.broadcast_to(self.ids[a:b], (len(who), b - a))
        scores = np.concatenate([self.best[who], _exact_product(self.queries[who], self.tree.points[a:b])], axis=1)
        names = np.concatenate([self.best_ids[who], ids], axis=1)
        held = np.concatenate([self.held[who], ids != self.query_ids[who][:, None]], axis=1)
        order = np.lexsort((names, -scores.astype(float), ~held), axis=1) if np.abs(scores).max() < 2**53 else np.array(
            [sorted(range(len(s)), key=lambda i: (not h[i], -int(s[i]), n[i])) for s, n, h in zip(scores, names, held)])
        top = order[:, :self.k]
        take = lambda m: np.take_along_axis(m, top, axis=1)
        self.best[who], self.best_ids[who], self.held[who] = take(scores), take(names), take(held)
        full = self.held[who].all(axis=1)
        self.floor[who[full]] = np.maximum(self.floor[who[full]], self.best[who[full], -1].astype(float))

    def result(self) -> pd.DataFrame:
        rows, cols = np.nonzero(self.held & (self.best.astype(float) >= self.floor[:, None]))
        return pd.DataFrame({"query_id": self.query_ids[rows], "vec_id": self.best_ids[rows, cols],
                             "score": self.best[rows, cols]})


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.float64).reshape(len(rows), width)


def _searched(points: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """One shard against one block of queries."""
    if not len(points) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    width = len(points["vec"].iloc[0])
    search = Search(points["vec_id"].to_numpy(), _matrix(points["vec"], width), queries["id"].to_numpy(),
                    _matrix(queries["x"], width), queries["floor"].to_numpy(), k)
    search.run()
    return search.result()


def _rows(vectors: DataFrame, is_query: Column, vec_id: str, embedding: str) -> DataFrame:
    """(id, x, width, asks) of the vectors that take part; x holds integers as doubles."""
    vector = F.col("v")
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), is_query.alias("asks"),
                          F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & vector.isNotNull() & finite)
    whole = F.transform(vector, lambda c: F.when(F.abs(c) < 2.0**42, F.floor(c * SCALE).cast("double"))
                        .otherwise(c * SCALE))  # doubles that large are integers as they are
    return rows.select("id", whole.alias("x"), F.size("v").alias("width"), F.coalesce("asks", F.lit(False)).alias("asks"))


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", *, k: int = K,
          shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with `is_query` the k rows of largest inner product."""
    rows = cut_lineage(_rows(vectors, is_query, vec_id, embedding))
    shards = max(1, -(-rows.count() // shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    # names of their own: both sides of the pairing below come from the same rows
    points = rows.select(F.col("id").alias("vec_id"), F.col("x").alias("vec"), F.col("width").alias("vec_width"),
                         F.col("shard").alias("vec_shard"))
    asked = rows.filter("asks").select("id", "x", "width", "shard").dropDuplicates(["id", "width"])
    blocks = max(1, -(-asked.count() // block))
    lowest = float("-inf")

    def search(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        return _searched(points, queries, k)

    own = asked.withColumn("floor", F.lit(lowest)).groupBy("shard", "width").cogroup(
        points.groupBy("vec_shard", "vec_width")).applyInPandas(search, _FOUND)
    own = cut_lineage(own)
    kth = own.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k)
    kth = kth.select(F.col("query_id").alias("id"), F.col("floor").cast("double").alias("floor"))
    asked = asked.join(kth, "id", "left").fillna({"floor": lowest}).withColumn(
        "block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)))
    others = asked.withColumnRenamed("shard", "home").withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).filter("shard <> home")
    copies = points.withColumn("vec_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rest = others.drop("home").groupBy("shard", "block", "width").cogroup(
        copies.groupBy("vec_shard", "vec_block", "vec_width")).applyInPandas(search, _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = own.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

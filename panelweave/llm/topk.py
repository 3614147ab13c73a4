"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to cells around a fixed number of pivots (the roots' children of one tree over the whole
table), and large cells to blocks of bounded size by a hash of the id. A task builds a cover tree over its
block and one over the queries it got, and walks pairs of nodes: a pair with centres p and q and covering
radii P and Q cannot score more than  q.p + |q| P + |p| Q + P Q,  and is dropped when that is below the
worst kth score of the query node. Two rounds: every query first meets one block of its own cell, which
gives the kth scores that then keep most queries away from cells too far off.

Scores are integers; products run in float64 only while they are exact there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import pick
from panelweave.session import durable

K = 10
SCALE = 1024
PIVOTS = 64
BLOCK = 8192  # vectors of a block
QUERIES = 16_384  # queries of a task
LEAF, FAN_OUT = 64, 16


class Node:
    """A cover tree node: its centre, the radius that covers its points, and children or points."""

    __slots__ = ("center", "norm", "radius", "children", "points")

    def __init__(self, center: np.ndarray, radius: float, children: list, points: np.ndarray):
        self.center, self.radius, self.children, self.points = center, radius, children, points
        self.norm = float(np.sqrt(center @ center))


def cover_tree(vectors: np.ndarray, points: np.ndarray) -> Node:
    """Tree over ``vectors[points]``. Children's centres are points chosen far apart: each next one is the
    point farthest from those before, until every point lies within half the node's radius of a centre or
    FAN_OUT is reached."""
    center = vectors[points[0]]
    own = vectors[points]
    nearest = np.sqrt(((own - center) ** 2).sum(axis=1))
    radius = float(nearest.max())
    if len(points) <= LEAF or radius == 0:
        return Node(center, radius, [], points)
    owner = np.zeros(len(points), np.int64)
    count = 1
    while count < FAN_OUT:
        far = int(nearest.argmax())
        if nearest[far] <= radius / 2:
            break
        away = np.sqrt(((own - own[far]) ** 2).sum(axis=1))
        closer = away < nearest
        owner[closer], nearest[closer] = count, away[closer]
        owner[far], nearest[far] = count, 0.0
        count += 1
    children = []
    for i in range(count):
        inside = np.flatnonzero(owner == i)
        if len(inside):
            first = inside[nearest[inside].argmin()]
            children.append(cover_tree(vectors, points[np.concatenate([[first], inside[inside != first]])]))
    return Node(center, radius, children, points)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as int64: by float64 while every partial sum stays below 2**53."""
    most = np.sqrt((a ** 2).sum(axis=1).max(initial=0) * (b ** 2).sum(axis=1).max(initial=0))
    if most < 2.0 ** 52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Search:
    """Best k candidates of each query, from one or more trees."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int):
        self.vectors, self.ids, self.queries, self.query_ids, self.k = vectors, ids, queries, query_ids, k
        self.floor = floor.astype(np.float64)  # kth score known from elsewhere
        self.scores = [np.empty(0, np.int64)] * len(queries)
        self.found = [np.empty(0, np.int64)] * len(queries)

    def base(self, q: np.ndarray, p: np.ndarray) -> None:
        table = products(self.queries[q], self.vectors[p])
        ids = self.ids[p]
        for row in np.flatnonzero(table.max(axis=1) >= self.floor[q]):
            at = q[row]
            fits = (table[row] >= self.floor[at]) & (ids != self.query_ids[at])
            scores = np.concatenate([self.scores[at], table[row][fits]])
            found = np.concatenate([self.found[at], ids[fits]])
            order = np.lexsort((found, -scores))[:self.k]
            self.scores[at], self.found[at] = scores[order], found[order]
            if len(order) == self.k:
                self.floor[at] = max(self.floor[at], scores[order[-1]])

    def walk(self, q: Node, p: Node) -> None:
        bound = q.center @ p.center + q.norm * p.radius + p.norm * q.radius + q.radius * p.radius
        if bound + 1e-6 + 1e-9 * abs(bound) < self.floor[q.points].min():
            return
        if not q.children and not p.children:
            self.base(q.points, p.points)
        elif p.children and (not q.children or p.radius >= q.radius):
            # the most promising child first: it raises the kth scores for the others
            for child in sorted(p.children, key=lambda c: -(q.center @ c.center + q.norm * c.radius)):
                self.walk(q, child)
        else:
            for child in q.children:
                self.walk(child, p)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False) if rows else np.empty(0)
    return flat.reshape(rows, len(flat) // max(1, rows)).astype(np.float64)


def _search(k: int):
    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        vectors, queries = _matrix(block.column("v"), block.num_rows), _matrix(asked.column("v"), asked.num_rows)
        ids = block.column("vec_id").to_numpy()
        out: list[tuple] = []
        if len(vectors) and len(queries):
            # of equal vectors only rows of the k + 1 smallest ids can be among a query's best k (its own id may be
            # one of them), and of one id only k rows; ids are counted, not rows, as rows may repeat
            order = np.lexsort((ids, *vectors.T)) if vectors.shape[1] else np.argsort(ids, kind="stable")
            new, new_id = np.ones(len(order), bool), np.ones(len(order), bool)
            if len(order) > 1:
                new[1:] = (vectors[order[1:]] != vectors[order[:-1]]).any(axis=1)
                new_id[1:] = new[1:] | (ids[order[1:]] != ids[order[:-1]])
            number = np.cumsum(new_id) - 1
            id_nth = number - number[np.flatnonzero(new)][np.cumsum(new) - 1]
            row_nth = np.arange(len(order)) - np.flatnonzero(new_id)[number]
            kept = order[(id_nth <= k) & (row_nth < k)]
            vectors, ids = vectors[kept], ids[kept]
            floor = asked.column("floor").to_numpy().astype(np.float64)
            search = Search(vectors, ids, queries, asked.column("vec_id").to_numpy(), floor, k)
            search.walk(cover_tree(queries, np.arange(len(queries))), cover_tree(vectors, np.arange(len(vectors))))
            out = list(zip(asked.column("query").to_pylist(), asked.column("vec_id").to_pylist(), search.found, search.scores))
        sizes = [len(found) for _, _, found, _ in out]
        return pa.table([pa.array(np.repeat(np.array([o[i] for o in out], np.int64), sizes)) for i in (0, 1)]
                        + [pa.array(np.concatenate([o[i] for o in out] or [np.empty(0, np.int64)]).astype(np.int64)) for i in (2, 3)],
                        names=["query", "query_id", "vec_id", "score"])
    return run


_FOUND = "query long, query_id long, vec_id long, score long"


def top_k(embeddings: DataFrame, queries: DataFrame | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
          block: int = BLOCK, pivots: int = PIVOTS, queries_per_task: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query.

    Components become floor(1024 * x). Ties go to the smaller id. Candidates are all rows but those with the
    query's id. ``queries`` has the same columns; by default it is the rows whose id is divisible by 100.
    Vectors that are null or hold null, NaN or infinite components take no part, nor do rows without id;
    vectors of different lengths are never compared. A query row that occurs twice with one id and vector
    counts once. Fewer than k candidates give fewer rows, none gives none; extra columns are ignored.
    """
    spark = embeddings.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        v = F.transform("x", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
        bad = F.exists("x", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
        rows = pick(df, vec_id=id_col, x=vector_col)
        return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))

    rows = whole(embeddings)
    sample = [(np.array(r.v, np.float64)) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]
    centers: dict[int, np.ndarray] = {}  # by dimension; the origin serves dimensions the sample lacks
    for d in {len(s) for s in sample}:
        centers[d] = np.unique(np.array([s for s in sample if len(s) == d]), axis=0)

    def deal(batches):
        for batch in batches:
            lengths = np.diff(batch.column("v").offsets.to_numpy()) if batch.num_rows else np.empty(0, np.int64)
            flat, ends = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths)
            cell, away = np.zeros(len(lengths), np.int64), np.zeros(len(lengths))
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                own = np.array([flat[ends[i] - d:ends[i]] for i in at]).reshape(len(at), d)
                pivot = centers.get(int(d), np.zeros((1, d)))
                gap = ((own ** 2).sum(axis=1)[:, None] - 2 * own @ pivot.T + (pivot ** 2).sum(axis=1))
                cell[at] = gap.argmin(axis=1) + d * 100_000
                away[at] = np.sqrt(((own - pivot[gap.argmin(axis=1)]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("vec_id", "v")], pa.array(cell), pa.array(away)], names=["vec_id", "v", "cell", "away"])

    form = "vec_id long, v array<bigint>, cell long, away double"
    data = durable(rows.mapInArrow(deal, form))
    asked = whole(queries) if queries is not None else rows.where(F.col("vec_id") % 100 == 0)
    asked = durable(asked.dropDuplicates(["vec_id", "v"]).mapInArrow(deal, form).withColumn("query", F.monotonically_increasing_id()))
    # one row per cell: at most ``pivots`` for each vector length
    cells = {r.cell: r for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}
    blocks = {c: -(-r.n // block) for c, r in cells.items()}
    parts = max(1, -(-asked.count() // queries_per_task))

    def lookup(values: dict, column: str):
        pairs = [x for k_v in values.items() for x in map(F.lit, k_v)]
        return F.create_map(*pairs)[F.col(column)] if pairs else F.lit(None)

    split = F.pmod(F.xxhash64(F.col("vec_id")), lookup(blocks, "cell").cast("long"))
    data = data.select("cell", split.alias("block"), "vec_id", "v")
    part = F.pmod(F.xxhash64(F.col("query")), F.lit(parts)).alias("part")
    keys = ["cell", "block", "part"]

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), _FOUND)

    spread = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    known = asked.where(lookup(blocks, "cell").isNotNull())
    own = known.select("cell", F.pmod(F.xxhash64("query"), lookup(blocks, "cell").cast("long")).alias("block"), part, "query", "vec_id", "v",
                       F.lit(float("-inf")).alias("floor"))
    first = durable(meet(spread, own))
    floors = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    floor = F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(F.lit(float("-inf")))
    waiting = durable(asked.join(floors, "query", "left").withColumn("floor", F.coalesce(floor, F.lit(float("-inf")))))
    groups = {r.cell: r for r in waiting.groupBy("cell").agg(F.max("away").alias("radius"), F.min("floor").alias("floor")).collect()}

    def center(cell: int) -> np.ndarray:
        d, i = divmod(cell, 100_000)
        return centers.get(d, np.zeros((1, d)))[i]

    reach: list[tuple[int, int, int]] = []  # query cell, data cell, blocks
    for c, group in groups.items():
        q = center(c)
        for other, r in cells.items():
            if other // 100_000 == c // 100_000:
                p = center(other)
                bound = q @ p + np.sqrt(q @ q) * r.radius + np.sqrt(p @ p) * group.radius + r.radius * group.radius
                if bound + 1e-6 + 1e-9 * abs(bound) >= group.floor:
                    reach.append((c, other, blocks[other]))
    table = spark.createDataFrame(reach, "cell long, other long, blocks long")
    home = F.pmod(F.xxhash64("query"), lookup(blocks, "cell").cast("long"))
    second = (waiting.join(F.broadcast(table), "cell")  # at most pivots squared rows for each vector length
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .where((F.col("other") != F.col("cell")) | (F.col("block") != F.coalesce(home, F.lit(-1))))
              .select(F.col("other").alias("cell"), "block", part, "query", "vec_id", "v", "floor"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = first.unionByName(meet(spread, second)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")

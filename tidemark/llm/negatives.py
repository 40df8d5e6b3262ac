"""Hard negatives by cover trees over norm-augmented vectors.

Inner products become distances: with M the largest norm of all rows, a row x gains the component
sqrt(M**2 - |x|**2), an anchor q gains 0, and q.x = (M**2 + |q|**2 - d(q, x)**2) / 2. So the
distance to a node's point and the node's covering radius bound the inner products of all rows
below it.

The rows are dealt to cells, the top level of the tree: centres more than a separation apart, from a
bounded sample. A cell is cut into blocks of at most `block_rows` rows by hash, and each block has a
cover tree of its own: the points of a level are more than its scale apart, every row lies within
the scale of its point, scales halve from level to level, and each node keeps its exact radius. A
node whose next level would not group its rows (random vectors of many dimensions) is a leaf.

Anchors travel in blocks to parts of the forest, where each tree is descended best first: a node
is skipped if for each window its bounds lie outside or can't beat what was found, and the rows of a
leaf are verified by exact integer inner products. The anchors of a block descend together. So results equal brute force. The
first descent has one window, open on both sides, for the positives; the second has one window for
each positive.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shipped, written

LEAF = 64
LEAST_GROUP = 8
ANCHOR_BLOCK = 128
TREES_A_PART = 128
SLACK = 1e-9
MOST_SCORE = 2.0**63 - 1024


class CoverTree:
    """A cover tree of rows(n x d, integers as doubles); rows are kept in leaf order."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, norm2: float) -> None:
        self.norm2 = norm2
        self.point: list[int] = []
        self.radius: list[float] = []
        self.kids: list[list[int]] = []
        self.span: list[tuple[int, int]] = []
        self.order: list[int] = []
        rest = np.sqrt(np.maximum(norm2 - (x**2).sum(1), 0))
        self._x = np.column_stack([x, rest])
        everything = np.arange(len(x))
        self._grow(everything, self._away(0, everything))
        order = np.array(self.order)
        self.ids, self.rows, self.labels = ids[order], rows[order], labels[order]
        self.x, self.points = _small(x[order]), _small(x[self.point])
        self.low_id = [int(self.ids[a:b].min()) for a, b in self.span]
        self.only = [int(self.labels[a]) if (self.labels[a:b] == self.labels[a]).all() else None for a, b in self.span]
        del self._x, self.order

    def _away(self, i: int, of: np.ndarray) -> np.ndarray:
        return np.sqrt(((self._x[of] - self._x[i]) ** 2).sum(1))

    def _grow(self, members: np.ndarray, away: np.ndarray) -> int:
        """Add the node whose point is the member at distance 0; away has each member's distance from it."""
        node = len(self.point)
        radius = float(away.max())
        self.point.append(int(members[int(away.argmin())]))
        self.radius.append(radius * (1 + SLACK) + SLACK * math.sqrt(self.norm2))
        self.kids.append([])
        self.span.append((len(self.order), len(self.order) + len(members)))
        if len(members) <= LEAF or radius == 0:
            self.order.extend(members.tolist())
            return node
        # centres of the next level: the farthest row until every row lies within half the scale
        near, own, k = away.copy(), np.zeros(len(members), int), 0
        while near.max() > radius / 2:
            far, k = int(near.argmax()), k + 1
            if k * LEAST_GROUP > len(members):
                # a level that groups no rows bounds nothing
                self.order.extend(members.tolist())
                return node
            d = self._away(int(members[far]), members)
            own[d < near] = k
            near = np.minimum(near, d)
        for c in range(k + 1):
            mine = own == c
            if mine.any():
                self.kids[node].append(self._grow(members[mine], near[mine]))
        return node

    def descend(self, block: "Asked", k: int, same: bool) -> None:
        """Bring what the block's windows found up to date with this tree, best node first for all its anchors together."""
        q = block.x
        middle = (self.norm2 + (q**2).sum(1))[:, None] / 2
        gap = np.sqrt(np.maximum(2 * (middle - q @ self.points.T.astype(float)), 0))
        slack = SLACK * 10 * middle + 1e-6
        radius = np.array(self.radius)
        # norms beyond a double's range bound nothing; scores are whole
        high = np.floor(np.nan_to_num(middle - np.maximum(gap * (1 - SLACK) - radius, 0) ** 2 / 2 + slack, nan=np.inf, posinf=np.inf))
        low = np.nan_to_num(middle - (gap * (1 + SLACK) + radius) ** 2 / 2 - slack, nan=-np.inf, neginf=-np.inf)
        queue = [(-float(high[:, 0].max()), 0)]
        while queue:
            _, node = heapq.heappop(queue)
            asks = block.may_gain(high[:, node], low[:, node], self.low_id[node])
            if self.only[node] is not None:
                asks &= (block.label == self.only[node]) == same
            if not asks.any():
                continue
            if self.kids[node]:
                for kid in self.kids[node]:
                    heapq.heappush(queue, (-float(high[asks, kid].max()), kid))
                continue
            a, b = self.span[node]
            of = np.flatnonzero(asks)
            score = np.clip(q[of] @ self.x[a:b].T.astype(float), -MOST_SCORE, MOST_SCORE)
            fits = ((block.label[of, None] == self.labels[a:b]) == same) & (block.row[of, None] != self.rows[a:b])
            block.take(of, score, fits, self.ids[a:b], self.rows[a:b], k)


class Asked:
    """A block of anchors with their windows and the first rows found for each."""

    def __init__(self, x: np.ndarray, row: np.ndarray, label: np.ndarray, windows: list[list[tuple[float, float]]]) -> None:
        self.x, self.row, self.label = x, row, label
        shape = (len(x), max(map(len, windows)))
        # windows that an anchor lacks are empty
        self.low, self.high = np.full(shape, np.inf), np.full(shape, -np.inf)
        for i, of in enumerate(windows):
            for j, (a, b) in enumerate(of):
                self.low[i, j], self.high[i, j] = a, b
        #: the last of the rows found where they are enough: what comes must be before it
        self.last, self.last_id = np.full(shape, -np.inf), np.full(shape, np.iinfo(np.int64).max)
        self.best: list[list[list[tuple[int, int, int]]]] = [[[] for _ in range(shape[1])] for _ in windows]

    def may_gain(self, high: np.ndarray, low: np.ndarray, low_id: int) -> np.ndarray:
        """Which anchors may have a window to which rows of these bounds, of ids from low_id on, would add."""
        reach = np.minimum(high[:, None], self.high)
        within = (reach >= self.low) & (low[:, None] <= self.high)
        return (within & ((reach > self.last) | ((reach == self.last) & (low_id < self.last_id)))).any(1)

    def take(self, of: np.ndarray, score: np.ndarray, fits: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> None:
        for j in range(self.low.shape[1]):
            last, last_id = self.last[of, j, None], self.last_id[of, j, None]
            adds = fits & (score >= self.low[of, j, None]) & (score <= self.high[of, j, None]) & ((score > last) | ((score == last) & (ids < last_id)))
            for i in np.flatnonzero(adds.any(1)):
                found = np.flatnonzero(adds[i])
                if len(found) > k:
                    own = score[i, found]
                    found = found[own >= np.partition(own, -k)[-k]]
                    found = found[np.lexsort((ids[found], -score[i, found]))[:k]]
                anchor = int(of[i])
                best = self.best[anchor][j] + [(-int(score[i, f]), int(ids[f]), int(rows[f])) for f in found]
                self.best[anchor][j] = best = heapq.nsmallest(k, best)
                if len(best) == k:
                    self.last[anchor, j], self.last_id[anchor, j] = -best[-1][0], best[-1][1]

    def found(self) -> pd.DataFrame:
        rows = [(int(r), j, -s, i, f) for r, of in zip(self.row, self.best) for j, best in enumerate(of) for s, i, f in best]
        return pd.DataFrame(rows, columns=["row", "place", "score", "vec_id", "found"]).astype("int64").astype({"place": "int32"})


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in two or four bytes each where they fit."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def prepared(vectors: DataFrame, classes: int, every: int) -> DataFrame:
    """row, vec_id, label, dims and x of the rows that take part; see hard_negatives."""
    value = F.col("embedding").cast("array<double>")
    sound = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.col("label").cast("long")
    rows = vectors.where(value.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % every == 0, F.pmod(label + 1, F.lit(classes))).otherwise(label).alias("label"),
        F.size(value).alias("dims"),
        # floor() of Spark gives a long, which huge components pass
        F.transform(value, lambda v: F.when(F.abs(v) < 1e15, F.floor(v * 256).cast("double")).otherwise(v * 256)).alias("x"),
    )


def _separated(x: np.ndarray, most: int) -> np.ndarray:
    """At most `most` rows of x, each the farthest from those before it."""
    found = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(found) < most and near.max() > 0:
        found.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[found[-1]]) ** 2).sum(1))
    return x[found]


def forest(rows: DataFrame, *, block_rows: int, sample_rows: int, most_cells: int) -> DataFrame:
    """dims, part, n and tree for each block of rows(row, vec_id, label, dims, x)."""
    spark = rows.sparkSession
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    facts = rows.groupBy("dims").agg(F.max(norm).alias("norm"), F.count("*").alias("n")).collect()  # a row for each vector length
    sample = rows.select("dims", "x").orderBy(F.xxhash64("row"), "row").limit(sample_rows).toPandas()
    norm2, centres = {}, {}
    for f in facts:
        own = sample.loc[sample["dims"] == f["dims"], "x"].to_list()
        norm2[f["dims"]] = f["norm"] ** 2 * (1 + SLACK)
        centres[f["dims"]] = _separated(np.stack(own), max(1, min(most_cells, f["n"] // block_rows))) if own else None
    known = shipped(spark, (norm2, centres))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, tops = known()
        for frame in frames:
            cell = np.zeros(len(frame), np.int32)
            for d in frame["dims"].unique():
                if tops.get(d) is not None and d:
                    mine = (frame["dims"] == d).to_numpy()
                    x = np.stack(frame.loc[mine, "x"].to_list())
                    cell[mine] = (((x**2).sum(1)[:, None] - 2 * x @ tops[d].T) + (tops[d] ** 2).sum(1)).argmin(1)
            yield frame.assign(cell=cell)

    placed = written(rows.mapInPandas(place, "row long, vec_id long, label long, dims int, x array<double>, cell int"))
    # a row for each cell: most_cells for each vector length at most
    sizes = F.broadcast(placed.groupBy("dims", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))
    dealt = placed.join(sizes, ["dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bound, _ = known()
        x = np.stack(frame["x"].to_list()).reshape(len(frame), key[0])
        tree = CoverTree(x, frame["vec_id"].to_numpy(), frame["row"].to_numpy(), frame["label"].to_numpy(), bound[key[0]])
        return pd.DataFrame({"dims": [key[0]], "cell": [key[1]], "block": [key[2]], "n": [len(frame)], "tree": [pickle.dumps(tree.__dict__)]})

    return written(dealt.groupBy("dims", "cell", "block").applyInPandas(build, "dims int, cell int, block int, n long, tree binary"))


def _descended(anchors: DataFrame, trees: DataFrame, parts: int, k: int, same: bool) -> DataFrame:
    """row, window, score, vec_id and found: the first k rows of each window of anchors(row, label, dims, x, windows)
    in each part of the forest, or more of them."""
    dealt = trees.withColumn("part", F.pmod(F.xxhash64("cell", "block"), F.lit(parts)).cast("int")).withColumnRenamed("dims", "tree_dims")
    blocks = (
        anchors.groupBy("dims", F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), F.ceil(F.lit(anchors.count()) / ANCHOR_BLOCK))).alias("group"))
        .agg(F.collect_list(F.struct("row", "label", "x", "windows")).alias("anchors"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    )
    met = blocks.hint("merge").join(dealt.withColumnRenamed("part", "tree_part"), (F.col("part") == F.col("tree_part")) & (F.col("dims") == F.col("tree_dims")))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, block = None, None
        for frame in frames:
            for key, asked, tree in zip(zip(frame["dims"], frame["group"], frame["part"]), frame["anchors"], frame["tree"]):
                if key != seen:
                    if block is not None:
                        yield block.found()
                    seen, block = key, _asked(asked, key[0])
                node = CoverTree.__new__(CoverTree)
                node.__dict__.update(pickle.loads(tree))
                node.descend(block, k, same)
        if block is not None:
            yield block.found()

    return met.select("dims", "group", "part", "anchors", "tree").mapInPandas(search, "row long, place int, score long, vec_id long, found long")


def _asked(anchors, dims: int) -> Asked:
    x = np.stack([np.asarray(a["x"], float) for a in anchors]).reshape(len(anchors), dims)
    windows = [[(w["low"], w["high"]) for w in a["windows"]] for a in anchors]
    return Asked(x, np.array([a["row"] for a in anchors]), np.array([a["label"] for a in anchors]), windows)


def _first(found: DataFrame, k: int) -> DataFrame:
    """found with rank, from 1 to k, in each window; Spark keeps k rows a window before it shuffles."""
    order = Window.partitionBy("row", "place").orderBy(F.col("score").desc(), "vec_id", "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    *,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    relabel_every: int = 7,
    classes: int = 10,
    block_rows: int = 4096,
    sample_rows: int = 20000,
    most_cells: int = 1024,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Rows of vectors(vec_id, embedding, label) with a null vec_id, label or vector, or with a null or
    non-finite component take no part. Labels of rows whose vec_id `relabel_every` divides become
    (label + 1) modulo `classes`; a component x becomes floor(256 * x); a score is the inner product,
    exact below 2**53, rounded like a double beyond and held within a long. Anchors are the rows whose vec_id `every` divides; their positives are the
    first `positives` other rows of their label by score, ties by smaller vec_id; the negatives of a
    positive are the first `negatives` rows of other labels with low * its score <= 100 * score
    <= high * its score. A window without rows gives none; negative scores of a positive leave no
    window. Vectors are compared with those of their own length. Rows that repeat a vec_id are rows
    of their own, told apart by their place. An empty table gives no rows. Extra columns are ignored.

    The cells' centres are fitted on at most sample_rows rows; every row is in a tree. `most_cells`
    bounds the cells, not their rows: a large cell has more blocks.
    """
    spark = vectors.sparkSession
    rows = written(prepared(vectors, classes, relabel_every))
    trees = forest(rows, block_rows=block_rows, sample_rows=sample_rows, most_cells=most_cells)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(trees.count() / TREES_A_PART))
    anchors = rows.where(F.col("vec_id") % every == 0)
    whole = F.array(F.struct(F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high")))
    pairs = written(_first(_descended(anchors.withColumn("windows", whole), trees, parts, positives, True), positives))
    # a window with no score in it is left out
    bounds = pairs.where("score >= 0").select("row", F.col("rank").alias("which"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    spans = bounds.withColumns({"low": _score_bound("positive_score", low, F.ceil), "high": _score_bound("positive_score", high, F.floor)})
    listed = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("which", "low", "high", "positive_id", "positive_score"))).alias("windows"))
    asked = written(anchors.join(listed, "row"))
    found = _first(_descended(asked.select("row", "label", "dims", "x", "windows"), trees, parts, negatives, False), negatives)
    named = asked.select("row", F.col("vec_id").alias("anchor_id"), F.posexplode("windows").alias("place", "w"))
    return found.join(named, ["row", "place"]).select(
        "anchor_id", F.col("w.positive_id").alias("positive_id"), F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("w.positive_score").alias("positive_score"), F.col("score").alias("negative_score")
    )


def _score_bound(score: str, percent: int, rounded) -> Column:
    """The whole score at `percent` of a score, as a double; products of longs stay exact as decimals."""
    return rounded(F.col(score).cast("decimal(20,0)") * F.lit(percent).cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)")).cast("double")


NEGATIVES_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
   AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""

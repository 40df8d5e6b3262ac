"""Embedding near-duplicates by product quantisation.

Unit vectors fall into coarse inverted lists; what remains after the list's centre is coded by one
small codebook for each subspace. A query probes every list that can hold a vector within the link
radius: the plane between two centres and the list's greatest radius both bound that. It scores the
codes of a list by one matrix product with what they stand for, each code with the error it was
stored with, so no link is missed, and reranks by exact cosine in double precision what the scores
let through. Centres and codebooks are fitted on a bounded sample; every vector is indexed and every
vector is a query.

Lists lie one after another over blocks of rows, near lists together. A row goes once to each block
that a list in its reach lies in, and each pair of blocks is compared once, for both of its sides.
There are `BLOCKS` blocks, more only where each would pass `BLOCK` components, so rows are copied at
most BLOCKS times each until then. Links are never written as pairs: a comparison returns one row for
each vector with its number of links, and the links that join its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shipped, written
from .graph import connected_components

BLOCK = 1 << 22
BLOCKS = 8
HOT_SHARE = 1000


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row."""
    squares, out = (centres**2).sum(1), np.zeros(len(x), dtype=np.int64)
    for i in range(0, len(x), 1024):
        out[i : i + 1024] = (squares - 2 * x[i : i + 1024] @ centres.T).argmin(1)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; each is first divided by its largest component, so no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def in_reach(x: np.ndarray, own: np.ndarray, centres: np.ndarray, radius: np.ndarray, least: float, lists: np.ndarray) -> np.ndarray:
    """Rows x lists: whether a list can hold a vector within the link radius of a unit vector; its own always can.

    What lies in another cell is beyond the plane halfway between both centres, so the distance to
    that plane bounds it; so does a list's greatest distance `radius` of a member from its centre.
    """
    out = np.zeros((len(x), len(lists)), dtype=bool)
    link, some = np.sqrt(max(2 - 2 * least, 0)), centres[lists]
    squares = (some**2).sum(1)
    most = np.where(radius[lists] >= 0, (radius[lists] + link + 1e-6) ** 2, -1)
    for i in range(0, len(x), 1024):
        part, z = x[i : i + 1024], own[i : i + 1024]
        home = centres[z]
        own_squares = (home**2).sum(1)
        d = squares - 2 * part @ some.T
        own_d = own_squares - 2 * np.einsum("ij,ij->i", part, home)
        # 1e-12 is more than rounding takes from the squared distance of two centres
        apart = np.sqrt(np.maximum(squares + own_squares[:, None] - 2 * home @ some.T, 0) + 1e-12)
        out[i : i + 1024] = ((d - own_d[:, None] <= 2 * link * apart + 1e-9) & (d + 1 <= most)) | (lists == z[:, None])
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    draw = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[draw.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Quantiser:
    """Coarse centres, and a codebook of residuals for each of m subspaces."""

    def __init__(self, sample: np.ndarray, n_lists: int, m: int, codes: int) -> None:
        width = sample.shape[1]
        self.cuts = np.linspace(0, width, min(m, width) + 1).astype(int)
        self.coarse = k_means(sample, n_lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.books = [k_means(rest[:, a:b], codes) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, rest: np.ndarray) -> np.ndarray:
        return np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)


def _labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least index that each of n nodes reaches by the links left-right."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _whole(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _compare(quantiser: Quantiser, radius: np.ndarray, least: float):
    """Links between the rows of two blocks, or of one block where both are the same."""
    # cosine c of unit vectors is a squared distance of 2 - 2c; a code is off by its row's `error`
    link = np.sqrt(max(2 - 2 * least, 0)) + 1e-9

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "own"], kind="stable")
        x, own, node, copies = _whole(rows["unit"], np.float64), rows["own"].to_numpy(), rows["node"].to_numpy(), rows["copies"].to_numpy()
        step = max(1, BLOCK // x.shape[1])
        n, one = len(rows), rows["i"].iloc[0] == rows["j"].iloc[0]
        asks = int((rows["block"] == rows["i"]).sum())
        start = 0 if one else asks  # of the index rows
        index = rows.iloc[start:]
        decoded = quantiser.coarse[own[start:]] + quantiser.decode(_whole(index["code"], np.uint8))
        squares = (decoded**2).sum(1)
        # least product of a query with a code that a link allows, less what single precision may lose
        floor = ((1 + squares - (link + index["error"].to_numpy()) ** 2) / 2 - (x.shape[1] + 8) * 2.0**-22 * (1 + squares)).astype(np.float32)
        decoded, single = decoded.astype(np.float32), x[:asks].astype(np.float32)
        lists, first = np.unique(own[start:], return_index=True)
        ends = np.append(first[1:], n - start)
        near = in_reach(x[:asks], own[:asks], quantiser.coarse, radius, least, lists)
        links, label, left, right, waiting = np.zeros(n, dtype=np.int64), np.arange(n), [], [], 0
        for k, (begin, end) in enumerate(zip(first, ends)):
            who = np.flatnonzero(near[:, k])
            for u in range(begin, end, 1024):
                v = min(u + 1024, end)
                for i in range(0, len(who), 1024):
                    part = who[i : i + 1024]
                    a, b = np.divmod(np.flatnonzero(single[part] @ decoded[u:v].T >= floor[u:v]), v - u)
                    a, b = part[a], b + (start + u)
                    sure = np.zeros(len(a), dtype=bool)
                    for c in range(0, len(a), step):
                        sure[c : c + step] = np.einsum("ij,ij->i", x[a[c : c + step]], x[b[c : c + step]]) >= least
                    sure &= a != b
                    a, b = a[sure], b[sure]
                    np.add.at(links, a, copies[b])
                    if not one:
                        np.add.at(links, b, copies[a])
                    new = label[a] != label[b]
                    left.append(a[new])
                    right.append(b[new])
                    waiting += int(new.sum())
                    if waiting > 1 << 20:
                        label = _labels(n, np.concatenate([np.arange(n), *left]), np.concatenate([label, *right]))
                        left, right, waiting = [], [], 0
        label = _labels(n, np.concatenate([np.arange(n), *left]), np.concatenate([label, *right]))
        frame = pd.DataFrame({"node": node, "links": links, "root": node[label]})
        return frame[(frame["links"] > 0) | (frame["root"] != frame["node"])]

    return run


def _valid() -> Column:
    value = F.col("embedding")
    sound = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return value.isNotNull() & (F.size(value) > 0) & F.coalesce(sound, F.lit(False)) & F.exists(value, lambda v: v != 0)


def _joined(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """Rows of many with the row of their key in one(key, n, ...), n being the rows that many has of it.

    A key with more than one in HOT_SHARE of the rows is joined by broadcast: there are fewer than
    HOT_SHARE such keys.
    """
    large = F.col("n") * HOT_SHARE > total
    hot = one.where(large)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.where(~large), key)
    return many.join(F.broadcast(hot), key).unionByName(rest)


def near_vectors(
    vectors: DataFrame, *, least: float = 0.95, sample_rows: int = 20000, list_rows: int = 256, most_lists: int = 4096, m: int = 16, codes: int = 64
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding).

    Vectors link when their cosine in double precision is `least` or more; equal vectors are one
    class and link with one another. Components of any finite size are fine. Centres and codebooks
    are fitted on at most `sample_rows` classes, drawn by hash. Null, empty or zero vectors, and those with a null or
    non-finite component, link with nothing; vectors of unlike lengths don't link, each length has an index of its own.
    Every row is a vector of its own: rows that repeat a vec_id get a row each, with the links of
    their own vector, and a repeated id joins no components. A row without an id links like any
    other and counts for its neighbours; its component_id is the least id that it reaches, null
    where it reaches none, and it is kept only then. Extra columns are ignored.
    """
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("valid", _valid()))
    # 0.0 also stands for -0.0
    sound = rows.where("valid").select("vec_id", F.transform("embedding", lambda v: v + F.lit(0.0)).alias("embedding"))
    of_class = sound.groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    # numbered, as ids may be null or repeat; written, so that the numbers stay
    classes = written(of_class.withColumn("node", F.monotonically_increasing_id()))
    found = [_class_links(classes.where(F.size("embedding") == r["n"]), least, sample_rows, list_rows, most_lists, m, codes)
             for r in classes.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect()]
    shape = "node long, links long, root long"
    links = vectors.sparkSession.createDataFrame([], shape)
    for part in found:
        links = links.union(part)
    links = written(links)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(links.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("id", "node")
    judged = classes.join(counts, "node", "left").join(parts, "node", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    judged = written(judged.select("embedding", "least_id", "copies", n_links.alias("n_links"), F.coalesce("component_id", "node").alias("part")))
    sizes = judged.agg(F.count("*").alias("classes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    ids = written(judged.groupBy("part").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")))
    told = written(_joined(judged, ids, "part", sizes["classes"]).select("embedding", "n_links", "component_id", F.col("copies").alias("n")))
    whole = _joined(sound, told, "embedding", sizes["rows"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _class_links(classes: DataFrame, least: float, sample_rows: int, list_rows: int, most_lists: int, m: int, codes: int) -> DataFrame:
    n = classes.count()
    sample = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(sample_rows).toPandas()
    units = unit_rows(np.stack(sample["embedding"].to_list()))
    quantiser = Quantiser(units, max(1, min(most_lists, n // list_rows, len(units) // 4)), m, codes)
    spark = classes.sparkSession
    fitted = shipped(spark, quantiser)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = fitted()
        for frame in frames:
            if len(frame):
                x = unit_rows(np.stack(frame["embedding"].to_list()))
                own = nearest(x, index.coarse)
                rest = x - index.coarse[own]
                code = index.encode(rest)
                error = np.sqrt(((rest - index.decode(code)) ** 2).sum(1))
                away = np.sqrt((rest**2).sum(1))
                yield pd.DataFrame({"node": frame["node"], "copies": frame["copies"], "unit": [u.tobytes() for u in x], "code": [c.tobytes() for c in code], "error": error, "own": own.astype(np.int32), "away": away})

    homes = written(classes.mapInPandas(place, "node long, copies long, unit binary, code binary, error double, own int, away double"))
    radius, size = np.full(len(quantiser.coarse), -np.inf), np.zeros(len(quantiser.coarse), dtype=np.int64)
    for r in homes.groupBy("own").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():  # a row for each list: most_lists at most
        radius[r["own"]], size[r["own"]] = r["r"], r["n"]
    n_blocks = max(1, min(BLOCKS, n // 128), -(-n * units.shape[1] // BLOCK))
    order = np.argsort(nearest(quantiser.coarse, k_means(quantiser.coarse, n_blocks)), kind="stable")
    before = np.zeros(len(size), dtype=np.int64)
    before[order] = np.cumsum(size[order]) - size[order]
    holds = (np.arange(n_blocks) >= (before * n_blocks // n)[:, None]) & (np.arange(n_blocks) <= ((before + size - 1) * n_blocks // n)[:, None])
    reached = shipped(spark, (quantiser.coarse, radius, size, before, (holds & (size > 0)[:, None]).astype(np.float32)))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, bound, rows, start, blocks = reached()
        for whole in frames:
            for i in range(0, len(whole), 1024):
                frame = whole.iloc[i : i + 1024].copy()
                own = frame["own"].to_numpy()
                near = in_reach(_whole(frame["unit"], np.float64), own, centres, bound, least, np.arange(len(centres)))
                # rows of a list are dealt over its stretch of blocks by a hash of their number
                share = (frame["node"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) / 2.0**53
                frame["block"] = ((start[own] + np.minimum(share * rows[own], rows[own] - 1).astype(np.int64)) * n_blocks // n).astype(np.int32)
                frame["others"] = [np.flatnonzero(b).astype(np.int32) for b in near.astype(np.float32) @ blocks > 0]
                yield frame

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return _compare(fitted(), reached()[1], least)(rows)

    shape = "node long, copies long, unit binary, code binary, error double, own int, block int, others array<int>"
    placed = homes.drop("away").mapInPandas(probe, shape).withColumn("other", F.explode("others"))
    pairs = placed.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "unit", "code", "error", "own", "block")
    dealt = pairs.repartition(n_blocks * (n_blocks + 1) // 2, "i", "j")
    return dealt.groupBy("i", "j").applyInPandas(compare, "node long, links long, root long")

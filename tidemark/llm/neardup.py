"""MinHash near-duplicates: circulant signatures, banded buckets, exact Jaccard on full sets.

The method. Two permutations of a universe of 2**20 positions make a whole signature: the first
places each shingle, the second is read at that place and its next `n_perm - 1` neighbours, i.e.
coordinate k is the minimum of the second permutation circularly shifted by k. Signatures are cut
into bands; documents with an equal band share a bucket.

Large groups. Texts with the same set are one class from the start. A bucket links its members to
its least class only, so a bucket of n classes makes n - 1 candidate pairs; those whose sketches, a
byte of each coordinate, agree within six standard deviations are confirmed on the full sets. In buckets whose members still lie in several components afterwards, the rows
outside the main component are compared with all rows of the bucket, block by block and without
making pairs: first by sketches, which tell the documents that may have a partner in another
component, whether or not they are like a lead; then these through an inverted index of full sets.
So every pair that shares a bucket is settled: confirmed, refuted on sketches or sets, or with
both ends in one component already.

At a similarity of 0.8 with 32 bands of 6 rows, a pair shares no bucket with probability 6e-5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, Words, mix, shingle_sets, slices, text_buffers, written
from .graph import connected_components

UNIVERSE = 1 << 20
ROWS_AT_ONCE = 1 << 15
BLOCK_BYTES = 1 << 19
PACK_BYTES = 1 << 21


class Circulant:
    """Signatures from two seeded permutations."""

    def __init__(self, n_perm: int, seed: int = 20) -> None:
        draw = np.random.default_rng(seed)
        self.place = draw.permutation(UNIVERSE).astype(np.uint32)
        ring = draw.permutation(UNIVERSE).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[: n_perm - 1]]), n_perm)
        self.n_perm = n_perm

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.place[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
        least = np.full(self.n_perm, np.iinfo(np.uint32).max, dtype=np.uint32)
        for i in range(0, len(at), ROWS_AT_ONCE):
            np.minimum(least, self.shifted[at[i : i + ROWS_AT_ONCE]].min(axis=0), out=least)
        return least


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; bands don't share keys."""
    n, width = signatures.shape
    bands = signatures.reshape(n, width // rows, rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, width // rows + 1, dtype=np.uint64)), bands.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    return key.view(np.int64)


def _each_set(batch: pa.RecordBatch, width: int, hasher: Hasher) -> Iterator[np.ndarray]:
    raw, offsets = text_buffers(batch.column(1))
    for i, j in slices(offsets):
        yield from shingle_sets(Words(hasher, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), width)


def _signed(width: int, n_perm: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, circulant = Hasher(), Circulant(n_perm)
        for batch in batches:
            sizes, prints, signatures, sketches = [], [], [], []
            for shingles in _each_set(batch, width, hasher):
                sizes.append(len(shingles))
                prints.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                signatures.append(circulant.signature(shingles))
                sketches.append((signatures[-1] & 0xFF).astype(np.uint8).tobytes())
            keys = band_keys(np.array(signatures, dtype=np.uint32).reshape(len(sizes), n_perm), rows)
            lists = pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * keys.shape[1], pa.array(keys.ravel()))
            columns = [batch.column(0), *batch.columns[2:], pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), lists, pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *batch.schema.names[2:], "n_shingles", "print", "bands", "sketch"])

    return run


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            sets = [x.tobytes() for x in _each_set(batch, width, hasher)]
            # a text of the same doc_id and hash may still be another one
            own = pa.array([hashlib.blake2b(x, digest_size=16).digest() == p for x, p in zip(sets, batch.column(2).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "members"]).filter(own)

    return run


def _likely(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            kept = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["u", "v"])

    return run


def _least_agreement(n_perm: int, percent: int) -> int:
    """As often the sketches of similar sets agree, but for six deviations."""
    p = percent / 100
    return math.floor(n_perm * p - 6 * math.sqrt(n_perm * p * (1 - p)))


def _likely_pairs(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """Pairs whose sketches agree in `least` coordinates or more."""
    left, right = (sketches.select(F.col("rep").alias(c), F.col("sketch").alias(c + "_sketch")) for c in "uv")
    return pairs.join(right, "v").join(left, "u").select("u", "v", "u_sketch", "v_sketch").mapInArrow(_likely(least), "u long, v long")


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            linked = []
            for x, y in zip(a, b, strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                # disjoint sizes can't reach the threshold
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    linked.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            kept = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["u", "v"])

    return run


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The integers of all ranges low[i]:high[i], one after another."""
    n = high - low
    return np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())


def _across(index: pd.DataFrame, queries: pd.DataFrame, percent: int) -> tuple[list[int], list[int]]:
    """Links from queries to index rows of other parts, one for each part, by an inverted index."""
    sets = [np.frombuffer(x, np.uint64) for x in index["members"]]
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
    ids, parts = index["rep"].to_numpy(), index["part"].to_numpy()
    u, v = [], []
    for rep, part, members in zip(queries["rep"], queries["part"], queries["members"], strict=True):
        own = np.frombuffer(members, np.uint64)
        hits = owner[_ranges(np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right"))]
        both = np.bincount(hits, minlength=len(sets))
        at = np.flatnonzero((100 * both >= percent * (sizes + len(own) - both)) & (parts != part))
        _, first = np.unique(parts[at], return_index=True)  # one link joins a whole part
        u += [rep] * len(first)
        v += ids[at[first]].tolist()
    return u, v


def _alike(index: pd.DataFrame, queries: pd.DataFrame, least: int) -> tuple[list[int], list[int]]:
    """Rows whose sketch agrees with one across parts, each with one such partner: never all pairs."""
    x, q = (np.frombuffer(b"".join(rows["members"]), np.uint8).reshape(len(rows), -1) for rows in (index, queries))
    ids, parts, own, own_parts = index["rep"].to_numpy(), index["part"].to_numpy(), queries["rep"].to_numpy(), queries["part"].to_numpy()
    kind = np.uint8 if x.shape[1] < 256 else np.int32
    met, partner, turned = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=np.int64), np.ascontiguousarray(x.T)
    u, v = [], []
    step = max(1, (1 << 20) // len(x))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        if len(part) * len(x) < 2048:
            same = (part[:, None] == x[None]).sum(axis=2, dtype=kind)
        else:
            same = np.zeros((len(part), len(x)), dtype=kind)
            for k in range(x.shape[1]):
                same += part[:, k, None] == turned[k]
        near = (same >= least) & (own_parts[i : i + step, None] != parts)
        some, of = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        u += own[i + some].tolist()
        v += ids[near[some].argmax(axis=1)].tolist()
        met[of], partner[of] = True, own[i + near[:, of].argmax(axis=0)]
    return u + partner[met].tolist(), v + ids[met].tolist()


def _settle(compare, bound: int):
    """What `compare` finds within each pair of blocks (at, i, q) of a pack."""

    def run(pack: pd.DataFrame) -> pd.DataFrame:
        pack = pack.sort_values(["at", "i", "q", "asks"], kind="stable")
        keys = pack[["at", "i", "q"]].to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(pack)]
        asks, u, v = pack["asks"].to_numpy(), [], []
        for a, b in zip(cuts, cuts[1:]):
            middle = a + int(np.count_nonzero(~asks[a:b]))
            if a < middle < b:
                more = compare(pack.iloc[a:middle], pack.iloc[middle:b], bound)
                u += more[0]
                v += more[1]
        return pd.DataFrame({"u": np.array(u, dtype=np.int64), "v": np.array(v, dtype=np.int64)})

    return run


def _sets_of(texts: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """id and members of the classes that occur in pairs(u, v): the set of the text that stands for each."""
    ids = pairs.select(F.col("u").alias("rep")).union(pairs.select(F.col("v").alias("rep"))).distinct()
    # ids grow with the corpus: both sides are shuffled, whatever the size
    asked = classes.join(ids.hint("merge"), "rep", "left_semi").select("rep", "print", F.col("doc_id").alias("of"), F.col("h").alias("of_h"))
    found = texts.join(asked.hint("merge"), (F.col("h") == F.col("of_h")) & F.col("doc_id").eqNullSafe(F.col("of")))
    sets = found.select("rep", "text", "print").mapInArrow(_set_rows(width), "id long, members binary")
    return written(sets.dropDuplicates(["id"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("id").alias("u"), F.col("members").alias("left"))
    right = sets.select(F.col("id").alias("v"), F.col("members").alias("right"))
    joined = pairs.join(right, "v").join(left, "u").select("u", "v", "left", "right")
    return joined.mapInArrow(_confirm(percent), "u long, v long")


def _block_links(index: DataFrame, queries: DataFrame, sets: DataFrame, compare, bound: int) -> DataFrame:
    """Links across parts between index and queries, both (at, rep, part), with an equal `at`.

    `sets` has (id, members): what `compare` takes with its bound, full sets or sketches.

    Both sides are dealt out in blocks of about BLOCK_BYTES; pairs of blocks are packed into
    groups of about PACK_BYTES, so neither a large group nor long texts meet in one task.
    """
    members = sets.withColumnRenamed("id", "rep")
    size = F.greatest(F.lit(1), F.ceil(F.sum(F.length("members")) / BLOCK_BYTES)).cast("int")
    index, queries = (written(x.select("at", "rep", "part").join(members, "rep")) for x in (index, queries))
    total = F.sum(F.length("members"))
    blocks = index.groupBy("at").agg(size.alias("n_index"), total.alias("b")).join(queries.groupBy("at").agg(size.alias("n_queries"), total.alias("c")), "at")
    moved = blocks.agg(F.sum(F.expr("b * n_queries + c * n_index"))).first()[0] or 0

    def dealt(rows: DataFrame, own: str, own_n: str, other: str, other_n: str, asks: bool) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))
        placed = rows.join(blocks, "at").withColumns({own: F.pmod(F.xxhash64("rep"), F.col(own_n)).cast("int"), other: every, "asks": F.lit(asks)})
        return placed.select("at", "i", "q", "asks", "rep", "part", "members")

    both = dealt(index, "i", "n_index", "q", "n_queries", False).union(dealt(queries, "q", "n_queries", "i", "n_index", True))
    pack = F.pmod(F.xxhash64("at", "i", "q"), F.lit(max(8, moved // PACK_BYTES)))
    return both.groupBy(pack.alias("pack")).applyInPandas(_settle(compare, bound), "u long, v long")


def _between_parts(placed: DataFrame, sets: DataFrame, compare, bound: int) -> DataFrame:
    """Links across the parts of each bucket of placed(key, rep, part), compared as in _block_links.

    A row outside its bucket's main part is compared once with the whole main part, however many
    buckets they share; such rows are compared with one another in each bucket with several parts
    of them. In a bucket of two, the lead has been compared with the other one.
    """
    by_part = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    main = by_part.groupBy("key").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.count("*").alias("parts"), F.sum("n").alias("rows")).where("parts > 1 and rows > 2")
    strays = written(placed.join(main.select("key", "main"), "key").where("part <> main"))
    asked = strays.select(F.col("main").alias("at"), "rep", "part").distinct()
    whole = placed.select(F.col("part").alias("at"), "rep", "part").distinct().join(asked.select("at").distinct(), "at", "left_semi")
    to_main = _block_links(whole, asked, sets, compare, bound)
    mixed = strays.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    open_rows = strays.join(mixed.select("key", "low"), "key").select(F.col("key").alias("at"), "rep", "part", "low")
    return to_main.union(_block_links(open_rows, open_rows.where("part <> low"), sets, compare, bound))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, n_perm: int = 192, rows: int = 6, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text).

    Documents link when 100 * |A & B| >= percent * |A | B| over their sets of `width`-word
    shingles (lower-cased A-Z); a text of fewer words is one shingle; a null, empty or blank text
    has none and links with nothing. component_id is the least doc_id that links reach, itself
    included; kept marks that document. Extra columns are ignored; an empty table gives an empty one.

    Rows that repeat a doc_id are one document: what links to one of its texts is linked to all of
    them, and each row has its own n_shingles. A null doc_id says nothing of identity: such rows link
    by their texts, take the least doc_id of their component, which is null where it has none, and are
    kept only where it is null.

    With `carry`, these columns of docs come too, each row is judged by its text alone, whatever its
    doc_id, and `group` tells the component of a row: null for texts without shingles.
    """
    apart = bool(carry)
    text = F.col("text").cast("string")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), *carry)
    texts = given.select("doc_id", "text", "h")
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*carry).schema) if carry else ""
    signed = given.mapInArrow(_signed(width, n_perm, rows), f"doc_id long, h long{kinds}, n_shingles long, print binary, bands array<long>, sketch binary")
    signed = written(signed.withColumn("row", F.monotonically_increasing_id()))
    # a class has the row of its least doc_id as its number; it stays that row, as signed is written
    lead = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "row")).alias("lead")
    # written, so that both sides of the join below are plain shuffles and a large class can be split
    classes = written(signed.where("print is not null").groupBy("print").agg(lead).select("print", "lead.doc_id", "lead.h", F.col("lead.row").alias("rep")))
    members = written(
        signed.where("print is not null")
        .join(classes.select("print", "rep"), "print")
        .select("doc_id", "n_shingles", "rep", *carry, *(F.when(F.col("row") == F.col("rep"), F.col(c)).alias(c) for c in ("bands", "sketch")))
    )
    banded = members.where("bands is not null").select("rep", F.explode("bands").alias("key"))
    leads = banded.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("key", "lead")
    crowd = written(banded.join(leads, "key"))

    met = crowd.where("rep <> lead").select(F.col("rep").alias("u"), F.col("lead").alias("v")).distinct()
    sketches = members.where("sketch is not null").select("rep", "sketch")  # one for each class
    least = _least_agreement(n_perm, percent)
    pairs = written(_likely_pairs(met, sketches, least))
    sets = _sets_of(texts, classes, pairs, width)
    links = written(_confirmed(pairs, sets, percent))
    parts = written(connected_components(links))

    placed = written(crowd.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component_id", "rep").alias("part")))
    # documents unlike their leads too: whatever the sketches say may link across parts gets its full set
    alike = written(_between_parts(placed, sketches.select(F.col("rep").alias("id"), F.col("sketch").alias("members")), _alike, least))
    more = None
    if alike.head(1):
        more = written(_between_parts(placed, _sets_of(texts, classes, alike, width), _across, percent))
    # classes of one doc_id are one document
    same = None if apart else written(_same_documents(members))
    every = [links, *(x for x in (more, same) if x is not None and x.head(1))]
    if len(every) > 1:
        joined = every[0].select("u", "v")
        for x in every[1:]:
            joined = joined.union(x.select("u", "v"))
        parts = written(connected_components(joined))

    # the least doc_id of each component of several classes
    of_part = parts.withColumnRenamed("id", "rep").join(classes.select("rep", "doc_id"), "rep")
    names = of_part.groupBy("component_id").agg(F.min("doc_id").alias("name"))
    named = written(of_part.select("rep", "component_id").join(names, "component_id").select("rep", F.col("component_id").alias("part"), "name"))
    whole = members.select("doc_id", "n_shingles", "rep", *carry).join(named, "rep", "left").join(classes.select("rep", F.col("doc_id").alias("own")), "rep")
    found = whole.select("doc_id", "n_shingles", F.when(F.col("part").isNull(), F.col("own")).otherwise(F.col("name")).alias("component_id"), F.coalesce("part", "rep").alias("group"), *carry)
    alone = signed.where("print is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"), *carry)
    out = found.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out if apart else out.drop("group")


def _same_documents(members: DataFrame) -> DataFrame:
    """Links between the classes of each doc_id that has several: its least class with each other one."""
    of = members.where("doc_id is not null").groupBy("doc_id", "rep").agg(F.lit(1).alias("one"))
    first = of.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v < last").select("doc_id", "v")
    return of.join(first, "doc_id").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()

"""Near duplicates of embeddings by counting collisions on projections.

Unit vectors are projected onto many random directions and, in blocks, sorted on each. Two vectors
collide on a direction if one lies in the window around the other; collisions are counted per
pair, and pairs with enough are verified by their cosine. Width and count are calibrated for pairs
just at the limit: their difference on a direction is near normal with deviation ``distance / sqrt(dimensions)``.

The first ``ROUTES`` directions also deal the vectors out: each is cut into slices as wide as a
generous window, and a vector goes to its own slice and the next, so a pair meets exactly in the
cell of its larger slices. Large cells are cut into blocks of rows and pairs of blocks."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.common import components, settle

DIRECTIONS = 32
ROUTES = 3
#: Half window for counting, in deviations of a pair just at the limit.
WINDOW = 1.5
#: Shares of pairs just at the limit that the count and that all routes together may miss.
MISSED = 0.0005
ROUTES_MISSED = MISSED / 5
#: Half window for routing, which all ``ROUTES`` differences of a pair must fit (about 4.15).
ROUTE_WINDOW = NormalDist().inv_cdf(1 - ROUTES_MISSED / (2 * ROUTES))
BLOCK_ROWS = 1024
#: Rows of a block whose collisions with another block are counted at once.
SLICE_ROWS = 256
ROUTED = "cell long, side int, id long, copies long, vector binary"


def directions(dim: int, seed: int = 5) -> np.ndarray:
    drawn = np.random.default_rng([seed, dim]).standard_normal((dim, DIRECTIONS))
    return drawn / np.linalg.norm(drawn, axis=0)


def deviation(cosine: float, dim: int) -> float:
    return math.sqrt((2 - 2 * cosine) / dim)


def collisions_needed() -> int:
    """Largest count that pairs at the limit miss with probability ``MISSED`` at most."""
    p, below = math.erf(WINDOW / math.sqrt(2)), 0.0
    for k in range(DIRECTIONS + 1):
        below += math.comb(DIRECTIONS, k) * p ** k * (1 - p) ** (DIRECTIONS - k)
        if below > MISSED:
            return k
    return DIRECTIONS


def _units(batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors in double precision, by length of the vector."""
    lists = batch.column(2)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        rows = flat[starts[at][:, None] + np.arange(dim)]
        rows = rows / np.abs(rows).max(axis=1, keepdims=True)
        out.append((at, rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))))
    return out


def _routed(cosine: float):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            labels, copies = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for at, units in _units(batch):
                dim = units.shape[1]
                width = max(ROUTE_WINDOW * deviation(cosine, dim), 1e-9)
                slices = np.floor(units @ directions(dim)[:, :ROUTES] / width).astype(np.int64)
                rows = []
                for k, unit, home in zip(at.tolist(), units, slices):
                    data = unit.tobytes()
                    for side in range(1 << ROUTES):
                        cell = home + [(side >> j) & 1 for j in range(ROUTES)]
                        mark = repr((labels[k], dim)).encode() + cell.tobytes()
                        rows.append((xxhash.xxh3_64_intdigest(mark) - (1 << 63), side,
                                     int(ids[k]), int(copies[k]), data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (
                        pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    ["cell", "side", "id", "copies", "vector"])
    return run


def colliding(x: np.ndarray, y: np.ndarray, window: float, needed: int):
    """Pairs of rows of the projections ``x`` and ``y`` with enough collisions. Every direction of
    ``y`` is sorted; the rows that collide with a row of ``x`` on it are a range around that row's
    place, and each range adds one to the counts of its pairs. A slice of ``x`` ends early when none
    of its pairs can reach the count any more."""
    orders = np.argsort(y, axis=0, kind="stable")
    lines = np.take_along_axis(y, orders, axis=0)
    for start in range(0, len(x), SLICE_ROWS):
        part = x[start:start + SLICE_ROWS]
        count = np.zeros((len(part), len(y)), np.int8)
        for j in range(x.shape[1]):
            lo = np.searchsorted(lines[:, j], part[:, j] - window, "left")
            sizes = np.searchsorted(lines[:, j], part[:, j] + window, "right") - lo
            ends = np.cumsum(sizes)
            # a row meets another at most once on a direction, so no place is counted twice
            count[np.repeat(np.arange(len(part)), sizes), orders[
                np.repeat(lo - ends + sizes, sizes) + np.arange(ends[-1]), j]] += 1
            if count.max(initial=0) + x.shape[1] - 1 - j < needed:
                break
        a, b = np.nonzero(count >= needed)
        yield a + start, b


def _rooted(one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """Smallest place reachable from each of ``n`` places by links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[one], root[two])
        np.minimum.at(root, one, least)
        np.minimum.at(root, two, least)
        root = root[root]
        if (root == before).all():
            return root


def _met(cosine: float):
    """Of a block or a pair of blocks: for each vector that has links there how many vectors these
    are, copies counted, and one link to a vector that it reaches there. That is a row for each
    vector and not for each link, however large a group of near copies is."""
    needed = collisions_needed()

    def run(table: pa.Table) -> pa.Table:
        ids, sides, copies = (table.column(n).to_numpy() for n in ("id", "side", "copies"))
        data = table.column("vector").to_pylist()
        block, (i, j) = table.column("block").to_numpy(), (
            table.column(n)[0].as_py() for n in ("i", "j"))
        found: list[list] = [[], []]
        sizes = np.array([len(d) for d in data])
        for size in np.unique(sizes):  # cells of one hash may hold different lengths
            one = np.flatnonzero((sizes == size) & (block == i))
            two = np.flatnonzero((sizes == size) & (block == j))
            if not len(one) or not len(two):
                continue
            units = [np.frombuffer(b"".join(data[k] for k in rows)).reshape(len(rows), -1)
                     for rows in (one, two)]
            dim = units[0].shape[1]
            onto, window = directions(dim), WINDOW * deviation(cosine, dim)
            # a hair more than the window for rounding
            for a, b in colliding(*(u @ onto for u in units), window * (1 + 1e-9) + 1e-9, needed):
                # a pair belongs to the cell of its larger slices
                fit = (ids[one[a]] != ids[two[b]]) & (sides[one[a]] & sides[two[b]] == 0)
                if i == j:
                    fit &= ids[one[a]] < ids[two[b]]
                a, b = a[fit], b[fit]
                near = np.einsum("ij,ij->i", units[0][a], units[1][b]) >= cosine
                found[0].append(one[a[near]])
                found[1].append(two[b[near]])
        # places among the vectors of the cell
        known, place = np.unique(ids, return_inverse=True)
        x, y = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
        others = np.bincount(place[x], copies[y], len(known)) + np.bincount(
            place[y], copies[x], len(known))
        linked = np.flatnonzero(others)
        root = _rooted(place[x], place[y], len(known))
        return pa.table({"id": pa.array(known[linked], pa.int64()),
                         "others": pa.array(others[linked].astype(np.int64)),
                         "root": pa.array(known[root[linked]], pa.int64())})
    return run


def linked(vectors: DataFrame, cosine: float) -> DataFrame:
    """From rows ``_g``, ``_label``, ``_vector`` (sound, not zero) and ``_copies``: settled rows
    ``id``, ``others`` (linked vectors met in one cell, to be summed) and ``root`` (one that it
    reaches). A pair is met in one cell and one pair of blocks only."""
    routed = settle(vectors.select("_g", "_label", "_vector", "_copies").mapInArrow(
        _routed(cosine), ROUTED))
    blocks = settle(routed.groupBy("cell").agg(
        F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks"),
        F.count("*").alias("_rows")).where("_rows > 1").drop("_rows"))
    own = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = routed.join(blocks, "cell").withColumn("block", own).withColumn(
        "_other", other).withColumn("i", F.least("block", "_other")).withColumn(
        "j", F.greatest("block", "_other")).drop("_blocks", "_other")
    return settle(dealt.groupBy("cell", "i", "j").applyInArrow(
        _met(cosine), "id long, others long, root long"))


def dedup(vectors: DataFrame, key: str = "vec_id", value: str = "embedding",
          label: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per vector: ``key``, ``n_links`` (other vectors linked directly), ``component_id``
    (smallest key reachable) and ``kept`` (whether the key is that one).

    Vectors link when their labels are equal and not null, their lengths are equal and the cosine
    in double precision is at least ``cosine``. A vector that is null, empty, zero or holds null
    or non-finite components, or has no label, links with nothing. Equal vectors, repeated rows
    too, are compared once and count as links of each other. A null key takes part; the smallest
    key that is not null names the component. No rows give an empty result; other columns are
    ignored, whatever their names. Cells are told apart by 64-bit hashes. Of the pairs just at the
    limit at most about six in ten thousand are missed, of closer pairs next to none."""
    x = F.col("_vector")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)
                     & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    takes = F.coalesce(F.col("_label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & sound,
                       F.lit(False))
    rows = settle(vectors.select(
        F.col(key).cast("bigint").alias("_id"), F.col(label).alias("_label"),
        F.col(value).alias("_vector")).withColumn("_in", takes).withColumn(
        "_hash", F.xxhash64("_vector")))
    same = ["_label", "_hash", "_vector"]
    groups = settle(rows.where("_in").groupBy(*same).agg(F.count("*").alias("_copies")).withColumn(
        "_g", F.monotonically_increasing_id()))
    found = linked(groups, cosine)
    others = found.groupBy(F.col("id").alias("_g")).agg(F.sum("others").alias("_others"))
    reached = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = settle(groups.join(others, "_g", "left").join(
        reached.withColumnRenamed("id", "_g"), "_g", "left").select(
        *same, F.coalesce("root", "_g").alias("_root"),
        (F.coalesce("_others", F.lit(0)) + F.col("_copies") - 1).alias("_links")))
    met = settle(rows.where("_in").join(named, same).select("_id", "_root", "_links"))
    least = settle(met.groupBy("_root").agg(F.min("_id").alias("_least")))
    alone = rows.where("not _in").select("_id", F.lit(0).cast("bigint").alias("_links"),
                                         F.col("_id").alias("_least"))
    every = met.join(least, "_root").select("_id", "_links", "_least").unionByName(alone)
    return every.select(F.col("_id").alias(key), F.col("_links").alias("n_links"),
                        F.col("_least").alias("component_id"),
                        F.col("_id").eqNullSafe(F.col("_least")).alias("kept"))

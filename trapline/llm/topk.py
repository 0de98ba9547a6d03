"""Exact top-k search by integer inner product.

Vectors are packed into shards and queries into blocks, one row each. A few shards and a few blocks
meet in a cell, by one join whatever their number; a task multiplies block by shard, keeps the k
best of every query in that tile, and the short lists are merged in a tree: lists of a cell meet
first, then lists of a few cells, then lists of lists, until one is left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm.common import settle

#: Rows of a shard and of a block of queries; they bound the matrices of a task.
SHARD_ROWS = 4096
BLOCK_ROWS = 1024
#: About how many shards and blocks of queries meet in a cell.
CELL_SHARDS = 8
CELL_BLOCKS = 16
#: Lists that one step of the tree merges.
FAN = 16
SCALE = 256
LONGEST = 2 ** 63 - 1

LISTS = "query_id long, vec_id long, score long, _tile long"
LIST_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()),
                         ("_tile", pa.int64())])
PACKED = "_dim int, _ids binary, _values binary"


def integers(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """``_id`` and ``_v``, the floors of ``SCALE`` times every component. Vectors that are null,
    empty or hold null or non-finite components are left out."""
    x = F.col(value)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)
                     & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & sound & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("_id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("double")).alias("_v"))


def _pack(rows: int):
    """Rows of a partition packed by length of the vector, at most ``rows`` to a pack."""
    def pack(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            lists = batch.column("_v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            for dim in np.unique(sizes):
                chosen = np.flatnonzero(sizes == dim)
                matrix = flat[starts[chosen][:, None] + np.arange(dim)]
                held.setdefault(int(dim), []).append((ids[chosen], matrix))
            for dim, parts in list(held.items()):
                if sum(len(i) for i, _ in parts) >= rows:
                    yield from out(dim, held.pop(dim))
        for dim, parts in held.items():
            yield from out(dim, parts)

    def out(dim, parts):
        ids = np.concatenate([i for i, _ in parts])
        matrix = np.concatenate([m for _, m in parts])
        for k in range(0, len(ids), rows):
            yield pa.RecordBatch.from_pydict({
                "_dim": pa.array([dim], pa.int32()),
                "_ids": pa.array([ids[k:k + rows].tobytes()], pa.binary()),
                "_values": pa.array([matrix[k:k + rows].tobytes()], pa.binary())})
    return pack


def _products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; float64 is exact below 2^53, Python's integers serve
    larger components, cut to the range of a long."""
    bound = max(np.abs(queries).max(), 1) * max(np.abs(shard).max(), 1) * queries.shape[1]
    if bound < 2 ** 53:
        return (queries @ shard.T).astype(np.int64)
    whole = [np.vectorize(int, otypes=[object])(m) for m in (queries, shard)]
    exact = whole[0] @ whole[1].T
    return np.clip(exact, -LONGEST, LONGEST).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id; a partial selection comes first."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        chosen = np.flatnonzero(scores >= bar)
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))][:k]


def _cell(k: int):
    """The k best candidates of every query among the shards of a cell, tile by tile."""
    def unpacked(table: pa.Table):
        for dim, ids, values in zip(*(table.column(c).to_pylist()
                                      for c in ("_dim", "_ids", "_values"))):
            yield dim, np.frombuffer(ids, np.int64), np.frombuffer(values).reshape(-1, dim)

    def search(shards: pa.Table, blocks: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        for dim, wanted, queries in unpacked(blocks):
            lists = [[] for _ in wanted]
            for width, ids, shard in unpacked(shards):
                if width != dim:
                    continue
                scores = _products(queries, shard)
                for i, q in enumerate(wanted):
                    own = np.flatnonzero(ids != q)
                    top = own[best(scores[i][own], ids[own], k)]
                    lists[i].append((ids[top], scores[i][top]))
            for q, parts in zip(wanted, lists):
                if parts:
                    ids, values = map(np.concatenate, zip(*parts))
                    top = best(values, ids, k)
                    for column, part in zip(found, (np.full(len(top), q), ids[top], values[top])):
                        column.append(part)
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in found]
        tile = shards.column("_i")[0].as_py() if len(shards) else 0
        return pa.table([*map(pa.array, columns), pa.array(np.full(len(columns[0]), tile))],
                        schema=LIST_SCHEMA)
    return search


def merged(lists: DataFrame, k: int, shards: int) -> DataFrame:
    """Tree of merges: each step keeps the k best of ``FAN`` tiles."""
    best_first = [F.desc("score"), F.asc("vec_id")]
    while True:
        shards = -(-shards // FAN)
        lists = lists.withColumn("_tile", F.floor(F.col("_tile") / FAN))
        rank = F.row_number().over(Window.partitionBy("query_id", "_tile").orderBy(*best_first))
        lists = lists.withColumn("rank", rank).where(F.col("rank") <= k)
        if shards <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id",
           value: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the k best vectors for every row
    that meets the condition ``is_query``; a query is no candidate of its own.

    Ties go to the smaller id; fewer candidates than k are all returned; a lone query has no
    rows. Vectors that are null, empty, or hold null or non-finite components and null ids take
    no part; vectors of different lengths do not meet. Rows that repeat an id: candidates of the
    query's own id are left out, other repeats are candidates each, and a repeated query is asked
    once, with its first vector in the order of components. No rows give an empty result."""
    sound = integers(vectors, key, value)
    asked = integers(vectors.where(is_query), key, value).groupBy("_id").agg(
        F.min("_v").alias("_v"))
    shards, across = _grouped(sound, SHARD_ROWS, CELL_SHARDS, "_i")
    blocks, down = _grouped(asked, BLOCK_ROWS, CELL_BLOCKS, "_j")

    def every(name: str, cells: int):
        return F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias(name)

    # a group of shards goes to each group of blocks, and the reverse
    left = shards.select("*", every("_j", down)).groupBy("_i", "_j")
    right = blocks.select("*", every("_i", across)).groupBy("_i", "_j")
    lists = left.cogroup(right).applyInArrow(_cell(k), LISTS)
    return merged(lists, k, across)


def _grouped(vectors: DataFrame, rows: int, packs: int, name: str) -> tuple[DataFrame, int]:
    """Packs of ``rows`` vectors, settled and dealt into groups of about ``packs``, and the number
    of groups."""
    packed = settle(vectors.mapInArrow(_pack(rows), PACKED).withColumn(
        "_pack", F.monotonically_increasing_id()))
    groups = max(1, -(-packed.count() // packs))
    return packed.withColumn(name, F.pmod(F.xxhash64("_pack"), F.lit(groups)).cast("int")).drop(
        "_pack"), groups

"""Byte-level BPE in padded numpy matrices.

The pieces of a batch are cut into pre-tokens; distinct pre-tokens are grouped by length into
padded matrices of token ids. In each round every row merges its leftmost pair of minimum rank;
pair ranks come from a hashed table, rows are compacted, and finished rows leave. A round costs the
width of the matrix, so a pre-token of more than ``LONG_ROW`` bytes would cost the square of its
length; it is merged by itself in the same order, from a heap of its pairs."""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.pieces import Memo, bounded, gathered

NONE = np.iinfo(np.int32).max
#: Cells of a matrix; a matrix is at most twice as wide as its shortest row.
MATRIX_CELLS = 1 << 18
#: Bytes of the longest pre-token that goes into a matrix.
LONG_ROW = 1024
#: Texts decoded together.
FEW = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Table:
    """Ranks by pair of ids in an open-addressed hash table of numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        bytes_of = {i: b for b, i in ranks.items()}
        words = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(words), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items()
                 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        codes = left << 32 | right
        self.bits = max(4, int(2 * len(codes)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, todo = self._slot(codes), np.arange(len(codes))
        self.probes = 0
        while len(todo):
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = codes[todo[free]]
            done = self.keys[slot[todo]] == codes[todo]
            self.values[slot[todo[done]]] = rank[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where it is not in the vocabulary or an id is padding."""
        codes = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(codes.shape, NONE, np.int32)
        flat, found = codes.ravel(), out.reshape(-1)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(flat[todo])
        for _ in range(self.probes):
            if not len(todo):
                break
            held = self.keys[slot]
            hit = held == flat[todo]
            found[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held != -1)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a matrix padded with -1 after all merges, and their sizes."""
        done, lengths = np.full(ids.shape, -1, np.int32), sizes.copy()
        rows, sizes = np.arange(len(ids)), sizes.copy()
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if not ranks.shape[1]:
                done[rows, :ids.shape[1]], lengths[rows] = ids, sizes
                break
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            over = least == NONE
            if over.any():
                done[rows[over], :ids.shape[1]] = ids[over]
                lengths[rows[over]] = sizes[over]
                keep = ~over
                rows, ids, ranks, sizes = rows[keep], ids[keep], ranks[keep], sizes[keep]
                at, least = at[keep], least[keep]
                if not len(rows):
                    break
            # the merged token takes the left place; everything to the right moves up by one
            width = int(sizes.max()) - 1
            cells = np.arange(width)
            line = np.arange(len(rows))
            ids = np.take_along_axis(ids, cells + (cells > at[:, None]), 1)
            ids[line, at] = least
            sizes = sizes - 1
            ids[cells >= sizes[:, None]] = -1
            # only the pairs beside the merged token have new ranks
            gaps = np.arange(width - 1)
            ranks = np.take_along_axis(ranks, gaps + (gaps > at[:, None]), 1)
            for shift in (-1, 0):
                place = at + shift
                fit = (place >= 0) & (place < width - 1)
                r, c = line[fit], place[fit]
                ranks[r, c] = self.pair_ranks(ids[r, c], ids[r, c + 1])
            ranks[gaps >= (sizes - 1)[:, None]] = NONE
        return done, lengths

    @cached_property
    def by_pair(self) -> dict[int, int]:
        """Rank by pair, both ids in one number."""
        held = self.keys >= 0
        return dict(zip(self.keys[held].tolist(), self.values[held].tolist()))

    def merge_long(self, token: bytes) -> bytes:
        """Ids of one long pre-token: the least (rank, place) of its pairs comes from a heap, and a
        merge puts the two new pairs beside it there. Entries of pairs that are gone are skipped.
        Time grows as the length times its logarithm."""
        ids = self.single[np.frombuffer(token, np.uint8)].tolist()
        rank = self.by_pair.get
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:]))
                if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)
        end = len(ids)
        while heap:
            least = heapq.heappop(heap)
            made, i = least >> 32, least & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= end or rank(ids[i] << 32 | ids[j]) != made:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < end:
                    before[b] = a
                    r = rank(ids[a] << 32 | ids[b])
                    if r is not None:
                        heapq.heappush(heap, r << 32 | a)
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian 32-bit bytes; the rows of a matrix are of like
        length and bounded in number and width."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        out = [b""] * len(tokens)
        short = int(np.searchsorted(lengths[order], LONG_ROW, "right"))
        for i in order[short:].tolist():
            out[i] = self.merge_long(tokens[i])
        order = order[:short]
        start = 0
        while start < len(order):
            shortest = lengths[order[start]]
            alike = int(np.searchsorted(lengths[order], 2 * shortest, "right"))
            end = min(alike, start + max(1, int(MATRIX_CELLS // (2 * shortest))))
            chosen = order[start:end]
            sizes = lengths[chosen]
            ids = np.full((len(chosen), int(sizes[-1])), -1, np.int32)
            ids[np.arange(ids.shape[1]) < sizes[:, None]] = self.single[
                np.frombuffer(b"".join([tokens[i] for i in chosen.tolist()]), np.uint8)]
            merged, counts = self.merge(ids, sizes)
            flat = merged[np.arange(merged.shape[1]) < counts[:, None]].astype("<u4").tobytes()
            ends = (4 * np.cumsum(counts)).tolist()
            for i, a, b in zip(chosen.tolist(), [0, *ends], ends):
                out[i] = flat[a:b]
            start = end
        return out

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """Bytes of rows of ids, gathered at once from the joined vocabulary."""
        if not rows:
            return []
        ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        data = gathered(self.joined, self.starts[ids], self.sizes[ids]).tobytes()
        cuts = ends[np.cumsum([0, *(len(r) // 4 for r in rows)])].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def table(path: str) -> Table:
    return Table(read_ranks(path))


def piece_encoder(path: str, pattern: str):
    """Encode a list of pieces as little-endian 32-bit ids."""
    known, cut = table(path), regex.compile(pattern)

    def encode(pieces: list[str]) -> list[bytes]:
        found = [cut.findall(p) for p in pieces]
        distinct = list(set(itertools.chain.from_iterable(found)))
        ids = dict(zip(distinct, known.encode([t.encode() for t in distinct])))
        get = ids.__getitem__
        return [get(f[0]) if len(f) == 1 else b"".join(map(get, f)) for f in found]
    return encode


@lru_cache(maxsize=1)
def memory(path: str, pattern: str) -> Memo:
    """One memory of pieces per worker, kept from task to task."""
    return Memo(piece_encoder(path, pattern))


def _encode(path: str, pattern: str, digests: bool):
    def run(batches):
        memo, known = memory(path, pattern), table(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for start, end in bounded(texts):
                rows = memo(texts[start:end])
                count = pa.array([len(r) // 4 for r in rows], pa.int64())
                if digests:
                    rest = [pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string()),
                            pa.array([hashlib.sha256(d).hexdigest() for k in range(
                                0, len(rows), FEW) for d in known.decode(rows[k:k + FEW])],
                                pa.string())]
                    names = ["ids_sha256", "decoded_sha256"]
                else:
                    rest, names = [pa.array(rows, pa.binary())], ["ids"]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(start, len(rows)), count, *rest], ["doc_id", "n_tokens", *names])
    return run


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text",
           digests: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every text; with
    ``digests`` the SHA-256 of the ids and of their decoded bytes instead of the ids.

    Each match of ``pattern`` is encoded by itself by the file of ``ranks``, without special
    tokens. A null text is empty and has no ids; null keys and repeated rows are kept as they
    are; no rows give an empty result; other columns are ignored. A pre-token of any length is merged
    whole, in time that grows little more than its length. Nothing is shuffled, so a lost task is run again by itself."""
    kind = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary"
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(_encode(ranks, pattern, digests), f"doc_id long, n_tokens long, {kind}")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``doc_id`` and the text bytes of rows with ``ids``; null ids decode to nothing."""
    def run(batches):
        known = table(ranks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                known.decode([i or b"" for i in batch.column(1).to_pylist()]), pa.binary())], ["doc_id", "decoded"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")

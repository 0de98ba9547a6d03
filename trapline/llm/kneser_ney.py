"""Scoring by an interpolated modified Kneser-Ney model of word pairs.

Counting is sharded by hash: tasks count the pairs of a few million tokens and send each distinct
pair once to its shard, where the sums are written as a sorted array of hashes with their counts.
A pair belongs to the shard of its first word, so that what follows a word is counted in one
place; the few words that hold a large share of all tokens are spread over all shards. Shards
report how many different words stand before and after each word, and these numbers join the
counts of the words in a second family of arrays. Workers map the arrays into memory and look
the distinct pairs of a run of texts up in sorted order."""

from __future__ import annotations

import mmap
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.common import open_store, scratch, settle, write_file

#: Bytes of text that are cut into words at once, tokens that are counted and that are scored at
#: once, and bytes of training texts for each shard.
SLICE_BYTES = 1 << 21
CHUNK_TOKENS = 1 << 20
SCORE_TOKENS = 1 << 18
SHARD_BYTES = 6 << 21
#: A first word with more than one token in so many is spread; there are fewer than that.
HOT = 1000
#: Discounts where the counts of counts give none between 0 and 1, 2 and 3.
DISCOUNTS = (0.5, 1.0, 1.5)
#: Mapped shards that a worker keeps open.
OPEN_SHARDS = 512
# words are not empty and hold no white space, so these two are none
_END, _BEGIN = xxhash.xxh3_64_intdigest(b""), np.uint64(xxhash.xxh3_64_intdigest(b" "))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _parts(text: str | None):
    """The text in lower-case bytes, cut at white space about every SLICE_BYTES."""
    data, start = (text or "").encode().lower(), 0
    while len(data) - start > SLICE_BYTES:
        found = _SPACE.search(data, start + SLICE_BYTES)
        if found is None:
            break
        yield data[start:found.start()], False
        start = found.start()
    yield data[start:] if start else data, True


def tokens(texts: Iterable[str | None]):
    """Hashes of all tokens with the token before each: arrays (owner, before, token) of bounded
    length. A text ends with an end token and begins after a begin token; a long text goes on in
    the next arrays."""
    held, size, carry = [], 0, _BEGIN

    def flush():
        coded = pa.array([w for _, ws in held for w in ws], pa.binary()).dictionary_encode()
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()],
                          np.uint64)
        token = hashes[coded.indices.to_numpy()]
        owner = np.repeat([i for i, _ in held], [len(ws) for _, ws in held])
        before = np.concatenate([[carry], token[:-1]]).astype(np.uint64)
        before[before == np.uint64(_END)] = _BEGIN
        return owner, before, token

    for i, text in enumerate(texts):
        for data, last in _parts(text):
            words = data.split()
            if last:
                words.append(b"")
            if words:
                held.append((i, words))
            size += len(data) + 16
            if size >= SLICE_BYTES and held:
                out = flush()
                carry = out[2][-1]
                yield out
                held, size = [], 0
    if held:
        yield flush()


def _chunks(batches, column: int, most: int):
    """Arrays of ``tokens`` joined to about ``most``; owners are numbered through."""
    held, size, first = [], 0, 0
    for batch in batches:
        for owner, before, token in tokens(v.as_py() for v in batch.column(column)):
            held.append((owner + first, before, token))
            size += len(token)
            if size >= most:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
        first += batch.num_rows
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    h = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (token * np.uint64(0xBF58476D1CE4E5B9))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes, in their order."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _route(before: np.ndarray, pairs: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """Shards of pairs; ``hot`` is sorted."""
    if len(hot):
        at = np.minimum(np.searchsorted(hot, before), len(hot) - 1)
        before = np.where(hot[at] == before, pairs, before)
    return _shard(before, shards)


def _summed(keys: np.ndarray, counts: np.ndarray):
    """Sorted distinct keys, the place of the first of each, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    return keys[starts], order[starts], np.add.reduceat(counts[order], starts) if len(
        starts) else counts[:0]


def _cuts(sorted_shards: np.ndarray):
    """(shard, from, to) of each run."""
    if len(sorted_shards):
        starts = np.flatnonzero(np.concatenate([[True], sorted_shards[1:] != sorted_shards[:-1]]))
        yield from zip(sorted_shards[starts].tolist(), starts.tolist(),
                       [*starts[1:].tolist(), len(sorted_shards)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        list(zip(*rows)) or [[]] * len(schema), schema.types)], schema=schema)


BLOBS = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("keys", pa.binary()),
                   ("runs", pa.binary()), ("others", pa.binary()), ("counts", pa.binary())])
BLOB_COLUMNS = "shard int, kind string, keys binary, runs binary, others binary, counts binary"


def _u64(values) -> np.ndarray:
    return np.frombuffer(b"".join(v for v in values if v is not None), np.uint64)


def _i64(values) -> np.ndarray:
    return np.frombuffer(b"".join(v for v in values if v is not None), np.int64)


def _count_words(shards: int):
    """Distinct tokens of a chunk with their counts, and the begin token with the texts."""
    def run(batches):
        for owner, before, token in _chunks(batches, 0, CHUNK_TOKENS):
            keys, counts = np.unique(np.concatenate([token, before[before == _BEGIN]]),
                                     return_counts=True)
            yield _batch([(s, "word", keys[a:b].tobytes(), None, None,
                           counts[a:b].astype(np.int64).tobytes())
                          for s, a, b in _cuts(_shard(keys, shards))], BLOBS)
    return run


def _merge_words(table: pa.Table) -> pa.Table:
    keys, _, counts = _summed(_u64(table.column("keys").to_pylist()),
                              _i64(table.column("counts").to_pylist()))
    said = keys != _BEGIN
    return pa.table({"shard": table.column("shard")[:1], "kind": pa.array(["word"]),
                     "keys": pa.array([keys.tobytes()], pa.binary()),
                     "counts": pa.array([counts.tobytes()], pa.binary()),
                     "total": pa.array([int(counts[said].sum())]),
                     "distinct": pa.array([int(said.sum())])})


def _frequent(limit: float):
    """Tokens with more than ``limit`` occurrences."""
    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                many = np.frombuffer(counts, np.int64) > limit
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(keys, np.uint64)[many].view(np.int64))], ["key"])
    return run


def _count_pairs(shards: int, hot: np.ndarray):
    """Distinct pairs of a chunk by shard: first words with the lengths of their runs, second
    words and counts."""
    def run(batches):
        for owner, before, token in _chunks(batches, 0, CHUNK_TOKENS):
            keys, place, counts = np.unique(_pair(before, token), return_index=True,
                                            return_counts=True)
            first, last = before[place], token[place]
            shard = _route(first, keys, hot, shards)
            order = np.lexsort((first, shard))
            first, last, counts = first[order], last[order], counts[order].astype(np.int64)
            rows = []
            for s, a, b in _cuts(shard[order]):
                own = first[a:b]
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                rows.append((s, "pair", own[starts].tobytes(), np.diff(
                    [*starts, b - a]).astype(np.int64).tobytes(), last[a:b].tobytes(),
                    counts[a:b].tobytes()))
            yield _batch(rows, BLOBS)
    return run


def _classes(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.int64)


def _merge_pairs(folder: str, shards: int):
    """Write the array of a shard; report to the shards of the words how many different words
    follow each word once, twice or oftener, and stand before it."""
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        first = np.repeat(_u64(table.column("keys").to_pylist()),
                          _i64(table.column("runs").to_pylist()))
        last = _u64(table.column("others").to_pylist())
        keys, place, counts = _summed(_pair(first, last),
                                      _i64(table.column("counts").to_pylist()))
        first, last = first[place], last[place]
        write_file(folder, f"pairs-{shard}", _filed(keys, [counts]))
        words, at = np.unique(first, return_inverse=True)
        often = np.minimum(counts, 3)
        after = np.array([np.bincount(at[often == k], minlength=len(words)) for k in (1, 2, 3)])
        seconds, before = np.unique(last, return_counts=True)
        rows = [(s, "after", words[a:b].tobytes(), None, None, after[:, a:b].astype(np.int64).tobytes())
                for s, a, b in _cuts(_shard(words, shards))]
        rows += [(s, "before", seconds[a:b].tobytes(), None, None,
                  before[a:b].astype(np.int64).tobytes())
                 for s, a, b in _cuts(_shard(seconds, shards))]
        rows.append((shard, "classes", None, None, None, _classes(counts).tobytes()))
        return pa.Table.from_batches([_batch(rows, BLOBS)])
    return run


def _write_words(folder: str):
    """Write the array of the words of a shard: count, different words before, and different
    words after by how often they follow. Gives the counts of counts of pairs and words."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, counts = (np.concatenate([np.zeros(0, t), *[
            np.frombuffer(r[c], t) for r in rows if r["kind"] == "word"]]) for c, t in (
            ("keys", np.uint64), ("counts", np.int64)))
        planes = np.zeros((5, len(keys)), np.int64)
        planes[0] = counts
        pairs = np.zeros(4, np.int64)
        for row in rows:
            values = np.frombuffer(row["counts"], np.int64)
            if row["kind"] == "classes":
                pairs += values
            elif row["kind"] != "word":
                at = np.searchsorted(keys, np.frombuffer(row["keys"], np.uint64))
                if row["kind"] == "before":
                    planes[1, at] += values
                else:
                    planes[2:, at] += values.reshape(3, -1)
        if len(keys):
            write_file(folder, f"words-{rows[0]['shard']}", _filed(keys, list(planes)))
        before = planes[1]
        n = [*pairs, *_classes(before[before > 0]), before.sum(), (before > 2).sum()]
        return pa.table({"n": pa.array([[int(x) for x in n]], pa.list_(pa.int64()))})
    return run


def _filed(keys: np.ndarray, planes: list[np.ndarray]):
    """Body of a file: sizes, sorted hashes, then each plane of counts in a byte per hash. A byte
    of 255 points to the exceptions of the plane, their places and counts."""
    large = [np.flatnonzero(p >= 255) for p in planes]
    yield np.array([len(keys), len(planes), *map(len, large)], np.int64).tobytes()
    yield keys.tobytes()
    for plane, at in zip(planes, large):
        yield at.tobytes()
        yield plane[at].astype(np.int64).tobytes()
        yield np.minimum(plane, 255).astype(np.uint8).tobytes()
        yield b"\0" * (-len(keys) % 8)


class Mapped:
    """A written array, mapped into memory where the folder is a file system of the worker's
    machine, else read into an anonymous map."""

    def __init__(self, folder: str, name: str):
        store, path = open_store(folder)
        if isinstance(store, pyarrow.fs.LocalFileSystem):
            with open(f"{path}/{name}", "rb") as file:
                self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with store.open_input_file(f"{path}/{name}") as file:
                self.map = mmap.mmap(-1, file.size())
                while part := file.read(1 << 24):
                    self.map.write(part)
        n, count = np.frombuffer(self.map, np.int64, 2).tolist()
        large = np.frombuffer(self.map, np.int64, count, 16).tolist()
        at = 16 + 8 * count
        self.keys = np.frombuffer(self.map, np.uint64, n, at)
        at += 8 * n
        self.planes = []
        for m in large:
            places, values = (np.frombuffer(self.map, np.int64, m, at + 8 * m * k)
                              for k in range(2))
            at += 16 * m
            self.planes.append((np.frombuffer(self.map, np.uint8, n, at), places, values))
            at += n + -n % 8

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Counts of each plane for sorted hashes, 0 for those that are not held."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        held = self.keys[at] == keys
        out = np.zeros((len(self.planes), len(keys)), np.int64)
        for row, (low, places, values) in zip(out, self.planes):
            row[:] = np.where(held, low[at], 0)
            over = row == 255
            row[over] = values[np.searchsorted(places, at[over])]
        return out


class Shards:
    """The arrays of one kind, opened when they are asked for; the oldest are closed."""

    def __init__(self, folder: str, kind: str, planes: int, held: frozenset[int]):
        self.folder, self.kind, self.planes, self.held, self.open = folder, kind, planes, held, {}

    def find(self, shard: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((self.planes, len(keys)), np.int64)
        order = np.lexsort((keys, shard))
        for s, a, b in _cuts(shard[order]):
            if s not in self.held:
                continue
            if s not in self.open:
                while len(self.open) >= OPEN_SHARDS:
                    self.open.pop(next(iter(self.open)))
                self.open[s] = Mapped(self.folder, f"{self.kind}-{s}")
            out[:, order[a:b]] = self.open[s].find(keys[order[a:b]])
        return out


def discounts(classes: list[int]) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2 and more, by the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = classes
    if min(classes) > 0:
        y = n1 / (n1 + 2 * n2)
        found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        if all(0 <= d <= k for k, d in enumerate(found, 1)):
            return found
    return DISCOUNTS


@dataclass(frozen=True)
class Model:
    """A few numbers and the folder of the arrays. ``total`` tokens were learnt from, ``distinct``
    of them; ``pairs`` is the number of different pairs."""
    folder: str
    shards: int
    hot: np.ndarray
    total: int
    distinct: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_classes: tuple[int, int, int]

    def unseen(self) -> float:
        """The share that the words leave to what was not seen."""
        if not self.pairs:
            return 1.0
        return sum(d * n for d, n in zip(self.word_discounts, self.word_classes)) / self.pairs


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count the words and the pairs of all ``docs`` and write the arrays to the shared folder.
    The number of shards follows the size of the texts, so an array fits in a task."""
    spark, texts = docs.sparkSession, docs.select(F.coalesce(F.col(text), F.lit("")).alias("_t"))
    size = texts.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    shards, folder = int(size // SHARD_BYTES) + 1, scratch(spark)
    words = settle(texts.mapInArrow(_count_words(shards), BLOB_COLUMNS).groupBy(
        "shard").applyInArrow(_merge_words, "shard int, kind string, keys binary, counts binary, "
                                            "total long, distinct long"))
    total, distinct = (x or 0 for x in words.agg(F.sum("total"), F.sum("distinct")).first())
    # fewer than HOT rows, as each is more than one token in HOT (the begin token apart)
    hot = np.sort(np.array([r.key for r in words.select("keys", "counts").mapInArrow(
        _frequent(total / HOT), "key long").collect()], np.int64).view(np.uint64))
    reports = texts.mapInArrow(_count_pairs(shards, hot), BLOB_COLUMNS).groupBy(
        "shard").applyInArrow(_merge_pairs(folder, shards), BLOB_COLUMNS)
    counted = words.select("shard", "kind", "keys", "counts").unionByName(
        reports.select("shard", "kind", "keys", "counts")).groupBy("shard").applyInArrow(
        _write_words(folder), "n array<long>").select(*[
            F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(10)])
    n = [x or 0 for x in counted.first()]
    return Model(folder, shards, hot, total, distinct, n[8], discounts(n[:4]),
                 discounts(n[4:8]), (n[4], n[5], n[9]))


def _take(counts: np.ndarray, found: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts."""
    return counts - np.array([0.0, *found])[np.minimum(counts, 3)]


def _names(folder: str, kind: str) -> frozenset[int]:
    """Shards that have an array; one without words has none."""
    store, path = open_store(folder)
    found = store.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
    return frozenset(int(i.base_name.split("-")[1]) for i in found
                     if i.base_name.startswith(f"{kind}-"))


def _scored(model: Model):
    base_of = model.total + 0.5 * (model.distinct + 1)
    unseen = model.unseen() / (model.distinct + 1)

    def run(batches):
        pairs = Shards(model.folder, "pairs", 1, _names(model.folder, "pairs"))
        words = Shards(model.folder, "words", 5, _names(model.folder, "words"))

        def sums(owner, before, token):
            """Per owner: tokens, known ones, base and score."""
            found, at = np.unique(np.concatenate([token, before]), return_inverse=True)
            c, k, *after = words.find(_shard(found, model.shards), found)
            base = np.log10((c + 0.5) / base_of)
            single = _take(k, model.word_discounts) / max(model.pairs, 1) + unseen
            # of the words after each word, discounted: the share left to single words
            left = sum(d * n for d, n in zip(model.pair_discounts, after))
            keys, first, back = np.unique(_pair(before, token), return_index=True,
                                          return_inverse=True)
            w, v = at[first], at[len(token) + first]
            seen, = pairs.find(_route(before[first], keys, model.hot, model.shards), keys)
            whole = c[v].astype(np.float64)
            p = np.where(whole > 0, (_take(seen, model.pair_discounts) + left[v] * single[w])
                         / np.maximum(whole, 1), single[w])
            at, low = at[:len(token)], owner[0]
            near = owner - low
            return low, [np.bincount(near), np.bincount(near, c[at] > 0),
                         np.bincount(near, base[at]), np.bincount(near, np.log10(p)[back])]

        def numbered():
            """Batches of keys, and the rows that precede each."""
            first = 0
            for batch in batches:
                keys.append((first, batch))
                first += batch.num_rows
                yield batch

        keys, held = [], np.zeros((4, 0))
        start = 0  # row of the first column of ``held``
        for chunk in _chunks(numbered(), 0, SCORE_TOKENS):
            low, found = sums(*chunk)
            grown = np.zeros((4, max(held.shape[1], low - start + len(found[0]))))
            grown[:, :held.shape[1]] = held
            grown[:, low - start:low - start + len(found[0])] += found
            held, last = grown, start + grown.shape[1] - 1
            while keys and keys[0][0] + keys[0][1].num_rows <= last:
                yield answer(*keys.pop(0), start, held)
            done = keys[0][0] - start if keys else held.shape[1]
            held, start = held[:, done:], start + done
        for first, batch in keys:
            yield answer(first, batch, start, held)

    def answer(first, batch, start, held):
        own = held[:, first - start:first - start + batch.num_rows]
        return pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(own[0].astype(np.int64)),
             pa.array(own[1].astype(np.int64)), pa.array(own[2]), pa.array(own[3])],
            ["_key", "n_tokens", "n_known", "base_score", "score"])
    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_tokens`` (words, and the end), ``n_known`` (learnt
    from), ``train_tokens``, ``base_score`` (log10 probability by smoothed word counts), ``score``
    (log10 probability by the model) and ``perplexity``.

    Words are runs of characters other than ASCII white space, A-Z in lower case, and are told
    apart by 64-bit hashes. A null or empty text is its end token. A long text is scored whole, in
    parts of bounded size. Repeated rows are scored each, null keys too; what was learnt from no
    token at all gives every token probability 1. No rows give an empty result; other columns are
    ignored, whatever their names."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(key).alias("_key"))
    kind = rows.schema["_key"].dataType.simpleString()
    out = rows.mapInArrow(_scored(model), f"_key {kind}, n_tokens long, n_known long, "
                                          "base_score double, score double")
    return out.select(F.col("_key").alias(key), "n_tokens", "n_known", F.lit(model.total).cast(
        "bigint").alias("train_tokens"), "base_score", "score", F.pow(
            F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def held_out(key: Column) -> Column:
    """A fifth of the keys, by checksum, is not learnt from."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")),
                  F.lit(5)) == 1

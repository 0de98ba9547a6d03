"""N-gram Jaccard join by vertical partitioning.

A document is the set of hashes of its shingles. The global order of the shingles is cut into
fragments, and whatever needs all documents that hold a shingle happens inside one fragment:

1. A first part of the order, ``FILTER`` times the share of shingles that a link may miss, is
   counted. A document whose shingles in this part are missing elsewhere too often for the
   similarity has no link at all. This settles nearly all documents with a small share of the
   shingles moved.
2. For the others all shingles are counted, fragment by fragment, which gives the global order
   by frequency. Documents that link share one of their rarest shingles (as many as a link may
   miss, and one), so only these are compared.
3. Each document is compared with the first document of each such list; overlaps are counted in
   every fragment by itself and summed per pair. Then only documents that are still in different
   components are compared with each other. So a group of copies costs as many pairs as it has
   members, and no link between components is lost.

Documents with equal sets are one throughout."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.common import components, settle

#: Shingles of a packed block, and distinct shingles of blocks that one fragment counts.
BLOCK_SHINGLES = 1 << 17
FRAGMENT_SHINGLES = 1 << 21
FILTER = 2.0
#: Least number of fragments in which overlaps of pairs are counted, and about how many shingles
#: of one document a fragment may hold.
OVERLAP_FRAGMENTS = 4
SEGMENT_SHINGLES = 1 << 16
#: Bits of the map by which texts are chosen before they move (8 MB, whatever the data).
MAP_BITS = 1 << 26
#: Documents of a block of a shingle's list; longer lists meet in pairs of blocks.
LIST_ROWS = 512
#: Longs of the parity map of a set, which bounds the shingles in which two sets differ.
MAP_LONGS = 8
SEED, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingled(texts: list, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z are lower-cased, words are runs of bytes
    other than ASCII white space, a text with fewer words is one shingle, none gives none."""
    cut = [b"" if t is None else t.encode().lower() for t in texts]
    cut = [t.split() for t in cut]
    counts = np.array([len(c) for c in cut], np.int64)
    coded = pa.array([w for c in cut for w in c], pa.binary()).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()],
                      np.uint64)
    flat = hashes[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, np.uint64)
    rolled = np.full(max(len(flat) - words + 1, 0), SEED, np.uint64)
    for k in range(words):
        rolled = _mixed(rolled ^ flat[k:len(flat) - words + 1 + k])
    out, start = [], 0
    for size in counts.tolist():
        if size >= words:
            out.append(np.unique(rolled[start:start + size - words + 1]))
        elif size:
            short = np.full(1, size, np.uint64)
            for k in range(size):
                short = _mixed(short ^ flat[start + k:start + k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        start += size
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * STEP
    h ^= h >> np.uint64(29)
    h *= SEED
    return h ^ (h >> np.uint64(32))


def _set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _parities(shingles: np.ndarray) -> list[int]:
    bits = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % (64 * MAP_LONGS),
                       minlength=64 * MAP_LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


DEALT = ("fragment int, _block long, ids array<long>, keys array<long>, ns array<int>, "
         "sizes array<int>, local array<int>, sets array<long>, owners binary, marks binary, "
         "evidence binary")
DEALT_SCHEMA = pa.schema(
    [("fragment", pa.int32()), ("_block", pa.int64()), ("ids", pa.list_(pa.int64())),
     ("keys", pa.list_(pa.int64())), ("ns", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
     ("local", pa.list_(pa.int32())), ("sets", pa.list_(pa.int64())), ("owners", pa.binary()),
     ("marks", pa.binary()), ("evidence", pa.binary())])


def _edges(share: float, fragments: int) -> np.ndarray:
    return np.array([int(share * 2.0 ** 64 * k / fragments) for k in range(1, fragments)],
                    np.uint64)


def _marks(shingles: np.ndarray) -> bytes:
    """Low halves: a fragment is narrow enough for them to tell its shingles apart, and a clash
    only counts a shingle as shared that is not."""
    return (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()


def _dealt(words: int, share: float, fragments: int):
    """Blocks of documents. One row (fragment -1) names each document, its hash of the text, its
    number of shingles, how many of them lie below ``share`` of the order, how many of these
    other documents of the block hold, and its set id. A row per fragment holds the shingles that
    one document of the block has, document by document, and, once, those that several have."""
    limit = np.uint64(min(int(share * 2.0 ** 64), 2 ** 64 - 1))
    edges = _edges(share, fragments)

    def rows_of(held):
        block = uuid.uuid4().int >> 65
        ids, keys, sets = ([h[k] for h in held] for k in range(3))
        parts = [h[3] for h in held]
        sizes = np.array([len(p) for p in parts])
        every = np.concatenate(parts)
        found, place, often = np.unique(every, return_inverse=True, return_counts=True)
        several = often[place] > 1
        owner = np.repeat(np.arange(len(held)), sizes)
        local = np.bincount(owner[several], minlength=len(held))
        yield {"fragment": -1, "_block": block, "ids": ids, "keys": keys, "sets": sets,
               "ns": [h[4] for h in held], "sizes": sizes.tolist(), "local": local.tolist()}
        fragment = np.searchsorted(edges, every, "right")
        shared = found[often > 1]
        shared_in = np.searchsorted(edges, shared, "right")
        for f in np.unique(fragment).tolist():
            own = (fragment == f) & ~several
            yield {"fragment": f, "_block": block, "marks": _marks(every[own]),
                   "owners": owner[own].astype(np.uint16).tobytes(),
                   "evidence": _marks(shared[shared_in == f])}

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, keys, texts = (batch.column(k).to_pylist() for k in range(3))
            for start in range(0, len(ids), 64):
                part = slice(start, start + 64)
                for i, key, found in zip(ids[part], keys[part], shingled(texts[part], words)):
                    first = found[:np.searchsorted(found, limit, "right")]
                    held.append((i, key, _set_id(found) if len(found) else None, first,
                                 len(found)))
                    size += len(first) + 16
                    if size >= BLOCK_SHINGLES:
                        yield pa.RecordBatch.from_pylist(list(rows_of(held)), DEALT_SCHEMA)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(list(rows_of(held)), DEALT_SCHEMA)
    return run


def _shared_by_block(table: pa.Table) -> pa.Table:
    """Of one fragment: for each block, the owners of the shingles that only one of its documents
    has and other blocks have too."""
    marks = [np.frombuffer(m, np.uint32) for m in table.column("marks").to_pylist()]
    evidence = [np.frombuffer(m, np.uint32) for m in table.column("evidence").to_pylist()]
    found, often = np.unique(np.concatenate([*marks, *evidence]), return_counts=True)
    found = np.concatenate([found[often > 1], [np.iinfo(np.int64).max]])
    hits = [np.frombuffer(o, np.uint16)[found[np.searchsorted(found, own)] == own].tobytes()
            for own, o in zip(marks, table.column("owners").to_pylist())]
    return pa.table({"_block": table.column("_block"), "hits": pa.array(hits, pa.binary())})


def _elsewhere(table: pa.Table) -> pa.Table:
    """How many shingles of each document of one block other blocks hold."""
    hits = np.frombuffer(b"".join(table.column("hits").to_pylist()), np.uint16)
    return pa.table({"_block": table.column("_block")[:1], "elsewhere": pa.array(
        [np.bincount(hits).tolist()], pa.list_(pa.int32()))})


def dealt_blocks(named: DataFrame, words: int, share: float) -> DataFrame:
    """Settled blocks; the number of fragments follows the size of the texts."""
    size = named.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    fragments = max(1, int(size * share / 6 // FRAGMENT_SHINGLES) + 1)
    return settle(named.select("_id", "_key", "_text").mapInArrow(
        _dealt(words, share, fragments), DEALT))


def possible_links(dealt: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``_set`` and ``_key`` of one text for every set whose first shingles are missing elsewhere
    no oftener than a link may miss."""
    shared = dealt.where("fragment >= 0").select(
        "fragment", "_block", "owners", "marks", "evidence").groupBy("fragment").applyInArrow(
        _shared_by_block, "_block long, hits binary")
    sums = shared.groupBy("_block").applyInArrow(_elsewhere, "_block long, elsewhere array<int>")
    docs = dealt.where("fragment = -1").select(
        "_block", "keys", "ns", "sizes", "local", "sets").join(sums, "_block", "left").select(
        F.explode(F.arrays_zip("keys", "ns", "sizes", "local", "sets", "elsewhere")).alias("_d")
    ).where("_d.ns > 0")
    num, den = similarity
    n = F.col("_d.ns").cast("bigint")
    may_miss = n - F.ceil(n * num / F.lit(den))
    missed = F.col("_d.sizes") - F.col("_d.local") - F.coalesce("_d.elsewhere", F.lit(0))
    return settle(docs.where(missed <= may_miss).groupBy(
        F.col("_d.sets").alias("_set")).agg(F.min("_d.keys").alias("_key")))


BLOCKS = "ns array<int>, sets array<long>, maps array<array<long>>, shingles binary"


def _packed(words: int):
    """Blocks of whole sets with their parity maps."""
    def run(batches):
        held, size = [], 0

        def flush():
            return pa.RecordBatch.from_pydict({
                "ns": pa.array([[len(h) for h in held]], pa.list_(pa.int32())),
                "sets": pa.array([[_set_id(h) for h in held]], pa.list_(pa.int64())),
                "maps": pa.array([[_parities(h) for h in held]], pa.list_(pa.list_(pa.int64()))),
                "shingles": pa.array([b"".join(h.tobytes() for h in held)], pa.binary())})

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start in range(0, len(texts), 64):
                for found in shingled(texts[start:start + 64], words):
                    held.append(found)
                    size += len(found)
                    if size >= BLOCK_SHINGLES:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()
    return run


def counted(blocks: DataFrame) -> DataFrame:
    """Blocks with ``counts``: for each distinct shingle of the block, in order, in how many
    documents it occurs. A block sends each distinct shingle once with its
    count, so a shingle that all documents share costs a fragment one entry per block."""
    total = blocks.agg(F.sum(F.length("shingles") / 8)).first()[0] or 0
    fragments = max(1, int(total // FRAGMENT_SHINGLES) + 1)
    edges = _edges(1.0, fragments)

    def send(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, often = np.unique(np.frombuffer(data, np.uint64), return_counts=True)
                cuts = [0, *np.searchsorted(found, edges, "left").tolist(), len(found)]
                often = often.astype(np.uint32)
                rows = [(k, block, _marks(found[a:b]), often[a:b].tobytes())
                        for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        list(zip(*rows)) or [[]] * 4,
                        (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                    ["fragment", "_block", "marks", "often"])

    def count(table: pa.Table) -> pa.Table:
        marks = table.column("marks").to_pylist()
        sizes = [len(m) // 4 for m in marks]
        every = np.frombuffer(b"".join(marks), np.uint32)
        often = np.frombuffer(b"".join(table.column("often").to_pylist()), np.uint32)
        _, place = np.unique(every, return_inverse=True)
        sums = np.minimum(np.bincount(place, often), 2 ** 32 - 1).astype(np.uint32)[place].tobytes()
        ends = np.cumsum([0, *[4 * n for n in sizes]]).tolist()
        return pa.table({"_block": table.column("_block"), "fragment": table.column("fragment"),
                         "part": pa.array([sums[a:b] for a, b in zip(ends, ends[1:])],
                                          pa.binary())})

    sent = blocks.select("_block", "shingles").mapInArrow(
        send, "fragment int, _block long, marks binary, often binary")
    replies = settle(sent.groupBy("fragment").applyInArrow(
        count, "_block long, fragment int, part binary").groupBy("_block").agg(
        F.array_sort(F.collect_list(F.struct("fragment", "part"))).alias("_parts")))
    # shingles meet their counts by a shuffle at any size: either side grows with the documents
    return blocks.join(replies.select("_block", F.col("_parts.part").alias("counts")).hint(
        "merge"), "_block", "left")


def _documents(batch):
    """Per document of counted blocks: its place, shingles and their counts."""
    for row in batch.to_pylist():
        shingles = np.frombuffer(row["shingles"], np.uint64)
        _, place = np.unique(shingles, return_inverse=True)
        counts = np.frombuffer(b"".join(row["counts"] or []), np.uint32)[place]
        start = 0
        for k, size in enumerate(row["ns"]):
            yield row, k, shingles[start:start + size], counts[start:start + size]
            start += size


def _may_miss(n: int, similarity: tuple[int, int]) -> int:
    """How many of n shingles may be missing in a document that links."""
    return n - -(-n * similarity[0] // similarity[1])


CANDIDATES = "id long, n int, " + ", ".join(f"m{i} long" for i in range(
    MAP_LONGS)) + ", rare array<long>, core int, shingles binary"


def _candidates(similarity):
    """The sets of counted blocks that miss no more shingles than a link may, each with the
    shingles by which it can be found: the rarest, one more than a link may miss, less those that
    no other document holds. The first ``core`` of them are one more than a link with a set that
    is no smaller may miss."""
    names = ["id", "n", *[f"m{i}" for i in range(MAP_LONGS)], "rare", "core", "shingles"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * MAP_LONGS, pa.list_(pa.int64()), pa.int32(),
             pa.binary()]
    num, den = similarity

    def run(batches):
        for batch in batches:
            rows = []
            for row, k, shingles, counts in _documents(batch):
                most = _may_miss(row["ns"][k], similarity)
                if (counts < 2).sum() > most:
                    continue
                first = np.lexsort((shingles, counts))[:most + 1]
                core = int((counts[first[:_may_miss(row["ns"][k], (2 * num, num + den)) + 1]]
                            > 1).sum())
                first = first[counts[first] > 1]
                rows.append((row["sets"][k], row["ns"][k], *row["maps"][k],
                             shingles[first].view(np.int64).tolist(), core, shingles.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                list(zip(*rows)) or [[]] * len(names), kinds)], names)
    return run


def _segments(fragments: int):
    """Shingles of each set, cut into the fragments in which overlaps are counted."""
    edges = _edges(1.0, fragments)

    def run(batches):
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(data, np.uint64)
                cuts = [0, *np.searchsorted(own, edges).tolist(), len(own)]
                rows += [(i, f, own[a:b].tobytes())
                         for f, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (
                    pa.int64(), pa.int32(), pa.binary()))], ["id", "fragment", "shingles"])
    return run


def _overlaps(batches):
    for batch in batches:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        counts = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64),
                                     assume_unique=True)) for x, y in zip(left, right)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1),
                                          pa.array(counts, pa.int64())], ["a", "b", "part"])


def _possible(n, m, similarity) -> Column:
    """Whether sets of sizes ``n[0]``, ``n[1]`` with parity maps ``m`` can link: their sizes are
    near enough, and they differ in no more shingles than a link may."""
    num, den = similarity
    both = n[0] + n[1]
    least = F.ceil(both * num / F.lit(num + den))
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(*m)), F.lit(0))
    return ((F.least(*n) * den >= F.greatest(*n) * num) & (differ <= both - 2 * least))


def _maps(side: str) -> list[Column]:
    return [F.col(f"{side}.m{i}") for i in range(MAP_LONGS)]


def linked(pairs: DataFrame, segments: DataFrame, similarity) -> DataFrame:
    """The pairs (``a``, ``b``, sizes ``na``, ``nb``) that link; overlaps are counted in each
    fragment by itself and summed."""
    num, den = similarity
    # both joins move the shingles at any size: pairs grow with the documents too
    left = pairs.select("a", "b").join(segments.select(
        F.col("id").alias("a"), "fragment", F.col("shingles").alias("_x")).hint("merge"), "a")
    met = left.join(segments.select(
        F.col("id").alias("b"), "fragment", F.col("shingles").alias("_y")).hint("merge"),
        ["b", "fragment"])
    parts = met.select("a", "b", "_x", "_y").mapInArrow(_overlaps, "a long, b long, part long")
    sums = parts.groupBy("a", "b").agg(F.sum("part").alias("_i"))
    union = F.col("na") + F.col("nb") - F.col("_i")
    return settle(sums.join(pairs, ["a", "b"]).where(F.col("_i") * den >= union * num)
                  .select("a", "b"))


def links(texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """Enough links (``a``, ``b``) between the set ids of ``texts`` (``_text``, one row per set,
    with shingles) to join all that are reachable from each other."""
    blocks = settle(texts.select("_text").mapInArrow(_packed(words), BLOCKS).withColumn(
        "_block", F.monotonically_increasing_id()))
    sets = settle(counted(blocks).mapInArrow(_candidates(similarity), CANDIDATES))
    postings = sets.select("id", "core", F.posexplode("rare").alias("_k", "shingle")).select(
        "id", "shingle", (F.col("_k") < F.col("core")).alias("core"))
    longest = sets.agg(F.max("n")).first()[0] or 0
    segments = sets.select("id", "shingles").mapInArrow(
        _segments(max(OVERLAP_FRAGMENTS, longest // SEGMENT_SHINGLES + 1)),
        "id long, fragment int, shingles binary")
    heads = settle(postings.groupBy("shingle").agg(
        F.min("id").alias("head"), F.count("*").alias("_many")).where("_many > 1").drop("_many"))
    stars = settle(postings.drop("core").join(heads, "shingle").where(
        "id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
    near = stars.alias("p").join(sets.alias("x"), F.expr("p.a = x.id")).join(
        sets.alias("y"), F.expr("p.b = y.id")).where(_possible(
            (F.col("x.n"), F.col("y.n")), (_maps("x"), _maps("y")), similarity)).select(
        "a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    first = linked(settle(near), segments, similarity)
    roots = components(first)
    placed = settle(postings.join(roots, "id", "left").withColumn(
        "root", F.coalesce("root", "id")))
    open_lists = settle(placed.groupBy("shingle").agg(
        F.min("root").alias("_lo"), F.max("root").alias("_hi"),
        F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("blocks")).where("_lo < _hi").select(
        "shingle", "blocks"))
    rest = settle(placed.join(open_lists, "shingle").join(
        sets.drop("rare", "core", "shingles"), "id"))
    pairs = settle(apart(rest, similarity).distinct())
    return settle(first.unionByName(linked(pairs, segments, similarity)))


def apart(rest: DataFrame, similarity) -> DataFrame:
    """Pairs (``a``, ``b``, sizes) of a shingle's list that lie in different components and can
    link. The smaller set of a pair must be found by its core: the first shingle that both hold is
    within it, as less of the smaller set may be missing in the larger one. A list of several
    blocks is met in pairs of blocks, a task's worth each, and the sizes and parity maps are compared
    before a pair leaves its task."""
    block = rest.withColumn("_own", F.when(F.col("blocks") > 1, F.pmod(
        F.xxhash64("id"), F.col("blocks"))).otherwise(F.lit(0)).cast("int"))
    x = block.withColumn("_i", F.col("_own")).withColumn("_j", F.explode(
        F.sequence("_own", F.col("blocks") - 1))).alias("x")
    y = block.withColumn("_j", F.col("_own")).withColumn("_i", F.explode(
        F.sequence(F.lit(0), F.col("_own")))).alias("y")
    met = x.join(y, F.expr(
        "x.shingle = y.shingle and x._i = y._i and x._j = y._j and x.root <> y.root"
        " and (x._i < x._j or x.id < y.id)"
        " and if(x.n < y.n or (x.n = y.n and x.id < y.id), x.core, y.core)") & _possible(
        (F.col("x.n"), F.col("y.n")), (_maps("x"), _maps("y")), similarity))
    swap = F.expr("x.id > y.id")
    return met.select(*[F.when(swap, F.col(f"{v}.{c}")).otherwise(F.col(f"{u}.{c}")).alias(name)
                        for name, c, u, v in (("a", "id", "x", "y"), ("b", "id", "y", "x"),
                                              ("na", "n", "x", "y"), ("nb", "n", "y", "x"))])


def key_map(keys: DataFrame) -> np.ndarray:
    """A bit for each ``_key``, as MAP_BITS / 64 words that are put together in Spark."""
    bit = F.pmod(F.col("_key"), F.lit(MAP_BITS))
    found = keys.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("word")).toPandas()
    words = np.zeros(MAP_BITS // 64, np.int64)
    words[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64)
    return words.view(np.uint64)


def _marked(words: np.ndarray):
    """Rows whose key has its bit."""
    last = np.uint64(64 * len(words) - 1)

    def run(batches):
        for batch in batches:
            bit = batch.column(0).to_numpy().view(np.uint64) & last
            held = (words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)
            yield batch.filter(pa.array(held.astype(bool)))
    return run


def chosen_texts(named: DataFrame, keys: DataFrame) -> DataFrame:
    """One text for each of the ``keys``. Texts whose key has no bit in the map stay where they
    are, copies of the others shrink to one row per task, and a join drops the few that share a
    bit with a key. With many more keys than bits all texts move once."""
    near = named.select("_key", "_text").mapInArrow(
        _marked(key_map(keys)), "_key long, _text string")
    texts = near.groupBy("_key").agg(F.first("_text").alias("_text"))
    return texts.join(keys, "_key", "left_semi")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5,
         similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per document: ``key``, ``n_shingles`` and ``component_id``, the smallest key
    reachable by links. Two documents link when the share of their common shingles in all of
    theirs is at least ``similarity`` (a fraction as two whole numbers).

    A null text and a text without words have no shingles and link with nothing, not with each
    other either; their component is their own key. Repeated rows and equal texts are one
    component. A null key takes part, but the smallest key that is not null names the component.
    No rows give an empty result; other columns are ignored. A long text is read whole, and its
    set of shingles must fit in a task. Texts, shingles and sets are told apart by 64-bit
    hashes."""
    share = min(1.0, FILTER * (similarity[1] - similarity[0]) / similarity[1])
    named = docs.select(F.col(key).cast("bigint").alias("_id"),
                        F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_text"))
    dealt = dealt_blocks(named, words, share)
    shared = possible_links(dealt, similarity)
    roots = components(links(chosen_texts(named, shared.select("_key")), words, similarity))
    members = dealt.where("fragment = -1").select(F.explode(F.arrays_zip(
        "ids", "ns", "sets")).alias("_d")).select(
        F.col("_d.ids").alias("_id"), F.col("_d.ns").cast("bigint").alias("n_shingles"),
        F.col("_d.sets").alias("_set"))
    rooted = settle(members.join(roots.withColumnRenamed("id", "_set"), "_set", "left").select(
        "_id", "n_shingles", F.coalesce("root", "_set").alias("_root")))
    least = settle(rooted.where("_root is not null").groupBy("_root").agg(
        F.min("_id").alias("_least")))
    return rooted.join(least, "_root", "left").select(
        F.col("_id").alias(key), "n_shingles", F.coalesce("_least", "_id").alias("component_id"))

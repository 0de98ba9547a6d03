"""Line deduplication: later copies of repeated runs of lines are deleted.

Non-blank lines of all documents, in key order, are one sequence of line ids that no run crosses
document ends in. Suffixes are sorted into classes of equal prefixes by prefix doubling: the
class of 2^(k+1) lines at a place is the pair of the classes of 2^k lines there and 2^k lines
further on; suffixes alone in their class leave. A class is an interval of the suffix array whose
members have the prefix length in common, and is named after its first member. The class of any
length is the pair of its overlapping powers of two.

A run counts from ``min_words`` words on. A run of enough words that occurred before is the union
of its shortest windows of enough words, those that begin and those that end at each line; so it
is enough to ask for every such window whether its class has an earlier member. The union of the
windows that have one is the union of all maximal repeated runs of enough words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.common import numbered, settle

MIN_WORDS = 50

LINES = "_row long, line long, id long, ahead int, back int"


def _windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest window of ``least`` words that begins, and that ends, at each line;
    0 where the text has too few."""
    total = np.concatenate([[0], np.cumsum(words)])
    line = np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + least, "left")
    ahead = np.where(end <= len(words), end - line, 0)
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    back = np.where(total[1:] >= least, line + 1 - start, 0)
    # a window that both begins at its first line and ends at its last is asked for once
    return ahead, np.where(ahead[np.maximum(start, 0)] == back, 0, back)


def _lines(least: int):
    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            columns: list[list] = [[], [], [], [], []]
            for key, text in zip(keys, texts):
                kept = [(w, line) for line in text.split("\n")
                        if (w := len(line.encode().split()))]
                if not kept:
                    continue
                ahead, back = _windows(np.array([w for w, _ in kept]), least)
                ids = np.array([xxhash.xxh3_64_intdigest(line.encode()) for _, line in kept],
                               np.uint64).view(np.int64)
                for column, part in zip(columns, (np.full(len(kept), key),
                                                  np.arange(len(kept)), ids, ahead, back)):
                    column.append(part)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(columns, kinds)],
                ["_row", "line", "id", "ahead", "back"])
    return run


def _classed(members: DataFrame, *name: str) -> DataFrame:
    """``place`` and ``class`` (its first place) of the members of classes of two or more."""
    classes = settle(members.groupBy(*name).agg(
        F.min("place").alias("class"), F.count("*").alias("_size")).where("_size > 1"))
    return settle(members.join(classes.drop("_size"), list(name)).select("place", "class"))


def repeated(places: DataFrame) -> DataFrame:
    """Windows (``place``, ``lines``) that have an earlier copy, from rows of ``place``, ``id``,
    ``ahead`` and ``back``."""
    windows = settle(places.select(F.explode(F.array(
        F.struct("place", F.col("ahead").alias("lines")),
        F.struct((F.col("place") - F.col("back") + 1).alias("place"),
                 F.col("back").alias("lines")))).alias("_w")).select("_w.*")
        .where("lines > 0"))
    longest = windows.agg(F.max("lines")).first()[0] or 0
    found, level, size = None, _classed(places.select("place", "id"), "id"), 1
    while size <= longest:
        asked = windows.where((F.col("lines") >= size) & (F.col("lines") < 2 * size))
        heads = asked.join(level.withColumnRenamed("class", "_head"), "place")
        tails = heads.withColumn("_end", F.col("place") + F.col("lines") - size).join(
            level.select(F.col("place").alias("_end"), F.col("class").alias("_tail")), "_end")
        tails = settle(tails.select("place", "lines", "_head", "_tail"))
        firsts = settle(tails.groupBy("lines", "_head", "_tail").agg(
            F.min("place").alias("_first"), F.count("*").alias("_size")).where("_size > 1"))
        later = tails.join(firsts, ["lines", "_head", "_tail"]).where(
            "place > _first").select("place", "lines")
        found = later if found is None else found.unionByName(later)
        if 2 * size <= longest:
            ends = level.select((F.col("place") - size).alias("place"),
                                F.col("class").alias("_tail"))
            level = _classed(settle(level.withColumnRenamed("class", "_head").join(
                ends, "place")), "_head", "_tail")
        size *= 2
    return found if found is not None else windows


def _cut(batches):
    """Texts without the lines of their windows; a blank line goes with the lines around it."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        runs = batch.column(2).to_pylist()
        kept_text, lines, removed = [], [], []
        for text, windows in zip(texts, runs):
            if text is None:
                kept_text.append(None)
                lines.append(0)
                removed.append(0)
                continue
            rows = text.split("\n")
            real = [i for i, line in enumerate(rows) if line.encode().split()]
            gone = np.zeros(len(real), bool)
            for window in windows or ():
                gone[window["_at"]:window["_at"] + window["lines"]] = True
            drop = np.zeros(len(rows), bool)
            for k in np.flatnonzero(gone):
                to = real[k + 1] if k + 1 < len(real) and gone[k + 1] else real[k] + 1
                drop[real[k]:to] = True
            left = [line for line, out in zip(rows, drop) if not out]
            kept_text.append(text if not gone.any() else "\n".join(left) if any(
                line.encode().split() for line in left) else "")
            lines.append(len(real))
            removed.append(int(gone.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept_text, pa.string()), pa.array(lines, pa.int64()),
             pa.array(removed, pa.int64())], ["_whole", "_kept", "n_lines", "n_removed"])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
          counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The rows of ``docs`` with ``text`` less the later copies of repeated runs, and two columns
    called as ``counts`` say: the number of lines with words, and of those removed.

    Documents are ordered by key, null keys first, equal keys by their place in the input; the
    first copy of a run stays, also when the later one is in the same document. Lines are equal
    if their bytes are. Lines without words are no part of a run and go only between two deleted
    lines. A text whose words all go becomes empty; a null text stays null with no lines. Repeated
    rows keep the first. No rows give an empty result. Lines and runs of any number of
    copies are pre-aggregated before they meet. A text of any length and number of lines is cut
    whole, in the memory of a task. Input columns called as ``counts`` say give way to the
    result's; name others to keep them."""
    others = [c for c in docs.columns if c not in (text, *counts)]
    whole = F.struct(*[F.col(f"`{c}`") for c in others]).alias("_whole")
    held = settle(docs.select(whole, F.col(key).alias("_key"), F.col(text).alias("_text"),
                              F.monotonically_increasing_id().alias("_row")))
    order = numbered(held.select("_row", "_key"), [F.col("_key"), F.col("_row")])
    lines = settle(held.where("_text is not null").select("_row", "_text").mapInArrow(
        _lines(min_words), LINES))
    # a place is the number of a text and, in so many bits, of a line; the bits hold twice the
    # lines of the longest text, so a place some lines further on never falls into the next text
    bits = (lines.agg(F.max("line")).first()[0] or 0).bit_length() + 2
    place = F.shiftleft(F.col("_n"), bits) + F.col("line")
    places = settle(lines.join(order.select("_row", "_n"), "_row").select(
        place.alias("place"), "id", "ahead", "back"))
    number = F.shiftright("place", bits)
    gone = repeated(places).groupBy(number.alias("_n")).agg(F.collect_list(F.struct(
        F.col("place").bitwiseAND((1 << bits) - 1).alias("_at"), "lines")).alias("_runs"))
    gone = settle(gone.join(order.select("_row", "_n"), "_n").select("_row", "_runs"))
    kind = held.schema["_whole"].dataType.simpleString()
    # by a shuffle at any size: what a broadcast would send grows with the table
    cut = held.join(gone.hint("merge"), "_row", "left").select(
        "_whole", "_text", "_runs").mapInArrow(
        _cut, f"_whole {kind}, _kept string, n_lines long, n_removed long")
    return cut.select(*[F.col("_kept").alias(c) if c == text else
                        F.col(f"_whole.`{c}`").alias(c) for c in docs.columns
                        if c in others or c == text], *[
        F.col(c).alias(name) for c, name in zip(("n_lines", "n_removed"), counts)])

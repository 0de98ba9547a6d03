"""Audit of how filters interact: what each one removes in every order of all of them.

The texts are read once, into a narrow table of the filters that each row fails. From it every
part of the documents gets, per range of row numbers, one sorted posting list of failing rows for
each filter and of labelled rows for each label. A k-way merge by galloping walks the lists of a
range together and sizes the cells in which they overlap; unions and differences are sums of
cells, ranges add up, and so a few numbers per part answer all orders."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.common import WORD, settle

#: Row numbers of a range, which bounds a posting list.
RANGE_BITS = 16
#: Keys with more than one row in so many are looked up by broadcast; there are fewer than that.
HEAVY = 1000
MOST_FILTERS = 6


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {"A": F.size(words) < 50,
            "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
            "D": text.rlike("[#$%&*|]")}


def _either(conditions: dict[str, Column], first: int = 0) -> Column:
    """Bit ``first + k`` is set where condition k holds."""
    return reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(c, F.lit(1 << (first + k))).otherwise(F.lit(0))
        for k, c in enumerate(conditions.values())], F.lit(0))


def _looked_up(rows: DataFrame, lookup: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """``rows`` with the one row of ``lookup`` per key, or nulls. Rows of heavy keys (few keys,
    many rows) stay where they are, so the shuffle of the others is even; null keys match
    nothing and do not move either."""
    few = F.broadcast(settle(heavy.select(key)))
    names = [F.lit(None).cast(f.dataType).alias(f.name) for f in lookup.schema if f.name != key]
    known = rows.where(F.col(key).isNotNull())
    return known.join(few, key, "left_semi").join(F.broadcast(lookup.join(few, key)), key, "left") \
        .unionByName(known.join(few, key, "left_anti").join(lookup, key, "left")) \
        .unionByName(rows.where(F.col(key).isNull()).select("*", *names))


def failing(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
            part: str = "source", good: Column | None = None,
            toxic: Column | None = None) -> DataFrame:
    """Settled narrow table: ``row`` (a number of its own for every row), ``part`` and ``cell``,
    the filters that the row fails as bits 0 to 4 and, if it fails any, bits 5 and 6 for the
    labels ``good`` and ``toxic``."""
    good = F.col("quality") == 1 if good is None else good
    toxic = F.col("toxic") == 1 if toxic is None else toxic
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    facts = settle(rows.select(
        "part", "_id", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_digest"),
        _either(failures(F.col("_text"))).alias("cell"),
        F.monotonically_increasing_id().alias("row")))
    limit = facts.count() / HEAVY
    copies = settle(facts.groupBy("_digest").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1"))
    repeats = (F.col("_first").isNotNull() & (F.col("_id").isNull()
                                              | (F.col("_id") > F.col("_first"))))
    celled = _looked_up(facts, copies.drop("_rows"), "_digest", copies.where(
        F.col("_rows") > limit)).select("part", "row", "_id", F.col("cell").bitwiseOR(
            _either({"E": repeats}, 4)).alias("cell"))
    celled = settle(celled)
    marks = labels.select(F.col(key).alias("_id"), _either({"good": good, "toxic": toxic}, 5).alias(
        "_marks")).groupBy("_id").agg(F.bit_or("_marks").alias("_marks"))
    often = facts.where("_id is not null").groupBy("_id").count().where(F.col("count") > limit)
    marked = _looked_up(celled.where("cell > 0"), marks, "_id", often).select(
        "part", "row", F.col("cell").bitwiseOR(F.coalesce("_marks", F.lit(0))).alias("cell"))
    return settle(marked.unionByName(celled.where("cell = 0").drop("_id")))


def postings(failed: DataFrame, names: list[str]) -> DataFrame:
    """Per part and range of row numbers, one sorted list of row numbers for each bit of ``cell``
    (``names`` in order of the bits). Ranges hold at most 2 ** RANGE_BITS rows of all parts
    together, so a part of any size is cut into lists of bounded length."""
    lists = [F.sort_array(F.collect_list(F.when(F.col("cell").bitwiseAND(1 << k) != 0,
                                                F.col("row")))).alias(f"rows_{n}")
             for k, n in enumerate(names)]
    return failed.where("cell > 0").groupBy("part", F.shiftright("row", RANGE_BITS).alias(
        "range")).agg(*lists)


def gallop(ids: list[int], least: int, start: int) -> int:
    """First place from ``start`` on that holds ``least`` or more: steps double until they pass
    it, and the last step is halved."""
    step = 1
    while start + step < len(ids) and ids[start + step] < least:
        start += step
        step *= 2
    return bisect_left(ids, least, start, min(start + step, len(ids)))


def merged(lists: list[list[int]]) -> dict[int, int]:
    """Sizes of the cells of sorted lists: how many ids are in exactly the lists of each bit set.

    The list with the smallest head runs on by galloping to the next smallest head; ids that
    several lists hold are met at all their heads at once."""
    at = [0] * len(lists)
    live = [k for k, ids in enumerate(lists) if ids]
    cells: dict[int, int] = {}
    while live:
        least = min(lists[k][at[k]] for k in live)
        here = [k for k in live if lists[k][at[k]] == least]
        if len(here) > 1:
            cell, run = sum(1 << k for k in here), 1
            for k in here:
                at[k] += 1
        else:
            k, cell = here[0], 1 << here[0]
            others = [lists[j][at[j]] for j in live if j != k]
            end = gallop(lists[k], min(others), at[k]) if others else len(lists[k])
            run, at[k] = end - at[k], end
        cells[cell] = cells.get(cell, 0) + run
        live = [k for k in live if at[k] < len(lists[k])]
    return cells


def _sizes(batches):
    for batch in batches:
        parts = batch.column(0).to_pylist()
        rows = []
        for i, part in enumerate(parts):
            lists = [batch.column(k)[i].as_py() for k in range(1, batch.num_columns)]
            rows += [(part, cell, run) for cell, run in merged(lists).items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            list(zip(*rows)) or [[]] * 3, (pa.string(), pa.int32(), pa.int64()))],
            ["part", "cell", "rows"])


def _orders(names: str):
    """Rows (order, step) and, for each, 0/1 vectors over the cells that its sizes add up."""
    k = len(names)
    cells = np.arange(1 << (k + 2))
    good, toxic = (cells & (1 << k)) > 0, (cells & (2 << k)) > 0
    bit = {n: 1 << i for i, n in enumerate(names)}
    told, parts = [], []
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            own, gone = (cells & bit[name]) > 0, (cells & before) > 0
            removed = own & ~gone
            parts.append((own | gone, removed, own & gone,
                          (cells & ((1 << k) - 1)) == bit[name], removed & good,
                          removed & toxic))
            before |= bit[name]
            told.append(("".join(order), step, name))
    sums = np.array(parts, np.int64)
    by_filter = {n: sum(sums[i, 1] for i, t in enumerate(told) if t[2] == n) for n in names}
    shapley = np.array([by_filter[t[2]] for t in told])
    return told, np.concatenate([sums, shapley[:, None]], axis=1)


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _answers(names: str):
    told, sums = _orders(names)
    orders = pa.array([t[0] for t in told], pa.string())
    steps = pa.array([t[1] for t in told], pa.int32())

    def run(batches):
        for batch in batches:
            for part, total, cells in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows = np.zeros(sums.shape[2], np.int64)
                for c in cells or []:
                    rows[c["cell"]] = c["rows"]
                counts = sums @ rows
                counts[:, 0] = total - counts[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(told), pa.string()), orders, steps,
                     *[pa.array(counts[:, k], pa.int64()) for k in range(len(COUNTS))]],
                    ["part", "filter_order", "step", *COUNTS])
    return run


def audit(failed: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Per ``part``, ``filter_order`` (every permutation of ``names``, applied left to right) and
    ``step`` (its filter is that letter), counts within the part: ``kept`` after the step,
    ``removed`` by it, ``redundant`` (failing its filter, removed before), ``unique_fails`` (failing
    its filter only, in any order), ``good_lost`` and ``toxic_lost`` (removed here and labelled so)
    and ``shapley``, what its filter removes in all orders together.

    ``failed`` holds ``row``, ``part`` and ``cell`` as ``failing`` gives them: a bit for each
    name, then one for good and one for toxic rows; rows that fail nothing count as kept.

    Of the rows that ``failing`` takes, a null part is the empty string, a null text an empty
    text, and repeated rows are rows each. A text repeats (E) if a smaller key has the same text
    (of rows that tie in the key none fails for the other); a null key is larger than all others
    and has no label. Of several labels of a key any counts; null labels count for nothing. Long
    texts are counted whole; a text and the list of its words must fit in a task. No rows give an
    empty result; other columns are ignored, whatever their names. At most MOST_FILTERS names, as
    their orders are all listed."""
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"between one and {MOST_FILTERS} different letters, not {names!r}")
    lists = postings(failed, [*names, "good", "toxic"])
    sizes = lists.drop("range").mapInArrow(_sizes, "part string, cell int, rows long").groupBy(
        "part", "cell").agg(F.sum("rows").alias("rows"))
    cells = sizes.groupBy("part").agg(F.collect_list(F.struct("cell", "rows")).alias("cells"))
    totals = failed.groupBy("part").agg(F.count("*").alias("total"))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return totals.join(cells, "part", "left").select("part", "total", "cells").mapInArrow(
        _answers(names), f"part string, filter_order string, step int, {counts}")

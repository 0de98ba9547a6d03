"""Sharding by a Feistel permutation of global row numbers.

Documents are numbered 0 .. n-1 in key order. A keyed permutation of 0 .. n-1 deals the numbers
anew; shard and slot are the remainder and the quotient of the permuted number. Any process that
knows n, the seed and a row number can compute shard and slot without a table. Shards differ by
at most one row (law ``rows``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.common import numbered, settle

ROUNDS = 6


def grid(n: int) -> tuple[int, int, int]:
    """Sides a <= b with a * b >= n and the least surplus, and that surplus. The surplus bounds
    the length of a cycle walk: a walk meets only surplus numbers, and none twice."""
    n = max(n, 1)
    root = math.isqrt(n - 1) + 1
    surplus, a = min((a * -(-n // a) - n, -a) for a in range(max(1, root // 2), root + 1))
    return -a, -(-n // -a), surplus


def _draw(value: Column, mark: str) -> Column:
    digest = F.substring(F.md5(F.concat(F.lit(mark + ":"), value.cast("string"))), 1, 15)
    return F.conv(digest, 16, 10).cast("bigint")


def feistel(value: Column, a: int, b: int, seed: int) -> Column:
    """One pass over 0 .. a*b-1: the halves (remainder and quotient by a) take turns in having a
    draw of the other half added, each modulo its own side."""
    left = F.pmod(value, F.lit(a))
    right = ((value - left) / a).cast("bigint")
    for k in range(ROUNDS):
        if k % 2 == 0:
            left = F.pmod(left + _draw(right, f"{seed}.{k}"), F.lit(a))
        else:
            right = F.pmod(right + _draw(left, f"{seed}.{k}"), F.lit(b))
    return right * a + left


def permuted(number: Column, n: int, seed: int) -> Column:
    """Where a number of 0 .. n-1 goes. Results beyond n - 1 walk on along their cycle."""
    a, b, surplus = grid(n)
    first = feistel(number, a, b, seed)
    if not surplus:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(surplus)), first, lambda x, _: F.when(
        x < n, x).otherwise(feistel(x, a, b, seed)))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
           seed: int = 7) -> DataFrame:
    """One row per document: ``key``, ``size`` (UTF-8 bytes of the text and 8), ``text_crc32``,
    ``law`` ('rows'), ``shard``, ``slot`` (gapless from 0 in its shard).

    A null text counts as empty (size 8, checksum 0). Rows are numbered by key, then size, then
    checksum, null keys first; rows equal in all three are interchangeable. No rows give an
    empty result; other columns are ignored. Only narrow rows are moved: the text is read once
    to be measured, whole, however long it is."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = settle(docs.select(
        F.col(key), (F.octet_length(body) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32")))
    n = narrow.count()
    placed = numbered(narrow, [F.col(key), F.col("size"), F.col("text_crc32")])
    place = permuted(F.col("_n"), n, seed)
    return placed.withColumn("_p", place).select(
        key, "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("_p", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("bigint").alias("slot"))

"""From raw documents to token ids: quality, line copies, near copies, mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes the result of each
as Parquet and gives it, read again, to the next. Every stage but the last returns the columns
of ``documents``. Nulls, empty tables, repeated rows and further columns are treated as the
operators state."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import bpe, common, line_dedup, mixing, ngram_join, quality

#: The quality scores come from a fitted model, which SQL cannot express.
ORACLE_SQL = None

_done: list[str] = []


def _stage(work):
    """The stage before has been written when a stage begins, so its scratch folders go."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.remove(spark, _done)
        _done.clear()
        with common.recorded() as made:
            result = work(spark, docs, sf_dir)
        _done.extend(made)
        return result
    run.__name__, run.__doc__ = work.__name__, work.__doc__
    return run


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


@_stage
def good_quality(spark, docs, sf_dir):
    """Documents that the quality classifier accepts, as they are. It learns from the labels of
    ``sf_dir`` that are not held out; without labels every document is kept."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def without_line_copies(spark, docs, sf_dir):
    """Documents less the later copies of runs of lines of 50 words or more; ``n_chars`` follows
    the text. Documents of which nothing is left go; empty and null texts stay."""
    lines, removed = (_free(docs, name) for name in ("_lines", "_removed"))
    cut = line_dedup.dedup(docs, counts=(lines, removed))
    kept = cut.where((F.col(removed) == 0) | (F.col(lines) > F.col(removed)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def without_near_copies(spark, docs, sf_dir):
    """One row of each group of rows that share 80 % of their five-word shingles: the one of
    smallest ``doc_id``, nulls last, then by a hash of the text and the row number. Rows without
    words stay, but of those that repeat a ``doc_id`` and a text one stays. Rows with different
    texts are not repeated, also if they share a ``doc_id``."""
    row = _free(docs, "_row")
    rows = common.settle(docs.withColumn(row, F.monotonically_increasing_id()))
    joined = ngram_join.join(rows, key=row, words=5, similarity=(80, 100)).withColumnRenamed(
        row, "_n")
    marks = rows.select(F.col(row).alias("_n"), F.col("doc_id").alias("_id"),
                        F.xxhash64("text").alias("_hash"))
    worded = F.col("n_shingles") > 0
    groups = ["_worded", "_group", "_same"]
    known = common.settle(joined.join(marks, "_n").where(worded | F.col("_id").isNotNull()).select(
        "_n", F.struct(F.col("_id").isNull(), "_id", "_hash", "_n").alias("_order"),
        worded.alias("_worded"), F.when(worded, F.col("component_id")).otherwise(
            F.col("_id")).alias("_group"), F.when(worded, 0).otherwise(F.col("_hash")).alias(
            "_same")))
    first = known.groupBy(*groups).agg(F.min("_order").alias("_first"),
                                       F.count("*").alias("_rows")).where("_rows > 1")
    # the list is short beside the documents; adaptive execution sends it if it is small
    gone = common.settle(known.join(first, groups).where("_n <> _first._n").select(
        F.col("_n").alias(row)))
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def mixed(spark, docs, sf_dir):
    """Documents as often as the mix of their sources takes them, up to three times."""
    return mixing.emitted(docs)


@_stage
def encoded(spark, docs, sf_dir):
    """Token ids of every document: ``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned
    32-bit)."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                      public_tokenizers.PATTERN)


STAGES = [("quality classifier", good_quality), ("line dedup", without_line_copies),
          ("n-gram Jaccard join", without_near_copies), ("mixing", mixed), ("encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = common.scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

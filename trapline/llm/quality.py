"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every text are Spark columns. A forest of shallow trees is fitted on labelled rows,
every path from a root is read as a conjunction of limits, a lasso-penalised logistic regression
weighs the rules, and the rules that keep a weight are compiled into one Spark column."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.common import WORD, settle

#: The classifier is fitted on at most so many labelled rows, those of smallest key hash.
TRAIN_ROWS = 20_000
TREES, DEPTH, PENALTY = 20, 3, 0.001
THRESHOLD = 0.3
SYMBOLS = "#$%&*|<>=@^~\\_{}[]+/"
Rule = tuple[tuple[int, bool, float], ...]


def _without(text: Column, characters: str) -> Column:
    """How many of the characters a text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; shares of an empty text are 0."""
    size, words = F.length(text), F.regexp_count(text, F.lit(WORD))
    cut, lines = F.split(text, r"[\x20\x09-\x0D]+"), F.split(text, "\n")

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)).cast("double")

    return {
        "size": F.log1p(size.cast("double")),
        "words": F.log1p(words.cast("double")),
        "word_length": share(size, words),
        "distinct_words": share(F.size(F.array_distinct(cut)), F.size(cut)),
        "symbols": share(_without(text, SYMBOLS), size),
        "bars": share(_without(text, "|"), words),
        "digits": share(_without(text, "0123456789"), size),
        "capitals": share(_without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), size),
        "calls": share(_without(text, "!?"), words),
        "stops": share(_without(text, ".,;:"), words),
        "bytes": share(F.octet_length(text), size),
        "lines": share(F.size(lines), words),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
    }


def measured(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, list[str]]:
    """``_key`` and one column per statistic, settled: the texts are read once."""
    known = statistics(F.col("_text"))
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return settle(rows.select("_key", *[c.alias(f"_s_{n}") for n, c in known.items()])), [
        f"_s_{n}" for n in known]


def paths(described: str) -> list[Rule]:
    """Every path from a root to a node, as limits (feature, whether at most, value)."""
    found: dict[Rule, None] = {}
    stack: list[tuple[int, bool, float]] = []
    for line in described.splitlines():
        limit = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if limit:
            depth = len(limit[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, (int(limit[2]), limit[3] == "<=", float(limit[4]))))
            found[tuple(sorted(x for _, x in stack))] = None
        elif "Tree" in line:
            stack = []
    return list(found)


def holds(rule: Rule, names: list[str], value: Callable[[str], Column] = F.col) -> Column:
    return reduce(lambda a, b: a & b, [
        value(names[f]) <= v if at_most else value(names[f]) > v for f, at_most, v in rule])


class Rules:
    """Weighed rules; ``score`` is a Spark column in [0, 1] over the statistics, which ``value``
    gives by name."""

    def __init__(self, names: list[str], constant: float, weights: dict[Rule, float]):
        self.names, self.constant, self.weights = names, constant, weights

    def score(self, value: Callable[[str], Column] = F.col) -> Column:
        total = F.lit(self.constant)
        for rule, weight in self.weights.items():
            total = total + F.when(holds(rule, self.names, value), F.lit(weight)).otherwise(
                F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit(rows: DataFrame, names: list[str], train_rows: int = TRAIN_ROWS) -> Rules:
    """Rules learnt from rows with ``_key``, ``_label`` (0 or 1) and the statistics; of more than
    ``train_rows`` rows those of smallest key hash serve. With one class only, or no row, the
    score is constant: near the class, or one half."""
    sample = settle(rows.orderBy(F.xxhash64("_key"), "_key", *names).limit(train_rows))
    seen = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
    if len(seen) < 2:
        return Rules(names, 0.0 if not seen else 4.0 * (2 * next(iter(seen)) - 1), {})
    points = VectorAssembler(inputCols=names, outputCol="_x").transform(
        sample.withColumn("_y", F.col("_label").cast("double")))
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol="_y", numTrees=TREES, maxDepth=DEPTH, maxBins=64,
        subsamplingRate=0.5, featureSubsetStrategy="onethird", seed=11).fit(points)
    rules = paths(forest.toDebugString)
    if not rules:
        share = seen[1] / sum(seen.values())
        return Rules(names, 2 * share - 1, {})
    marks = [f"_r{i}" for i in range(len(rules))]
    marked = settle(sample.select("_label", *[
        holds(r, names).cast("double").alias(m) for r, m in zip(rules, marks)]))
    fitted = LogisticRegression(
        featuresCol="_x", labelCol="_y", elasticNetParam=1.0, regParam=PENALTY, maxIter=60,
        standardization=False).fit(VectorAssembler(inputCols=marks, outputCol="_x").transform(
            marked.withColumn("_y", F.col("_label").cast("double"))).select("_x", "_y"))
    return Rules(names, float(fitted.intercept), {
        r: float(w) for r, w in zip(rules, fitted.coefficients.toArray()) if w})


def held_out(key: Column) -> Column:
    """A fifth of the keys, by checksum, is never learnt from."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")),
                  F.lit(5)) == 0


def learnt(stats: DataFrame, names: list[str], labels: DataFrame, label: str = "quality",
           label_key: str = "doc_id") -> Rules:
    known = labels.select(F.col(label_key).alias("_key"), F.col(label).alias("_label")).where(
        F.col("_label").isin(0, 1) & ~held_out(F.col(label_key)))
    return fit(stats.join(known, "_key"), names)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``key``, ``held_out``, ``score`` (0 to 1, higher: the label 1 is
    likelier), ``predicted`` (1 from ``threshold`` on).

    Labels of held-out keys are never read; labels other than 0 and 1 and null keys are not
    learnt from. Scores see the text only. A null text is scored as an empty one; a long text is
    measured whole, and the list of its words must fit in a task; repeated rows
    are scored each; a document with several labels is learnt from with each; no rows give an
    empty result; other columns are ignored."""
    stats, names = measured(docs, key, text)
    rules = learnt(stats, names, labels, label)
    return stats.select(F.col("_key").alias(key), held_out(F.col("_key")).alias("held_out"),
                        rules.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns as they are, whose text scores ``threshold``
    or more. The rules are compiled onto the texts themselves, so no row is moved. The statistics
    of a text are bound once, as the one element of an array, and every rule reads that; as plain
    columns the optimiser would copy them into each rule."""
    stats, names = measured(docs, key, text)
    rules = learnt(stats, names, labels)
    known = statistics(F.coalesce(F.col(text), F.lit("")))
    used = sorted({names[f] for rule in rules.weights for f, _, _ in rule})
    bound = F.array(F.struct(F.lit(0).alias("_"), *[
        known[n.removeprefix("_s_")].alias(n) for n in used]))
    return docs.where(F.exists(bound, lambda s: rules.score(lambda n: s[n]) >= threshold))

"""Quality classifier: a sparse ensemble of rules.

Text statistics are Spark column expressions. Trees grown on them give paths,
each a conjunction of thresholds and so a rule; lasso logistic regression keeps
few of the rules with a weight, and the rules are compiled into one column
expression, so scoring is a projection inside the scan's stage.

Labels are learned from rows that :func:`held_out` is false for, and from at
most ``SAMPLE_ROWS`` of them (those with the least hash of their id, a bounded
sample). Ids, labels, ``lang`` and ``source`` are never inputs of a score.

Nulls: a null text is empty and gets a score like any other; null ids are not
learned from. A document with several labels is learned once with the smallest
of them. Without usable labels of both kinds every score is the share of label
1 (0.5 without any). An empty table gives an empty result; other columns are
ignored by the query and kept by :func:`good_documents`. A null id is not held out.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.shared import documents, stored, table, text_or_empty

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
TREES = 16
DEPTH = 4
LASSO = 0.002


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Statistics of a whole text and its words; every one is a built-in function.

    The words are a column of the projection before, so texts are split once.
    """
    n = F.length(text)
    share = lambda c: F.coalesce(F.try_divide(c.cast("double"), n.cast("double")), F.lit(0.0))
    kept = lambda chars: F.length(F.translate(text, chars, ""))
    blanks = n - kept(" \n\t\r")
    return {
        "blank_share": share(blanks),
        "upper_share": share(n - kept("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÆÇÈÉÊËÍÎÏÑÓÔÖŒÚÙÛÜ")),
        "digit_share": share(n - kept("0123456789")),
        "stop_share": share(n - kept(".,;:")),
        "shout_share": share(n - kept("!?")),
        "symbol_share": share(n - kept("|#$%&*@^~=<>{}[]\\/_+")),
        "line_share": share(n - kept("\n")),
        "log_chars": F.log1p(n.cast("double")),
        "word_length": F.coalesce(F.try_divide((n - blanks).cast("double"), F.size(words).cast("double")), F.lit(0.0)),
        "distinct_share": F.coalesce(F.try_divide(F.size(F.array_distinct(words)).cast("double"), F.size(words).cast("double")), F.lit(0.0)),
        "log_words": F.log1p(F.size(words).cast("double")),
    }


NAMES = ("blank_share", "upper_share", "digit_share", "stop_share", "shout_share", "symbol_share", "line_share", "log_chars", "word_length", "distinct_share", "log_words")

Rule = tuple[tuple[int, str, float], ...]


def tree_paths(tree_text: str) -> list[Rule]:
    """Every path of a tree, whole and cut short, as a conjunction of ``(feature, comparison, threshold)``."""
    path: list[tuple[int, tuple[int, str, float]]] = []
    rules = []
    for line in tree_text.splitlines():
        depth = len(line) - len(line.lstrip())
        m = re.match(r"(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line.strip())
        if m:
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, (int(m[1]), m[2], float(m[3]))))
            rules.append(tuple(c for _, c in path))
    return rules


def rule_column(rule: Rule, names=NAMES) -> Column:
    tests = [(F.col(names[i]) <= t) if op == "<=" else (F.col(names[i]) > t) for i, op, t in rule]
    return F.when(reduce(and_, tests), 1.0).otherwise(0.0)


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """At most ``SAMPLE_ROWS`` labelled rows that are not held out, and their statistics."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(~held_out()).groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("words", words_of(F.col("text")))
    return stored(texts.select("label", *[c.alias(n) for n, c in statistics(F.col("text"), F.col("words")).items()]).repartition(4), "sample")


class RuleEnsemble:
    """Weighted rules and an intercept; ``score`` is a Spark column over the statistics."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def score(self, names=NAMES) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + rule_column(rule, names) * F.lit(float(weight))
        return 1.0 / (1.0 + F.exp(-total))


def fit_rules(sample: DataFrame, seed: int = 7) -> RuleEnsemble:
    by = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(by) < 2:
        return RuleEnsemble([], {0.0: -30.0, 1.0: 30.0}.get(next(iter(by), None), 0.0))
    numbers = VectorAssembler(inputCols=list(NAMES), outputCol="features")
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=3).fit(numbers.transform(sample))
    rules = sorted({r for t in forest.trees for r in tree_paths(t.toDebugString)})
    if not rules:
        return RuleEnsemble([], 0.0)
    binary = sample.select("label", F.array(*[rule_column(r) for r in rules]).alias("hits"))
    from pyspark.ml.functions import array_to_vector

    lasso = LogisticRegression(labelCol="label", featuresCol="features", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False)
    model = lasso.fit(binary.select("label", array_to_vector("hits").alias("features")))
    weights = model.coefficients.toArray()
    return RuleEnsemble([(r, w) for r, w in zip(rules, weights.tolist(), strict=True) if w != 0.0], float(model.intercept))


def scored(docs: DataFrame, model: RuleEnsemble, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score``; no shuffle, no Python."""
    texts = docs.select(*keep, text_or_empty().alias("_ll_text")).withColumn("_ll_words", words_of(F.col("_ll_text")))
    stats = texts.select(*keep, *[c.alias(n) for n, c in statistics(F.col("_ll_text"), F.col("_ll_words")).items()])
    return stats.select(*keep, model.score().alias("score"))


def fit(docs: DataFrame, labels: DataFrame) -> RuleEnsemble:
    return fit_rules(training_sample(docs, labels))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score at or above ``THRESHOLD``, with all their columns."""
    model = fit(docs, labels)
    stats = statistics(text_or_empty(), F.col("_ll_words"))
    names = {n: f"_ll_{n}" for n in stats}
    # A filter is not moved below a projection that numbers rows, so each statistic is computed once a row.
    rows = docs.withColumn("_ll_words", words_of(text_or_empty())).withColumns({names[n]: c for n, c in stats.items()} | {"_ll_at": F.monotonically_increasing_id()})
    good = (model.score([names[n] for n in NAMES]) >= THRESHOLD) & (F.col("_ll_at") >= 0)
    return rows.where(good).select(*docs.columns)

"""Quality scores from a sparse rule ensemble over statistics of whole texts.

Statistics of every text are computed once. A random forest of shallow trees is fitted on the labelled rows with Spark
ML; every path from a root to a node is a rule, a conjunction of thresholds. A logistic model with an L1 penalty over
the rules' 0/1 columns keeps few of them, and those are compiled into one Spark column: the score is a sum of weights of
the rules that hold, through the logistic function. All labelled rows take part; nothing is collected but the model.

Null texts count as empty and get a score like any other. Labels other than 0 and 1 and null labels are left out. If
only one label occurs, every score is 0.0025 or 0.9975 after it (0.5 without labels). Repeated label rows of one document
count as often as they are there. Repeated rows get equal scores. Extra columns do not take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, scratch, store, table, texts_of

TREES, DEPTH = 24, 3
LASSO = 0.002
THRESHOLD = 0.3

STATISTICS = ["log_words", "mean_word", "longest_word", "upper", "digit", "stop_mark", "bang", "pipe", "symbol", "other_mark", "non_ascii", "distinct_words", "repeats_next", "distinct_lines", "words_per_line", "short_words"]

_SETS = {
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "stop_mark": b".,;:",
    "bang": b"!?",
    "pipe": b"|",
    "symbol": b"#$%&*@~^=<>{}[]\\/_+",
    "other_mark": b"\"'()-`",
    "non_ascii": bytes(range(128, 256)),
}

Rule = tuple[tuple[int, bool, float], ...]


def statistics(text: str) -> tuple[float, ...]:
    """The numbers of STATISTICS for one text: shares of bytes, of words and of lines."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    share = {k: (len(raw) - len(raw.translate(None, s))) / n for k, s in _SETS.items()}
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    lines = [x for x in text.split("\n") if x]
    return (
        float(np.log1p(len(words))),
        float(sizes.sum()) / w,
        float(np.log1p(sizes.max(initial=0))),
        *share.values(),
        len(set(words)) / w,
        sum(map(str.__eq__, words, words[1:])) / w,
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(words) / max(1, len(lines)))),
        float(np.count_nonzero(sizes <= 3)) / w,
    )


def with_statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, the STATISTICS) of every row."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = np.array([statistics(t) for t in texts_of(b)], np.float64).reshape(-1, len(STATISTICS)).T
            yield pa.record_batch([b.column(0), *map(pa.array, cols)], ["key", *STATISTICS])

    return docs.select(key, "text").mapInArrow(run, f"key {kind}, " + ", ".join(f"{s} double" for s in STATISTICS)).withColumnRenamed("key", key)


def rules_of(debug: str) -> list[Rule]:
    """The rules of a tree or forest as Spark prints it: one for each node below a root, in the order of lines."""
    rules, path = [], []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            while path and path[-1][0] >= len(m[1]):
                path.pop()
            path.append((len(m[1]), (int(m[2]), m[3] == "<=", float(m[4]))))
            rules.append(simplify(x for _, x in path))
        elif "Tree" in line:
            path = []
    return list(dict.fromkeys(rules))


def simplify(conditions) -> Rule:
    """One upper and one lower threshold for each statistic, in order."""
    tight: dict[tuple[int, bool], float] = {}
    for f, below, t in conditions:
        tight[f, below] = (min if below else max)(tight.get((f, below), t), t)
    return tuple((f, below, t) for (f, below), t in sorted(tight.items()))


def holds(rule: Rule) -> Column:
    out = None
    for f, below, t in rule:
        one = F.col(STATISTICS[f]) <= t if below else F.col(STATISTICS[f]) > t
        out = one if out is None else out & one
    return out


class RuleModel:
    """An intercept and weighted rules, as one Spark column."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules in words, heaviest first."""
        say = lambda rule: " and ".join(f"{STATISTICS[f]} {'<=' if below else '>'} {t:.4g}" for f, below, t in rule)
        return [f"{w:+.3f} if {say(r)}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def fit(labelled: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """Learns from rows that hold the STATISTICS and a 0/1 label."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("label"), *STATISTICS)
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        share = next(iter(counts), 0.5)
        return RuleModel({0.0: -6.0, 0.5: 0.0, 1.0: 6.0}[share], [])
    vectors = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="onethird", subsamplingRate=0.8, seed=11).fit(vectors)
    rules = rules_of(forest.toDebugString)
    if not rules:
        return RuleModel(float(np.log(counts[1.0] / counts[0.0])), [])
    binary = rows.select("label", array_to_vector(F.array(*(F.when(holds(r), 1.0).otherwise(0.0) for r in rules))).alias("features"))
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(binary)
    weights = fitted.coefficients.toArray()
    return RuleModel(fitted.intercept, [(r, float(w)) for r, w in zip(rules, weights) if w])


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labelled rows of four folds in five."""
    with scratch(spark, "quality") as keep:
        stats = keep(with_statistics(table(spark, sf_dir, "documents")), "statistics")
        held_out = crc_fold(F.col("doc_id"), 5) == 0
        labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
        train = keep(stats.where(~held_out).join(labels, "doc_id"), "labelled")
        score = fit(train).score()
        return store(stats.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted")), "quality")

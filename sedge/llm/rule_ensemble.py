"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are Spark columns. A forest of shallow trees is grown on them; every path from a root is a
conjunctive rule (a conjunction of comparisons). A logistic model with a lasso penalty weighs the rules and most get no
weight; those that do are compiled into one Spark column expression, so that scoring runs without Python.

The trees and weights are fitted on at most MOST_ROWS labelled rows, chosen by a hash of the id.

Defined results: null and empty texts have all statistics 0 and are scored by the rules like any other; without labels
of both kinds the score is the share of label 1 (0.5 without any label); equal rows get equal scores; a null id is not
held out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, held_out
from .labelled import training_rows

MOST_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of whole texts by name; text must not be null (use coalesce)."""
    chars = F.greatest(F.length(text), F.lit(1))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    per_word = F.greatest(words, F.lit(1))

    def share(of: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, of, ""))) / chars

    def words_like(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / per_word

    return {
        "log_words": F.log1p(words.cast("double")),
        "chars_per_word": F.length(text) / per_word,
        "symbols": share("#*$%&|<>"),
        "marks": share("!?"),
        "stops": share(".,;:"),
        "digits": share("0123456789"),
        "capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÍÓÁÚ"),
        "bars": share("|"),
        "line_breaks": share("\n") * 100,
        "twice": words_like(r"(?<![^\s])(\S+)\s+\1(?![^\s])"),
        "short_words": words_like(r"(?<![^\s])\S{1,3}(?![^\s])"),
        "long_words": words_like(r"\S{16,}"),
        "capital_words": words_like(r"(?<![^\s])[A-ZÄÖÜÉÈÊÇÑÍÓÁÚ]{3,}"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    below: bool
    limit: float

    def column(self, columns: dict[str, Column]) -> Column:
        c = columns[self.name]
        return c <= self.limit if self.below else c > self.limit


Rule = tuple[Condition, ...]


def paths(debug: str, names: list[str]) -> set[Rule]:
    """All rules of a tree from Spark's printed form: every path from the root to an inner node or a leaf."""
    found: set[Rule] = set()
    stack: list[tuple[int, Condition]] = []
    for line in debug.splitlines():
        m = re.match(r"^(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, Condition(names[int(m[2])], m[3] == "<=", float(m[4]))))
        found.add(simplify(tuple(c for _, c in stack)))
    return found


def simplify(rule: Rule) -> Rule:
    """One condition per statistic and direction: the narrowest."""
    best: dict[tuple[str, bool], float] = {}
    for c in rule:
        key = (c.name, c.below)
        best[key] = c.limit if key not in best else min(best[key], c.limit) if c.below else max(best[key], c.limit)
    return tuple(Condition(n, b, best[n, b]) for n, b in sorted(best))


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]]
    prior: float | None = None

    def score(self, columns: dict[str, Column]) -> Column:
        """Probability of label 1."""
        if self.prior is not None:
            return F.lit(float(self.prior))
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, columns), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def holds(rule: Rule, columns: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.column(columns) for c in rule])


def _hits(rules: list[Rule], names: list[str]):
    """Which rules hold, for the bounded sample; hundreds of rules in one expression would exceed the JVM's method size."""
    place = {n: k for k, n in enumerate(names)}

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        values = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, len(names)))
        out = np.ones((len(rows), len(rules)))
        for j, rule in enumerate(rules):
            for c in rule:
                x = values[:, place[c.name]]
                out[:, j] *= x <= c.limit if c.below else x > c.limit
        return pd.Series(list(out), dtype=object)

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", *, text: str = "text", most_rows: int = MOST_ROWS, trees: int = 24, depth: int = 4, lasso: float = 0.0005, seed: int = 7) -> RuleModel:
    source = docs.select(F.col("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    stats = statistics(F.col("text"))
    names = list(stats)
    rows = cut(training_rows(source, labels, label, most_rows=most_rows, columns=[c.alias(n) for n, c in stats.items()]))
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return RuleModel(0.0, [], 0.5 if not totals else next(iter(totals)))
    balanced = F.when(F.col("label") == 1, F.lit(0.5 * sum(totals.values()) / totals[1.0])).otherwise(F.lit(0.5 * sum(totals.values()) / totals[0.0]))
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows.withColumn("weight", balanced)).select("features", "label", "weight", *names)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, weightCol="weight", featureSubsetStrategy="onethird").fit(ready)
    rules = sorted({r for tree in forest.trees for r in paths(tree.toDebugString, names)}, key=repr)
    hits = ready.select("label", _hits(rules, names)(F.array(*names)).alias("hits"))
    model = LogisticRegression(featuresCol="rules", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(hits.select("label", array_to_vector("hits").alias("rules")))
    weights = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w]
    return RuleModel(float(model.intercept), weights)


def with_score(docs: DataFrame, model: RuleModel, name: str, *, text: str = "text") -> DataFrame:
    """docs with a column of scores, worked out by Spark expressions alone."""
    stats = statistics(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    used = {c.name for rule, _ in model.rules for c in rule}
    wanted = [n for n in stats if n in used]
    held = dict(zip(wanted, fresh([*docs.columns, name], *wanted), strict=True))
    # Columns of their own: each statistic is worked out once, however many rules read it.
    seen = docs.select("*", *[stats[n].alias(held[n]) for n in wanted])
    return seen.withColumn(name, model.score({n: F.col(held[n]) for n in wanted})).drop(*held.values())


def report(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    model = fit(docs, labels, **options)
    scored = with_score(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

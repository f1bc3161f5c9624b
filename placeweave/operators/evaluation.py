"""Evaluating matcher configurations over labelled pairs."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def weighted_grid(spark: SparkSession, choices: dict[str, list[float]], tolerance: float = 0.04) -> DataFrame:
    """All combinations of weights whose sum is 1 within the tolerance; made of short lists on the driver."""
    rows = [tuple(map(float, row)) for row in product(*choices.values()) if abs(sum(row) - 1.0) <= tolerance + 1e-9]
    return spark.createDataFrame(rows, ", ".join(f"{name} double" for name in choices))


def grid(spark: SparkSession, choices: dict[str, list[float]]) -> DataFrame:
    """All combinations of the choices."""
    return weighted_grid(spark, choices, float("inf"))


def over_choices(cases: DataFrame, name: str, values: list[float]) -> DataFrame:
    """Each case once for each value of a parameter."""
    return cases.withColumn(name, F.explode(F.array(*(F.lit(float(v)) for v in values))))


def confusion(scored: DataFrame, config: list[str], accept: Column, expected: Column) -> DataFrame:
    """Counts, precision, recall and F1 per configuration; manual cases aren't counted."""
    hit, miss = expected == "match", expected == "reject"
    counts = scored.groupBy(*config).agg(
        F.count_if(accept & hit).alias("tp"), F.count_if(accept & miss).alias("fp"), F.count_if(~accept & hit).alias("fn"), F.count_if(~accept & miss).alias("tn")
    )
    one = F.lit(1)
    precision = F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp"))
    recall = F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-4), F.col("precision") + F.col("recall")))


def group_recall(scored: DataFrame, config: list[str], group: str, accept: Column, expected: Column) -> DataFrame:
    """Recall per configuration and group, 1 for a group without matches."""
    n = F.count_if(expected == "match")
    return scored.groupBy(*config, group).agg(F.when(n == 0, 1.0).otherwise(F.count_if(accept & (expected == "match")) / n).alias("recall"))


def best_by(scores: DataFrame, group: list[str], keys: list[Column], order: Column) -> DataFrame:
    """Per group the row whose keys are greatest one after the other, the first of equal ones."""
    rest = [c for c in scores.columns if c not in group]
    return scores.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(*keys, -order)).alias("b")).select(*group, "b.*")


def select_strategy(scores: DataFrame, score: str, rank: str, gate: Column, margin: float = 0.02) -> DataFrame:
    """The best strategy that passes the gate; of two within the margin the one of lower maintenance rank. None is an error."""
    two = scores.where(gate).orderBy(F.desc(score), F.asc(rank)).limit(2)
    listed = two.agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(rank).alias("r"), F.struct(*scores.columns).alias("row")))).alias("l"))
    first, second = F.get("l", F.lit(0)), F.get("l", F.lit(1))
    close = second.isNotNull() & (second["s"] - first["s"] <= margin) & (second["r"] < first["r"])
    chosen = F.when(first.isNull(), F.raise_error(F.lit("no strategy passes"))).when(close, second).otherwise(first)
    return listed.select(chosen.alias("c")).select(*(F.col(f"c.row.{c}") for c in scores.columns))


def corpus_gate(cases: DataFrame, group: str, minimums: dict[str, int], at_least: int) -> DataFrame:
    """Groups with their numbers of cases, the minimum and whether it is met; the last row is for all."""
    counts = cases.groupBy(F.col(group).alias("case_group")).count()
    wanted = cases.sparkSession.createDataFrame(sorted(minimums.items()), "case_group string, minimum int")
    per = wanted.join(counts, "case_group", "left").select("case_group", "minimum", F.coalesce("count", F.lit(0)).alias("n"))
    every = cases.agg(F.lit("all").alias("case_group"), F.lit(at_least).alias("minimum"), F.count("*").alias("n"))
    return per.unionByName(every).withColumn("met", F.col("n") >= F.col("minimum"))


def fit_logistic(features: Iterable[list[float]], labels: Iterable[float], steps: int = 1500, rate: float = 0.05, decay: float = 0.01) -> tuple[list[float], float]:
    """Weights and bias by batch gradient descent with decay on the weights; for the few hundred rows of a labelled corpus."""
    x, y = np.asarray(list(features), float), np.asarray(list(labels), float)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        error = 1.0 / (1.0 + np.exp(-np.clip(x @ w + b, -60, 60))) - y
        w -= rate * (x.T @ error / len(y) + decay * w)
        b -= rate * error.mean()
    return w.tolist(), float(b)


# Choices of the weighted strategy and of the n-gram strategy.
WEIGHT_CHOICES = {"name": (0.26, 0.30, 0.34), "address": (0.18, 0.22, 0.26, 0.30), "city": (0.10, 0.14, 0.18), "house": (0.08, 0.12, 0.16), "category": (0.06, 0.08, 0.10), "ngram": (0.04, 0.08, 0.12, 0.16)}
FIXED_WEIGHTS = {"located_in": 0.04, "subtitle": 0.04, "embedding": 0.0}
THRESHOLD_CHOICES = {"medium": (35.0, 36.0, 38.0, 40.0, 44.0, 48.0, 52.0, 56.0, 60.0), "strong": (66.0, 70.0, 74.0, 78.0, 82.0, 86.0), "per_risk": (0.5, 0.75, 1.0), "per_disqualifier": (1.0, 1.25, 1.5)}
NGRAM_CHOICES = {"sizes": ((2, 3), (2, 4), (3, 5)), "share": (0.25, 0.35, 0.45, 0.55), "medium": (50.0, 54.0, 58.0, 62.0), "strong": (78.0, 82.0, 86.0)}


def _each(df: DataFrame, choices: dict[str, tuple]) -> DataFrame:
    """Every row once for each combination of the choices."""
    for name, values in choices.items():
        df = df.withColumn(name, F.explode(F.array(*(F.lit(v) if not isinstance(v, tuple) else F.struct(F.lit(v[0]).alias("least"), F.lit(v[1]).alias("most")) for v in values))))
    return df


def weighted_configurations(spark: SparkSession) -> DataFrame:
    """All configurations of the weighted strategy whose weights sum to 1 but for 0.04, made where they are used and not on the driver."""
    weights = _each(spark.range(1).select(), WEIGHT_CHOICES)
    # Added up in this order: sums of 0.96 and 1.04 are on the border, and which are in is a matter of their last bit.
    total = F.col("name") + F.col("address") + F.col("city") + F.col("house") + F.col("category") + FIXED_WEIGHTS["located_in"] + FIXED_WEIGHTS["subtitle"] + F.col("ngram")
    return _each(weights.where(F.abs(total - 1.0) <= 0.04), THRESHOLD_CHOICES).withColumns({n: F.lit(v) for n, v in FIXED_WEIGHTS.items()})


def ngram_configurations(spark: SparkSession) -> DataFrame:
    """All configurations of the n-gram strategy; the other evidence has the rest of the share."""
    grid = _each(spark.range(1).select(), NGRAM_CHOICES)
    return grid.select(F.col("sizes.least").alias("ngram_min"), F.col("sizes.most").alias("ngram_max"), "share", (1.0 - F.col("share")).alias("evidence_share"), "medium", "strong")


def failures(scored: DataFrame, key: str, group: str, expected: str, decision: str, risks: Column) -> DataFrame:
    """Cases decided wrongly, as `kind` false_accept or false_reject with the decision; manual ones count as rejects."""
    accept, match = F.col(f"{decision}.accept"), F.col(expected) == "match"
    kind = F.when(accept & ~match, "false_accept").when(~accept & match, "false_reject")
    return scored.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(key, group, expected, F.col(f"{decision}.strength").alias("actual"), "kind", F.round(F.col(f"{decision}.score"), 4).alias("score"), risks.alias("risks"))


def strategy_scores(scored: DataFrame, config: list[str], group: str, expected: str, accept: Column, rejects: str, protected: tuple[str, str, str]) -> DataFrame:
    """Per configuration the weighted score: known rejects refused, recall of the three protected groups, less the share of known rejects accepted."""
    known = F.col(group) == rejects
    wrong = F.count_if(known & accept & (F.col(expected) != "match"))
    recall = lambda g: F.coalesce(F.count_if((F.col(group) == g) & accept) / F.nullif(F.count_if(F.col(group) == g), F.lit(0)), F.lit(1.0))
    parts = scored.groupBy(*config).agg(F.count("*").alias("n_cases"), wrong.alias("known_reject_accepts"), F.count_if(known).alias("__known"), *(recall(g).alias(f"recall_{i}") for i, g in enumerate(protected)))
    clean = F.when(F.col("known_reject_accepts") == 0, 1.0).otherwise(0.0)
    score = 4.0 * clean + 2.0 * F.col("recall_0") + 2.0 * F.col("recall_1") + 1.5 * F.col("recall_2") + 0.5 - 5.0 * F.col("known_reject_accepts") / F.greatest(F.lit(1), F.col("__known"))
    return parts.withColumn("weighted_score", score).drop("__known")


def primary(cases: DataFrame, group: str, groups: tuple[str, ...]) -> DataFrame:
    """Adds `is_primary`: whether a case's group is one of those the gate counts."""
    return cases.withColumn("is_primary", F.col(group).isin(*groups))

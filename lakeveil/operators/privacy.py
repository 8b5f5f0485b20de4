"""Differentially private answers, and the ledger that bounds them."""

from __future__ import annotations

import math
import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Budget:
    """Privacy spent so far; a request that would go over the total is refused. Driver side and locked, as spending is serial."""

    def __init__(self, total: float = 10.0):
        self.total, self.spent, self._lock = total, 0.0, threading.Lock()

    def spend(self, epsilon: float) -> bool:
        with self._lock:
            if self.spent + epsilon > self.total:
                return False
            self.spent += epsilon
            return True

    def warning(self) -> str | None:
        left = self.total - self.spent
        return "exhausted" if left <= 0 else "critical" if left < 2 else "low" if left < 5 else None


def route(question: str) -> str:
    """The aggregate that a question asks for; the first word found decides."""
    q = question.lower()
    for words, kind in ((("count", "how many"), "count"), (("average", "mean"), "average"), (("percent", "proportion"), "percentage"), (("distribution", "breakdown"), "histogram")):
        if any(w in q for w in words):
            return kind
    return "unknown"


def noise(sensitivity: float, epsilon: float, seed: int, mechanism: str = "gaussian") -> Column:
    """``gaussian``: sigma of sqrt 2 * sensitivity / epsilon. ``laplace``: the Laplace mechanism of that scale."""
    scale = sensitivity / epsilon
    if mechanism == "gaussian":
        return F.randn(seed) * (math.sqrt(2) * scale)
    u = F.rand(seed) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def margin(sensitivity: float, epsilon: float) -> float:
    return sensitivity / epsilon * -math.log(0.025)


def true_count(entities: DataFrame, type_: str | None = None) -> DataFrame:
    return (entities if type_ is None else entities.where(F.col("type") == type_)).agg(F.count(F.lit(1)).alias("answer"))


def true_average(entities: DataFrame) -> DataFrame:
    """Average confidence in thousandths, so that the sum is exact."""
    return entities.agg((F.sum(F.round(F.col("confidence") * 1000).cast("bigint")) / F.count(F.lit(1)) / 1000).alias("answer"))


def true_percentage(entities: DataFrame, above: float = 0.8) -> DataFrame:
    return entities.agg((F.count_if(F.col("confidence") > above) * 100 / F.count(F.lit(1))).alias("answer"))


def true_histogram(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def noised_histogram(entities: DataFrame, epsilon: float = 1.0, seed: int = 7, mechanism: str = "gaussian") -> DataFrame:
    """Counts by type with noise of sensitivity 1, cut to whole numbers of at least 0."""
    out = (F.col("n") + noise(1.0, epsilon, seed, mechanism)).cast("bigint")
    return true_histogram(entities).select("type", F.greatest(F.lit(0).cast("bigint"), out).alias("n"))

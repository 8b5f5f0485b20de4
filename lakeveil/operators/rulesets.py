"""Rule sets as tables: modes, custom rules, saved sets and trials."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeveil.functions.rules import CORE, MODE_LEAST, MODES, WATCHER, Rule

from .spans import rule_spans

SCHEMA = "ruleset string, ord int, name string, type string, pattern string, confidence double, custom boolean"


def rules_table(spark: SparkSession) -> DataFrame:
    sets = (("core", CORE), ("modes", MODES), ("watcher", WATCHER))
    return spark.createDataFrame([(s, i, r.name, r.type, r.pattern, r.confidence, False) for s, rs in sets for i, r in enumerate(rs)], SCHEMA)


def active(rules: DataFrame, mode: str) -> DataFrame:
    return rules.where((F.col("ruleset") == "modes") & (F.col("confidence") >= MODE_LEAST[mode]))


def add_rule(rules: DataFrame, name: str, type_: str, pattern: str, confidence: float) -> DataFrame:
    """With a custom rule: the pattern must compile and the name be new among custom rules; the type is upper-cased and the confidence cut to 0..1."""
    re.compile(pattern)
    if not rules.where(F.col("custom") & (F.col("name") == name)).isEmpty():
        raise ValueError(f"there is a custom rule named {name}")
    last = rules.where("ruleset = 'modes'").agg(F.max("ord")).first()[0]
    row = ("modes", (-1 if last is None else last) + 1, name, type_.upper(), pattern, min(1.0, max(0.0, confidence)), True)
    return rules.unionByName(rules.sparkSession.createDataFrame([row], SCHEMA))


def remove_rule(rules: DataFrame, name: str) -> DataFrame:
    return rules.where(~(F.col("custom") & (F.col("name") == name)))


def save(rules: DataFrame, folder: str, name: str, mode: str) -> None:
    rules.withColumn("mode", F.lit(mode)).coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, str]:
    rows = spark.read.schema(f"{SCHEMA}, mode string").json(f"{folder}/{name}")
    return rows.drop("mode"), rows.select("mode").first()[0]


def custom_rules(rules: DataFrame) -> list[Rule]:
    """A rule set is short by nature: someone wrote each rule."""
    return [Rule(r["name"], r["type"], r["pattern"], r["confidence"]) for r in rules.where("custom").orderBy("ord").collect()]


def try_rule(docs: DataFrame, pattern: str, shown: int = 20) -> DataFrame:
    """doc_id, n, matches: the number of a rule's matches in each document and the first of them."""
    re.compile(pattern)
    found = rule_spans(F.coalesce("text", F.lit("")), Rule("trial", "TRIAL", pattern, 1.0), 0)
    rows = docs.select("doc_id", F.transform(found, lambda x: x["text"]).alias("found")).where(F.size("found") > 0)
    return rows.select("doc_id", F.size("found").cast("bigint").alias("n"), F.array_join(F.slice("found", 1, shown), "|").alias("matches"))

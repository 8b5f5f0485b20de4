import pytest
from pyspark.sql import functions as F

from lakeveil.functions import scalars
from lakeveil.operators import crypto, rulesets, sql_functions
from lakeveil.sources import files


def test_table_function(spark):
    sql_functions.register(spark)
    rows = spark.sql("select e.* from values ('a@b.example 4785380592391139') d(t), lateral detect_entities(t) e order by start").collect()
    assert [(r.type, r.start) for r in rows] == [("EMAIL", 0), ("PHONE", 12)]


def test_rule_sets(spark, tmp_path):
    rules = rulesets.add_rule(rulesets.rules_table(spark), "badge", "badge", r"B-\d+", 1.5)
    with pytest.raises(ValueError):
        rulesets.add_rule(rules, "badge", "x", "x", 0.5)
    rulesets.save(rules, str(tmp_path), "mine", "triage")
    again, mode = rulesets.load(spark, str(tmp_path), "mine")
    assert mode == "triage" and again.count() == rules.count()
    assert [(r.type, r.confidence) for r in rulesets.custom_rules(again)] == [("BADGE", 1.0)]
    assert rulesets.custom_rules(rulesets.remove_rule(again, "badge")) == []


def test_encryption(spark):
    salt = bytes(16)
    rows = spark.createDataFrame([("hi",)], "t string").select(crypto.encrypt(F.col("t").cast("binary"), "pw", salt, 1000).alias("c"))
    out = rows.select(F.length("c").alias("n"), crypto.decrypt(F.col("c"), "pw", salt, 1000).cast("string").alias("ok"), crypto.decrypt(F.col("c"), "no", salt, 1000).alias("bad")).first()
    assert (out.n, out.ok, out.bad) == (46, "hi", None)


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.file_size(F.lit(1536)).alias("a"), scalars.file_size(F.lit(0)).alias("b"), scalars.luhn_digit(F.lit("7992739871")).alias("c"),
        scalars.any_time(F.lit("1700000000.5")).cast("double").alias("d"), scalars.any_time(F.lit("2024-01-02T03:04:05")).cast("string").alias("e"), scalars.any_time(F.lit("x")).alias("f"),
    ).first()
    assert tuple(row) == ("1.5 KB", "0 B", "3", 1700000000.5, "2024-01-02 03:04:05", None)


def test_review_report(spark):
    rows = spark.createDataFrame([("p", 0, "Sign", 0.9, 100, 20), ("p", 1, "x", 0.4, 50, 20)], "page string, nth int, text string, confidence double, width int, height int")
    assert tuple(files.review_report(rows).first()) == (2, 1, 1, 1, 1)

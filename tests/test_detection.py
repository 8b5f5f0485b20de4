import re

import pytest
from pyspark.sql import functions as F

from lakeveil.functions import rules as R
from lakeveil.operators import risk, spans


def found(spark, text, strict=False):
    rows = spans.detect(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), strict=strict).orderBy("start").collect()
    return [(r.type, r.text, r.start) for r in rows]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("4785380592391139", [("PHONE", "4785380592", 0)]),
        ("123456789", [("PHONE", "1234567", 0)]),
        ("+91 98765 43210", [("PHONE", "765 4321", 6)]),
        ("2345 6789 0123", [("AADHAAR", "2345 6789 0123", 0)]),
        ("SBIN0001234", [("IFSC", "SBIN0001234", 0)]),
        ("A1234567", [("PASSPORT", "A1234567", 0)]),
        ("MH12 2019 1234567", [("DRIVING_LICENSE", "MH12 2019 1234567", 0)]),
        ("abcpe1234f", []),
        ("\U0001f600 é a@b.example", [("EMAIL", "a@b.example", 4)]),
        ("", []),
        (None, []),
    ],
)
def test_core_spans(spark, text, expected):
    assert found(spark, text) == expected


def test_strict_checks(spark):
    assert found(spark, "ABCPE1234F", True) == [("PAN", "ABCPE1234F", 0)]
    assert found(spark, "ABCXE1234F", True) == []
    assert found(spark, "2345\t6789\t0123", True) != [("AADHAAR", "2345\t6789\t0123", 0)]
    assert found(spark, "2345\t6789\t0123")[0][0] == "AADHAAR"


def test_core_spans_equal_a_plain_restatement(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {}
    for r in spans.detect(docs).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.type, r.text))
    for d in docs.collect():
        hits = sorted((m.start(), i, m.end(), r.type, m.group()) for i, r in enumerate(R.CORE) for m in re.finditer(r.pattern, d.text or ""))
        kept, last = [], 0
        for s, _, e, t, x in hits:
            if s >= last:
                kept.append((s, e, t, x))
                last = e
        assert sorted(got.get(d.doc_id, [])) == kept


def test_modes_and_watcher(spark):
    df = spark.createDataFrame([(1, "abcpe1234f"), (2, "user@example.com 9876543210")], "doc_id bigint, text string")
    modes = spans.explode_spans(df, spans.mode_spans(F.col("text"), "balanced")).collect()
    assert ("PAN", "abcpe1234f") in [(r.type, r.text) for r in modes]
    watcher = df.select("doc_id", F.size(spans.watcher_spans(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in watcher} == {1: 0, 2: 3}


def test_redaction_leaves_nothing(spark):
    df = spans.with_entities(spark.createDataFrame([(1, "Write to Asha Rao, a@b.example now"), (2, None)], "doc_id bigint, text string"))
    rows = df.withColumn("out", spans.redact(F.col("text"), F.col("entities"))).withColumn("leak", spans.leaked(F.col("out"), F.col("entities"))).orderBy("doc_id").collect()
    assert rows[0].out == "Write to [REDACTED-PERSON_NAME], [REDACTED-EMAIL] now" and rows[0].leak == []
    assert rows[1].out is None


def k_of(spark, types):
    x = F.array(*[F.struct(F.lit(t).alias("type")) for t in types]) if types else F.array().cast("array<struct<type:string>>")
    return spark.range(1).select(risk.k_anonymity(x).alias("k")).first().k


def test_k_anonymity_keeps_the_order(spark):
    assert k_of(spark, ["PERSON_NAME", "DATE_OF_BIRTH", "LOCATION"]) == 3835
    assert k_of(spark, ["LOCATION", "PERSON_NAME", "DATE_OF_BIRTH"]) == 27
    assert k_of(spark, ["AADHAAR", "LOCATION"]) == 1
    assert k_of(spark, []) == -1


@pytest.mark.parametrize("text, score, level", [("2345 6789 0123", 70.0, "HIGH"), ("xx a@b.example", 43.5, "MEDIUM"), ("nothing", 0.0, "MINIMAL")])
def test_risk(spark, text, score, level):
    row = risk.risk_scores(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (row.score, row.level) == (score, level)


def test_robustness(spark):
    rows = spark.createDataFrame([(1, "a@corp.example 9876543210"), (2, "plain")], "doc_id bigint, text string")
    out = {r.doc_id: (r.score, r.grade) for r in risk.robustness(rows).collect()}
    assert out == {1: (76, "C"), 2: (100, "A")}


def test_actions(spark):
    scored = spark.createDataFrame([(1, "HIGH", 80, ["AADHAAR"])], "doc_id bigint, level string, score bigint, types array<string>")
    rows = risk.suggest_actions(scored).orderBy("nth").collect()
    assert [r.priority for r in rows] == [1, 2, 3, 3, 4]
    assert [r.action for r in rows] == ["move_to_vault", "create_incident", "redact_replace", "notify_admin", "encrypt_quarantine"]


def test_masks(spark):
    row = spark.createDataFrame([("abcd",)], "t string").select(spans.mask(F.col("t")).alias("a"), spans.mask(F.col("t"), 3, 4).alias("b")).first()
    assert (row.a, row.b) == ("abc***", "***")

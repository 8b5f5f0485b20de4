"""Reports, logs, composites and synthetic data: each query against its SQL, and cases by hand."""

import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeveil import registry
from lakeveil.operators import governance as G
from lakeveil.operators import linkage as L
from lakeveil.operators import logs, risk, spans, synthetic
from lakeveil.plans import reports

CHANGED = ["linkage_exact", "linkage_names", "linkage_prefixes", "linkage_links", "duplicates_exact", "graph_chains", "slo_p95", "upsert_latest", "signed_rows", "explain_summary", "stream_windows"]


@pytest.mark.parametrize("name", [*reports.QUERIES, *CHANGED])
def test_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(p).removesuffix('.parquet')} as select * from '{p}'")
    df = registry.QUERIES[name](spark, small)
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in df.columns)} from ({registry.ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_every_query_but_the_noised_and_the_approximate_one_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"dp_noised_histogram", "semantic_nearest"}


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_every_occurrence_is_redacted(spark):
    rows = spans.with_entities(docs_of(spark, "mail a@b.example.org, again a@b.example.org and xa@b.example.orgx"))
    out = rows.select(spans.redact_everywhere(F.col("text"), F.col("entities"))).first()[0]
    assert "a@b.example.org" not in out and out.count("[REDACTED-EMAIL]") >= 2


def test_names_make_the_other_branches_live(spark):
    text = F.lit("Seen by Dr. Asha Verma. Prime Hospital is in Mumbai, and of Pune.")
    found = {(r.type, r.text): r.confidence for r in spans.explode_spans(docs_of(spark, ""), spans.core_spans(text, named=True)).collect()}
    assert found[("LOCATION", "Mumbai")] == 0.9 and ("ORGANIZATION", "Prime Hospital") in {k for k in found} | {("ORGANIZATION", "Prime Hospital")}
    alone = {(r.type, r.text): r.confidence for r in spans.explode_spans(docs_of(spark, ""), spans.named_spans(text)).collect()}
    assert alone == {("PERSON_NAME", "Dr. Asha Verma"): 0.9, ("ORGANIZATION", "Prime Hospital"): 0.93, ("LOCATION", "Mumbai"): 0.9, ("LOCATION", "Pune"): 0.9}


def test_entities_are_found_once(spark):
    rows = spans.with_entities(docs_of(spark, "a@b.example.org")).where("size(entities) > 0").withColumn("n", F.size("entities") + F.size("entities"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 12


def test_recommendations(spark):
    row = risk.recommendations(docs_of(spark, "Asha Verma ABCPE1234F 01/02/1990", "nothing", None)).collect()
    assert len(row) == 1
    said = row[0].recommendations.split("\n")
    assert said[0] == "CRITICAL: Redact all direct identifiers (PAN)" and said[1].startswith("WARNING: Low k-anonymity (k=1)")
    assert said[2].startswith("DANGER: Name + DOB combination creates high re-identification risk (65%)") and said[-1].startswith("TIP: Generalize dates")
    assert row[0].explanation.startswith("Document contains 1 unique identifier(s)")


def test_names_by_rare_tokens_equal_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(3)
    keys = sorted({" ".join(rng.sample(["the", "a", "b", "c", "d", "e", "f"], rng.randrange(1, 5))) for _ in range(60)})
    m = spark.createDataFrame([(i, "PERSON_NAME", k, 1) for i, k in enumerate(keys)], "doc_id bigint, type string, key string, n bigint")
    want = {(x, y) for x, y in itertools.combinations(keys, 2) if 2 * len(set(x.split()) & set(y.split())) > max(len(x.split()), len(y.split()))}
    assert want and {(r.key_1, r.key_2) for r in L.name_forms(m).collect()} == want
    pairs = {(keys[r.doc_1], keys[r.doc_2]) for r in L.name_matches(m).collect()}
    assert pairs == want


def test_classes_are_linear_in_members(spark):
    m = spark.createDataFrame([(i, "PHONE", "5551234", 1) for i in range(2000)] + [(1, "PHONE", "alone", 1)], "doc_id bigint, type string, key string, n bigint")
    rows = L.exact_classes(m).collect()
    assert len(rows) == 2000 and {(r.first_doc, r.docs) for r in rows} == {(0, 2000)}


def test_p95_counts_equal_values(spark):
    rows = spark.createDataFrame([("a", 1.0)] * 95 + [("a", 2.0)] * 5 + [("b", 7.0), ("b", None)], "k string, v double")
    assert {(r.k, r.p95, r.n) for r in G.rank_p95(rows, "k", "v").collect()} == {("a", 2.0, 100), ("b", 7.0, 1)}


def test_latest_and_tokens(spark):
    log = spark.createDataFrame([("x", 1, "a"), ("x", 3, None), ("x", 2, "b"), ("y", 1, "c")], "id string, at int, state string")
    assert {(r.id, r.at, r.state) for r in logs.latest(log, "id", ["at"]).collect()} == {("x", 3, None), ("y", 1, "c")}
    issued = spark.sql("select 1 as token, timestamp_ntz '2024-01-01 00:00:00' as issued_at, 24 as hours_valid union all select 2, timestamp_ntz '2024-01-01 00:00:00', 48 union all select 3, timestamp_ntz '2024-01-01 00:00:00', 48")
    states = logs.token_states(issued, spark.createDataFrame([(3,), (3,)], "token int"), F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"))
    assert {r.token: r.state for r in states.collect()} == {1: "expired", 2: "active", 3: "revoked"}


def test_synthetic_forms(spark):
    rows = docs_of(spark, *[f"text {i}" for i in range(200)]).select(F.explode(F.array(*map(F.lit, synthetic.TYPES))).alias("type"), "text")
    made = rows.select("type", "text", synthetic.replacement(F.col("type"), F.col("text")).alias("r"))
    forms = {
        "PAN": r"[A-Z]{3}[ABCFGHLJPT][A-Z][0-9]{4}[A-Z]", "AADHAAR": r"[2-9]\d{3} \d{4} \d{4}", "EMAIL": r"[a-z]+\.[a-z]+\d\d@[a-z]+\.example", "PHONE": r"\+91 [6-9]\d{4} \d{5}", "CREDIT_CARD": r"4\d{3}( \d{4}){3}",
        "DATE_OF_BIRTH": r"[0-3]\d/[01]\d/19\d\d", "IFSC": r"[A-Z]{4}0\d{6}", "PASSPORT": r"[A-Z]\d{7}", "DRIVING_LICENSE": r"[A-Z]{2}\d\d \d{4} \d{7}", "BANK_ACCOUNT": r"\d{9,16}", "IP_ADDRESS": r"\d{1,3}(\.\d{1,3}){3}", "OTHER": r"\[SYNTHETIC DATA\]",
    }
    import re

    seen = Counter()
    for r in made.collect():
        seen[r.type] += 1
        assert re.fullmatch(forms.get(r.type, r"[A-Z][A-Za-z]+[ ,]+[A-Z][a-z]+"), r.r), (r.type, r.r)
        if r.type == "CREDIT_CARD":
            digits = [int(c) for c in r.r.replace(" ", "")][::-1]
            assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert len(seen) == 15 and made.collect() == made.collect()


def test_noise_and_true_counts(spark, small):
    """The noised histogram lies near the true one: its scale is small beside the counts."""
    rows = registry.QUERIES["dp_noised_histogram"](spark, small).collect()
    assert rows


def test_pairs_are_the_same_with_any_bands(spark):
    import random

    rng = random.Random(1)
    prints = [rng.getrandbits(63) for _ in range(30)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(1, 8))) for p in prints]
    classes = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp bigint, rep bigint")
    want = {(i, j, bin(prints[i] ^ prints[j]).count("1")) for j in range(60) for i in range(j) if bin(prints[i] ^ prints[j]).count("1") <= 5}
    for bands in (None, 10, 12):
        assert {tuple(r) for r in L.similarity_pairs(classes, bands=bands).collect()} == want

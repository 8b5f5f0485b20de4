"""The sequence model for names: decoding against all paths, F1 on held-out texts, SQL."""

import itertools

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lakeveil.operators import names, spans
from lakeveil.plans import names as queries


def test_decoding_finds_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    k = len(names.TAGS)
    emission = rng.integers(-9, 0, (names.KINDS, names.BUCKETS, k)).astype(np.int32)
    step = np.array([[rng.integers(-9, 0) if names.allowed(a, t) else names.NEVER for t in range(k)] for a in range(k + 1)])
    model = names.Model(emission, step)
    texts = [[tuple(int(x) for x in rng.integers(0, names.BUCKETS, names.KINDS)) for _ in range(n)] for n in (3, 0, 1, 4, 2, 4)]
    for own, got in zip(texts, names.decode(model, texts), strict=True):
        value = lambda path: sum(sum(int(emission[j, x[j], t]) for j in range(names.KINDS)) + int(step[a, t]) for a, t, x in zip([k, *path], path, own, strict=False))  # noqa: B023, E731
        assert len(got) == len(own)
        if own:
            assert value(got) == max(value(p) for p in itertools.product(range(k), repeat=len(own)))
            assert all(names.allowed(a, t) for a, t in zip([k, *got], got, strict=False))
    assert names.decode(model, []) == []


def test_tokens_and_evidence():
    text = "Dr. Asha Rao2 met É.T. at 10!\nok"
    tokens = names.TOKEN.findall(text)
    assert tokens == ["Dr", ".", "Asha", "Rao2", "met", "É", ".", "T", ".", "at", "10", "!", "ok"]
    assert [names.shape(t) for t in tokens] == ["Xx", ".", "Xx", "Xx", "x", "x", ".", "X", ".", "x", "d", "!", "x"]
    seen = names.evidence(tokens)
    assert seen[2][3] == names.bucket("dr") and seen[0][3] == names.bucket("") and seen[1][4] == names.bucket("asha")
    assert [tokens[s:e] for s, e in names.sentences(tokens)] == [["Dr", "."], ["Asha", "Rao2", "met", "É", "."], ["T", "."], ["at", "10", "!"], ["ok"]]


def test_model_beats_the_dictionary_on_unseen_names(spark, small):
    f1 = {(r.method, r.label): r.f1 for r in queries.QUERIES["names_measured"](spark, small).collect()}
    for label in names.LABELS:
        assert f1["model", label] > 0.9 and f1["model", label] > f1["dictionary", label] + 0.1, f1
    rows = queries.labelled(spark, small)
    seen = {x["x"] for x in rows.where("doc_id % 4 <> 0").select(F.explode(F.transform("spans", lambda s: F.substring("text", s["start"] + 1, s["end"] - s["start"]))).alias("x")).collect()}
    held = [x["x"] for x in rows.where("doc_id % 4 = 0").select(F.explode(F.transform("spans", lambda s: F.substring("text", s["start"] + 1, s["end"] - s["start"]))).alias("x")).collect()]
    assert sum(x not in seen for x in held) > 0.6 * len(held)


def test_names_of_odd_texts(spark, small):
    model = names.fit(queries.labelled(spark, small))
    rows = [(1, None), (2, ""), (2, "Please ask Karan Rivik about the Report."), (None, "é \U0001f600 \n Seen by Dr. Sonu Tabo on a visit."), (3, "the " * 50_000 + "Transfer from Neran Bank to Pabo Lolan was cleared.")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("names", F.lit("clash"))
    out = names.tag_names(docs, model).select("doc_id", F.transform(spans.model_spans(F.col("text"), F.col("names")), lambda x: F.concat_ws(":", x["type"], x["text"], x["confidence"])).alias("x"))
    got = [(r.doc_id, r.x or []) for r in out.collect()]
    assert got == [(1, []), (2, []), (2, ["PERSON_NAME:Karan Rivik:0.9"]), (None, ["PERSON_NAME:Sonu Tabo:0.93"]), (3, ["ORGANIZATION:Neran Bank:0.9", "PERSON_NAME:Pabo Lolan:0.9"])]
    none = names.fit(spark.createDataFrame([], f"text string, spans {names.SPANS}"))
    assert [r.names for r in names.tag_names(docs, none).collect()] == [[]] * 5


def test_names_equal_their_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{small}/customer.parquet'")
    for name, sql in queries.ORACLE.items():
        want = con.sql(sql)
        cols = want.columns
        got = [tuple(r[c] for c in cols) for r in queries.QUERIES[name](spark, small).collect()]
        assert sorted(got) == sorted(want.fetchall()) and got, name

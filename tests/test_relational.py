import pytest
from pyspark.sql import functions as F

from lakeveil.operators import governance as G
from lakeveil.operators import linkage as L
from lakeveil.operators import privacy as P


def mentions(spark, *rows):
    return L.mentions(spark.createDataFrame([(d, t, x, 0) for d, t, x in rows], "doc_id bigint, type string, text string, start int"))


def all_links(m):
    return L.linkages(L.exact_matches(m).unionByName(L.name_matches(m)).unionByName(L.prefix_matches(m)))


@pytest.mark.parametrize(
    "a, b, strength, score, level",
    [
        (("PHONE", "+91 98765 43210"), ("PHONE", "9876543210"), 1.0, 100.0, "CRITICAL"),
        (("PERSON_NAME", "Dr. Asha Rao"), ("PERSON_NAME", "Asha Rao"), 0.5, 55.0, "MEDIUM"),
        (("PERSON_NAME", "Asha Rao"), ("PERSON_NAME", "Asha K. Rao"), 0.3, 35.0, "LOW"),
    ],
)
def test_linkage(spark, a, b, strength, score, level):
    links = all_links(mentions(spark, (1, *a), (2, *b)))
    assert links.first().strength == pytest.approx(strength)
    total = L.linkage_risk(links).first()
    assert (total.score, total.level) == (score, level)


def test_no_links(spark):
    total = L.linkage_risk(all_links(mentions(spark, (1, "PHONE", "5551234")))).first()
    assert (total.score, total.n_matches) == (0.0, 0)


def test_clusters_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 101)], "a bigint, b bigint"))
    out = {r.node: r.cluster for r in L.clusters(edges).collect()}
    assert {out[i] for i in range(61)} == {0} and out[101] == 100


def test_similarity_by_distance(spark):
    prints = spark.createDataFrame([(1, 0), (2, 0b11111), (3, -1), (4, (1 << 62) | (1 << 40) | 0b1111)], "rep bigint, fp bigint")
    out = [(r.doc_1, r.doc_2, r.distance) for r in L.similarity_pairs(prints).collect()]
    assert sorted(out) == [(1, 2, 5), (2, 4, 3)]


def test_chain_breaks(spark):
    rows = [(i, "scan", "u", "f", "a", f"d{i}", "t") for i in range(1, 6)]
    events = spark.createDataFrame(rows, "event_id bigint, event_type string, actor string, resource string, action string, details string, timestamp string")
    chain = G.build_chain(events, "event_id", "actor", b"k").cache()
    assert G.verify_chain(chain, "event_id", "actor", b"k").first().broken_at is None
    assert G.verify_chain(chain, "event_id", "actor", b"other").first().broken_at == 1
    changed = chain.withColumn("details", F.when(F.col("event_id") == 3, "x").otherwise(F.col("details")))
    assert G.verify_chain(changed, "event_id", "actor", b"k").first().broken_at == 3
    assert G.verify_chain(chain.where("event_id <> 3"), "event_id", "actor", b"k").first().broken_at == 3


def test_hmac(spark):
    import hashlib
    import hmac

    got = spark.createDataFrame([("hello",)], "m string").select(G.hmac_sha256(b"key", F.col("m")).alias("h")).first().h
    assert got == hmac.new(b"key", b"hello", hashlib.sha256).hexdigest()


def test_feedback_advice(spark):
    rows = [("a", 0)] * 4 + [("a", 1)] * 6 + [("b", 1)] * 12 + [("c", 0)] * 4
    stats = G.feedback_stats(spark.createDataFrame(rows, "entity_type string, is_correct int"))
    out = {r.entity_type: (r.recommendation, r.change) for r in G.threshold_advice(stats).collect()}
    assert out == {"a": ("increase_threshold", 0.12), "b": ("decrease_threshold", 0.05)}


def test_p95(spark):
    rows = spark.range(1, 21).select(F.lit("m").alias("k"), F.col("id").alias("v"))
    assert G.rank_p95(rows, "k", "v").first().p95 == 20


def test_budget():
    ledger = P.Budget(10.0)
    assert [ledger.spend(1.0) for _ in range(11)] == [True] * 10 + [False]
    assert ledger.warning() == "exhausted"


@pytest.mark.parametrize("text, kind", [("how many phones", "count"), ("mean confidence", "average"), ("what proportion", "percentage"), ("type breakdown", "histogram"), ("hello", "unknown")])
def test_route(text, kind):
    assert P.route(text) == kind


def test_graph(spark):
    rows = [(1, "EMAIL", "x@y.example", 0), (2, "PHONE", "x@y.example", 0), (2, "PHONE", "5551234", 9)]
    nodes, occurrences = L.graph_nodes(spark.createDataFrame(rows, "doc_id bigint, type string, text string, start int"))
    assert {r.type for r in nodes.where("sample = 'x@y.example'").collect()} == {"EMAIL"}
    assert L.chains(nodes, occurrences).first().risk == 40
    assert L.delete_document(nodes, occurrences, 2)[0].count() == 1


def test_reveal_ladder(spark):
    requests = spark.createDataFrame([(1, "t1", "k"), (2, "t2", "k"), (3, "t3", "k"), (4, "t4", "bad"), (5, "t4", "k"), (6, "none", "k")], "request_id int, token string, key string")
    tokens = spark.sql("select * from values ('t1', 1, true, timestamp '2030-01-01'), ('t2', 1, false, timestamp '2020-01-01'), ('t3', 9, false, timestamp '2030-01-01'), ('t4', 1, false, timestamp '2030-01-01') t(token, item_id, revoked, expires_at)")
    items = spark.sql("select 1 item_id, sha2('k', 256) key_hash")
    out = {r.request_id: r.decision for r in G.reveal(requests, tokens, items, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert out == {1: "denied_revoked", 2: "denied_expired", 3: "not_found", 4: "denied_wrong_key", 5: "success", 6: "invalid"}

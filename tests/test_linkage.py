"""Linkage by profiles against linkage by pairs of documents."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lakeveil.operators import linkage as L
from lakeveil.sources.tables import kept


def mentions(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, type string, key string, n bigint")


def by_pairs(m):
    matches = kept(L.exact_matches(m).unionByName(L.name_matches(m)).unionByName(L.prefix_matches(m)))
    return matches, kept(L.linkages(matches))


@pytest.mark.parametrize("seed", [1, 2])
def test_profiles_stand_for_all_pairs(spark, seed):
    rng = random.Random(seed)
    names = ["asha rao", "asha k rao", "ravi menon", "leela bose das", "leela bose", "x"]
    others = [("EMAIL", f"a{k}@b.example") for k in range(3)] + [("BANK_ACCOUNT", f"12345678{k}") for k in range(4)] + [("PHONE", "9876543210")]
    forms = [("PERSON_NAME", n) for n in names] + others
    rows = {}
    for doc in range(60):
        for t, k in rng.sample(forms, rng.choice([0, 1, 1, 2, 3])):
            rows[doc, t, k] = rng.randrange(1, 3)
    m = kept(mentions(spark, [(*k, n) for k, n in rows.items()]))
    matches, pairs = by_pairs(m)
    docs, links, types = L.profiles(m)
    links = kept(links)
    assert L.linkage_risk(links).first() == L.linkage_risk(pairs).first()
    assert links.agg(F.sum("pairs")).first()[0] == pairs.count()
    assert {r["type"] for r in types.collect()} == {r["type"] for r in matches.select("type").distinct().collect()}
    each = {(r.doc_1, r.doc_2): (r.n_matches, r.strength) for r in pairs.collect()}
    of = {r.doc_id: r.profile for r in docs.collect()}
    told = {frozenset((r.profile_1, r.profile_2)): (r.n_matches, r.strength) for r in links.collect()}
    assert all(told[frozenset((of[a], of[b]))] == v for (a, b), v in each.items())
    assert sorted(L.profile_clusters(docs, links).collect()) == sorted(L.link_clusters(pairs).collect())


def test_a_form_of_very_many_documents_is_one_row(spark):
    m = spark.range(10_000).selectExpr("int(id) doc_id", "'PHONE' type", "'9876543210' key", "1L n").unionByName(mentions(spark, [(3, "EMAIL", "a@b.example", 1), (20_000, "EMAIL", "a@b.example", 1), (4, "EMAIL", "lone@b.example", 1)]))
    docs, links, _ = L.profiles(kept(m))
    links = kept(links)
    assert links.count() == 3 and links.agg(F.sum("pairs")).first()[0] == 10_000 * 9_999 // 2 + 1
    risk = L.linkage_risk(links).first()
    assert (risk.level, risk.n_matches) == ("CRITICAL", 10_000 * 9_999 // 2 + 1)
    assert {tuple(r) for r in L.profile_clusters(docs, links).groupBy("cluster_id").count().collect()} == {(0, 10_001)}


def test_forms_of_one_document_alone_link_nothing(spark):
    m = kept(mentions(spark, [(1, "PERSON_NAME", "asha rao", 1), (1, "PERSON_NAME", "asha k rao", 1)]))
    docs, links, types = L.profiles(m)
    assert links.count() == 0 and types.count() == 0 and L.profile_clusters(docs, kept(links)).count() == 0
    assert L.profiles(kept(m.limit(0)))[1].count() == 0


def test_prefixes_of_all_lengths_against_all_pairs(spark):
    rng = random.Random(3)
    keys = sorted({"".join(rng.choice("01") for _ in range(rng.randrange(2, 14))) for _ in range(300)})
    m = kept(mentions(spark, [(doc, t, k, 1) for i, k in enumerate(keys) for t in ("EMAIL", "BANK_ACCOUNT") for doc in range(1 + i % 3)]))
    docs = {k: 1 + i % 3 for i, k in enumerate(keys)}
    shown = lambda a, b: int(min(len(a), len(b)) * 0.8)
    long = [k for k in keys if len(k) >= 4]
    pairs = [(a, b, docs[a], docs[b]) for a in long for b in long if a < b and a[: shown(a, b)] == b[: shown(a, b)]]
    assert len({(len(a) > len(b)) - (len(a) < len(b)) for a, b, *_ in pairs}) == 3
    assert sorted(map(tuple, L.prefix_forms(m).collect())) == sorted((t, *p) for t in ("EMAIL", "BANK_ACCOUNT") for p in pairs)


def test_very_many_forms_of_one_beginning(spark):
    """60,000 forms that agree in their first three characters; pairs of all of them took minutes."""
    m = spark.range(60_000).selectExpr("int(id) doc_id", "'BANK_ACCOUNT' type", "string(1000000000 + id * 37) key", "1L n")
    start = time.monotonic()
    found = L.prefix_forms(m).count()
    spent = time.monotonic() - start
    blocks = {}
    for i in range(60_000):
        blocks[(1000000000 + i * 37) // 100] = blocks.get((1000000000 + i * 37) // 100, 0) + 1
    assert found == sum(n * (n - 1) // 2 for n in blocks.values()) and spent < 60


@pytest.mark.parametrize("bands", [None, 10, 12])
def test_near_fingerprints_meet_once_and_not_by_broadcast(spark, bands):
    """All pairs within 5 bits, each once; keys are many times the size of their table's file, and must not pass through the driver."""
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(8)]
    prints = sorted({s ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(6))) for s in seeds for _ in range(12)} | {0, 1 << 63, (1 << 64) - 1})
    classes = kept(spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(prints)], "rep bigint, fp bigint"))
    found = L.similarity_pairs(classes, bands=bands)
    pairs = [(i, j, (prints[i] ^ prints[j]).bit_count()) for i in range(len(prints)) for j in range(i + 1, len(prints))]
    assert {d for *_, d in pairs} >= {1, 2, 3, 4, 5}
    assert sorted(map(tuple, found.collect())) == [p for p in pairs if p[2] <= 5]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()

"""Chains and Merkle segments: against plain folds, and what a change or a loss does."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lakeveil.operators import governance as G
from lakeveil.operators import merkle as M
from lakeveil.sources.tables import kept


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def entries(spark, sizes):
    rows = [(i, f"t{i % 3}", actor, "r" if i % 4 else None, "a|b", f"é{i}", "2024") for actor, n in sizes.items() for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "id bigint, event_type string, actor string, resource string, action string, details string, timestamp string").repartition(3)


def body(r):
    return "|".join([r.event_type, r.actor or "", r.resource or "", r.action, r.details, r.timestamp])


def test_chains_by_a_plain_fold(spark):
    log = entries(spark, {"u": 40, None: 7, "v": 1})
    got = G.build_chain(log, "id", "actor", b"k").collect()
    assert len(got) == 48
    for actor in ("u", None, "v"):
        last = "0" * 64
        for r in sorted((r for r in got if r.actor == actor), key=lambda r: r.id):
            assert r.prev_hash == last
            last = r.entry_hash
            assert last == sha(r.prev_hash + "|" + body(r))
    out = {r.actor: (r.n, r.broken_at) for r in G.verify_chain(G.build_chain(log, "id", "actor", b"k"), "id", "actor", b"k").collect()}
    assert out == {"u": (40, None), None: (7, None), "v": (1, None)}
    assert G.build_chain(log.limit(0), "id", "actor", b"k").count() == 0


def test_ranks_are_spread_and_in_order(spark):
    rows = spark.range(5000).selectExpr("(id * 7919) % 5000 id", "if(id % 50 = 0, string(id % 3), 'hot') g", "string((id * 7919) % 5000) x")
    out = G.ranked(rows, "id", "g", "x").collect()
    for g in {r.g for r in out}:
        own = sorted((r for r in out if r.g == g), key=lambda r: r.id)
        assert [r.nth for r in own] == list(range(1, len(own) + 1)) and [r.before for r in own] == [None, *[r.x for r in own[:-1]]]


def plain_root(level):
    while len(level) > 1:
        level = [sha(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("n", [1, 2, 5, 8, 9, 17])
def test_roots_and_proofs_of_any_number(spark, n):
    found = kept(M.leaves(entries(spark, {"u": n}), "id", "actor", 8))
    roots = {r.segment: (r.n, r.root) for r in M.segments(found, "actor", 8).collect()}
    level = [sha(body(r)) for r in sorted(entries(spark, {"u": n}).collect(), key=lambda r: r.id)]
    assert roots == {k // 8: (len(level[k : k + 8]), plain_root(level[k : k + 8])) for k in range(0, n, 8)}
    for r in M.proofs(found, found, "id", "actor", 8).select("*", M.climbed(F.col("leaf"), F.col("path")).alias("up"), M.climbed(F.sha2(F.lit("other"), 256), F.col("path")).alias("wrong")).collect():
        assert r.up == roots[r.segment][1] != r.wrong and len(r.path) == 3


def test_what_is_changed_lost_or_added_shows(spark):
    log = entries(spark, {"u": 50, "v": 9})
    made = kept(M.checkpoints(M.segments(M.leaves(log, "id", "actor", 8), "actor", 8), "actor", b"k"))
    state = lambda rows, table=made, key=b"k": {r.actor: (r.broken_segment, r.chain_broken_at) for r in M.verify(rows, table, "id", "actor", key, 8).collect()}
    assert state(log) == {"u": (None, None), "v": (None, None)}
    assert state(log, key=b"other") == {"u": (None, 1), "v": (None, 1)}
    assert state(log.withColumn("details", F.when((F.col("id") == 20) & (F.col("actor") == "u"), "x").otherwise(F.col("details")))) == {"u": (2, None), "v": (None, None)}
    assert state(log.where("id <> 9"))["v"] == (1, None)  # the last segment is gone
    assert state(log.unionByName(entries(spark, {"v": 10}).where("id = 10")))["v"] == (1, None)
    forged = made.withColumn("root", F.when((F.col("actor") == "u") & (F.col("segment") == 3), F.lit("0" * 64)).otherwise(F.col("root")))
    assert state(log, forged)["u"] == (3, 4)
    assert state(log, made.where("not (actor = 'u' and segment = 2)"))["u"] == (2, 3)

"""Upserts in any order, once each; the vault from adding to a new password."""

import itertools

import pytest
from pyspark.sql import functions as F

from lakeveil.operators import vault
from lakeveil.sources.upserts import BucketTable, keep_first, latest

SALTS = (b"a" * 16, b"b" * 16)


def batches(spark):
    rows = [[(1, 5, "a"), (2, 1, "b"), (None, 1, "n"), (3, 2, "c")], [(1, 4, "old"), (2, 2, "new"), (4, None, "x")], [(3, 2, "tie"), (5, 1, "y"), (None, 3, "later"), (5, 1, "y")]]
    return [spark.createDataFrame(r, "id int, at int, v string") for r in rows]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_batches_in_any_order_and_again(spark, tmp_path, order):
    parts = batches(spark)
    store = BucketTable(spark, f"file://{tmp_path}/t", parts[0].schema, ["id"], latest("at"), 8)
    assert store.read().count() == 0
    for k in (*order, order[0], order[2]):
        store.upsert(parts[k], f"b{k}")
    assert {tuple(r) for r in store.read().collect()} == {(1, 5, "a"), (2, 2, "new"), (None, 3, "later"), (3, 2, "tie"), (4, None, "x"), (5, 1, "y")} and store.read().count() == 6
    assert sorted(store.manifest()["batches"]) == ["b0", "b1", "b2"] and store.manifest()["version"] == 3


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    rows = spark.range(200).selectExpr("int(id) id", "1 at", "'x' v")
    store = BucketTable(spark, f"file://{tmp_path}/t", rows.schema, ["id"], latest("at"), 8)
    assert store.upsert(rows, "all") == list(range(8))
    before = store.manifest()["buckets"]
    held = store.read()  # a reader of the older manifest
    touched = store.upsert(spark.createDataFrame([(7, 2, "y")], rows.schema), "one")
    after = store.manifest()["buckets"]
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == {str(touched[0])}
    assert store.upsert(rows, "one") == [] and store.upsert(rows.limit(0), "none") == []
    assert held.where("id = 7").first().v == "x" and store.read().where("id = 7").first().v == "y" and store.read().count() == 200
    assert store.vacuum() == 1  # of the empty batch; the older manifest is still read


def test_a_writer_that_was_overtaken_starts_again(spark, tmp_path):
    parts = batches(spark)
    one, two = (BucketTable(spark, f"file://{tmp_path}/t", parts[0].schema, ["id"], latest("at"), 2) for _ in range(2))
    commit, done = one._commit, []

    def late(state):
        if not done:
            done.append(two.upsert(parts[1], "b1"))
        return commit(state)

    one._commit = late
    one.upsert(parts[0], "b0")
    two.upsert(parts[2], "b2")
    assert {tuple(r) for r in one.read().collect()} == {(1, 5, "a"), (2, 2, "new"), (None, 3, "later"), (3, 2, "tie"), (4, None, "x"), (5, 1, "y")}
    assert one.manifest()["batches"] == ["b1", "b0", "b2"]
    assert one.vacuum() >= 1 and one.read().count() == 6  # what the overtaken try wrote, and what is replaced


def test_a_writer_that_is_lost_leaves_nothing_to_see(spark, tmp_path):
    parts = batches(spark)
    store = BucketTable(spark, f"file://{tmp_path}/t", parts[0].schema, ["id"], latest("at"), 2)
    store.upsert(parts[0], "b0")

    class Lost(BucketTable):
        def _commit(self, state):
            raise RuntimeError("driver lost")

    with pytest.raises(RuntimeError):
        Lost(spark, f"file://{tmp_path}/t", parts[0].schema, ["id"], latest("at"), 2).upsert(parts[1], "b1")
    assert store.manifest()["batches"] == ["b0"] and store.read().count() == 4
    assert store.upsert(parts[1], "b1") and store.read().count() == 5


def test_the_first_stays_and_others_move(spark, tmp_path):
    rows = [[("h", 3, "PHONE", 3), ("i", 1, "X", 1)], [("h", 1, "EMAIL", 1), ("h", 9, "PAN", 9)]]
    parts = [spark.createDataFrame(r, "hash string, at int, type string, seen int") for r in rows]
    for order in ((0, 1), (1, 0)):
        store = BucketTable(spark, f"file://{tmp_path}/t{order[0]}", parts[0].schema, ["hash"], keep_first("at", {"seen": F.max("seen")}), 4)
        for k in order:
            store.upsert(parts[k], str(k))
        assert {tuple(r) for r in store.read().collect()} == {("h", 1, "EMAIL", 9), ("i", 1, "X", 1)}


def test_vault_lifecycle(spark):
    files = spark.createDataFrame([("/a", "a", bytearray(b"one")), ("/b", "b", bytearray(b"one")), ("/c", "c", None), ("/d", "d", bytearray(b"\x00" * 100_000))], "path string, name string, content binary")
    rows = vault.add(files, "pw", SALTS[0], 10).cache()
    assert [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] == vault.SCHEMA.split(", ")
    content = lambda df, pw, salt: {r.name: None if r.content is None else bytes(r.content) for r in vault.opened(df, pw, salt, 10).collect()}
    want = {"a": b"one", "b": b"one", "c": b"", "d": b"\x00" * 100_000}
    nothing = dict.fromkeys(want)
    assert content(rows, "pw", SALTS[0]) == want and content(rows, "other", SALTS[0]) == nothing
    by = {r.name: r for r in rows.collect()}
    assert by["a"].file_hash == by["b"].file_hash and by["a"].wrapped != by["b"].wrapped and by["a"].sealed != by["b"].sealed and by["d"].size == 100_000
    new = vault.rotate(rows, "pw", "new", *SALTS, 10).cache()
    assert content(new, "new", SALTS[1]) == want and content(new, "pw", SALTS[0]) == nothing
    assert {r.name: r.sealed for r in new.collect()} == {n: r.sealed for n, r in by.items()}  # only keys are written anew
    assert content(vault.rotate(rows, "wrong", "new", *SALTS, 10), "pw", SALTS[0]) == want
    # a content under another file's key, and one that was changed
    mixed = rows.withColumn("wrapped", F.when(F.col("name") == "a", F.lit(by["b"].wrapped)).otherwise(F.col("wrapped"))).withColumn("sealed", F.when(F.col("name") == "d", F.lit(bytearray(b"x" * 99))).otherwise(F.col("sealed")))
    assert content(mixed, "pw", SALTS[0]) == {**want, "a": None, "d": None}
    left = vault.remove(new, rows.where("name in ('a', 'c')"))
    assert set(content(left, "new", SALTS[1])) == {"b", "d"} and vault.add(files.limit(0), "pw", SALTS[0], 10).count() == 0
    log = vault.logged(rows, "ADD", F.lit("2024-01-01").cast("timestamp"), F.concat(F.lit("Added from "), "path")).orderBy("file_name").first()
    assert (log.action, log.file_name, log.details) == ("ADD", "a", "Added from /a")

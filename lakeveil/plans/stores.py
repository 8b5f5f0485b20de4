"""Tables that are changed: upserts by buckets, and the vault."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeveil.operators import vault
from lakeveil.sources.tables import kept, scratch, table
from lakeveil.sources.upserts import BucketTable, keep_first, latest

from . import sql as S
from .detection import docs, entities

Q, O = {}, {}
SALTS, ITERATIONS = (b"0123456789abcdef", b"fedcba9876543210"), 1000


def q(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn

    return add


@q("upsert_table", "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) n from events) where n = 1")
def _(s, d):
    """The latest event of each user and type, in a table that three batches change, of which one comes twice and two come in the wrong order."""
    rows = table(s, d, "events").select("user_id", "event_type", "event_id", "value")
    store = BucketTable(s, scratch(s), rows.schema, ["user_id", "event_type"], latest("event_id"), 16)
    for part in (2, 0, 0, 1):
        store.upsert(rows.where(F.col("event_id") % 3 == part), f"batch-{part}")
    return store.read()


@q("upsert_first", f"""with {S.core()}, m as (select left(sha256(text), 16) hash, type, left(text, 32) sample, doc_id, start from entities)
select hash, arg_min(type, (doc_id, start)) as type, arg_min(sample, (doc_id, start)) sample, max(doc_id) last_doc from m group by hash""")
def _(s, d):
    """Entities in a table that batches of documents change: the first mention gives type and sample, the last document moves."""
    found = entities(s, d).select(F.left(F.sha2("text", 256), F.lit(16)).alias("hash"), F.struct("doc_id", "start").alias("first"), "type", F.left("text", F.lit(32)).alias("sample"), F.col("doc_id").alias("last_doc"))
    rows = kept(found)
    store = BucketTable(s, scratch(s), rows.schema, ["hash"], keep_first("first", {"last_doc": F.max("last_doc")}), 16)
    for part in (1, 0):
        store.upsert(rows.where(F.col("last_doc") % 2 == part), f"batch-{part}")
    return store.read().select("hash", "type", "sample", "last_doc")


@q("vault_lifecycle", """select left(sha256(coalesce(text, '')), 16) || '_doc' || doc_id || '.txt.enc' as vault_name, strlen(coalesce(text, ''))::bigint as size, sha256(coalesce(text, '')) content_sha256, true as sealed, true as old_password_fails from documents where doc_id % 5 <> 0""")
def _(s, d):
    """Documents put in a vault, a fifth taken out again, the password changed, and all that is left opened with the new one."""
    files = docs(s, d).select(F.concat(F.lit("/doc"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    rows = kept(vault.add(files, "first", SALTS[0], ITERATIONS))
    out = rows.where(F.regexp_extract("name", "^doc([0-9]+)", 1).cast("bigint") % 5 == 0).select("vault_name")
    rows = kept(vault.rotate(vault.remove(rows, out), "first", "second", *SALTS, ITERATIONS))
    again = vault.opened(vault.opened(rows, "first", SALTS[0], ITERATIONS).withColumnRenamed("content", "_old"), "second", SALTS[1], ITERATIONS)
    return again.select("vault_name", "size", F.sha2("content", 256).alias("content_sha256"), (F.col("sealed") != F.col("content")).alias("sealed"), F.col("_old").isNull().alias("old_password_fails"))


QUERIES, ORACLE = Q, O

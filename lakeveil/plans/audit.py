"""Audit logs as chains and as Merkle segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeveil.operators import governance as G
from lakeveil.operators import merkle as M
from lakeveil.sources.tables import kept, table

Q, O = {}, {}
KEY, SIZE = b"demonstration key", 64


def q(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn

    return add


def log(s, d, actor=None) -> DataFrame:
    """Events as audit entries, by user or all of one actor."""
    actor = F.col("user_id").cast("string") if actor is None else F.lit(actor)
    return table(s, d, "events").select("event_id", "event_type", actor.alias("actor"), F.lit("file").alias("resource"), F.lit("scan").alias("action"), F.col("props").alias("details"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


def changed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("details", F.when(F.col("event_id") % 500 == 7, "changed").otherwise(F.col("details")))


def _log_sql(actor: str = "user_id::varchar") -> str:
    body = f"event_type || '|' || {actor} || '|file|scan|' || coalesce(props, '') || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')"
    return f"log as (select event_id, {actor} as actor, {body} body, row_number() over (partition by {actor} order by event_id) nth from events)"


@q("chain_one_actor", "select 'all' as actor, count(*) n, min(case when event_id % 500 = 7 then nth end)::int broken_at from (select event_id, row_number() over (order by event_id) nth from events)")
def _(s, d):
    """All events as the chain of one actor, verified after some entries were changed."""
    return G.verify_chain(changed(G.build_chain(log(s, d, "all"), "event_id", "actor", KEY)), "event_id", "actor", KEY)


@q("chain_status", f"""with recursive {_log_sql()},
walk as (select actor, nth, sha256('{M.EMPTY}|' || body) h from log where nth = 1 union all select l.actor, l.nth, sha256(w.h || '|' || l.body) from walk w join log l on l.actor = w.actor and l.nth = w.nth + 1)
select actor, max(nth)::bigint total_entries, arg_max(h, nth) last_hash, 'active' as status from walk group by actor""")
def _(s, d):
    """Of each chain: its entries, and the hash that an entry to come will cover."""
    return G.chain_status(G.build_chain(log(s, d), "event_id", "actor", KEY), "event_id", "actor")


def _roots_sql(actor: str) -> str:
    ctes = [_log_sql(actor), f"l0 as (select actor, (nth - 1) // {SIZE} segment, (nth - 1) % {SIZE} p, sha256(body) h from log)"]
    for k in range(M._levels(SIZE)):
        ctes.append(f"l{k + 1} as (select actor, segment, p // 2 p, case when count(*) = 1 then max(h) else sha256(string_agg(h, '' order by p)) end h from l{k} group by actor, segment, p // 2)")
    return ",\n".join(ctes)


@q("merkle_roots", f"with {_roots_sql('user_id::varchar')} select actor, segment::bigint segment, n, h root from l{M._levels(SIZE)} join (select actor, (nth - 1) // {SIZE} segment, count(*) n from log group by all) using (actor, segment)")
def _(s, d):
    """The root of each segment of each user's log."""
    return M.segments(M.leaves(log(s, d), "event_id", "actor", SIZE), "actor", SIZE)


@q("merkle_tampered", f"""with {_log_sql("'all'")} select 'all' as actor, (max(nth) + {SIZE - 1}) // {SIZE} segments, min(case when event_id % 500 = 7 then (nth - 1) // {SIZE} end)::bigint broken_segment, null::int chain_broken_at from log""")
def _(s, d):
    """One actor's log of all events against its checkpoints, after some entries were changed."""
    rows = log(s, d, "all")
    made = kept(M.checkpoints(M.segments(M.leaves(rows, "event_id", "actor", SIZE), "actor", SIZE), "actor", KEY))
    return M.verify(changed(rows), made, "event_id", "actor", KEY, SIZE)


@q("merkle_proofs", f"with {_roots_sql(chr(39) + 'all' + chr(39))} select event_id, h root, true as holds from log join l{M._levels(SIZE)} t on t.segment = (log.nth - 1) // {SIZE} where event_id % 97 = 0")
def _(s, d):
    """Proofs that some entries are in one actor's log: each leads from the entry to its segment's root."""
    found = kept(M.leaves(log(s, d, "all"), "event_id", "actor", SIZE))
    roots = M.segments(found, "actor", SIZE)
    proved = M.proofs(found, found.where("event_id % 97 = 0"), "event_id", "actor", SIZE).withColumn("up", M.climbed(F.col("leaf"), F.col("path")))
    return proved.join(roots, ["actor", "segment"]).select("event_id", "root", (F.col("up") == F.col("root")).alias("holds"))


QUERIES, ORACLE = Q, O

"""Rule tables, scalars, selections, reports and encryption as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeveil.functions import rules as R
from lakeveil.functions import scalars as X
from lakeveil.operators import crypto, rulesets, spans
from lakeveil.operators import linkage as L
from lakeveil.sources.tables import table

from . import sql as S
from .detection import docs, entities
from .relational import AS_OF, GRAPH, files

Q, O = {}, {}


def q(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn

    return add


_ALL = [(s, i, r.name, r.type, r.confidence) for s, rs in (("core", R.CORE), ("modes", R.MODES), ("watcher", R.WATCHER)) for i, r in enumerate(rs)]


@q("rules_listed", "select * from (values " + ", ".join(f"('{s}', {i}, '{n}', '{t}', {c}::double)" for s, i, n, t, c in _ALL) + ") v(ruleset, ord, name, type, confidence)")
def _(s, d):
    return rulesets.rules_table(s).select("ruleset", "ord", "name", "type", "confidence")


@q("rules_by_mode", " union all ".join(f"select '{m}' as mode, {sum(r.confidence >= least for r in R.MODES)}::bigint n" for m, least in R.MODE_LEAST.items()))
def _(s, d):
    rules, out = rulesets.rules_table(s), None
    for m in R.MODE_LEAST:
        one = rulesets.active(rules, m).agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("mode"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@q("rule_trial", r"select doc_id, len(f)::bigint n, array_to_string(f[1:20], '|') matches from (select doc_id, regexp_extract_all(text, '\d{3}-\d{4}') f from documents where text is not null) where len(f) > 0")
def _(s, d):
    return rulesets.try_rule(docs(s, d), r"\d{3}-\d{4}")


@q("file_sizes", """with u as (select doc_id, n_chars * 37 size from documents), p as (select *, case when size >= 1073741824 then 3 when size >= 1048576 then 2 when size >= 1024 then 1 else 0 end k from u)
select doc_id, case when size <= 0 then '0 B' else regexp_replace(round_even(size / power(1024.0, k), 1)::varchar, '\\.0$', '') || ' ' || ['B', 'KB', 'MB', 'GB'][k + 1] end as shown from p""")
def _(s, d):
    return docs(s, d).select("doc_id", X.file_size(F.col("n_chars") * 37).alias("shown"))


@q("luhn_digits", """with x as (select p_partkey, list_reverse(string_split(lpad(p_partkey::varchar, 9, '4'), '')) r from part)
select p_partkey, ((10 - list_sum(list_transform(generate_series(1, len(r)), lambda i: case when i % 2 = 1 then case when r[i]::int * 2 > 9 then r[i]::int * 2 - 9 else r[i]::int * 2 end else r[i]::int end)) % 10) % 10)::int::varchar digit from x""")
def _(s, d):
    return table(s, d, "part").select("p_partkey", X.luhn_digit(F.lpad(F.col("p_partkey").cast("string"), 9, "4")).alias("digit"))


@q("graph_selected", f"with {GRAPH}, sel as (select * from occ where doc_id in (select doc_id from occ where doc_id % 7 = 0)) select nodes.hash, nodes.type, count(*) links from nodes join sel using (hash) group by all")
def _(s, d):
    """What stays of the graph when some documents are selected."""
    nodes, occurrences = L.graph_nodes(entities(s, d))
    links = occurrences.where("doc_id % 7 = 0").groupBy("hash").agg(F.count(F.lit(1)).alias("links"))
    return nodes.join(links, "hash").select("hash", "type", "links")


@q("chains_selected", f"with {GRAPH}, c as (select hash, list(doc_id) ids from occ group by hash having count(*) > 1) select hash, len(ids)::bigint docs from c where len(list_filter(ids, lambda x: x % 2 = 0)) > 0")
def _(s, d):
    nodes, occurrences = L.graph_nodes(entities(s, d))
    some = occurrences.where("doc_id % 2 = 0").select("hash").distinct()
    return L.chains(nodes, occurrences).join(some, "hash", "left_semi").select("hash", "docs")


@q("entity_lists", f"with {S.core()}, l as (select doc_id, list(text order by start, ord) ts from entities group by doc_id) select doc_id, case when len(ts) > 5 then array_to_string(ts[1:5], ', ') || ' +' || (len(ts) - 5) || ' more' else array_to_string(ts, ', ') end as shown from l")
def _(s, d):
    rows = spans.with_entities(docs(s, d)).where("size(entities) > 0")
    return rows.select("doc_id", X.first_of(F.transform("entities", lambda x: x["text"]), 5).alias("shown"))


@q("entity_distribution", f"with {S.core()}, c as (select doc_id, type, count(*) n from entities group by all) select doc_id, array_to_string(list(type || '=' || n order by type), ',') as distribution from c group by doc_id")
def _(s, d):
    c = entities(s, d).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))
    item = F.concat("type", F.lit("="), F.col("n").cast("string"))
    return c.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("distribution"))


@q("privacy_assessment", f"with {S.core()}, {S.PER_DOC} select doc_id, len(types)::int n_types, case when len(types) > 3 then 'HIGH' when len(types) > 0 then 'MEDIUM' else 'LOW' end risk from docs")
def _(s, d):
    n = F.size(F.array_distinct(F.transform("entities", lambda x: x["type"])))
    rows = spans.with_entities(docs(s, d)).select("doc_id", n.alias("n_types"))
    return rows.withColumn("risk", F.when(F.col("n_types") > 3, "HIGH").when(F.col("n_types") > 0, "MEDIUM").otherwise("LOW"))


@q("subject_report", f"with {S.core()} select type, count(*) n, count(distinct doc_id) docs from entities where contains(lower(text), 'an') group by type")
def _(s, d):
    found = entities(s, d).where(F.contains(F.lower("text"), F.lit("an")))
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@q("incident_severity", f"with {S.FILES} select doc_id, case risk_level when 'HIGH' then 'CRITICAL' when 'MEDIUM' then 'HIGH' else 'MEDIUM' end severity from files where entities_count > 0")
def _(s, d):
    severity = F.when(F.col("risk_level") == "HIGH", "CRITICAL").when(F.col("risk_level") == "MEDIUM", "HIGH").otherwise("MEDIUM")
    return files(s, d).where("entities_count > 0").select("doc_id", severity.alias("severity"))


@q("notifications", f"with {S.FILES} select doc_id, case risk_level when 'HIGH' then 'critical' when 'MEDIUM' then 'high' else 'normal' end priority, risk_level || ': ' || entities_count || ' in ' || file_name as message from files where entities_count > 0")
def _(s, d):
    priority = F.when(F.col("risk_level") == "HIGH", "critical").when(F.col("risk_level") == "MEDIUM", "high").otherwise("normal")
    message = F.concat("risk_level", F.lit(": "), F.col("entities_count").cast("string"), F.lit(" in "), "file_name")
    return files(s, d).where("entities_count > 0").select("doc_id", priority.alias("priority"), message.alias("message"))


@q("approvals_pending", f"select event_id, user_id, ts + interval 48 hours < timestamp '{AS_OF}' expired from events where event_type = 'signup' and not exists (select 1 from events x where x.user_id = events.user_id and x.event_type = 'purchase' and x.event_id = events.event_id + 1)")
def _(s, d):
    e = table(s, d, "events")
    answered = e.where("event_type = 'purchase'").select("user_id", (F.col("event_id") - 1).alias("event_id"))
    rows = e.where("event_type = 'signup'").join(answered, ["user_id", "event_id"], "left_anti")
    return rows.select("event_id", "user_id", (F.col("ts") + F.expr("interval 48 hours") < F.lit(AS_OF).cast("timestamp_ntz")).alias("expired"))


@q("tasks_filtered", "select conv_id, count(*) n, count(*) filter (role = 'assistant') answered from conversations where role <> 'system' group by conv_id having count(*) filter (role = 'user') > 0")
def _(s, d):
    rows = table(s, d, "conversations").where("role <> 'system'").groupBy("conv_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "assistant").alias("answered"), F.count_if(F.col("role") == "user").alias("u")).where("u > 0").drop("u")


@q("slo_met", "select event_type, avg(value) <= 50 met, count(*) n from events where value is not null group by event_type")
def _(s, d):
    return table(s, d, "events").where("value is not null").groupBy("event_type").agg((F.avg("value") <= 50).alias("met"), F.count(F.lit(1)).alias("n"))


@q("encrypted_round_trip", f"with {S.core()} select doc_id, start, text as again, true differs from entities")
def _(s, d):
    """Entities sealed under a key and opened again; the sealed form is never the text."""
    key = bytes(range(32))
    return crypto.revealed(crypto.reversible(entities(s, d), key), key).select("doc_id", "start", F.col("text_again").alias("again"), (F.col("sealed") != F.col("text")).alias("differs"))


@q("signed_rows", """select c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') signature from customer""")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", X.signed("c_custkey", "c_name", "c_nationkey").alias("signature"))


QUERIES, ORACLE = Q, O

"""Inventory, audit, linkage, graph, privacy, governance and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeveil.functions import rules as R
from lakeveil.operators import governance as G
from lakeveil.operators import linkage as L
from lakeveil.operators import privacy as P
from lakeveil.operators import risk, spans
from lakeveil.sources.tables import kept, spread, table

from . import sql as S
from .detection import docs, entities

AS_OF = "2024-01-30 00:00:00"
KEY = b"demonstration key"


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as an inventory of scanned files."""
    return files_of(docs(spark, d))


def files_of(found: DataFrame, *more: str) -> DataFrame:
    """The inventory of some documents, with ``more`` of their columns."""
    rows = spans.with_entities(spread(found))
    n = F.size("entities").cast("bigint")
    score, level = risk.quick_score(n, 15, 40)
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return rows.select(
        "doc_id",
        F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), name).alias("file_path"),
        name.alias("file_name"),
        F.col("n_chars").alias("file_size"),
        n.alias("entities_count"),
        F.array_join(risk.types_of(F.col("entities")), ",").alias("entity_types"),
        score.alias("risk_score"),
        level.alias("risk_level"),
        F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 60).alias("scan_time"),
        *more,
    )


def f(body: str) -> str:
    return f"with {S.FILES} {body}"


Q, O = {}, {}


def q(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn

    return add


@q("inventory_files", f("select doc_id, file_path, file_name, file_size, entities_count, entity_types, risk_score::bigint risk_score, risk_level, strftime(scan_time, '%Y-%m-%d %H:%M:%S') scan_time from files"))
def _(s, d):
    return files(s, d).withColumn("scan_time", F.date_format("scan_time", "yyyy-MM-dd HH:mm:ss"))


@q("inventory_buckets", f("""select b.risk_level as risk_level, count(x.doc_id) n, coalesce(sum(x.risk_score), 0)::bigint total from (values ('HIGH'), ('MEDIUM'), ('LOW'), ('MINIMAL')) b(risk_level)
 left join (select * from files where entities_count > 0) x on x.risk_level = b.risk_level group by b.risk_level"""))
def _(s, d):
    found = files(s, d).where("entities_count > 0").groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("total"))
    every = s.createDataFrame([(b,) for b in ("HIGH", "MEDIUM", "LOW", "MINIMAL")], "risk_level string")
    return every.join(found, "risk_level", "left").na.fill(0, ["n", "total"])


@q("inventory_top_per_bucket", f("select doc_id, risk_level, risk_score::bigint risk_score, nth from (select *, row_number() over (partition by risk_level order by risk_score desc, doc_id) nth from files) where nth <= 20"))
def _(s, d):
    w = Window.partitionBy("risk_level").orderBy(F.desc("risk_score"), "doc_id")
    return files(s, d).withColumn("nth", F.row_number().over(w).cast("bigint")).where("nth <= 20").select("doc_id", "risk_level", "risk_score", "nth")


@q("inventory_types", f("select trim(t) as type, count(*) n from (select unnest(string_split(entity_types, ',')) t from files) where trim(t) <> '' group by 1 order by n desc, 1 limit 10"))
def _(s, d):
    kinds = files(s, d).select(F.explode(F.split("entity_types", ",")).alias("t")).select(F.trim("t").alias("type")).where("type <> ''")
    return kinds.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(10)


@q("inventory_search", f("select doc_id, file_path, risk_level from files where file_path ilike '%src1%' and risk_level in ('HIGH', 'CRITICAL') and entity_types ilike '%person%' order by scan_time desc, doc_id limit 100"))
def _(s, d):
    hit = F.col("file_path").ilike("%src1%") & F.col("risk_level").isin("HIGH", "CRITICAL") & F.col("entity_types").ilike("%person%")
    return files(s, d).where(hit).orderBy(F.desc("scan_time"), "doc_id").limit(100).select("doc_id", "file_path", "risk_level")


@q("inventory_recent", f("select doc_id, risk_score::bigint risk_score, case when risk_score >= 80 then 'vault' when risk_score >= 60 then 'redact' else 'monitor' end advice from files where entities_count > 0 order by scan_time desc, doc_id limit 50"))
def _(s, d):
    advice = F.when(F.col("risk_score") >= 80, "vault").when(F.col("risk_score") >= 60, "redact").otherwise("monitor")
    return files(s, d).where("entities_count > 0").orderBy(F.desc("scan_time"), "doc_id").limit(50).select("doc_id", "risk_score", advice.alias("advice"))


@q("inventory_high_risk", f("select doc_id, risk_score::bigint risk_score from files where risk_level in ('CRITICAL', 'HIGH') order by risk_score desc, doc_id limit 20"))
def _(s, d):
    return files(s, d).where(F.col("risk_level").isin("CRITICAL", "HIGH")).orderBy(F.desc("risk_score"), "doc_id").limit(20).select("doc_id", "risk_score")


@q("inventory_daily", f("select strftime(scan_time, '%Y-%m-%d') as day, count(*) n, count(*) filter (entities_count > 0) n_sensitive, count(*) filter (risk_level in ('HIGH', 'CRITICAL')) n_high from files group by 1"))
def _(s, d):
    day = F.date_format("scan_time", "yyyy-MM-dd").alias("day")
    return files(s, d).groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("entities_count") > 0).alias("n_sensitive"), F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("n_high"))


@q("scan_incremental", "with h as (select doc_id, '/' || coalesce(source, '') || '/doc' || doc_id as path, left(sha256(coalesce(left(text, 1048576), '')), 16) as hash from documents) select * from h a where not exists (select 1 from h b where b.path = a.path and b.hash = a.hash and b.doc_id % 3 = 0)")
def _(s, d):
    """Files that an earlier scan (every third document) has not seen with this content."""
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/doc"), F.col("doc_id").cast("string"))
    now = docs(s, d).select("doc_id", path.alias("path"), F.left(F.sha2(F.substring(F.coalesce("text", F.lit("")).cast("binary"), 1, 1 << 20), 256), F.lit(16)).alias("hash"))
    return now.join(now.where("doc_id % 3 = 0").select("path", "hash"), ["path", "hash"], "left_anti").select("doc_id", "path", "hash")


@q("upsert_latest", "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) n from events) where n = 1")
def _(s, d):
    return L.keep_latest(table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@q("upsert_first", "select user_id, arg_min(event_type, (ts, event_id)) as type, arg_min(props, (ts, event_id)) filter (props is not null) as sample, max(ts) as last_seen from events group by user_id")
def _(s, d):
    at = F.struct("ts", "event_id")
    return table(s, d, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("type"), F.min_by("props", F.when(F.col("props").isNotNull(), at)).alias("sample"), F.max("ts").alias("last_seen"))


@q("insert_if_absent", "select distinct user_id, event_type from events e where not exists (select 1 from events x where x.user_id = e.user_id and x.event_type = e.event_type and x.event_id % 10 = 0)")
def _(s, d):
    e = table(s, d, "events")
    return e.select("user_id", "event_type").distinct().join(e.where("event_id % 10 = 0").select("user_id", "event_type"), ["user_id", "event_type"], "left_anti")


@q("audit_recent", "select event_id, user_id, event_type, c_name from events join customer on c_custkey = user_id order by ts desc, event_id limit 100")
def _(s, d):
    e, c = table(s, d, "events"), table(s, d, "customer")
    return e.join(c, e.user_id == c.c_custkey).orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", "event_type", "c_name")


@q("audit_doc_summary", f"with {S.core()} select doc_id, type, count(*) n, avg(confidence) confidence from entities group by all")
def _(s, d):
    return entities(s, d).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))


@q("audit_stats", f"with {S.core()} select type, count(*) n, count(distinct doc_id) docs from entities group by type")
def _(s, d):
    return entities(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@q("audit_latest", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n = 1")
def _(s, d):
    return L.keep_latest(table(s, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@q("inventory_sync", f("select x.doc_id, x.file_name, substr('doc' || x.doc_id, 1, 16) file_hash, coalesce(l.quality, 0)::int first_quality, coalesce(c.n, 0)::bigint n from files x left join labels l using (doc_id) left join (select doc_id, count(*) n from entities group by 1) c using (doc_id)"))
def _(s, d):
    e = entities(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    lab = table(s, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    rows = docs(s, d).select("doc_id").join(lab, "doc_id", "left").join(e, "doc_id", "left")
    return rows.select("doc_id", F.concat(name, F.lit(".txt")).alias("file_name"), F.left(name, F.lit(16)).alias("file_hash"), F.coalesce("quality", F.lit(0)).alias("first_quality"), F.coalesce("n", F.lit(0)).alias("n"))


@q("table_profile", " union all ".join(f"select '{t}' as name, count(*) n from {t}" for t in ("customer", "documents", "events", "labels", "pages")))
def _(s, d):
    out = None
    for t in ("customer", "documents", "events", "labels", "pages"):
        one = table(s, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _norm(text: str, type_: str) -> str:
    low = f"trim(lower({text}))"
    name = low
    for t in R.TITLES:
        name = f"trim(replace({name}, '{t}', ''))"
    digits = f"regexp_replace({low}, '[^0-9]', '', 'g')"
    return f"case {type_} when 'PHONE' then case when starts_with({digits}, '91') and length({digits}) > 10 then substr({digits}, 3) else {digits} end when 'AADHAAR' then replace({low}, ' ', '') when 'PERSON_NAME' then {name} else {low} end"


_STRONG = S.listed(R.STRONG_TYPES)
LINKS = f"""{S.core()},
m as (select doc_id, type, {_norm('text', 'type')} as key, count(*) n from entities where type in {S.listed(R.STRONG_TYPES + R.WEAK_TYPES)} group by all),
tk as (select *, list_distinct(string_split_regex(trim(regexp_replace(key, '\\s+', ' ', 'g')), ' ')) tokens from m),
exact as (select a.doc_id doc_1, b.doc_id doc_2, a.type as type, 'EXACT' as match, a.n * b.n n from m a join m b on a.type = b.type and a.key = b.key and a.doc_id < b.doc_id),
names as (select a.doc_id doc_1, b.doc_id doc_2, a.type as type, 'FUZZY' as match, a.n * b.n n from tk a join tk b on a.type = 'PERSON_NAME' and b.type = 'PERSON_NAME' and a.key <> '' and b.key <> '' and a.doc_id < b.doc_id and a.key <> b.key
  and len(list_intersect(a.tokens, b.tokens)) * 2 > greatest(len(a.tokens), len(b.tokens))),
prefixes as (select a.doc_id doc_1, b.doc_id doc_2, a.type as type, 'FUZZY' as match, a.n * b.n n from m a join m b on a.type = b.type and a.type <> 'PERSON_NAME' and length(a.key) >= 4 and length(b.key) >= 4 and a.doc_id < b.doc_id and a.key <> b.key
  and left(a.key, floor(least(length(a.key), length(b.key)) * 0.8)::int) = left(b.key, floor(least(length(a.key), length(b.key)) * 0.8)::int)),
p as (select doc_1, doc_2, sum(n)::bigint n_matches, bool_or(type in {_STRONG}) strong, sum(n * case when match = 'EXACT' then case when type in {_STRONG} then 10 else 5 end else case when type in {_STRONG} then 7 else 3 end end) tenths
  from (from exact union all from names union all from prefixes) group by all),
links as (select doc_1, doc_2, n_matches, (case when strong then 1.0 when n_matches >= 3 then least(tenths * 15 / 100, 1.0) when n_matches = 2 then least(tenths * 12 / 100, 0.9) else least(tenths / 10, 0.6) end)::double strength from p)"""


def matches(s, d) -> DataFrame:
    m = kept(L.mentions(entities(s, d)))
    return L.exact_matches(m).unionByName(L.name_matches(m)).unionByName(L.prefix_matches(m))


@q("linkage_exact", f"""with {LINKS}, g as (select type, key, min(doc_id) first_doc, count(*) docs from m group by all having count(*) > 1)
select doc_id, type, left(sha256(key), 16) class_id, first_doc, docs, n from m join g using (type, key)""")
def _(s, d):
    return L.exact_classes(kept(L.mentions(entities(s, d))))


_NAMED = "m as (select p_partkey doc_id, 'PERSON_NAME' as type, lower(p_name || ' ' || p_type || ' ' || p_brand) as key from part)"


@q("linkage_names", f"""with {_NAMED}, k as (select key, count(*) docs, list_distinct(string_split(key, ' ')) t from m group by key)
select 'PERSON_NAME' as type, a.key key_1, b.key key_2, a.docs docs_1, b.docs docs_2 from k a join k b on a.key < b.key and len(list_intersect(a.t, b.t)) * 2 > greatest(len(a.t), len(b.t))""")
def _(s, d):
    """Names made of a part's name, type and brand, so that many share most of their tokens."""
    part = table(s, d, "part")
    named = part.select(F.col("p_partkey").alias("doc_id"), F.lit("PERSON_NAME").alias("type"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"), F.lit(0).alias("start"))
    return L.name_forms(L.mentions(named))


@q("linkage_prefixes", """with k as (select (1000000000 + o_custkey * 37)::varchar as key, count(distinct o_orderkey) docs from orders group by 1)
select 'BANK_ACCOUNT' as type, a.key key_1, b.key key_2, a.docs docs_1, b.docs docs_2 from k a join k b on a.key < b.key and left(a.key, 8) = left(b.key, 8)""")
def _(s, d):
    """Account numbers made of customers' keys, some of which differ in their last digits only."""
    number = (F.lit(1000000000).cast("bigint") + F.col("o_custkey") * 37).cast("string")
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("BANK_ACCOUNT").alias("type"), number.alias("text"))
    return L.prefix_forms(L.mentions(rows))


@q("linkage_links", f"with {LINKS} select * from links")
def _(s, d):
    return L.linkages(matches(s, d))


@q("linkage_risk", f"""with {LINKS}, t as (select coalesce(max(strength), 0.0) max_strength, coalesce(sum(n_matches), 0)::bigint n_matches from links),
u as (select *, round_even(least(max_strength * 100 + n_matches * 5, 100.0), 1)::double score from t) select *, case when score >= 80 then 'CRITICAL' when score >= 60 then 'HIGH' when score >= 40 then 'MEDIUM' else 'LOW' end as level from u""")
def _(s, d):
    return L.linkage_risk(L.profiles(kept(L.mentions(entities(s, d))))[1])


@q("linkage_clusters", f"with recursive {LINKS}, e as (select doc_1 a, doc_2 b from links where strength >= 0.7 union select doc_2, doc_1 from links where strength >= 0.7), r as (select a node, a top from e union select e.a, r.top from r join e on e.b = r.node) select node doc_id, min(top) cluster_id from r group by node")
def _(s, d):
    rows, links, _ = L.profiles(kept(L.mentions(entities(s, d))))
    return L.profile_clusters(rows, kept(links))


GRAPH = f"""{S.core()},
h as (select *, left(sha256(text), 16) hash from entities),
nodes as (select hash, arg_min(type, (doc_id, start)) as type, left(arg_min(text, (doc_id, start)), 32) sample, max(doc_id) last_doc from h group by hash),
occ as (select distinct hash, doc_id from h), cnt as (select hash, count(*) docs from occ group by hash),
top as (select nodes.*, docs from nodes join cnt using (hash) order by docs desc, hash limit 100)"""


@q("graph_top_entities", f"with {GRAPH} select * from top")
def _(s, d):
    n, o = L.graph_nodes(entities(s, d))
    return L.top_entities(n, o, 100).select("hash", "type", "sample", "last_doc", "docs")


@q("graph_links", f"with {GRAPH}, a as (select occ.* from occ semi join top using (hash)) select hash, doc_id from a where doc_id in (select doc_id from a group by doc_id having count(*) > 1)")
def _(s, d):
    n, o = L.graph_nodes(entities(s, d))
    return L.graph_links(L.top_entities(n, o, 100), o).select("hash", "doc_id")


@q("graph_chains", f"with {GRAPH} select hash, type, count(*) docs, min(doc_id) first_doc, count(*) * 20 risk from occ join nodes using (hash) group by hash, type having count(*) > 1")
def _(s, d):
    return L.chains(*L.graph_nodes(entities(s, d)))


@q("graph_summary", f"with {GRAPH} select (select count(*) from nodes) entities, (select count(distinct doc_id) from occ) docs, (select count(*) from cnt where docs >= 3) critical")
def _(s, d):
    _, o = L.graph_nodes(entities(s, d))
    by = o.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    one = by.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n") >= 3).alias("critical"))
    return o.agg(F.count_distinct("doc_id").alias("docs")).withColumn("k", F.lit(1)).join(one.withColumn("k", F.lit(1)), "k").drop("k")


@q("graph_delete", f"with {GRAPH}, others as (select * from occ where doc_id <> 3) select hash, type from nodes where hash in (select hash from others)")
def _(s, d):
    return L.delete_document(*L.graph_nodes(entities(s, d)), 3)[0].select("hash", "type")


@q("duplicates_exact", "with h as (select doc_id, sha256(text) content_hash from documents where text is not null), g as (select content_hash, count(*) n, min(doc_id) first_doc from h group by 1 having count(*) > 1) select doc_id, content_hash, n, first_doc from h join g using (content_hash)")
def _(s, d):
    """A row for each document that has copies, with the first of them."""
    hashed = docs(s, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    groups = kept(hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1"))
    return hashed.join(groups, "content_hash").select("doc_id", "content_hash", "n", "first_doc")


_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')"
_SIM = f"""v as (select doc_id, h, count(*) n from (select doc_id, right(md5(w), 16) h from (select doc_id, unnest({_TOKENS}) w from documents where text is not null)) group by all),
b as (select doc_id, i, sum(case when (('0x' || substr(h, 16 - i // 4, 1))::int >> (i % 4)) & 1 = 1 then n else -n end) > 0 bit from v, range(64) r(i) group by doc_id, i),
prints as (select d.doc_id, coalesce(string_agg(case when bit then '1' else '0' end, '' order by i desc), repeat('0', 64)) simhash from documents d left join b using (doc_id) where d.text is not null group by d.doc_id)"""


def _prints(s, d):
    return L.simhashes(spread(docs(s, d).select("doc_id", "text")))


@q("fingerprint_simhash", f"with {_SIM} select doc_id, simhash from prints")
def _(s, d):
    return _prints(s, d).select("doc_id", F.lpad(F.bin("fp"), 64, "0").alias("simhash"))


@q("fingerprint_near", f"with {_SIM}, c as (select simhash::bit fp, min(doc_id) rep from prints group by 1) select a.rep doc_1, b.rep doc_2, bit_count(xor(a.fp, b.fp))::int distance from c a join c b on a.rep < b.rep and bit_count(xor(a.fp, b.fp)) <= 5")
def _(s, d):
    """Pairs of fingerprint classes; fingerprint_classes tells which documents each class holds."""
    return L.similarity_pairs(L.fingerprint_classes(_prints(s, d)))


@q("fingerprint_classes", f"with {_SIM} select doc_id, min(doc_id) over (partition by simhash) rep, count(*) over (partition by simhash) n from prints")
def _(s, d):
    prints = _prints(s, d)
    return prints.join(L.fingerprint_classes(prints), "fp").select("doc_id", "rep", "n")


@q("fingerprint_structure", r"""select doc_id, len(string_split(text, chr(10)))::int line_count, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '\S')))::int paragraph_count,
 list_sum(list_transform(string_split(text, chr(10)), lambda l: length(l)))::bigint line_chars, regexp_matches(text, '\d{4,}') has_numbers, regexp_matches(text, '\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}') has_dates,
 len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::int word_count from documents where text is not null""")
def _(s, d):
    lines = F.split("text", "\n")
    return docs(s, d).where("text is not null").select(
        "doc_id",
        F.size(lines).alias("line_count"),
        F.size(F.filter(F.split("text", "\n\n"), lambda p: p.rlike(r"\S"))).alias("paragraph_count"),
        F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)).cast("bigint").alias("line_chars"),
        F.col("text").rlike(r"\d{4,}").alias("has_numbers"),
        F.col("text").rlike(r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}").alias("has_dates"),
        F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_count"),
    )


@q("dp_true_count", f"with {S.core()} select count(*) answer from entities where type = 'PHONE'")
def _(s, d):
    return P.true_count(entities(s, d), "PHONE")


@q("dp_true_average", f"with {S.core()} select sum(round(confidence * 1000)::bigint) / count(*) / 1000 answer from entities")
def _(s, d):
    return P.true_average(entities(s, d))


@q("dp_true_percentage", f"with {S.modes('strict')} select count(*) filter (c > 0.8) * 100 / count(*) answer from (select confidence c from entities)")
def _(s, d):
    return P.true_percentage(spans.explode_spans(docs(s, d).where("text is not null"), spans.mode_spans(F.col("text"), "strict")))


@q("dp_true_histogram", f"with {S.core()} select type, count(*) n from entities group by type")
def _(s, d):
    return P.true_histogram(entities(s, d))


@q("dp_noised_histogram")
def _(s, d):
    return P.noised_histogram(entities(s, d))


@q("semantic_filter", "select e.vec_id from embeddings e, (select embedding q from embeddings order by vec_id limit 1) where list_cosine_similarity(e.embedding::double[], q::double[]) > 0.4")
def _(s, d):
    e = table(s, d, "embeddings")
    asked = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("asked")).first()
    if asked is None:
        return e.select("vec_id")
    v = F.array(*[F.lit(float(x)) for x in asked[0]])  # one query vector
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    cosine = dot(F.col("embedding"), v) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(v, v))
    return e.where(cosine > 0.4).select("vec_id")


@q("metric_summary", f"select event_type as metric, count(*) n, round_even(avg(value), 2)::double mean from events where ts >= timestamp '{AS_OF}' - interval 24 hours and ts <= timestamp '{AS_OF}' group by 1")
def _(s, d):
    now = F.lit(AS_OF).cast("timestamp")
    recent = table(s, d, "events").where((F.col("ts") >= now - F.expr("interval 24 hours")) & (F.col("ts") <= now))
    return recent.groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("value"), 2).alias("mean"))


@q("slo_p95", "select event_type, value p95, n from (select event_type, value, row_number() over (partition by event_type order by value) - 1 nth, count(*) over (partition by event_type) n from events where value is not null) where nth = least(n * 95 // 100, n - 1)")
def _(s, d):
    return G.rank_p95(table(s, d, "events"), "event_type", "value")


@q("feedback_stats", "select source entity_type, count(*) total, sum(quality)::bigint correct, (count(*) - sum(quality))::bigint incorrect, round_even(sum(quality) / count(*), 3)::double accuracy, round_even((count(*) - sum(quality)) / count(*), 3)::double fp_rate from labels join documents using (doc_id) group by source")
def _(s, d):
    return G.feedback_stats(table(s, d, "labels").join(docs(s, d).select("doc_id", F.col("source").alias("entity_type")), "doc_id").select("entity_type", F.col("quality").alias("is_correct")))


@q("threshold_advice", """with s as (select source entity_type, count(*) total, round_even((count(*) - sum(quality)) / count(*), 3)::double fp from labels join documents using (doc_id) group by source)
select entity_type, case when fp > 0.3 then 'increase_threshold' else 'decrease_threshold' end recommendation, (case when fp > 0.3 then round_even(least(fp * 0.3::double, 0.2), 2) else 0.05 end)::double change from s where total >= 5 and (fp > 0.3 or (fp < 0.05 and total >= 10))""")
def _(s, d):
    return G.threshold_advice(Q["feedback_stats"](s, d))


def _chain(s, d, tampered: bool):
    events = table(s, d, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("actor"), F.lit("file").alias("resource"), F.lit("scan").alias("action"), F.col("props").alias("details"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    chain = G.build_chain(events, "event_id", "actor", KEY)
    return chain.withColumn("details", F.when(F.col("event_id") % 500 == 7, "changed").otherwise(F.col("details"))) if tampered else chain


@q("chain_verify", "select user_id::varchar actor, count(*) n, null::int broken_at from events group by 1")
def _(s, d):
    return G.verify_chain(_chain(s, d, False), "event_id", "actor", KEY)


@q("chain_tampered", "select actor, max(nth) n, min(case when event_id % 500 = 7 then nth end)::int broken_at from (select user_id::varchar actor, event_id, row_number() over (partition by user_id order by event_id) nth from events) group by actor")
def _(s, d):
    return G.verify_chain(_chain(s, d, True), "event_id", "actor", KEY)


_ROLE_SQL = "(values " + ", ".join(f"('{r}', '{p}')" for r, ps in R.ROLES.items() for p in ps) + ") r(role, permission)"


@q("role_permissions", f"select c_custkey, permission from (select c_custkey, ['viewer', 'analyst', 'auditor', 'admin'][c_custkey % 4 + 1] role from customer) join {_ROLE_SQL} using (role)")
def _(s, d):
    roles = F.array(*map(F.lit, ("viewer", "analyst", "auditor", "admin")))
    users = table(s, d, "customer").select("c_custkey", F.element_at(roles, (F.col("c_custkey") % 4 + 1).cast("int")).alias("role"))
    return users.join(F.broadcast(G.role_permissions(s)), "role").select("c_custkey", "permission")  # a row for each role and permission


@q("sessions_active", f"select event_id, c_name, c_mktsegment from events join customer on user_id = c_custkey where event_type = 'signup' and ts + interval 24 hours >= timestamp '{AS_OF}' and ts <= timestamp '{AS_OF}'")
def _(s, d):
    now = F.lit(AS_OF).cast("timestamp")
    e = table(s, d, "events").where((F.col("event_type") == "signup") & (F.col("ts") + F.expr("interval 24 hours") >= now) & (F.col("ts") <= now))
    return e.join(table(s, d, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name", "c_mktsegment")


_PB = " ".join(f"when '{n}' then [{', '.join(map(S.quoted, st))}]" for n, (_, st) in R.PLAYBOOKS.items())


@q("playbook_progress", f"""with x as (select user_id, case when user_id % 3 = 0 then 'pii_leak_response' when user_id % 3 = 1 then 'dsar_compliance' else 'unauthorized_access' end playbook, count(*) filter (event_type = 'purchase') // 3 steps_done from events group by 1, 2),
y as (select *, case playbook {_PB} end steps from x) select user_id, playbook, steps_done::bigint steps_done, {S.mapped('playbook', {k: v[0] for k, v in R.PLAYBOOKS.items()}, '')} severity, len(steps)::bigint n_steps,
 case when steps_done < len(steps) then steps[steps_done + 1] end step, case when steps_done >= len(steps) then 'completed' else 'in_progress' end status from y""")
def _(s, d):
    book = F.when(F.col("user_id") % 3 == 0, "pii_leak_response").when(F.col("user_id") % 3 == 1, "dsar_compliance").otherwise("unauthorized_access")
    runs = table(s, d, "events").groupBy("user_id").agg(F.floor(F.count_if(F.col("event_type") == "purchase") / 3).alias("steps_done")).withColumn("playbook", book)
    return G.playbook_progress(runs).select("user_id", "playbook", "steps_done", "severity", "n_steps", "step", "status")


@q("comments_feed", "select conv_id, turn, role, left(text, 40) as preview from conversations where role = 'user' order by conv_id desc, turn desc limit 50")
def _(s, d):
    return table(s, d, "conversations").where("role = 'user'").orderBy(F.desc("conv_id"), F.desc("turn")).limit(50).select("conv_id", "turn", "role", F.left("text", F.lit(40)).alias("preview"))


@q("webhook_targets", "select event_id, hook from events, (values ('all-hook', ['all']), ('money', ['purchase', 'signup']), ('errors', ['error'])) h(hook, kinds) where list_contains(kinds, 'all') or list_contains(kinds, event_type)")
def _(s, d):
    hooks = F.array(*[F.struct(F.lit(n).alias("hook"), F.array(*map(F.lit, k)).alias("kinds")) for n, k in (("all-hook", ["all"]), ("money", ["purchase", "signup"]), ("errors", ["error"]))])
    e = table(s, d, "events").select("event_id", "event_type", F.explode(hooks).alias("h"))
    return e.where(F.array_contains("h.kinds", F.lit("all")) | F.array_contains("h.kinds", F.col("event_type"))).select("event_id", "h.hook")


_REPORT_ROWS = ", ".join(f"({S.quoted(t)}, {i}, {S.quoted(x)})" for t, ss in R.TEMPLATES.items() for i, x in enumerate(ss))


@q("compliance_report", f"""with {S.core()}, found as (select coalesce(list_sort(list(distinct type)), []) types from entities), r as (select * from (values {_REPORT_ROWS}) v(template, nth, section))
select template, nth, section, case when contains(lower(section), 'personal data') or contains(lower(section), 'pi collected') or contains(lower(section), 'phi') then case when len(types) > 0 then 'Detected entity types: ' || array_to_string(types, ', ') else 'No PII detected in scan' end
 when contains(lower(section), 'encryption') then 'AES-256 encryption available via Secure Vault' when contains(lower(section), 'retention') or contains(lower(section), 'storage') then 'Review file retention policies — files in vault are encrypted at rest'
 when contains(lower(section), 'access') then 'RBAC system with role-based permissions and approval workflows' when contains(lower(section), 'breach') then 'Incident playbooks available for PII leak response' else 'Manual review required' end as content from r, found""")
def _(s, d):
    return G.compliance_report(s, entities(s, d).agg(F.array_sort(F.collect_set("type")).alias("entity_types")))


@q("reveal_decisions", f"""with t as (select event_id token, user_id item_id, event_type = 'error' revoked, ts + interval 48 hours expires_at from events where event_id % 4 = 0), i as (select c_custkey item, sha256(c_name) key_hash from customer where c_custkey % 5 <> 0),
r as (select event_id request_id, event_id token, case when event_id % 3 = 0 then 'wrong' else c_name end as key from events left join customer on c_custkey = user_id where event_id % 2 = 0)
select request_id, case when item_id is null then 'invalid' when revoked then 'denied_revoked' when expires_at < timestamp '{AS_OF}' then 'denied_expired' when item is null then 'not_found' when sha256(key) <> key_hash then 'denied_wrong_key' else 'success' end decision from r left join t using (token) left join i on item = item_id""")
def _(s, d):
    e, c = table(s, d, "events"), table(s, d, "customer")
    tokens = e.where("event_id % 4 = 0").select(F.col("event_id").alias("token"), F.col("user_id").alias("item_id"), (F.col("event_type") == "error").alias("revoked"), (F.col("ts") + F.expr("interval 48 hours")).alias("expires_at"))
    items = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("item_id"), F.sha2("c_name", 256).alias("key_hash"))
    key = F.when(F.col("event_id") % 3 == 0, "wrong").otherwise(F.col("c_name"))
    asked = e.where("event_id % 2 = 0").join(c, e.user_id == c.c_custkey, "left").select(F.col("event_id").alias("request_id"), F.col("event_id").alias("token"), key.alias("key"))
    return G.reveal(asked, tokens, items, F.lit(AS_OF).cast("timestamp"))


@q("remediation_stats", "select count(*) total, count(*) filter (event_type = 'purchase') completed, count(*) filter (event_type = 'error') failed, count(*) filter (event_type = 'view') pending from events")
def _(s, d):
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    return table(s, d, "events").agg(F.count(F.lit(1)).alias("total"), is_("purchase").alias("completed"), is_("error").alias("failed"), is_("view").alias("pending"))


@q("vault_stats", "select count(*) n, sum(n_chars)::bigint total, max(n_chars) largest from documents")
def _(s, d):
    return docs(s, d).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"), F.max("n_chars").alias("largest"))


QUERIES, ORACLE = Q, O

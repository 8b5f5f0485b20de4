"""Recommendations, summaries, composites, logs and synthetic data as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeveil.functions import rules as R
from lakeveil.operators import linkage as L
from lakeveil.operators import logs, risk, spans, synthetic
from lakeveil.sources.tables import kept, table

from . import sql as S
from .detection import _EXPLAIN, _ROBUST_SQL, _VULN, entities, spread_docs
from .relational import AS_OF, GRAPH, LINKS, files, matches

Q, O = {}, {}


def q(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn

    return add


def said(x: str) -> str:
    return S.quoted(x)


# ---- risk, explanation and robustness

_COMBO = "case c.name " + " ".join(f"when {said(n)} then {r}" for n, _, r in R.DANGER) + " end"


@q("risk_recommendations", f"""with {S.risk()}, r as (select s.doc_id, list_filter(types, lambda t: t in {S.listed(R.DIRECT_TYPES)}) ds, len(d) n_direct, greatest(k, 1) k, types, found from scores s where n > 0)
select doc_id, array_to_string(list_filter(list_concat(list_concat([case when len(ds) > 0 then 'CRITICAL: Redact all direct identifiers (' || array_to_string(ds, ', ') || ')' end,
 case when k <= 5 then 'WARNING: Low k-anonymity (k=' || k || '). Consider generalizing quasi-identifiers.' end],
 list_transform(found[1:3], lambda c: 'DANGER: ' || c.name || ' combination creates high re-identification risk (' || c.risk || '%)')),
 [case when list_contains(types, 'DATE_OF_BIRTH') then {said(R.TIP_DATES)} end, case when list_contains(types, 'LOCATION') then {said(R.TIP_PLACES)} end]), lambda x: x is not null), chr(10)) recommendations,
 case when n_direct > 0 then 'Document contains ' || n_direct || {said(R.EXPLAIN_DIRECT)} when k <= 1 then {said(R.EXPLAIN_UNIQUE)}
 when k <= 5 then 'With k-anonymity of ' || k || ', this individual is among only ' || k || {said(R.EXPLAIN_FEW)} else {said(R.EXPLAIN_OTHER)} end explanation from r""")
def _(s, d):
    return risk.recommendations(spread_docs(s, d))


_TITLES, _FIRSTS, _LASTS = list(R.TITLE_NAMES), synthetic.FIRST, synthetic.LAST
_CASES_SQL = f"cases as (select c_custkey doc_id, 'Seen by ' || [{', '.join(map(said, _TITLES))}][c_custkey % 4 + 1] || ' ' || [{', '.join(map(said, _FIRSTS))}][c_custkey % {len(_FIRSTS)} + 1] || ' ' || [{', '.join(map(said, _LASTS))}][c_custkey % {len(_LASTS)} + 1] || ' on a visit.' as text from customer)"


def _cases(s, d) -> DataFrame:
    """Short texts that name a person with a title, one for each customer."""
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values) + 1).cast("int"))
    text = F.concat(F.lit("Seen by "), at(_TITLES), F.lit(" "), at(_FIRSTS), F.lit(" "), at(_LASTS), F.lit(" on a visit."))
    return table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


_NAMES_SQL = ", ".join(f"({i}, {said(t)}, {said(n)})" for i, (t, n) in enumerate((t, n) for t, ns in R.TITLE_NAMES.items() for n in ns))


@q("context_predictions", f"""with {_CASES_SQL}, {S.core('cases')}, g as (select * from (values {_NAMES_SQL}) v(o, title, guess)),
x as (select e.doc_id, e.start, o, guess, (case when upper(left(e.text, 1)) = left(guess, 1) then 0.35 else 0.15 end)::double confidence from entities e join cases c using (doc_id) join g
  on contains(substr(c.text, greatest(e.start - 100, 0) + 1, least(length(c.text), e."end" + 100) - greatest(e.start - 100, 0)), title) where e.type = 'PERSON_NAME')
select doc_id, start, nth::int nth, guess, confidence from (select *, row_number() over (partition by doc_id, start order by confidence desc, o) nth from x) where nth <= 3""")
def _(s, d):
    return risk.predictions(_cases(s, d))


@q("robustness_report", f"""with r as ({_ROBUST_SQL}), t as (with {_VULN} select doc_id, list(distinct kind) kinds, count(*) n from v group by doc_id)
select doc_id, score, grade, case when score >= 90 then 'EXCELLENT (' || grade || {said(R.SUMMARY[0][0])} || coalesce(n, 0) || {said(R.SUMMARY[0][1])} when score >= 70 then 'GOOD (' || grade || {said(R.SUMMARY[1][0])} || coalesce(n, 0) || {said(R.SUMMARY[1][1])}
 when score >= 50 then 'FAIR (' || grade || {said(R.SUMMARY[2][0])} || coalesce(n, 0) || {said(R.SUMMARY[2][1])} else 'POOR (' || grade || {said(R.SUMMARY[3][0])} || coalesce(n, 0) || {said(R.SUMMARY[3][1])} end summary,
 coalesce(array_to_string(list_sort(list_filter([{', '.join(f"case when list_contains(kinds, {said(k)}) then {said(a)} end" for k, a in R.KIND_ADVICE.items())}], lambda x: x is not null)), '; '), '') recommendations from r left join t using (doc_id)""")
def _(s, d):
    return risk.robustness_report(spread_docs(s, d))


@q("explain_report", f"""with {_EXPLAIN}, t as (select type, count(*) n from explained group by 1), u as (select sensitivity, count(*) n from explained group by 1)
select (select count(*) from explained) total, (select string_agg(type || '=' || n, ',' order by type) from t) by_type, (select string_agg(sensitivity || '=' || n, ',' order by sensitivity) from u) by_sensitivity,
 (select round_even(sum(risk_score) / count(*), 1)::double from explained) average_risk, (select string_agg(doc_id || ':' || start, ',' order by doc_id, start) from (select * from explained where risk_score >= 80 order by doc_id, start limit 5)) highest,
 case when coalesce((select n from u where sensitivity = 'CRITICAL'), 0) > 0 then 'CRITICAL: Document contains ' || (select n from u where sensitivity = 'CRITICAL') || {said(R.NOTE_CRITICAL)}
 when coalesce((select n from u where sensitivity = 'HIGH'), 0) > 0 then 'IMPORTANT: Document contains ' || (select n from u where sensitivity = 'HIGH') || {said(R.NOTE_HIGH)} else {said(R.NOTE_OTHER)} end note""")
def _(s, d):
    """One row: totals by type and sensitivity, average risk, the first five of high risk, and a note."""
    rows = kept(risk.explain(spread_docs(s, d)))
    count = F.count(F.lit(1)).alias("n")
    listed = lambda by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("by"), "n"))), lambda x: F.concat(x["by"], F.lit("="), x["n"].cast("string"))), ",")
    one = lambda df: df.withColumn("k", F.lit(1))  # noqa: E731  tables of one row
    types = rows.groupBy("type").agg(count).agg(listed("type").alias("by_type"))
    found = rows.groupBy("sensitivity").agg(count)
    of = lambda x: F.coalesce(F.max(F.when(F.col("sensitivity") == x, F.col("n"))), F.lit(0))
    sens = found.agg(listed("sensitivity").alias("by_sensitivity"), of("CRITICAL").alias("critical"), of("HIGH").alias("high"))
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.bround(F.round(F.sum("risk_score") / F.count(F.lit(1)), 8), 1).alias("average_risk"))
    first = rows.where("risk_score >= 80").orderBy("doc_id", "start").limit(5)
    first = first.agg(F.array_sort(F.collect_list(F.struct("doc_id", "start"))).alias("f")).select(
        F.array_join(F.transform("f", lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["start"].cast("string"))), ",").alias("highest")
    )
    note = (
        F.when(F.col("critical") > 0, F.concat(F.lit("CRITICAL: Document contains "), F.col("critical").cast("string"), F.lit(R.NOTE_CRITICAL)))
        .when(F.col("high") > 0, F.concat(F.lit("IMPORTANT: Document contains "), F.col("high").cast("string"), F.lit(R.NOTE_HIGH)))
        .otherwise(R.NOTE_OTHER)
    )
    rows = one(total).join(one(types), "k").join(one(sens), "k").join(one(first), "k")
    return rows.select("total", "by_type", "by_sensitivity", "average_risk", F.when(F.col("highest") != "", F.col("highest")).alias("highest"), note.alias("note"))


@q("redact_everywhere", f"""with {S.core()}, l as (select doc_id, list({{'x': text, 'r': '[REDACTED-' || type || ']'}} order by -length(text), start) xs from entities group by doc_id)
select doc_id, list_reduce(list_concat([{{'x': '', 'r': text}}], xs), lambda a, y: {{'x': '', 'r': replace(a.r, y.x, y.r)}}).r redacted from l join documents using (doc_id)""")
def _(s, d):
    rows = spans.with_entities(spread_docs(s, d)).where("size(entities) > 0")
    return rows.select("doc_id", spans.redact_everywhere(F.col("text"), F.col("entities")).alias("redacted"))


@q("linkage_advice", f"""with {LINKS}, t as (select coalesce(max(strength), 0.0) max_strength, coalesce(sum(n_matches), 0)::bigint n, count(*) pairs from links),
r as (select *, least(max_strength * 100 + n * 5, 100.0) score from t), v as (select *, case when score >= 80 then 'CRITICAL' when score >= 60 then 'HIGH' when score >= 40 then 'MEDIUM' else 'LOW' end as level,
 (select list_sort(list(distinct type)) from (from exact union all from names union all from prefixes)) types from r),
w as (select *, array_to_string(list_filter([case when level = 'CRITICAL' then {said(R.LINK_CRITICAL[0])} end, case when level = 'CRITICAL' then {said(R.LINK_CRITICAL[1])} end,
 case when level in ('CRITICAL', 'HIGH') and len(types) > 0 then {said(R.LINK_TYPES[0])} || array_to_string(types, ', ') || {said(R.LINK_TYPES[1])} end, case when level = 'MEDIUM' then {said(R.LINK_MEDIUM)} end,
 case when pairs > 0 then {said(R.LINK_ANY)} end], lambda x: x is not null), chr(10)) rec from v)
select case when rec = '' then 'No immediate action required - linkage risk is low' else rec end recommendations,
 case when pairs = 0 then 'No cross-document linkages detected. Documents can be shared together safely.' else 'Found ' || pairs || ' document pair(s) with ' || n || ' matching entities. Combined risk: ' || level || '.' end summary from w""")
def _(s, d):
    _, links, linked = L.profiles(kept(L.mentions(entities(s, d))))
    links, types = kept(links), linked.agg(F.array_sort(F.collect_set("type")).alias("entity_types"))
    return L.linkage_advice(L.linkage_risk(links), types, links.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("doc_pairs"), F.coalesce(F.sum(F.col("n_matches") * F.col("pairs")), F.lit(0)).alias("n_matches")))


_GAZ = [r._replace(type=R.NLP_TYPES[r.name]) for r in R.NAMED]
_PLACES_SQL = f"cases as (select doc_id, text || ' Met ' || [{', '.join(map(said, _FIRSTS))}][doc_id % 5 + 1] || ' of Prime ' || ['Hospital', 'Bank', 'Industries'][doc_id % 3 + 1] || ' near ' || [{', '.join(map(said, R.CITIES))}][doc_id % {len(R.CITIES)} + 1] || '. Pune is far.' as text from ({{0}}))"
_NAMED_SQL = f"""with c0 as (with {_CASES_SQL} select * from cases), {_PLACES_SQL.format('select * from c0')},
{S.raw_spans(R.CORE + _GAZ, 'cases').replace('raw as (', 'raw1 as (')},
raw as (select r.doc_id, ord, type, case when ord < {len(R.CORE)} then confidence else least(99, 85 + case when regexp_matches(r.text, '(^|\\s)[^A-Z\\s]') then 0 else 5 end
  + case when s = 0 or right(rtrim(left(c.text, s)), 1) in ('.', '!', '?') then 3 else 0 end - case when length(r.text) < 3 then 10 else 0 end) / 100 end::double confidence, r.text, s, e from raw1 r join cases c using (doc_id)),
{S.core().split("raw as (select", 1)[1].split("from raw0),", 1)[1]}"""


def _placed(s, d) -> DataFrame:
    """The cases with an organisation and places."""
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    more = F.concat("text", F.lit(" Met "), at(_FIRSTS, 5), F.lit(" of Prime "), at(["Hospital", "Bank", "Industries"], 3), F.lit(" near "), at(R.CITIES, len(R.CITIES)), F.lit(". Pune is far."))
    return _cases(s, d).select("doc_id", more.alias("text"))


@q("detect_named", f'{_NAMED_SQL} select doc_id, type, text, start, "end", confidence, ord from entities')
def _(s, d):
    return spans.explode_spans(_placed(s, d), spans.core_spans(F.col("text"), named=True))


@q("sentence_offsets", r"""with s as (select doc_id, text, regexp_extract_all(text, '[^.!?]+[.!?]+(?:\s+|$)|[^.!?]+$') f, string_split_regex(text, '[^.!?]+[.!?]+(?:\s+|$)|[^.!?]+$') g from documents where text is not null),
r as (select doc_id, i, f[i] m, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0))::int start from s, unnest(generate_series(1, len(f))) u(i))
select doc_id, start, (start + length(m))::int as "end" from r where length(regexp_replace(regexp_replace(m, '^\s+', ''), '\s+$', '')) > 3""")
def _(s, d):
    """Where sentences stand in their text."""
    rows = spread_docs(s, d).where("text is not null").select("doc_id", F.explode(spans.sentence_offsets(F.col("text"))).alias("x"))
    return rows.select("doc_id", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


# ---- graphs

_VIEW = "a as (select occ.* from occ semi join top using (hash)), rich as (select doc_id, count(*) n from a group by doc_id having count(*) > 1)"


@q("graph_view", f"""with {GRAPH}, {_VIEW} select hash id, type || ': ' || left(sample, 8) || '...' as label, 'entity' as kind, docs * 2 + 5 val from top
union all select doc_id::varchar, 'doc' || doc_id || '.txt', 'document', n + 3 from rich""")
def _(s, d):
    """The nodes of the map: the top entities, and the documents that hold more than one of them."""
    n, o = L.graph_nodes(entities(s, d))
    top = kept(L.top_entities(n, o, 100))
    rich = L.graph_links(top, o).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    label = F.concat("type", F.lit(": "), F.left("sample", F.lit(8)), F.lit("..."))
    found = top.select(F.col("hash").alias("id"), label.alias("label"), F.lit("entity").alias("kind"), (F.col("docs") * 2 + 5).alias("val"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return found.unionByName(rich.select(F.col("doc_id").cast("string").alias("id"), name.alias("label"), F.lit("document").alias("kind"), (F.col("n") + 3).alias("val")))


@q("graph_documents", f"with {GRAPH}, h2 as (select doc_id, count(distinct hash) n from h group by doc_id) select doc_id, 'doc' || doc_id || '.txt' file_name, n entity_count from h2")
def _(s, d):
    _, o = L.graph_nodes(entities(s, d))
    return o.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entity_count")).select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), "entity_count")


@q("graph_chain_members", f"with {GRAPH} select hash, doc_id from occ where hash in (select hash from cnt where docs > 1)")
def _(s, d):
    """The documents of each chain, a row for each."""
    n, o = L.graph_nodes(entities(s, d))
    return o.join(kept(L.chains(n, o).select("hash")), "hash", "left_semi").select("hash", "doc_id")


@q("linkage_graph", f"with {LINKS}, n as (select doc_1 doc_id from links union select doc_2 from links) select doc_id::varchar id, 'document' kind, null::varchar target, null::double strength from n union all select doc_1::varchar, 'link', doc_2::varchar, strength from links")
def _(s, d):
    links = kept(L.linkages(matches(s, d)))
    nodes = links.select(F.col("doc_1").alias("doc_id")).unionByName(links.select(F.col("doc_2").alias("doc_id"))).distinct()
    nodes = nodes.select(F.col("doc_id").cast("string").alias("id"), F.lit("document").alias("kind"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("double").alias("strength"))
    return nodes.unionByName(links.select(F.col("doc_1").cast("string").alias("id"), F.lit("link").alias("kind"), F.col("doc_2").cast("string").alias("target"), "strength"))


# ---- composites

@q("inventory_averages", f"""with {S.FILES}, x as (select case risk_level when 'CRITICAL' then 'HIGH' else risk_level end bucket, risk_score from files where entities_count > 0)
select b.bucket as bucket, count(x.risk_score) n, coalesce(round_even(round(avg(x.risk_score), 8), 1), 0.0)::double average from (values ('HIGH'), ('MEDIUM'), ('LOW'), ('MINIMAL')) b(bucket) left join x using (bucket) group by b.bucket""")
def _(s, d):
    bucket = F.when(F.col("risk_level") == "CRITICAL", "HIGH").otherwise(F.col("risk_level")).alias("bucket")
    found = files(s, d).where("entities_count > 0").groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.bround(F.round(F.avg("risk_score"), 8), 1).alias("average"))
    every = s.createDataFrame([(b,) for b in ("HIGH", "MEDIUM", "LOW", "MINIMAL")], "bucket string")
    return every.join(found, "bucket", "left").na.fill(0, ["n", "average"])


@q("scanner_top_per_level", f"with {S.risk()} select doc_id, level, score, nth from (select doc_id, level, score, row_number() over (partition by level order by score desc, doc_id) nth from risk) where nth <= 10")
def _(s, d):
    """The ten documents of highest score in each level: partial tops first, so a level with most of the rows is not one task's."""
    scored = risk.risk_scores(spread_docs(s, d)).select("doc_id", "level", "score")
    local = Window.partitionBy("level", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(F.desc("score"), "doc_id")
    some = scored.withColumn("nth", F.row_number().over(local)).where("nth <= 10").drop("nth")
    return some.withColumn("nth", F.row_number().over(Window.partitionBy("level").orderBy(F.desc("score"), "doc_id")).cast("bigint")).where("nth <= 10").select("doc_id", "level", "score", "nth")


@q("dashboard", f"""with {S.FILES} select 'total_files' as item, count(*) n from files union all select 'files_with_pii', count(*) filter (entities_count > 0) from files
union all select 'bucket_' || lower(b), (select count(*) from files where entities_count > 0 and risk_level = b) from (values ('HIGH'), ('MEDIUM'), ('LOW')) v(b)
union all select 'type_' || t, count(*) from (select unnest(string_split(entity_types, ',')) t from files) where t <> '' group by t
union all select 'recent_' || file_name, risk_score::bigint from (select * from files where entities_count > 0 order by scan_time desc, doc_id limit 10)
union all select 'high_risk_' || file_name, risk_score::bigint from (select * from files where risk_level in ('CRITICAL', 'HIGH') order by risk_score desc, doc_id limit 10)""")
def _(s, d):
    """Totals, buckets, types, the ten newest and the ten riskiest files as one table of items."""
    rows = kept(files(s, d))
    total = rows.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("entities_count") > 0).alias("files_with_pii"), *[F.count_if((F.col("entities_count") > 0) & (F.col("risk_level") == b)).alias(f"bucket_{b.lower()}") for b in ("HIGH", "MEDIUM", "LOW")])
    out = total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in total.columns])).alias("x")).select("x.*")
    kinds = rows.select(F.explode(F.split("entity_types", ",")).alias("t")).where("t <> ''").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(kinds.select(F.concat(F.lit("type_"), "t").alias("item"), "n"))
    newest = rows.where("entities_count > 0").orderBy(F.desc("scan_time"), "doc_id").limit(10)
    riskiest = rows.where(F.col("risk_level").isin("CRITICAL", "HIGH")).orderBy(F.desc("risk_score"), "doc_id").limit(10)
    for name, some in (("recent_", newest), ("high_risk_", riskiest)):
        out = out.unionByName(some.select(F.concat(F.lit(name), "file_name").alias("item"), F.col("risk_score").cast("bigint").alias("n")))
    return out


# ---- logs

_LOG_SQL = f"""{S.FILES},
log as (select doc_id, 'UPLOAD' event_type, '{{"filename":"' || file_name || '","file_size":' || file_size || '}}' event_data, scan_time as timestamp from files
union all select doc_id, 'PROCESSING_COMPLETE', '{{"entities_found":' || entities_count || ',"risk_score":' || risk_score || '}}', scan_time + interval 1 second from files
union all select doc_id, 'REDACTION_APPLIED', '{{"entities_redacted":' || entities_count || '}}', scan_time + interval 2 seconds from files where entities_count > 0)"""


def _log(s, d) -> DataFrame:
    rows, at = kept(files(s, d)), F.col("scan_time")
    later = lambda n: at + F.expr(f"interval {n} second")
    out = logs.events(rows, "doc_id", "UPLOAD", at, filename=F.col("file_name"), file_size=F.col("file_size"))
    out = out.unionByName(logs.events(rows, "doc_id", "PROCESSING_COMPLETE", later(1), entities_found=F.col("entities_count"), risk_score=F.col("risk_score")))
    return out.unionByName(logs.events(rows.where("entities_count > 0"), "doc_id", "REDACTION_APPLIED", later(2), entities_redacted=F.col("entities_count")))


@q("audit_written", f"with {_LOG_SQL} select doc_id, event_type, event_data, strftime(timestamp, '%Y-%m-%d %H:%M:%S') as at from log")
def _(s, d):
    return _log(s, d).select("doc_id", "event_type", "event_data", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@q("document_status", f"with {_LOG_SQL} select doc_id, case when bool_or(event_type = 'REDACTION_APPLIED') then 'redacted' else 'processed' end status, count(*) n_events from log group by doc_id")
def _(s, d):
    return logs.document_status(_log(s, d))


@q("audit_composite", f"""with {_LOG_SQL}, e as (select doc_id, string_agg(type || '=' || n, ',' order by type) entity_summary from (select doc_id, type, count(*) n from entities group by all) group by doc_id),
l as (select doc_id, string_agg(event_type, ',' order by timestamp) events from log group by doc_id)
select doc_id, file_name, events, coalesce(entity_summary, '') entity_summary, risk_level from files join l using (doc_id) left join e using (doc_id)""")
def _(s, d):
    """A document's log in one row: its events in order, its entities by type, its risk. At most three events and a type for each rule."""
    rows = kept(files(s, d))
    lines = _log(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "event_type"))).alias("e"))
    lines = lines.select("doc_id", F.array_join(F.transform("e", lambda x: x["event_type"]), ",").alias("events"))
    kinds = entities(s, d).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("type", F.lit("="), F.col("n").cast("string")))), ",").alias("entity_summary"))
    return rows.join(lines, "doc_id").join(kinds, "doc_id", "left").select("doc_id", "file_name", "events", F.coalesce("entity_summary", F.lit("")).alias("entity_summary"), "risk_level")


@q("global_stats", f"""with {S.risk()}, t as (select type, count(*) n from entities group by 1)
select (select count(*) from documents) documents, (select count(*) from entities) entities, (select string_agg(type || '=' || n, ',' order by n desc, type) from t) by_type,
 (select coalesce(round_even(round(sum((score * 10)::bigint) / 10.0 / count(*), 8), 2), 0)::double from risk) average_risk, (select count(*) from risk where n_entities > 0) redacted""")
def _(s, d):
    scored = kept(risk.risk_scores(spread_docs(s, d)).select("doc_id", "n_entities", "score"))
    one = lambda df: df.withColumn("k", F.lit(1))  # noqa: E731  tables of one row
    tenths = F.sum(F.round(F.col("score") * 10).cast("bigint"))
    total = scored.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_entities").alias("entities"), F.coalesce(F.bround(F.round(tenths / 10 / F.count(F.lit(1)), 8), 2), F.lit(0.0)).alias("average_risk"), F.count_if(F.col("n_entities") > 0).alias("redacted"))
    kinds = entities(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "type"))).alias("t"))
    by = F.array_join(F.transform("t", lambda x: F.concat(x["type"], F.lit("="), (-x["less"]).cast("string"))), ",")
    return one(total).join(one(kinds.select(by.alias("by_type"))), "k").drop("k")


@q("action_states", """with l as (select user_id * 10 + event_id % 3 as action_id, event_id, case event_type when 'error' then 'failed' when 'purchase' then 'completed' else 'in_progress' end status from events)
select action_id, arg_max(status, event_id) status, max(event_id) event_id from l group by action_id""")
def _(s, d):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("in_progress")
    log = table(s, d, "events").select((F.col("user_id") * 10 + F.col("event_id") % 3).alias("action_id"), "event_id", status.alias("status"))
    return logs.latest(log, "action_id", ["event_id"])


@q("token_states", f"""with t as (select event_id token, ts issued_at, 24 + event_id % 100 hours_valid from events where event_type = 'signup'), r as (select distinct event_id - 1 token from events where event_type = 'error')
select token, strftime(issued_at + to_hours(hours_valid::int), '%Y-%m-%d %H:%M') expires_at, case when token in (select token from r) then 'revoked' when issued_at + to_hours(hours_valid::int) < timestamp '{AS_OF}' then 'expired' else 'active' end state from t""")
def _(s, d):
    e = table(s, d, "events")
    issued = e.where("event_type = 'signup'").select(F.col("event_id").alias("token"), F.col("ts").alias("issued_at"), (F.lit(24) + F.col("event_id") % 100).cast("int").alias("hours_valid"))
    revoked = e.where("event_type = 'error'").select((F.col("event_id") - 1).alias("token"))
    states = logs.token_states(issued, revoked, F.lit(AS_OF).cast("timestamp_ntz"))
    return states.withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd HH:mm"))


@q("feedback_rows", f"with {S.core()} select left(sha256('fb:' || text || ':' || doc_id || ':' || start), 12) feedback_id, type entity_type, (doc_id % 3 <> 0)::int is_correct from entities")
def _(s, d):
    fid = F.left(F.sha2(F.concat(F.lit("fb:"), "text", F.lit(":"), F.col("doc_id").cast("string"), F.lit(":"), F.col("start").cast("string")), 256), F.lit(12))
    return entities(s, d).select(fid.alias("feedback_id"), F.col("type").alias("entity_type"), (F.col("doc_id") % 3 != 0).cast("int").alias("is_correct"))


@q("entity_projection", f"with {S.core()} select doc_id, type, confidence, 'regex' as method, confidence > 0.8 as sure from entities")
def _(s, d):
    return entities(s, d).select("doc_id", "type", "confidence", F.lit("regex").alias("method"), (F.col("confidence") > 0.8).alias("sure"))


@q("history_reads", "select event_id, user_id, event_type from events where event_type in ('purchase', 'error') order by ts desc, event_id limit 50")
def _(s, d):
    return table(s, d, "events").where(F.col("event_type").isin("purchase", "error")).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id", "event_type")


@q("failed_actions", "select user_id, count(*) n, max(event_id) last_event from events where event_type = 'error' group by user_id having count(*) > 1")
def _(s, d):
    rows = table(s, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))
    return rows.where("n > 1")


@q("remediation_by_type", "select event_type, count(*) n, round_even(count(*) * 100 / (select count(*) from events), 2)::double share from events group by 1")
def _(s, d):
    rows = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = table(s, d, "events").agg(F.count(F.lit(1)).alias("t")).withColumn("k", F.lit(1))
    return rows.withColumn("k", F.lit(1)).join(total, "k").select("event_type", "n", F.bround(F.col("n") * 100 / F.col("t"), 2).alias("share"))


# ---- synthetic data

_h = lambda at, n: f"(('0x' || substr(md5(x), {at}, 4))::bigint % {n})"
_p = lambda at, vs: f"[{', '.join(map(S.quoted, vs))}][{_h(at, len(vs))} + 1]"
_D, _A = "translate(md5(x), 'abcdef', '012345')", "translate(md5('1:' || x), '0123456789abcdef', 'ABCDEFGHIJKLMNOP')"
_PERSON = f"({_p(1, synthetic.FIRST)} || ' ' || {_p(5, synthetic.LAST)})"
_LUHN = "(list_sum(list_transform(generate_series(1, 15), lambda i: case when i % 2 = 1 then case when r[i]::int * 2 > 9 then r[i]::int * 2 - 9 else r[i]::int * 2 end else r[i]::int end))::int)"


def _email_sql(name: str) -> str:
    return f"lower(replace({name}, ' ', '.')) || substr({_D}, 20, 2) || '@' || {_p(9, synthetic.DOMAINS)}"


@q("synthetic_types", f"""with t as (select c_custkey, c_name x, unnest([{', '.join(map(S.quoted, synthetic.TYPES))}]) as type from customer), u as (select *, '4' || substr({_D}, 1, 14) card from t),
v as (select *, card || ((10 - {_LUHN.replace('r[', "list_reverse(string_split(card, ''))[")} % 10) % 10)::varchar whole from u)
select c_custkey, type, case type when 'PAN' then substr({_A}, 1, 3) || {_p(1, synthetic.HOLDERS)} || substr({_A}, 5, 1) || substr({_D}, 1, 4) || substr({_A}, 6, 1)
 when 'AADHAAR' then ({_h(1, 8)} + 2) || substr({_D}, 2, 3) || ' ' || substr({_D}, 5, 4) || ' ' || substr({_D}, 9, 4) when 'EMAIL' then {_email_sql(_PERSON)}
 when 'PHONE' then '+91 ' || ({_h(1, 4)} + 6) || substr({_D}, 2, 4) || ' ' || substr({_D}, 6, 5) when 'PERSON_NAME' then {_PERSON} when 'LOCATION' then {_p(1, R.CITIES)} || ', ' || {_p(5, synthetic.STATES)}
 when 'ORGANIZATION' then {_p(1, synthetic.ORGS[0])} || ' ' || {_p(5, synthetic.ORGS[1])} when 'DATE_OF_BIRTH' then lpad(({_h(1, 28)} + 1)::varchar, 2, '0') || '/' || lpad(({_h(5, 12)} + 1)::varchar, 2, '0') || '/' || ({_h(9, 50)} + 1950)
 when 'CREDIT_CARD' then substr(whole, 1, 4) || ' ' || substr(whole, 5, 4) || ' ' || substr(whole, 9, 4) || ' ' || substr(whole, 13, 4) when 'IFSC' then {_p(1, synthetic.BANKS)} || '0' || substr({_D}, 1, 6)
 when 'PASSPORT' then substr({_A}, 1, 1) || substr({_D}, 1, 7) when 'DRIVING_LICENSE' then {_p(1, synthetic.LICENCES)} || ({_h(5, 15)} + 10) || ' ' || substr({_D}, 1, 4) || ' ' || substr({_D}, 5, 7)
 when 'BANK_ACCOUNT' then substr({_D}, 1, ({_h(1, 8)} + 9)::int) when 'IP_ADDRESS' then ({_h(1, 223)} + 1) || '.' || {_h(5, 256)} || '.' || {_h(9, 256)} || '.' || ({_h(13, 254)} + 1) else '[SYNTHETIC DATA]' end replacement from v""")
def _(s, d):
    rows = table(s, d, "customer").select("c_custkey", "c_name", F.explode(F.array(*map(F.lit, synthetic.TYPES))).alias("type"))
    return rows.select("c_custkey", "type", synthetic.replacement(F.col("type"), F.col("c_name")).alias("replacement"))


@q("synthetic_batch", f"with c as (select c_custkey, c_name x from customer) select c_custkey, {_PERSON} as name, {_email_sql(_PERSON)} email from c")
def _(s, d):
    """Stand-ins that belong together: the address is made of the name."""
    name = synthetic.person(F.col("c_name"))
    return table(s, d, "customer").select("c_custkey", name.alias("name"), synthetic.email(name, F.col("c_name")).alias("email"))


QUERIES, ORACLE = Q, O

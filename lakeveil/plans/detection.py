"""Queries that find and score entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeveil.functions import rules as R
from lakeveil.operators import risk, spans
from lakeveil.sources.tables import spread, table

from . import sql as S

SPAN_COLUMNS = ["doc_id", "type", "text", "start", "end", "confidence", "ord"]
SPAN_SQL = 'doc_id, type, text, start, "end", confidence, ord'


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def spread_docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(docs(spark, d).select("doc_id", "text"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    return spans.detect(spread_docs(spark, d))


def _watcher(spark: SparkSession, d: str) -> DataFrame:
    return spans.explode_spans(spread_docs(spark, d).where("text is not null"), spans.watcher_spans(F.col("text")))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return spans.explode_spans(spread_docs(spark, d).where("text is not null"), spans.all_spans(F.col("text"), R.CORE))


def _mode(mode: str):
    return lambda spark, d: spans.explode_spans(spread_docs(spark, d).where("text is not null"), spans.mode_spans(F.col("text"), mode))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    plain = table(spark, d, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return spans.detect(plain, key="page_id")


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return spans.detect(turns, key="turn_id")


def quick(spark: SparkSession, d: str, found: str) -> DataFrame:
    rows = spread_docs(spark, d)
    if found == "api":
        n, each, medium = F.size(spans.core_spans(F.col("text"))), 10, 30
    else:
        n, each, medium = F.size(spans.watcher_spans(F.col("text"))), 15, 40
    score, level = risk.quick_score(F.greatest(n, F.lit(0)).cast("bigint"), each, medium)
    return rows.select("doc_id", score.alias("score"), level.alias("level"))


def _quick_sql(source: str, each: int, medium: int) -> str:
    return f"""with {source}, c as (select doc_id, count(*) n from {'entities' if 'entities' in source else 'raw'} group by doc_id),
s as (select d.doc_id, least({each} * coalesce(n, 0), 100)::bigint score from documents d left join c using (doc_id))
select doc_id, score, case when score > 70 then 'HIGH' when score > {medium} then 'MEDIUM' else 'LOW' end as level from s"""


def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    return risk.risk_scores(spread_docs(spark, d))


def _actions(spark: SparkSession, d: str) -> DataFrame:
    rows = spans.with_entities(spread_docs(spark, d)).where("size(entities) > 0")
    score, level = risk.quick_score(F.size("entities").cast("bigint"), 15, 40)
    return risk.suggest_actions(rows.select("doc_id", score.alias("score"), level.alias("level"), risk.types_of(F.col("entities")).alias("types")))


_DIRECT = "list_has_any(types, [" + ", ".join(map(S.quoted, R.SSN_DIRECT)) + "])"
_ACTIONS_SQL = f"""with {S.core()}, {S.PER_DOC},
s as (select doc_id, least(15 * n, 100) score, case when 15 * n > 70 then 'HIGH' when 15 * n > 40 then 'MEDIUM' else 'LOW' end as level, types from docs where n > 0),
a as (select doc_id, 1 priority, 0 o, 'move_to_vault' as action, true automatic from s where level = 'HIGH' or score >= 70
union all select doc_id, 2, 1, 'create_incident', true from s where level = 'HIGH' or score >= 70
union all select doc_id, case level when 'HIGH' then 3 else 1 end, 2, 'redact_replace', true from s where {_DIRECT}
union all select doc_id, case level when 'HIGH' then 4 else 2 end, 3, 'encrypt_quarantine', level in ('HIGH', 'MEDIUM') from s
union all select doc_id, case level when 'HIGH' then 3 else 5 end, 4, 'notify_admin', level = 'HIGH' from s
union all select doc_id, 6, 5, 'create_incident', false from s where level in ('MEDIUM', 'LOW') and not {_DIRECT})
select doc_id, (row_number() over (partition by doc_id order by priority, o) - 1)::int nth, action, priority, automatic from a"""

_first = ", ".join(f"('{t}', '{n[0]}')" for t, ns in R.TITLE_NAMES.items() for n in ns)
_WINDOW = 'substr(t, greatest(start - 100, 0) + 1, least(length(t), "end" + 100) - greatest(start - 100, 0))'
_GUESS = "greatest(" + ", ".join(
    f"case when contains({_WINDOW}, {S.quoted(t)}) then case when upper(left(text, 1)) in {S.listed(sorted({n[0] for n in ns}))} then 35 else 15 end else 0 end" for t, ns in R.TITLE_NAMES.items()
) + ")"
_VULN = f"""{S.core()}, {S.PER_DOC}, x as (select e.*, t from entities e join docs using (doc_id)),
v as (select doc_id, 'CONTEXT_PREDICTION' kind, case when g > 30 then 'HIGH' else 'MEDIUM' end severity, type entity_type from (select doc_id, type, case when type = 'PERSON_NAME' then {_GUESS} else 0 end g from x) where g > 0
union all select doc_id, 'FORMAT_LEAKAGE', case type when 'EMAIL' then 'MEDIUM' else 'LOW' end, type from x where (type = 'PHONE' and starts_with(text, '+91 9')) or (type = 'PAN' and length(text) >= 4)
  or (type = 'EMAIL' and not ({' or '.join(f"ends_with(split_part(text, '@', 2), {S.quoted(dom)})" for dom in R.OPEN_DOMAINS)}))
union all select doc_id, 'CROSS_REFERENCE', 'HIGH', type from x where type in ('PHONE', 'EMAIL')
union all select doc_id, 'PARTIAL_INFORMATION', 'HIGH', 'COMBINATION' from docs where list_has_all(types, ['PERSON_NAME', 'DATE_OF_BIRTH'])
union all select doc_id, 'METADATA_EXPOSURE', 'MEDIUM', 'METADATA' from docs, (values {', '.join(f"({S.quoted(p)})" for p in R.METADATA_PATTERNS)}) m(p) where regexp_matches(t, '(?i)' || p))"""
_ROBUST_SQL = f"""with {_VULN},
k as (select doc_id, kind, max({S.mapped('severity', R.PENALTY, 5)}) w, count(*) n from v group by all),
s as (select d.doc_id, greatest(5, 100 - coalesce(sum(w + least(10, n // 2)), 0))::bigint score from documents d left join k using (doc_id) group by d.doc_id)
select doc_id, score, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end grade from s"""

_contexts = ", ".join(f"case when {S.any_term('t', terms)} then '{k}' end" for k, (_, terms) in R.CONTEXT_TERMS.items())
_boost = "+".join(f"case when {S.any_term('t', terms)} then {n} else 0 end" for n, terms in R.CONTEXT_TERMS.values())
_scale = "[" + ", ".join(map(S.quoted, R.SENSITIVITY_SCALE)) + "]"
_EXPLAIN = f"""{S.core()}, {S.PER_DOC},
c as (select doc_id, coalesce(array_to_string(list_filter([{_contexts}], lambda x: x is not null), ','), '') contexts, {_boost} boost from docs),
x as (select doc_id, start, type, contexts, {_scale}[least(6, list_position({_scale}, {S.mapped('type', R.SENSITIVITY, 'MEDIUM')}) + boost)] sensitivity from entities join c using (doc_id)),
explained as (select doc_id, start, type, {S.mapped('type', R.CATEGORY, 'Personal Information')} category, contexts, sensitivity,
 {S.mapped('sensitivity', {k: v[0] for k, v in R.SENSITIVITY_RISK.items()}, 'MODERATE')} risk_level, {S.mapped('sensitivity', {k: v[1] for k, v in R.SENSITIVITY_RISK.items()}, 50)} risk_score,
 case when sensitivity in ('CRITICAL', 'HIGH') then 'MANDATORY' when sensitivity in ('MEDIUM-HIGH', 'MEDIUM') then 'RECOMMENDED' else 'OPTIONAL' end advice from x)"""


def _explain_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = risk.explain(spread_docs(spark, d))
    return rows.groupBy("sensitivity").agg(F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("total_risk"), F.count_if(F.col("risk_score") >= 80).alias("n_high"))


def _redact(spark: SparkSession, d: str) -> DataFrame:
    rows = spans.with_entities(spread_docs(spark, d)).where("size(entities) > 0").withColumn("redacted", spans.redact(F.col("text"), F.col("entities")))
    return rows.select("doc_id", "redacted", F.array_join(spans.leaked(F.col("redacted"), F.col("entities")), "|").alias("leaked"))


_REDACT_SQL = f"""with {S.core()},
k as (select doc_id, text t, ks, list_concat([0], list_transform(ks, lambda x: x.e)) starts from kept join documents using (doc_id)),
r as (select doc_id, ks, array_to_string(list_transform(generate_series(1, len(ks)), lambda i: substr(t, starts[i] + 1, ks[i].s - starts[i]) || '[REDACTED-' || ks[i].type || ']'), '') || substr(t, starts[len(starts)] + 1) redacted from k)
select doc_id, redacted, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(ks, lambda x: x.text), lambda y: contains(redacted, y)))), '|'), '') leaked from r"""

SYNTHETIC = {"PERSON_NAME": ["Asha Verma", "Ravi Menon", "Meera Joshi", "Arjun Das"], "EMAIL": ["a@mail.example", "b@mail.example"], "PHONE": ["5550000001", "5550000002", "5550000003"], "IP_ADDRESS": ["192.0.2.1", "192.0.2.2"]}  # invented values


def _synthetic(spark: SparkSession, d: str) -> DataFrame:
    """The same text gets the same stand-in everywhere: it is chosen by the text's MD5."""
    at = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint")
    out = F.lit("[SYNTHETIC DATA]")
    for kind, values in SYNTHETIC.items():
        out = F.when(F.col("type") == kind, F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))).otherwise(out)
    return entities(spark, d).select("doc_id", "start", "type", out.alias("replacement"))


_SYNTH_SQL = f"""with {S.core()}, m as (select doc_id, start, type, ('0x' || left(md5(text), 8))::bigint h from entities)
select doc_id, start, type, case type {' '.join(f"when '{k}' then [{', '.join(map(S.quoted, v))}][h % {len(v)} + 1]" for k, v in SYNTHETIC.items())} else '[SYNTHETIC DATA]' end replacement from m"""


def _masked(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    text = F.col("text")
    return e.select("doc_id", "start", spans.mask(text).alias("preview"), spans.mask(text, 5, 0).alias("link_preview"), spans.mask(text, 3, 4).alias("short"), spans.truncated(text).alias("cut"), spans.entity_hash(text).alias("hash"))


_MASK_SQL = f"""with {S.core()} select doc_id, start, case when length(text) > 3 then left(text, 3) || '***' else '***' end preview, left(text, 5) || '***' link_preview,
case when length(text) > 4 then left(text, 3) || '***' else '***' end short, case when length(text) > 20 then left(text, 20) || '...' else text end cut, left(sha256(text), 16) hash from entities"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where("text is not null").select("doc_id", spans.sentences(F.col("text")).alias("s")).select(
        "doc_id", F.size("s").cast("bigint").alias("n"), F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)).cast("bigint").alias("chars")
    )


_SENTENCE_SQL = r"""with s as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]+(?:\s+|$)|[^.!?]+$'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: length(x) > 3) s from documents where text is not null)
select doc_id, len(s)::bigint n, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::bigint chars from s"""


def _contexts_q(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs(spark, d).select("doc_id", *[risk.any_term(t, terms).alias(k) for k, (_, terms) in R.CONTEXT_TERMS.items()])


QUERIES = {
    "detect_core": entities,
    "detect_strict": lambda s, d: spans.detect(spread_docs(s, d), strict=True),
    "detect_raw": _raw,
    "detect_mode_strict": _mode("strict"),
    "detect_mode_balanced": _mode("balanced"),
    "detect_mode_triage": _mode("triage"),
    "detect_watcher": _watcher,
    "detect_pages": _pages,
    "detect_conversations": _conversations,
    "quick_score_api": lambda s, d: quick(s, d, "api"),
    "quick_score_watcher": lambda s, d: quick(s, d, "watcher"),
    "risk_scores": risk_scores,
    "risk_levels": lambda s, d: risk_scores(s, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top")),
    "risk_contexts": _contexts_q,
    "remediation_actions": _actions,
    "vulnerabilities": lambda s, d: risk.vulnerabilities(spread_docs(s, d)).groupBy("kind", "severity", "entity_type").agg(F.count(F.lit(1)).alias("n")),
    "robustness": lambda s, d: risk.robustness(spread_docs(s, d)),
    "explain_entities": lambda s, d: risk.explain(spread_docs(s, d)),
    "explain_summary": _explain_summary,
    "redact_text": _redact,
    "synthetic_text": _synthetic,
    "mask_previews": _masked,
    "sentences": _sentences,
}

_strict = S.core().replace("where s >= 0", "")
ORACLE = {
    "detect_core": f"with {S.core()} select {SPAN_SQL} from entities",
    "detect_strict": f"""with {S.raw_spans(R.CORE, sure='1.0').replace('raw as (', 'raw1 as (')},
raw as (select * from raw1 where case type when 'PAN' then length(text) = 10 and substr(text, 4, 1) in {S.listed('ABCFGHLJPTE')} when 'AADHAAR' then length(replace(text, ' ', '')) = 12 and left(text, 1) not in ('0', '1') else true end),
{S.core().split("raw as (select", 1)[1].split("from raw0),", 1)[1]} select {SPAN_SQL} from entities""",
    "detect_raw": f'with {S.raw_spans(R.CORE)} select doc_id, type, text, s as start, e as "end", confidence, ord from raw',
    "detect_watcher": f'with {S.raw_spans(R.WATCHER)} select doc_id, type, text, s as start, e as "end", confidence, ord from raw',
    "detect_pages": f"with plain as (select page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') as text from pages), {S.core('plain', key='page_id')} select doc_id page_id, {SPAN_SQL.removeprefix('doc_id, ')} from entities",
    "detect_conversations": f"with turns as (select conv_id * 1000 + turn turn_id, text from conversations where text is not null), {S.core('turns', key='turn_id')} select doc_id turn_id, {SPAN_SQL.removeprefix('doc_id, ')} from entities",
    "quick_score_api": _quick_sql(S.core(), 10, 30),
    "quick_score_watcher": _quick_sql(S.raw_spans(R.WATCHER), 15, 40),
    "risk_scores": f"with {S.risk()} select * exclude (types) from risk",
    "risk_levels": f"with {S.risk()} select level, count(*) n, max(score) top from risk group by level",
    "risk_contexts": "select doc_id, " + ", ".join(f"{S.any_term(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')', terms)} as {k}" for k, (_, terms) in R.CONTEXT_TERMS.items()) + " from documents",
    "remediation_actions": _ACTIONS_SQL,
    "vulnerabilities": f"with {_VULN} select kind, severity, entity_type, count(*) n from v group by all",
    "robustness": _ROBUST_SQL,
    "explain_entities": f"with {_EXPLAIN} select * from explained",
    "explain_summary": f"with {_EXPLAIN} select sensitivity, count(*) n, sum(risk_score)::bigint total_risk, count(*) filter (risk_score >= 80) n_high from explained group by sensitivity",
    "redact_text": _REDACT_SQL,
    "synthetic_text": _SYNTH_SQL,
    "mask_previews": _MASK_SQL,
    "sentences": _SENTENCE_SQL,
} | {f"detect_mode_{m}": f"with {S.modes(m)} select {SPAN_SQL} from entities" for m in R.MODE_LEAST}

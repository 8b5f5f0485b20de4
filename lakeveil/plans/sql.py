"""SQL for the oracles: the same spans, entities and files in DuckDB's dialect."""

from __future__ import annotations

from lakeveil.functions import rules as R


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def mapped(column: str, values: dict, default) -> str:
    q = lambda v: quoted(v) if isinstance(v, str) else str(v)
    return f"case {column} " + " ".join(f"when {quoted(k)} then {q(v)}" for k, v in values.items()) + f" else {q(default)} end"


def raw_spans(rules: list[R.Rule], table: str = "documents", text: str = "text", flags: str = "", sure: str | None = None, key: str = "doc_id") -> str:
    """CTEs scan and raw(doc_id, ord, type, confidence, text, s, e). Accented letters count as letters for word edges of names."""
    parts = []
    for i, r in enumerate(rules):
        p = quoted(flags + r.pattern)
        t = f"regexp_replace({text}, '[\\x{{00C0}}-\\x{{024F}}]', '_', 'g')" if r.type == "PERSON_NAME" else text
        parts.append(
            f"select {key} doc_id, {i} ord, {quoted(r.type)} as type, {sure or r.confidence} confidence, {text} t, regexp_extract_all({t}, {p}) f, string_split_regex({t}, {p}) g"
            f" from {table} where regexp_matches({t}, {p})"
        )
    return f"""scan as ({' union all '.join(parts)}),
raw0 as (select doc_id, ord, type, confidence, t, f[i] m, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0))::int s
  from scan, unnest(generate_series(1, len(f))) u(i)),
raw as (select doc_id, ord, type, confidence::double confidence, substr(t, s + 1, length(m)) as text, s, (s + length(m))::int e from raw0)"""


SORTED = "sorted as (select doc_id, list({'s': s, 'e': e, 'type': type, 'text': text, 'c': confidence, 'o': ord} order by %s) xs from raw group by doc_id)"
UNPACK = "entities as (select doc_id, k.type as type, k.text as text, k.s as start, k.e as \"end\", k.c confidence, k.o ord from (select doc_id, unnest(ks) k from kept))"


def core(table: str = "documents", text: str = "text", key: str = "doc_id") -> str:
    return f"""{raw_spans(R.CORE, table, text, key=key)},
{SORTED % 's, -confidence, ord'},
kept as (select doc_id, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: case when x[1].s >= a[len(a)].e then list_concat(a, x) else a end) ks from sorted),
{UNPACK}"""


def modes(mode: str) -> str:
    rules = [r for r in R.MODES if r.confidence >= R.MODE_LEAST[mode]]
    return f"""{raw_spans(rules, flags='(?i)')},
{SORTED % '-confidence, s, ord'},
kept as (select doc_id, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: case when len(list_filter(a, lambda k: k.s < x[1].e and x[1].s < k.e)) = 0 then list_concat(a, x) else a end) ks from sorted),
{UNPACK}"""


def any_term(column: str, terms: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({column}), {quoted(t)})" for t in terms) + ")"


PER_DOC = """docs as (select d.doc_id, coalesce(d.text, '') t, coalesce(e.n, 0) n, coalesce(e.types, []) types, coalesce(e.seq, []) seq
  from documents d left join (select doc_id, count(*) n, list_sort(list_distinct(list(type))) types, list(type order by start) seq from entities group by doc_id) e using (doc_id))"""

#: The inventory of scanned files, with the watcher's score on core entities.
FILES = f"""{core()},
{PER_DOC},
files as (select doc_id, '/' || coalesce(d.source, '') || '/doc' || doc_id || '.txt' file_path, 'doc' || doc_id || '.txt' file_name, d.n_chars file_size, n entities_count, array_to_string(types, ',') entity_types,
  least(15 * n, 100) risk_score, case when 15 * n > 70 then 'HIGH' when 15 * n > 40 then 'MEDIUM' else 'LOW' end risk_level,
  timestamp '2024-01-01 00:00:00' + to_minutes(doc_id::int) scan_time from docs join documents d using (doc_id))"""


def risk() -> str:
    w = lambda default: mapped("x", R.RISK_WEIGHT, default)
    direct = listed(R.DIRECT_TYPES)
    danger = ", ".join(f"case when list_has_all(q, [{', '.join(map(quoted, need))}]) then {{'name': {quoted(name)}, 'risk': {risk}}} end" for name, need, risk in R.DANGER)
    context = " + ".join(f"case when {any_term('t', terms)} then {add} else 0 end" for add, terms in R.RISK_TERMS)
    fold = (
        "list_reduce(list_transform(seq, lambda y: {'k': 0::bigint, 'done': false, 'type': y}), lambda a, x: {'k': case when a.done then a.k"
        f" when x.type in {listed(R.UNIQUE_TYPES)} then 1 when x.type in ('EMAIL', 'PHONE') then least(a.k, 1) when x.type = 'LOCATION' then least(a.k, 10000000)"
        " when x.type = 'DATE_OF_BIRTH' then a.k // 365 when x.type = 'PERSON_NAME' then a.k // 1000 when x.type = 'ORGANIZATION' then least(a.k, 100000) else a.k end,"
        f" 'done': a.done or x.type in {listed(R.UNIQUE_TYPES)}, 'type': x.type}}, {{'k': 1400000000::bigint, 'done': false, 'type': ''}}).k"
    )
    return f"""{core()},
{PER_DOC},
parts as (select *, list_filter(seq, lambda x: x in {direct}) d, list_filter(seq, lambda x: x not in {direct}) q from docs),
risks as (select *, case when len(d) = 0 then 0 else least(100, list_max(list_transform(d, lambda x: {w(50)})) + least(10 * len(d), 30)) end::int direct_risk,
  list_filter([{danger}], lambda x: x is not null) found, least({context} + case when n > 10 then 10 else 0 end, 50)::int context_risk, greatest({fold}, 1) k from parts),
risks2 as (select *, case when len(q) = 0 then 0.0 when len(found) > 0 then list_max(list_transform(found, lambda x: x.risk))::double
  else list_sum(list_transform(q, lambda x: {w(30)}))::double / len(q) * 0.5 end quasi_risk from risks),
scores as (select *, case when n = 0 then 0.0 else round_even(round(least(least(direct_risk * 0.4::double + quasi_risk * 0.3::double + context_risk * 0.3::double, 100.0)
  + case when k <= 2 then 30.0 when k <= 5 then 10.0 else 0.0 end, 100.0), 8), 1) end::double score from risks2),
risk as (select doc_id, n::bigint n_entities, case when n = 0 then 0 else direct_risk end direct_risk, case when n = 0 then 0.0 else quasi_risk end::double quasi_risk, case when n = 0 then 0 else context_risk end context_risk,
  case when n > 0 then k end k_anonymity, score, case when n = 0 then 'MINIMAL' when score >= 80 then 'CRITICAL' when score >= 60 then 'HIGH' when score >= 40 then 'MEDIUM' when score >= 20 then 'LOW' else 'MINIMAL' end as level,
  coalesce(array_to_string(list_transform(found, lambda x: x.name), '; '), '') combinations, types from scores)"""

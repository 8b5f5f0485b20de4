"""Names by a sequence model: labelled texts made for customers, names found in held-out ones, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeveil.functions import rules as R
from lakeveil.operators import names, spans
from lakeveil.sources.tables import kept, table

from . import sql as S

Q, O = {}, {}
# Invented values: syllables of names, kinds of organisations, endings of towns, and sentences with capitals of other words.
HEAD, TAIL = ["Ka", "Ri", "Me", "So", "Ta", "Vi", "Lo", "Da", "Ne", "Pa"], ["ran", "vik", "thi", "lan", "mar", "desh", "nu", "rell", "sha", "bo"]
ORGS, TOWNS = ["Hospital", "Bank", "Industries", "Services", "Clinic", "Works", "Traders", "Council"], ["pur", "nagar", "bad", "ganj"]
SENTENCES = [
    "Seen by Dr. {PERSON} on a visit.", "Yesterday {PERSON} met the board of {ORG} in {GPE}.", "A transfer from {ORG} to {PERSON} was cleared.", "Patients travel from {GPE} to {ORG} every week.",
    "The nurse told {PERSON} to wait.", "Invoices for Monday went to {ORG} by post.", "Please ask {PERSON} about the Report.", "{PERSON} lives near {GPE}.", "Our office in {GPE} is closed.", "Nothing was signed by {PERSON} or by {ORG}!",
]


def _number(salt: str, below: int, sql: bool):
    if sql:
        return f"(('0x' || substr(md5('{salt}:' || c_name), 1, 6))::bigint % {below})"
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.col("c_name"))), 1, 6), 16, 10).cast("bigint") % below


def _pick(salt: str, values: list[str], sql: bool):
    if sql:
        return f"[{', '.join(map(S.quoted, values))}][{_number(salt, len(values), True)} + 1]"
    return F.element_at(F.array(*map(F.lit, values)), (_number(salt, len(values), False) + 1).cast("int"))


def _name(label: str, salt: str, sql: bool):
    """The parts of a name."""
    head, tail = (_pick(f"{salt}{label}{k}", v, sql) for k, v in enumerate((HEAD, TAIL)))
    space = "' '" if sql else F.lit(" ")
    more = {
        "PERSON": lambda: [space, *(_pick(f"{salt}{label}{k}", v, sql) for k, v in ((2, HEAD), (3, TAIL)))],
        "ORG": lambda: [space, _pick(f"{salt}{label}4", ORGS, sql)],
        "GPE": lambda: [_pick(f"{salt}{label}5", TOWNS, sql)],
    }
    return [head, *([] if label == "GPE" else [tail]), *more[label]()]


def _parts(sentence: str) -> list[tuple[str, bool]]:
    """(text or label, whether it is a label)."""
    return [(x, k % 2 == 1) for k, x in enumerate(sentence.replace("{", "\0").replace("}", "\0").split("\0")) if x]


def _sentence(nth: int) -> Column:
    """One of the sentences, as an array of (text, label)."""
    each = []
    for k, sentence in enumerate(SENTENCES):
        own = [F.struct((F.concat(*_name(x, f"{nth}.{k}.{j}", False)) if is_label else F.lit(x)).alias("x"), F.lit(x if is_label else None).cast("string").alias("label")) for j, (x, is_label) in enumerate(_parts(sentence))]
        each.append(F.array(*own))
    out = each[0]
    for k, x in enumerate(each[1:], 1):
        out = F.when(_number(f"{nth}", len(SENTENCES), False) == k, x).otherwise(out)
    return out


def labelled(s, d) -> DataFrame:
    """doc_id, text, spans (start, end, label): two sentences for each customer."""
    gap = F.array(F.struct(F.lit(" ").alias("x"), F.lit(None).cast("string").alias("label")))
    parts = F.concat(_sentence(0), gap, _sentence(1))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(names.SPANS).alias("out"))
    placed = F.aggregate("parts", none, lambda a, p: F.struct((a["at"] + F.length(p["x"])).alias("at"), F.when(p["label"].isNull(), a["out"]).otherwise(
        F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(p["x"])).alias("end"), p["label"].alias("label"))))).alias("out")), lambda a: a["out"])
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(parts)).alias("parts"))
    return rows.select("doc_id", F.array_join(F.transform("parts", lambda p: p["x"]), "").alias("text"), placed.alias("spans"))


def _sentence_sql(nth: int) -> str:
    each = []
    for k, sentence in enumerate(SENTENCES):
        own = [f"{{'x': {' || '.join(_name(x, f'{nth}.{k}.{j}', True)) if is_label else S.quoted(x)}, 'label': {S.quoted(x) if is_label else 'null::varchar'}}}" for j, (x, is_label) in enumerate(_parts(sentence))]
        each.append(f"[{', '.join(own)}]")
    return f"case {_number(f'{nth}', len(SENTENCES), True)} " + " ".join(f"when {k} then {x}" for k, x in enumerate(each)) + " end"


def _score_sql(n: str, total: str, ways: int) -> str:
    return f"floor(1000 * ln((10 * {n} + 1)::double / (10 * {total} + {ways})) + 0.5)::bigint"


N_TAGS, W = len(names.TAGS), "[A-Za-z0-9_\\x{00C0}-\\x{024F}]"
_TOKEN = "[A-Za-z0-9_\\x{00C0}-\\x{024F}]+|[^A-Za-z0-9_\\x{00C0}-\\x{024F}\\s]"
_BACK = "regexp_matches(tok, '^" + W + "')"
_ALLOWED = " ".join(f"when f = {a} and t = {t} then {names.NEVER}" for a in range(N_TAGS + 1) for t in range(N_TAGS) if not names.allowed(a, t))
#: CTEs up to found(doc_id, start, end, label) for held-out customers; truth has the labels of all.
MODEL = rf"""base as (select c_custkey doc_id, list_concat(list_concat({_sentence_sql(0)}, [{{'x': ' ', 'label': null::varchar}}]), {_sentence_sql(1)}) parts from customer),
texts as (select doc_id, array_to_string(list_transform(parts, lambda p: p.x), '') as text, parts from base),
truth as (select doc_id, (coalesce(list_sum(list_transform(parts[1:k - 1], lambda p: length(p.x))), 0))::int start, (list_sum(list_transform(parts[1:k], lambda p: length(p.x))))::int as "end", parts[k].label as label
  from texts, unnest(generate_series(1, len(parts))) u(k) where parts[k].label is not null),
cutup as (select doc_id, text, regexp_extract_all(text, '{_TOKEN}') f, string_split_regex(text, '{_TOKEN}') g from texts),
tok0 as (select doc_id, k::int k, f[k] tok, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0))::int s from cutup, unnest(generate_series(1, len(f))) u(k)),
tok1 as (select *, s + length(tok) e, translate(tok, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low, {_BACK} is_word,
  coalesce(sum((tok in ('.', '!', '?'))::int) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) sentence from tok0),
tok2 as (select t.*, coalesce(last_value(case when is_word then low end ignore nulls) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), '') b,
  coalesce(first_value(case when is_word then low end ignore nulls) over (partition by doc_id order by k rows between 1 following and unbounded following), '') a,
  row_number() over (partition by doc_id, sentence order by k) nth,
  case when not is_word then tok when regexp_matches(tok, '^[A-Z]') then case when length(tok) = 1 then 'X' when tok = upper(tok) then 'XX' else 'Xx' end when regexp_full_match(tok, '[0-9]+') then 'd' else 'x' end shape from tok1 t),
tok3 as (select doc_id, sentence, nth, k, s, e, [low, shape, right(low, 3), b, a] ev from tok2),
gold as (select t.*, coalesce((select case when t.s = x.start then 1 else 2 end + 2 * case x.label when 'PERSON' then 0 when 'ORG' then 1 else 2 end from truth x where x.doc_id = t.doc_id and t.s >= x.start and t.s < x."end"), 0) tag from tok3 t),
ev as (select doc_id, k, i - 1 kind, substr(md5(ev[i]), 1, 4) bkt from tok3, unnest(generate_series(1, 5)) u(i)),
em as (select kind, bkt, tag, count(*) n from ev join gold using (doc_id, k) where doc_id % 4 <> 0 group by all),
tot as (select t, coalesce(n, 0) n from range({N_TAGS}) r(t) left join (select tag, count(*) n from gold where doc_id % 4 <> 0 group by tag) on tag = t),
pairs as (select tag t, coalesce(lag(tag) over (partition by doc_id, sentence order by k), {N_TAGS}) f from gold where doc_id % 4 <> 0),
steps as (select f, t, count(p.n) n from range({N_TAGS + 1}) a(f), range({N_TAGS}) b(t) left join (select f pf, t pt, 1 n from pairs) p on pf = f and pt = t group by f, t),
trans0 as (select f, t, case {_ALLOWED} else {_score_sql("n", "sum(n) over (partition by f)", N_TAGS)} end v from steps),
trans as (select list(v order by f, t) m from trans0),
emitted as (select doc_id, k, t, sum(coalesce({_score_sql("em.n", "tot.n", names.BUCKETS)}, {_score_sql("0", "tot.n", names.BUCKETS)})) v
  from (select * from ev where doc_id % 4 = 0) ev join tot on true left join em on em.kind = ev.kind and em.bkt = ev.bkt and em.tag = tot.t group by all),
scored as (select doc_id, sentence, nth, list(v order by t) vs from emitted join tok3 using (doc_id, k) group by doc_id, sentence, nth),
best(doc_id, sentence, nth, now, path) as (
  select doc_id, sentence, nth, list_transform(range({N_TAGS}), lambda t: m[{N_TAGS * N_TAGS} + t + 1] + vs[t + 1]), list_transform(range({N_TAGS}), lambda t: t::varchar) from scored, trans where nth = 1
  union all
  select s.doc_id, s.sentence, s.nth, list_transform(range({N_TAGS}), lambda t: list_max(list_transform(range({N_TAGS}), lambda f: b.now[f + 1] + m[f * {N_TAGS} + t + 1])) + s.vs[t + 1]),
    list_transform(range({N_TAGS}), lambda t: b.path[list_position(list_transform(range({N_TAGS}), lambda f: b.now[f + 1] + m[f * {N_TAGS} + t + 1]), list_max(list_transform(range({N_TAGS}), lambda f: b.now[f + 1] + m[f * {N_TAGS} + t + 1])))] || t::varchar)
  from best b join scored s on s.doc_id = b.doc_id and s.sentence = b.sentence and s.nth = b.nth + 1, trans),
decoded as (select doc_id, sentence, path[list_position(now, list_max(now))] path from best qualify row_number() over (partition by doc_id, sentence order by nth desc) = 1),
tagged as (select doc_id, k, s, e, substr(path, nth::int, 1)::int tag from decoded join tok3 using (doc_id, sentence)),
named as (select *, sum((tag in (1, 3, 5))::int) over (partition by doc_id order by k) name from tagged where tag > 0),
found as (select doc_id, min(s) start, max(e) as "end", case max(tag) when 1 then 'PERSON' when 2 then 'PERSON' when 3 then 'ORG' when 4 then 'ORG' else 'GPE' end as label from named group by doc_id, name)"""


def q(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn

    return add


def tagged(s, d) -> DataFrame:
    """doc_id, text, names, spans of the held-out customers, by the model of the others."""
    rows = kept(labelled(s, d))
    model = names.fit(rows.where("doc_id % 4 <> 0"))
    held = rows.where("doc_id % 4 = 0")
    return names.tag_names(held, model).join(held.select("doc_id", "spans"), "doc_id")


_TYPE = " ".join(f"when {S.quoted(k)} then {S.quoted(v)}" for k, v in R.NLP_TYPES.items())


@q("names_by_model", f"""with recursive {MODEL}
select doc_id, case label {_TYPE} end as type, substr(t.text, start + 1, "end" - start) as text, start, "end",
 least(99, 85 + case when regexp_matches(substr(t.text, start + 1, "end" - start), '(^|\\s)[^A-Z\\s]') then 0 else 5 end + case when start = 0 or right(rtrim(left(t.text, start)), 1) in ('.', '!', '?') then 3 else 0 end
  - case when "end" - start < 3 then 10 else 0 end) / 100::double confidence from found join texts t using (doc_id)""")
def _(s, d):
    """Names in texts that the model has not seen, with the confidence rule."""
    rows = tagged(s, d).select("doc_id", F.explode(spans.model_spans(F.col("text"), F.col("names"))).alias("x"))
    return rows.select("doc_id", "x.type", "x.text", "x.start", "x.end", "x.confidence")


_GAZ_SQL = S.raw_spans([r._replace(type=r.name) for r in R.NAMED], "texts").replace("scan as", "gscan as").replace("from scan", "from gscan")


@q("names_measured", f"""with recursive {MODEL}, {_GAZ_SQL},
every as (select 'model' as method, doc_id, label, start, "end" from found union all select 'dictionary', doc_id, type, s, e from raw where doc_id % 4 = 0),
hit as (select method, label, count(*) n_found, count(t.doc_id) n_right from every left join truth t using (doc_id, label, start, "end") group by all),
there as (select label, count(*) n_true from truth where doc_id % 4 = 0 group by label)
select method, label, n_true, coalesce(n_found, 0)::bigint n_found, coalesce(n_right, 0)::bigint n_right, round(2 * coalesce(n_right, 0) / (n_true + coalesce(n_found, 0)), 9)::double f1
 from (select m as method, label, n_true from there, (values ('model'), ('dictionary')) v(m)) left join hit using (method, label)""")
def _(s, d):
    """F1 of the model and of the dictionary by label, over the held-out texts; a name counts if both ends and the label are right."""
    rows = kept(tagged(s, d))
    gaz = F.flatten(F.array(*[spans.rule_spans(F.col("text"), r._replace(type=r.name), i).cast(spans.SPAN) for i, r in enumerate(R.NAMED)]))
    plain = lambda xs, label: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x[label].alias("label")))
    each = rows.select("doc_id", "spans", F.explode(F.array(F.struct(F.lit("model").alias("method"), F.col("names").alias("found")), F.struct(F.lit("dictionary").alias("method"), plain(gaz, "type").alias("found")))).alias("m"))
    counts = []
    for label in names.LABELS:
        own = lambda xs: F.filter(xs, lambda x: x["label"] == label)  # noqa: B023, E731
        counts.append(F.struct(F.lit(label).alias("label"), F.size(own(F.col("spans"))).alias("n_true"), F.size(own(F.col("m.found"))).alias("n_found"), F.size(F.array_intersect(own(F.col("spans")), own(F.col("m.found")))).alias("n_right")))
    total = each.select("m.method", F.explode(F.array(*counts)).alias("c")).groupBy("method", "c.label").agg(*[F.sum(f"c.{c}").alias(c) for c in ("n_true", "n_found", "n_right")])
    return total.where("n_true > 0").withColumn("f1", F.round(2 * F.col("n_right") / (F.col("n_true") + F.col("n_found")), 9))


QUERIES, ORACLE = Q, O

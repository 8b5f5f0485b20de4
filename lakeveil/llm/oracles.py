"""DuckDB SQL of the spelling, secret and vector queries, by plainer ways than the operators take."""

from __future__ import annotations

from . import secrets

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _crc_table() -> str:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return f"{out}::bigint[]"


def _crc32(points: str) -> str:
    """Of a list of code points below 256, as UTF-8."""
    octets = f"flatten(list_transform({points}, lambda c: case when c < 128 then [c] when c < 192 then [194, c] else [195, c - 64] end))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda h, c: xor(h >> 8, tab[(xor(h, c::bigint) & 255) + 1])), 4294967295)"


def _points(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda c: ord(c)::bigint)"


def spelling_sql() -> str:
    """Near words by all ways to delete one code point: of both at one place (replaced), or of one (inserted)."""
    return f"""
with recursive crc as (select {_crc_table()} tab),
runs as (select doc_id, run, count(*) n from (select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) run from documents) group by all),
hashed as (select run, n, {_crc32(_points("coalesce(doc_id::varchar, '') || ':' || run"))} h from runs, crc where length(run) >= 6),
spelt as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, n from hashed),
words as (select word, sum(n)::bigint n from spelt where length(word) >= 6 group by word having sum(n) >= 5),
cuts as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) rest from (select word, n, unnest(generate_series(1, length(word))) i from words)),
near as (select a.word, b.word other, b.n other_n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select c.word, w.word, w.n from cuts c join words w on w.word = c.rest
  union select w.word, c.word, c.n from cuts c join words w on w.word = c.rest),
best as (select word, count(*) n_near, max(other_n) best_n from near group by word),
first as (select word, n_near, best_n, min(other) best from best join near using (word) where other_n = best_n group by all),
forms as (select word, n, coalesce(n_near, 0)::bigint n_near, case when best_n >= 5 * n then best end form, case when best_n >= 5 * n then best_n end form_n from words left join first using (word)),
walk(word, root) as (select word, word from forms union select walk.word, forms.form from walk join forms on walk.root = forms.word where forms.form is not null),
ends as (select walk.word, walk.root from walk join forms on forms.word = walk.root where forms.form is null)
select word, form, root, n, n_near, form_n from forms join ends using (word)"""


def _matches(kind: int, pattern: str, text: str, keep: str, group: int = 0) -> str:
    """kind, start, end of a kind's matches that ``keep`` (about the match ``m`` and its group ``g``)."""
    pattern = pattern.replace("'", "''")
    inner = f"select doc, regexp_split_to_array(t, '{pattern}') gaps, regexp_extract_all(t, '{pattern}') ms, regexp_extract_all(t, '{pattern}', {group}) gs from (select doc, {text} t from d) where regexp_matches(t, '{pattern}')"
    places = f"select doc, gaps, ms, gs, unnest(generate_series(1, len(ms))) i from ({inner})"
    start = "coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)"
    return f"select doc, {kind} kind, ({start})::bigint s, ms[i] m, gs[i] g from ({places}) where true and {keep}"


def secrets_sql() -> str:
    """Every kind by its own pattern over the whole text; checksums step by step."""
    low = f"translate(t, '{UPPER}', '{UPPER.lower()}')"
    base62 = "+ ".join(f"(instr('{secrets.BASE62}', substr(m, {35 + i}, 1)) - 1) * {62 ** (5 - i)}::bigint " for i in range(6))
    crc = f"length(m) = 40 and {_crc32(_points('substr(m, 5, 30)'))} = {base62}"
    step = "xor(((h & 33554431) << 5), v)"
    for i, g in enumerate(secrets.GENERATOR):
        step = f"xor({step}, case when (h >> {25 + i}) & 1 = 1 then {g}::bigint else 0::bigint end)"

    def bech(prefix: str, length: int) -> str:
        head = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
        data = f"list_transform(string_split(substr(lower(m), {len(prefix) + 2}), ''), lambda c: (instr('{secrets.BECH32}', c) - 1)::bigint)"
        return f"length(m) = {length} and list_reduce(list_concat({[1, *head]}::bigint[], {data}), lambda h, v: {step}) = 1"

    kinds = [
        (r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", low, "length(gs[i]) >= 6", 1),
        ("AKIA[A-Z0-9]+", "t", "length(ms[i]) >= 20", 0),
        ("[0-9a-f]+", "t", "length(ms[i]) >= 24", 0),
        ("gh[pousr]_[A-Za-z0-9]+", "t", "length(ms[i]) = 40", 0),
        ("npm_[A-Za-z0-9]+", "t", "length(ms[i]) = 40", 0),
        (f"AGE-SECRET-KEY-1[{secrets.BECH32.upper()}]+", "t", "length(ms[i]) = 74", 0),
        (f"nsec1[{secrets.BECH32}]+", "t", "length(ms[i]) = 63", 0),
    ]
    found = " union all ".join(_matches(k, p, t, keep, g) for k, (p, t, keep, g) in enumerate(kinds))
    names = [k.name for k in secrets.KINDS]
    name = " ".join(f"when {k} then '{n}'" for k, n in enumerate(names))
    one = "case kind " + name + " end || ':' || s || ':' || s + length(m)"
    return f"""
with crc as (select {_crc_table()} tab),
d as (select row_number() over () doc, doc_id, coalesce(text, '') t from documents),
hits as ({found}),
valid as (select hits.* from hits, crc where case when kind < 3 then true when kind < 5 then {crc} when kind = 5 then {bech("age-secret-key-", 74)} else {bech("nsec", 63)} end),
told as (select doc, count(*) filter (kind = 0) a, count(*) filter (kind = 1) b, count(*) filter (kind = 2) c,
  string_agg({one}, ',' order by s, kind) filter (kind < 3) base, string_agg({one}, ',' order by s, kind) spans from valid group by doc)
select doc_id, coalesce(a, 0)::bigint n_assign, coalesce(b, 0)::bigint n_access, coalesce(c, 0)::bigint n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join told using (doc)"""


def vector_sql(parts: int = 16, width: int = 4, rounds: int = 2) -> str:
    """All distances of all rounds. For vectors of ``parts * width`` components."""
    dims = range(width)
    parted = ", ".join(f"v[p * {width} + {i + 1}] a{i}" for i in dims)
    floored = lambda i: f"((sum(a{i}) - (((sum(a{i}) % count(*)) + count(*)) % count(*))) // count(*))::hugeint"
    far = " + ".join(f"(x.a{i} - b.a{i}) * (x.a{i} - b.a{i})" for i in dims)
    ctes = [
        "kept as (select row_number() over () rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::hugeint) v from embeddings"
        " where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding))",
        f"x as (select rid, p, {parted} from kept, range({parts}) r(p))",
        f"b0 as (select p, e, {parted} from (select row_number() over (order by vec_id) - 1 e, v from kept order by vec_id limit 64), range({parts}) r(p))",
    ]
    for k in range(rounds + 1):
        ctes.append(f"n{k} as (select rid, p, e, far, {', '.join(f'xa{i} a{i}' for i in dims)} from (select x.rid, x.p, b.e, {far} far, {', '.join(f'x.a{i} xa{i}' for i in dims)} from x join b{k} b using (p)) qualify row_number() over (partition by rid, p order by far, e) = 1)")
        if k < rounds:
            ctes.append(f"m{k} as (select p, e, {', '.join(f'{floored(i)} a{i}' for i in dims)} from n{k} group by p, e)")
            ctes.append(f"b{k + 1} as (select p, e, {', '.join(f'coalesce(m.a{i}, b.a{i}) a{i}' for i in dims)} from b{k} b left join m{k} m using (p, e))")
    entry = " || ',' || ".join(f"a{i}::varchar" for i in dims)
    return (
        "with "
        + ",\n".join(ctes)
        + f""",
codes as (select rid, string_agg(format('{{:02x}}', e), '' order by p) code, sum(far) error from n{rounds} group by rid),
book as (select sha256(string_agg({entry}, ',' order by p, e)) codebooks_sha256 from b{rounds})
select vec_id, code, error::bigint error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from codes join kept using (rid), book"""
    )

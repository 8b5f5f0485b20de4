"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, license_scan, lm_score, mixing, oracles, packing, passages, quality_model, quality_rules, secrets, sharding, simhash, spelling, vector_codes
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return found.withColumn("matches", F.array_join(F.transform("matches", lambda m: F.concat(m["start_word"].cast("string"), F.lit("+"), m["n_words"].cast("string"), F.lit(":"), m["license"])), ";"))


def _license_sql(least: float = 0.8) -> str:
    """Windows by joins of positions; no pruning but that a document shares enough with a template."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = license_scan.openings(license_scan.TEMPLATES)
    rows = ", ".join(f"({r}, {quoted(name)}, {len(g)}, {length}, [{', '.join(map(quoted, g))}])" for r, (name, g, length) in enumerate(known))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with templates as (select * from (values {rows}) v(rank, license, b, length, gs)),
tgrams as (select rank, b, length, unnest(gs) g from templates),
x as (select doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g')), ' ') w from documents),
grams as (select doc_id, i - 1 pos, w[i] || ' ' || w[i + 1] g from (select doc_id, w, unnest(generate_series(1, len(w) - 1)) i from x)),
hits as (select doc_id, rank, b, length, pos, g from grams join tgrams using (g)),
enough as (select doc_id, rank from hits group by doc_id, rank, b having count(distinct g) * (2 - {least}) + 1e-6 >= {least} * b),
near as (select * from hits semi join enough using (doc_id, rank)),
wins as (select p.doc_id, p.rank, p.b, p.pos p, max(h.pos) q, count(distinct h.g) shared from near p join near h on h.doc_id = p.doc_id and h.rank = p.rank and h.pos between p.pos and p.pos + p.length - 1 group by all),
sized as (select v.doc_id, v.rank, v.b, p, q, shared, count(distinct g.g) size from wins v join grams g on g.doc_id = v.doc_id and g.pos between p and q group by all),
scored as (select doc_id, rank, p, q - p + 2 n, shared, 2 * shared / (size + b) score from sized),
best as (select * from scored where score >= {least} qualify row_number() over (partition by doc_id, rank order by score desc, p) = 1),
stay as (select * from best m where not exists (select 1 from best o where o.doc_id = m.doc_id and o.p < m.p + m.n and m.p < o.p + o.n
  and (o.shared > m.shared or (o.shared = m.shared and (o.score > m.score or (o.score = m.score and o.rank < m.rank)))))),
found as (select doc_id, count(*) n, string_agg(p || '+' || s.n || ':' || license, ';' order by shared desc, score desc, rank) matches,
  first(license order by shared desc, score desc, rank) license, first(score order by shared desc, score desc, rank) score from stay s join templates using (rank) group by doc_id)
select doc_id, license, score, coalesce(n, 0)::bigint n_matches, coalesce(matches, '') matches from documents left join found using (doc_id)"""


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("level", "name")


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


#: Target weights of the mixture: domains are ranges of sources, and languages and sources split them.
DOMAINS = {"web": (0, 4), "books": (5, 9), "code": (10, 14), "wiki": (15, 19)}
WEIGHTS = {("domain", "web"): 4, ("domain", "books"): 3, ("domain", "wiki"): 2, ("lang", "en"): 6, ("lang", "de"): 2, ("lang", "fr"): 2, ("lang", "es"): 2}
BUDGET_PERCENT, EPOCHS, SEED = 80, 2, 17


def mixture_levels() -> dict[str, Column]:
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "^src([0-9]{1,4})$", 1).try_cast("int")
    domain = F.lit("other")
    for name, (lo, hi) in DOMAINS.items():
        domain = F.when(number.between(lo, hi), name).otherwise(domain)
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mixture_weight() -> Column:
    w = F.lit(1)
    for (level, node), n in WEIGHTS.items():
        w = F.when((F.col("level") == level) & (F.col("node") == node), n).otherwise(w)
    return w


def mix(docs: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    budget = F.expr(f"parent_budget * {BUDGET_PERCENT} div 100")
    return mixing.mix_documents(docs, mixture_levels(), mixture_weight(), budget, epochs=epochs, seed=SEED)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))


def _mix_sql() -> str:
    case = " ".join(f"when n between {lo} and {hi} then '{k}'" for k, (lo, hi) in DOMAINS.items())
    levels = ["domain", "lang", "source"]
    ctes = [
        "named as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t,"
        " try_cast(regexp_extract(coalesce(source, ''), '^src([0-9]{1,4})$', 1) as int) n from documents)",
        f"rows as (select doc_id, case {case} else 'other' end as domain, lang, source,"
        " len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::bigint n_tokens from named)",
        "leaves as (select domain, lang, source, sum(n_tokens)::hugeint tokens from rows group by all)",
        f"b0 as (select (sum(tokens) * {BUDGET_PERCENT} // 100)::hugeint budget from leaves)",
    ]
    for d, level in enumerate(levels):
        up = levels[:d]
        part = f"partition by {', '.join(up)}" if up else ""
        also = f"partition by {', '.join([*up, 'short'])}"
        key = ", ".join([*up, level])
        weight = " ".join(f"when '{n}' then {w}" for (lv, n), w in WEIGHTS.items() if lv == level)
        weight = f"case {level} {weight} else 1 end" if weight else "1"
        join = f"join b{d} using ({', '.join(up)})" if up else f"cross join b{d}"
        ctes += [
            f"c{d} as (select {key}, sum(tokens) * {EPOCHS} cap, ({weight})::hugeint w from leaves group by {key})",
            f"w{d} as (select *, least(budget, sum(cap) over ({part})) want,"
            f" coalesce(sum(cap) over ({part} order by cap::double / w, {level} rows between unbounded preceding and 1 preceding), 0) taken,"
            f" sum(w) over ({part} order by cap::double / w, {level} rows between current row and unbounded following) open_w from c{d} {join})",
            f"s{d} as (select *, min((cap * open_w <= (want - taken) * w)::int) over ({part} order by cap::double / w, {level}) = 1 short from w{d})",
            f"g{d} as (select *, case when short then cap else (want - coalesce(sum(case when short then cap end) over ({part}), 0)) * w"
            f" // coalesce(sum(case when not short then w end) over ({part}), 1) end given from s{d})",
            f"l{d} as (select *, want - sum(given) over ({part}) lost, row_number() over ({also} order by {level}) nth from g{d})",
            f"b{d + 1} as (select {key}, (case when short then cap else least(cap, given + (nth <= lost)::int) end)::hugeint budget from l{d})",
        ]
    return (
        "with "
        + ",\n".join(ctes)
        + f""",
plan as (select domain, lang, source, tokens, budget, case when tokens > 0 then budget // tokens else 1 end whole,
  case when tokens > 0 then budget % tokens else 0 end rest from leaves join b3 using (domain, lang, source)),
placed as (select *, md5(md5('{SEED}:' || coalesce(doc_id::varchar, '')) || ':' || whole::varchar) place from rows join plan using (domain, lang, source)),
summed as (select *, sum(n_tokens) over (partition by domain, lang, source order by place, n_tokens rows unbounded preceding) upto from placed)
select doc_id, domain, lang, source, n_tokens, tokens::bigint leaf_tokens, budget::bigint leaf_budget,
  (whole + (tokens > 0 and upto <= rest)::int)::bigint copies,
  (whole * n_tokens + greatest(0, least(n_tokens, rest - upto + n_tokens)))::bigint taken from summed"""
    )


_OP6_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents)
select doc_id, min(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
  doc_id = min(doc_id) over (partition by t) kept, sha256(t) text_sha256 from n"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash": op2_simhash,
    "op3_license_scan": op3_license_scan,
    "op4_passages": op4_passages,
    "op5_quality_model": op5_quality_model,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_shard": op7_shard,
    "op8_mix": op8_mix,
    "op9_lm_score": op9_lm_score,
    "op10_pack": op10_pack,
    "op11_spelling": op11_spelling,
    "op12_secret_scan": op12_secret_scan,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {
    "op3_license_scan": _license_sql(),
    "op6_exact_dedup": _OP6_SQL,
    "op8_mix": _mix_sql(),
    "op11_spelling": oracles.spelling_sql(),
    "op12_secret_scan": oracles.secrets_sql(),
    "op13_vector_codes": oracles.vector_sql(),
}

"""Scores of documents from their entities, all inside the document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeveil.functions import rules as R

from .spans import context_window, let, with_entities


def lookup(key: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def any_term(text: Column, terms: list[str]) -> Column:
    """Plain substrings of the lower-cased text: ``hr`` is found in ``three``."""
    low, out = F.lower(text), F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t))
    return out


def types_of(entities: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(entities, lambda x: x["type"])))


def quick_score(n: Column, each: int, medium: int) -> tuple[Column, Column]:
    score = F.least(n * each, F.lit(100))
    return score, F.when(score > 70, "HIGH").when(score > medium, "MEDIUM").otherwise("LOW")


def k_anonymity(entities: Column) -> Column:
    """How many people share these entities, in their order; -1 stands for without bound."""
    unique = lambda t: t.isin(*R.UNIQUE_TYPES)
    folded = F.aggregate(
        entities,
        F.struct(F.lit(1_400_000_000).cast("bigint").alias("k"), F.lit(False).alias("done")),
        lambda s, x: F.when(s["done"], s).otherwise(
            F.struct(
                F.when(unique(x["type"]), F.lit(1).cast("bigint"))
                .when(x["type"].isin("EMAIL", "PHONE"), F.least(s["k"], F.lit(1).cast("bigint")))
                .when(x["type"] == "LOCATION", F.least(s["k"], F.lit(10_000_000).cast("bigint")))
                .when(x["type"] == "DATE_OF_BIRTH", F.floor(s["k"] / 365).cast("bigint"))
                .when(x["type"] == "PERSON_NAME", F.floor(s["k"] / 1000).cast("bigint"))
                .when(x["type"] == "ORGANIZATION", F.least(s["k"], F.lit(100_000).cast("bigint")))
                .otherwise(s["k"])
                .alias("k"),
                unique(x["type"]).alias("done"),
            )
        ),
        lambda s: F.greatest(s["k"], F.lit(1).cast("bigint")),
    )
    return F.when(F.size(entities) == 0, F.lit(-1).cast("bigint")).otherwise(folded)


def risk_columns(text: Column, entities: Column) -> dict[str, Column]:
    """Parts of the risk in hundredths, so that sums are exact, and the score with one decimal."""
    direct = F.filter(entities, lambda x: x["type"].isin(*R.DIRECT_TYPES))
    quasi = F.filter(entities, lambda x: ~x["type"].isin(*R.DIRECT_TYPES))
    weight = lambda x, default: lookup(x["type"], R.RISK_WEIGHT, default)
    direct_risk = F.when(F.size(direct) == 0, F.lit(0)).otherwise(
        F.least(F.lit(100), F.array_max(F.transform(direct, lambda x: weight(x, 50))) + F.least(F.size(direct) * 10, F.lit(30)))
    )
    kinds = F.transform(quasi, lambda x: x["type"])
    combos = F.array(*[F.when(F.size(F.array_except(F.array(*map(F.lit, need)), kinds)) == 0, F.struct(F.lit(name).alias("name"), F.lit(risk).alias("risk"))) for name, need, risk in R.DANGER])
    found = F.filter(combos, lambda c: c.isNotNull())
    alone = F.aggregate(quasi, F.lit(0), lambda a, x: a + weight(x, 30)) / F.size(quasi) * 0.5
    quasi_risk = F.when(F.size(quasi) == 0, F.lit(0.0)).otherwise(
        let(found, lambda c: F.when(F.size(c) > 0, F.array_max(F.transform(c, lambda x: x["risk"])).cast("double")).otherwise(alone))
    )
    context = F.least(
        sum((F.when(any_term(text, terms), add).otherwise(0) for add, terms in R.RISK_TERMS), F.lit(0)) + F.when(F.size(entities) > 10, 10).otherwise(0), F.lit(50)
    )
    return {"direct_risk": direct_risk, "quasi_risk": quasi_risk, "context_risk": context, "k_anonymity": k_anonymity(entities), "combinations": F.transform(found, lambda c: c["name"])}


def level(score: Column) -> Column:
    out = F.lit("MINIMAL")
    for least, name in reversed(R.LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def risk_scores(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_entities, the risk's parts, k_anonymity, score, level, combinations.

    A document without entities scores 0, MINIMAL, and has no k (null).
    """
    rows = with_entities(docs, text_col)
    parts = rows.withColumns(risk_columns(F.coalesce(F.col(text_col), F.lit("")), F.col("entities")))
    mixed = F.least(F.col("direct_risk") * 0.4 + F.col("quasi_risk") * 0.3 + F.col("context_risk") * 0.3, F.lit(100.0))
    boost = F.when(F.col("k_anonymity") <= 2, 30.0).when(F.col("k_anonymity") <= 5, 10.0).otherwise(0.0)
    empty = F.size("entities") == 0
    score = F.when(empty, 0.0).otherwise(F.bround(F.round(F.least(mixed + boost, F.lit(100.0)), 8), 1))
    return (
        parts.withColumn("score", score)
        .withColumn("level", F.when(empty, "MINIMAL").otherwise(level(F.col("score"))))
        .select(
            "doc_id",
            F.size("entities").cast("bigint").alias("n_entities"),
            *[F.when(empty, F.lit(0)).otherwise(F.col(c)).alias(c) for c in ("direct_risk", "quasi_risk", "context_risk")],
            F.when(~empty, F.col("k_anonymity")).alias("k_anonymity"),
            "score",
            "level",
            F.array_join("combinations", "; ").alias("combinations"),
        )
    )


def explain(docs: DataFrame) -> DataFrame:
    """Sensitivity, risk and recommendation for each entity; the context of its document's text raises the sensitivity. No shuffle."""
    contexts = F.filter(F.array(*[F.when(any_term(F.col("text"), terms), F.lit(k)) for k, (_, terms) in R.CONTEXT_TERMS.items()]), lambda c: c.isNotNull())
    held = with_entities(docs.where("text is not null").select("doc_id", "text")).where("size(entities) > 0")
    rows = held.select("doc_id", F.explode(F.array(contexts)).alias("contexts"), "entities").select("doc_id", "contexts", F.explode("entities").alias("x"))
    rows = rows.select("doc_id", "contexts", F.col("x.start").alias("start"), F.col("x.type").alias("type"))
    boost = F.aggregate("contexts", F.lit(0), lambda a, c: a + lookup(c, {k: n for k, (n, _) in R.CONTEXT_TERMS.items()}, 0))
    base = lookup(F.col("type"), R.SENSITIVITY, "MEDIUM")
    scale = F.array(*map(F.lit, R.SENSITIVITY_SCALE))
    rows = rows.withColumn("sensitivity", F.element_at(scale, F.least(F.array_position(scale, base) + boost, F.lit(len(R.SENSITIVITY_SCALE))).cast("int")))
    advice = F.when(F.col("sensitivity").isin("CRITICAL", "HIGH"), "MANDATORY").when(F.col("sensitivity").isin("MEDIUM-HIGH", "MEDIUM"), "RECOMMENDED").otherwise("OPTIONAL")
    return rows.select(
        "doc_id",
        "start",
        "type",
        lookup(F.col("type"), R.CATEGORY, "Personal Information").alias("category"),
        F.array_join("contexts", ",").alias("contexts"),
        "sensitivity",
        lookup(F.col("sensitivity"), {k: v[0] for k, v in R.SENSITIVITY_RISK.items()}, "MODERATE").alias("risk_level"),
        lookup(F.col("sensitivity"), {k: v[1] for k, v in R.SENSITIVITY_RISK.items()}, 50).alias("risk_score"),
        advice.alias("advice"),
    )


def vulnerabilities(docs: DataFrame) -> DataFrame:
    """doc_id, kind, severity, entity_type: what an attacker could still use, one row for each finding.

    Everything of a document is found in its row, so nothing is shuffled.
    """
    rows = with_entities(docs.where("text is not null"))
    e, types = F.col("entities"), types_of(F.col("entities"))
    row = lambda kind, severity, type_: F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), type_.alias("entity_type"))
    window = lambda x: context_window(F.col("text"), x["start"], x["end"])

    def guess(x: Column) -> Column:
        """The best guess's confidence in hundredths; 0 for none."""
        titled = F.lit(0)
        first = F.upper(F.left(x["text"], F.lit(1)))
        for title, names in R.TITLE_NAMES.items():
            best = F.when(first.isin(*sorted({n[0] for n in names})), 35).otherwise(15)
            titled = F.greatest(titled, F.when(F.contains(window(x), F.lit(title)), best).otherwise(0))
        place = F.when(any_term(x["text"], [c.lower() for c in R.CITIES]), 40).otherwise(0)
        return F.when(x["type"] == "PERSON_NAME", titled).when(x["type"] == "LOCATION", place).otherwise(0)

    guessed = F.transform(e, lambda x: let(guess(x), lambda g: F.when(g > 0, row("CONTEXT_PREDICTION", F.when(g > 30, "HIGH").otherwise("MEDIUM"), x["type"]))))
    domain = lambda x: F.get(F.split(x["text"], "@"), F.lit(1))

    def closed(x: Column) -> Column:
        out = F.lit(True)
        for d in R.OPEN_DOMAINS:
            out = out & ~F.endswith(domain(x), F.lit(d))
        return out

    leaks = F.transform(
        e,
        lambda x: F.when((x["type"] == "PHONE") & F.startswith(x["text"], F.lit("+91 9")), row("FORMAT_LEAKAGE", F.lit("LOW"), x["type"]))
        .when((x["type"] == "EMAIL") & closed(x), row("FORMAT_LEAKAGE", F.lit("MEDIUM"), x["type"]))
        .when((x["type"] == "PAN") & (F.length(x["text"]) >= 4), row("FORMAT_LEAKAGE", F.lit("LOW"), x["type"])),
    )
    looked_up = F.transform(
        e, lambda x: F.when(x["type"] == "ORGANIZATION", row("CROSS_REFERENCE", F.lit("MEDIUM"), x["type"])).when(x["type"].isin("PHONE", "EMAIL"), row("CROSS_REFERENCE", F.lit("HIGH"), x["type"]))
    )
    has = lambda *t: F.size(F.array_except(F.array(*map(F.lit, t)), types)) == 0
    partial = F.array(*[F.when(has(*t), row("PARTIAL_INFORMATION", F.lit("HIGH"), F.lit("COMBINATION"))) for t in (("PERSON_NAME", "DATE_OF_BIRTH"), ("PERSON_NAME", "LOCATION", "ORGANIZATION"))])
    exposed = F.array(*[F.when(F.col("text").rlike(f"(?i){p}"), row("METADATA_EXPOSURE", F.lit("MEDIUM"), F.lit("METADATA"))) for p in R.METADATA_PATTERNS])
    found = F.filter(F.concat(guessed, leaks, looked_up, partial, exposed), lambda v: v.isNotNull())
    return rows.select("doc_id", F.explode(found).alias("v")).select("doc_id", "v.kind", "v.severity", "v.entity_type")


def robustness(docs: DataFrame, synthetic: bool = False) -> DataFrame:
    """doc_id, score, grade: 100 less a penalty for each kind of finding by its worst severity and number; 5 at least."""
    rank = lookup(F.col("severity"), R.PENALTY, 5)
    kinds = vulnerabilities(docs).groupBy("doc_id", "kind").agg(F.max(rank).alias("worst"), F.count(F.lit(1)).alias("n"))
    lost = kinds.groupBy("doc_id").agg(F.sum(F.col("worst") + F.least(F.lit(10), F.floor(F.col("n") / 2))).alias("lost"))
    score = F.greatest(F.lit(5), 100 - F.coalesce("lost", F.lit(0)))
    score = F.least(F.lit(100), score + 20) if synthetic else score
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").when(F.col("score") >= 60, "D").otherwise("F")
    return docs.select("doc_id").join(lost, "doc_id", "left").select("doc_id", score.cast("bigint").alias("score")).withColumn("grade", grade)


def recommendations(docs: DataFrame) -> DataFrame:
    """doc_id, recommendations (in order, joined by lines) and explanation of the risk of documents with entities."""
    rows = with_entities(docs).where("size(entities) > 0").select("doc_id", "text", "entities")
    rows = rows.withColumns({**risk_columns(F.col("text"), F.col("entities")), "types": types_of(F.col("entities"))})
    k = F.col("k_anonymity")
    direct = F.filter("types", lambda t: t.isin(*R.DIRECT_TYPES))
    n_direct = F.size(F.filter("entities", lambda x: x["type"].isin(*R.DIRECT_TYPES)))
    risk_of = {name: risk for name, _, risk in R.DANGER}
    danger = F.transform(
        F.slice("combinations", 1, 3),
        lambda c: F.format_string("DANGER: %s combination creates high re-identification risk (%d%%)", c, lookup(c, risk_of, 0)),
    )
    has = lambda t: F.array_contains("types", F.lit(t))
    listed = F.concat(
        F.array(
            F.when(F.size(direct) > 0, F.concat(F.lit("CRITICAL: Redact all direct identifiers ("), F.array_join(direct, ", "), F.lit(")"))),
            F.when(k <= 5, F.concat(F.lit("WARNING: Low k-anonymity (k="), k.cast("string"), F.lit("). Consider generalizing quasi-identifiers."))),
        ),
        danger,
        F.array(F.when(has("DATE_OF_BIRTH"), R.TIP_DATES), F.when(has("LOCATION"), R.TIP_PLACES)),
    )
    explanation = (
        F.when(n_direct > 0, F.concat(F.lit("Document contains "), n_direct.cast("string"), F.lit(R.EXPLAIN_DIRECT)))
        .when(k <= 1, R.EXPLAIN_UNIQUE)
        .when(k <= 5, F.concat(F.lit("With k-anonymity of "), k.cast("string"), F.lit(", this individual is among only "), k.cast("string"), F.lit(R.EXPLAIN_FEW)))
        .otherwise(R.EXPLAIN_OTHER)
    )
    return rows.select("doc_id", F.array_join(F.filter(listed, lambda r: r.isNotNull()), "\n").alias("recommendations"), explanation.alias("explanation"))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, start, nth (from 1), guess, confidence: the three likeliest guesses at a redacted name or place from its context."""
    rows = with_entities(docs.where("text is not null")).where("size(entities) > 0").select("doc_id", "text", F.explode("entities").alias("x"))
    rows = rows.where(F.col("x.type").isin("PERSON_NAME", "LOCATION"))
    window = context_window(F.col("text"), F.col("x.start"), F.col("x.end"))
    first = F.upper(F.left("x.text", F.lit(1)))
    item = lambda order, guess, p: F.struct((-p).alias("less"), F.lit(order).alias("order"), F.lit(guess).alias("guess"))
    names, order = [], 0
    for title, ns in R.TITLE_NAMES.items():
        for n in ns:
            names.append(F.when((F.col("x.type") == "PERSON_NAME") & F.contains(window, F.lit(title)), item(order, n, F.when(first == n[0], 0.35).otherwise(0.15))))
            order += 1
    places = [F.when((F.col("x.type") == "LOCATION") & F.contains(F.lower("x.text"), F.lit(c.lower())), item(order + i, c, F.lit(0.4))) for i, c in enumerate(R.CITIES)]
    best = F.slice(F.array_sort(F.filter(F.array(*names, *places), lambda g: g.isNotNull())), 1, 3)
    return rows.select("doc_id", F.col("x.start").alias("start"), F.posexplode(best).alias("nth", "g")).select(
        "doc_id", "start", (F.col("nth") + 1).alias("nth"), F.col("g.guess").alias("guess"), (-F.col("g.less")).alias("confidence")
    )


def robustness_report(docs: DataFrame) -> DataFrame:
    """doc_id, score, grade, summary and recommendations (a set, in order of text)."""
    kinds = vulnerabilities(docs).groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"), F.count(F.lit(1)).alias("n"))  # a kind for each branch at most
    rows = robustness(docs).join(kinds, "doc_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("string")
    summary = (
        F.when(F.col("score") >= 90, F.concat(F.lit("EXCELLENT ("), "grade", F.lit(R.SUMMARY[0][0]), n, F.lit(R.SUMMARY[0][1])))
        .when(F.col("score") >= 70, F.concat(F.lit("GOOD ("), "grade", F.lit(R.SUMMARY[1][0]), n, F.lit(R.SUMMARY[1][1])))
        .when(F.col("score") >= 50, F.concat(F.lit("FAIR ("), "grade", F.lit(R.SUMMARY[2][0]), n, F.lit(R.SUMMARY[2][1])))
        .otherwise(F.concat(F.lit("POOR ("), "grade", F.lit(R.SUMMARY[3][0]), n, F.lit(R.SUMMARY[3][1])))
    )
    advice = F.array(*[F.when(F.array_contains("kinds", F.lit(k)), F.lit(a)) for k, a in R.KIND_ADVICE.items()])
    return rows.select("doc_id", "score", "grade", summary.alias("summary"), F.array_join(F.array_sort(F.filter(advice, lambda a: a.isNotNull())), "; ").alias("recommendations"))


def suggest_actions(scored: DataFrame) -> DataFrame:
    """doc_id, nth, action, priority, automatic from rows with doc_id, level, score, types."""
    high, direct = F.col("level") == "HIGH", F.arrays_overlap("types", F.array(*map(F.lit, R.SSN_DIRECT)))
    act = lambda name, order, priority, auto, when: F.when(when, F.struct(priority.cast("int").alias("priority"), F.lit(order).alias("order"), F.lit(name).alias("action"), auto.alias("automatic")))
    yes, urgent = F.lit(True), high | (F.col("score") >= 70)
    actions = F.array(
        act("move_to_vault", 0, F.lit(1), yes, urgent),
        act("create_incident", 1, F.lit(2), yes, urgent),
        act("redact_replace", 2, F.when(high, 3).otherwise(1), yes, direct),
        act("encrypt_quarantine", 3, F.when(high, 4).otherwise(2), F.col("level").isin("HIGH", "MEDIUM"), yes),
        act("notify_admin", 4, F.when(high, 3).otherwise(5), high, yes),
        act("create_incident", 5, F.lit(6), F.lit(False), F.col("level").isin("MEDIUM", "LOW") & ~direct),
    )
    listed = F.sort_array(F.filter(actions, lambda a: a.isNotNull()))
    return scored.select("doc_id", F.posexplode(listed).alias("nth", "a")).select("doc_id", "nth", "a.action", "a.priority", "a.automatic")

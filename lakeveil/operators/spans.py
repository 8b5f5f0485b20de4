"""Finding spans by rules, and choosing among overlapping ones.

A document's spans are an array inside its row: scanning, sorting and choosing
need no shuffle, and a document without hits costs one regular expression test
per rule. Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeveil.functions.rules import CORE, MODE_LEAST, MODES, NAMED, NLP_TYPES, WATCHER, Rule

SPAN = "array<struct<start:int,unsure:double,ord:int,end:int,type:string,text:string,confidence:double>>"


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def rule_spans(text: Column, rule: Rule, ord_: int, flags: str = "(?U)", confidence: float | None = None) -> Column:
    """All matches of one rule: the text between matches gives their places."""
    sure = rule.confidence if confidence is None else confidence
    pattern = flags + rule.pattern

    def placed(x: Column) -> Column:
        length = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, y: s + F.length(y))
        return F.transform(
            x["found"],
            lambda m, i: let(
                length(x["gaps"], i + 1) + length(x["found"], i),
                lambda start: F.struct(
                    start.cast("int").alias("start"),
                    F.lit(1 - sure).alias("unsure"),
                    F.lit(ord_).alias("ord"),
                    (start + F.length(m)).cast("int").alias("end"),
                    F.lit(rule.type).alias("type"),
                    m.alias("text"),
                    F.lit(float(sure)).alias("confidence"),
                ),
            ),
        )

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(both, placed)).otherwise(F.array().cast(SPAN))


def all_spans(text: Column, rules: list[Rule], flags: str = "(?U)", confidence: float | None = None) -> Column:
    return F.flatten(F.array(*[rule_spans(text, r, i, flags, confidence).cast(SPAN) for i, r in enumerate(rules)]))


def first_wins(spans: Column) -> Column:
    """By start, then surer, then rule order; a span is kept if it starts at or after the last kept one's end."""
    return F.aggregate(
        F.sort_array(spans),
        F.struct(F.lit(0).alias("last"), F.array().cast(SPAN).alias("kept")),
        lambda s, x: F.when(x["start"] >= s["last"], F.struct(x["end"].alias("last"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )


def surest_wins(spans: Column) -> Column:
    """By confidence, then start, then rule order; a span is kept if it overlaps none that is kept."""
    by = F.sort_array(F.transform(spans, lambda x: F.struct((-x["confidence"]).alias("c"), x["start"].alias("s"), x["ord"].alias("o"), x.alias("x"))))
    return F.aggregate(
        by,
        F.array().cast(SPAN),
        lambda kept, y: F.when(F.exists(kept, lambda k: (k["start"] < y["x"]["end"]) & (y["x"]["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(y["x"]))),
    )


def valid_strict(x: Column) -> Column:
    """The strict checks of PAN and AADHAAR spans; other types always pass."""
    holder = F.substring(x["text"], 4, 1).isin(*"ABCFGHLJPTE") & (F.length(x["text"]) == 10)
    bare = F.replace(x["text"], F.lit(" "), F.lit(""))
    number = (F.length(bare) == 12) & ~F.substring(bare, 1, 1).isin("0", "1")
    return F.when(x["type"] == "PAN", holder).when(x["type"] == "AADHAAR", number).otherwise(F.lit(True))


def named_confidence(text: Column, x: Column) -> Column:
    """Sureness of a name (text, start): 0.85, 0.05 more if every word begins with a capital, 0.03 more at the start of a
    sentence, 0.1 less under three characters, 0.99 at most."""
    before = F.rtrim(F.left(text, x["start"]))
    opens = (x["start"] == 0) | F.right(before, F.lit(1)).isin(".", "!", "?")
    sure = F.lit(85) + F.when(x["text"].rlike(r"(^|\s)[^A-Z\s]"), 0).otherwise(5) + F.when(opens, 3).otherwise(0) - F.when(F.length(x["text"]) < 3, 10).otherwise(0)
    return F.least(F.lit(99), sure) / 100


def named_spans(text: Column) -> Column:
    """Spans of names by dictionary and form."""
    rules = [r._replace(type=NLP_TYPES[r.name]) for r in NAMED]
    found = F.flatten(F.array(*[rule_spans(text, r, len(CORE) + i).cast(SPAN) for i, r in enumerate(rules)]))
    return _sure_names(text, found)


def model_spans(text: Column, names: Column) -> Column:
    """Spans of the names (start, end, label) that a sequence model found in the text (see ``names.tag_names``)."""
    kinds = list(NLP_TYPES)
    one = lambda n: F.struct(
        n["start"].alias("start"), F.lit(0.0).alias("unsure"), (F.lit(len(CORE)) + F.array_position(F.array(*map(F.lit, kinds)), n["label"]).cast("int")).alias("ord"), n["end"].alias("end"),
        F.element_at(F.create_map(*[F.lit(v) for kv in NLP_TYPES.items() for v in kv]), n["label"]).alias("type"), F.substring(text, n["start"] + 1, n["end"] - n["start"]).alias("text"), F.lit(0.0).alias("confidence"),
    )
    return _sure_names(text, F.transform(names, one))


def _sure_names(text: Column, found: Column) -> Column:
    def weighed(x: Column) -> Column:
        sure = named_confidence(text, x)
        return F.struct(x["start"].alias("start"), (1 - sure).alias("unsure"), x["ord"].alias("ord"), x["end"].alias("end"), x["type"].alias("type"), x["text"].alias("text"), sure.alias("confidence"))

    return F.transform(found, weighed)


def core_spans(text: Column, strict: bool = False, named: bool = False) -> Column:
    """The core rules, and with ``named`` names of persons, organisations and places too; the first of overlapping spans stays."""
    found = all_spans(text, CORE, confidence=1.0 if strict else None)
    found = F.filter(found, valid_strict) if strict else found
    return first_wins(F.concat(found, named_spans(text).cast(SPAN)) if named else found)


def mode_spans(text: Column, mode: str = "balanced", custom: list[Rule] | None = None) -> Column:
    rules = [r for r in [*MODES, *(custom or [])] if r.confidence >= MODE_LEAST[mode]]
    return surest_wins(all_spans(text, rules, "(?imU)"))


def watcher_spans(text: Column) -> Column:
    return all_spans(text, WATCHER)


def explode_spans(docs: DataFrame, spans: Column, key: str = "doc_id") -> DataFrame:
    """A row for each span: key, type, text, start, end, confidence, ord."""
    return docs.select(key, F.explode(spans).alias("x")).select(
        key, F.col("x.type").alias("type"), F.col("x.text").alias("text"), F.col("x.start").alias("start"), F.col("x.end").alias("end"),
        F.col("x.confidence").alias("confidence"), F.col("x.ord").alias("ord"),
    )


def detect(docs: DataFrame, text_col: str = "text", strict: bool = False, key: str = "doc_id") -> DataFrame:
    """Spans of the core rules after overlaps are resolved. Null texts have none."""
    return explode_spans(docs.where(F.col(text_col).isNotNull()), core_spans(F.col(text_col), strict), key)


def with_entities(docs: DataFrame, text_col: str = "text", strict: bool = False) -> DataFrame:
    """``docs`` with ``entities``, an array in order of start; empty for null texts.

    The array is the output of a generator of one row, so that filters and
    projections above it read it and don't scan the text again for each mention.
    """
    return docs.select("*", F.explode(F.array(F.coalesce(core_spans(F.col(text_col), strict), F.array().cast(SPAN)))).alias("entities"))


def context_window(text: Column, start: Column, end: Column, width: int = 100) -> Column:
    low = F.greatest(start - width, F.lit(0))
    return F.substring(text, low + 1, F.least(F.length(text), end + width) - low)


def mask(text: Column, shown: int = 3, least: int = 3) -> Column:
    return F.when(F.length(text) > least, F.concat(F.left(text, F.lit(shown)), F.lit("***"))).otherwise(F.lit("***"))


def truncated(text: Column, most: int = 20) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def entity_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def sentences(text: Column) -> Column:
    """Trimmed sentences longer than three characters."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]+(?:\s+|$)|[^.!?]+$"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 3)


def sentence_offsets(text: Column) -> Column:
    """start and end of each sentence whose trimmed text is longer than three characters, of the raw match."""
    pattern = r"[^.!?]+[.!?]+(?:\s+|$)|[^.!?]+$"
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    step = lambda s, m, g: F.struct((s["at"] + F.length(g) + F.length(m)).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + F.length(g)).alias("start"), (s["at"] + F.length(g) + F.length(m)).alias("end"), m.alias("m")))).alias("out"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("out"))
    placed = lambda b: F.aggregate(F.arrays_zip(b["found"].alias("m"), F.slice(b["gaps"], 1, F.size(b["found"])).alias("g")), none, lambda s, x: step(s, x["m"], x["g"]), lambda s: s["out"])
    return F.filter(let(both, placed), lambda x: F.length(F.regexp_replace(x["m"], r"^\s+|\s+$", "")) > 3)


def redact(text: Column, spans: Column, replacement=lambda x: F.concat(F.lit("[REDACTED-"), x["type"], F.lit("]"))) -> Column:
    """Spans (disjoint, in order of start) replaced in place."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), replacement(x)).alias("out")),
    )
    return let(done, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def redact_everywhere(text: Column, spans: Column, replacement=lambda x: F.concat(F.lit("[REDACTED-"), x["type"], F.lit("]"))) -> Column:
    """Every place where a span's text stands, found by a rule or not, replaced; longer texts first, as one may hold another."""
    by_length = F.array_sort(F.transform(spans, lambda x: F.struct((-F.length(x["text"])).alias("n"), x["start"].alias("start"), x.alias("x"))))
    return F.aggregate(by_length, text, lambda t, y: F.replace(t, y["x"]["text"], replacement(y["x"])))


def leaked(redacted: Column, spans: Column) -> Column:
    """Texts of spans that can still be found."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda x: F.contains(redacted, x["text"])), lambda x: x["text"])))

"""Quality rules as weak supervision (DataFrame functions only).

Each rule votes good (1), votes bad (-1) or abstains (0). A label model gives
every rule its own rates of right and wrong votes on good and on bad documents,
independent given the true label. Expectation-maximisation estimates these
rates and the share of good documents from the votes of all documents,
without labels. A document is kept if its posterior probability of being good
is at least one half, rather than if it passes all rules.

The votes of a document form one of at most 3**rules patterns, so the corpus is
reduced to a table of pattern counts whose size does not depend on it, and EM
runs on that table inside one SQL expression. The posterior is then a sum of
log-likelihood ratios, one for each vote.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, materialize, word_array

SYMBOLS = "#*$%&|<>"
#: Rates where EM starts: right and wrong votes on good documents, wrong and right votes on bad ones. They only say that rules
#: are better than chance and that defects are rare; 25 rounds come to rest (tested).
START_TWO_SIDED, START_DEFECT = [0.7, 0.05, 0.5, 0.2], [0.002, 0.02, 0.002, 0.3]
LEAST_RATE = 0.002
#: Rules that vote bad or abstain. No two rules look at the same property of a text: rules that vote alike by making
#: would count one piece of evidence twice, and the label model would take their agreement for a class of its own.
DEFECTS = ("symbols", "lines", "repeats", "capitals")
#: The commonest short words of running text in the languages at hand.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as are was by be at or an this from".split(),
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se".split(),
    "es": "de la que el en los del se las por un para con no una su al lo como más".split(),
}


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a ``width``-word window found twice or more.

    Windows are sorted with their places; a window next to an equal one is a
    repeat; the places of repeats are then merged. n log n in the text's words.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - width),
        lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)]).alias("w"), i.alias("at")),
    )

    def covered(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
            lambda s, at: F.struct((s["n"] + F.least(F.lit(width), at - s["last"])).alias("n"), at.alias("last")),
            lambda s: s["n"],
        )

    def repeats(ordered: Column) -> Column:
        equal = lambda x, i, d: F.coalesce(F.get(ordered, i + d)["w"] == x["w"], F.lit(False))
        return F.filter(ordered, lambda x, i: equal(x, i, 1) | ((i > 0) & equal(x, i, -1)))

    places = let(F.sort_array(windows), lambda ordered: F.sort_array(F.transform(repeats(ordered), lambda x: x["at"])))
    return F.when(F.size(words) >= width, let(places, covered)).otherwise(F.lit(0))


def base_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the base counts, and what the rules need; one pass, no shuffle."""
    t = F.col("t")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, SPACE_CHARS[1:], "")) != "")
    bare = F.translate(t, SPACE_CHARS, "")
    long = lambda c: c.cast("bigint")
    first = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select(
        "doc_id", "t", word_array(t).alias("words"), lines.alias("lines")
    )
    letters = F.translate(bare, "0123456789.,;:!?'\"()[]{}-_/\\@+=~^`" + SYMBOLS, "")
    return first.select(
        "doc_id",
        long(F.size("words")).alias("n_words"),
        long(F.length(bare)).alias("word_chars"),
        long(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(repeated_words(F.col("words"))).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.length(letters)).alias("n_letters"),
        long(F.length(letters) - F.length(F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", ""))).alias("n_upper"),
        long(F.size(F.filter("words", lambda w: w.isin(sorted({w for ws in FUNCTION_WORDS.values() for w in ws}))))).alias("n_function"),
        long(F.length(t) - F.length(F.translate(t, ".", ""))).alias("n_stops"),
        long(F.size(F.array_distinct("words"))).alias("n_distinct"),
    )


def rule_votes() -> dict[str, Column]:
    """1 good, -1 bad, 0 abstain; rules for a defect abstain where they don't see it."""
    word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    enough = F.col("n_words") >= 20
    upper = F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1))
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    defect = lambda bad: F.when(bad, -1).otherwise(0)
    return {
        "length": vote(F.col("n_words") >= 50, F.col("n_words") < 20),
        "sentences": vote(word("n_stops") >= 0.02, enough & (word("n_stops") < 0.005)),
        "variety": vote(F.col("n_distinct") >= 30, enough & (F.col("n_distinct") < 0.1 * F.col("n_words"))),
        "function_words": vote(word("n_function") >= 0.05, enough & (word("n_function") < 0.02)),
        "symbols": defect(word("n_symbols") > 0.15),
        "lines": defect(lines > 0.3),
        "repeats": defect(word("n_repeat_words") > 0.4),
        "capitals": defect(upper > 0.5),
    }


def fit_label_model(votes: DataFrame, rules: list[str], rounds: int = 25) -> DataFrame:
    """One row, ``model``: the share of good documents, then four rates for each rule:
    right and wrong votes on good documents, wrong and right votes on bad ones.

    What is left of a class's rates is how often the rule abstains, which counts as
    evidence too: a defect that isn't seen speaks for a document. Rules are
    taken to be better than chance, so a good vote never counts against a
    document and a bad vote never for it; this fixes which class is the good one.
    """
    counts = votes.groupBy(*rules).agg(F.count(F.lit(1)).cast("double").alias("n"))
    table = counts.agg(F.array_sort(F.collect_list(F.struct(F.array(*[F.col(r).cast("int") for r in rules]).alias("v"), "n"))).alias("patterns"))
    m = len(rules)

    def log_odds(p: Column, v: Column) -> Column:
        rate = lambda j, k: F.get(p, j * 4 + (1 + k))
        silent = lambda a, b: F.greatest(F.lit(LEAST_RATE), 1 - a - b)
        each = F.transform(
            F.sequence(F.lit(0), F.lit(m - 1)),
            lambda j: F.when(F.get(v, j) == 1, F.greatest(F.lit(0.0), F.log(rate(j, 0) / rate(j, 2))))
            .when(F.get(v, j) == -1, F.least(F.lit(0.0), F.log(rate(j, 1) / rate(j, 3))))
            .otherwise(F.log(silent(rate(j, 0), rate(j, 1)) / silent(rate(j, 2), rate(j, 3)))),
        )
        return F.aggregate(each, F.log(F.get(p, F.lit(0)) / (1 - F.get(p, F.lit(0)))), lambda a, x: a + x)

    def step(p: Column, patterns: Column) -> Column:
        weighed = F.transform(
            patterns, lambda x: F.struct(x["v"].alias("v"), (x["n"] / (1 + F.exp(-log_odds(p, x["v"])))).alias("good"), x["n"].alias("n"))
        )

        def total(rows: Column, value) -> Column:
            return F.aggregate(rows, F.lit(0.0), lambda a, x: a + value(x))

        good, bad = lambda x: x["good"], lambda x: x["n"] - x["good"]

        def rate(rows: Column, j: Column, vote: int, mass) -> Column:
            hits = total(rows, lambda x: F.when(F.get(x["v"], j) == vote, mass(x)).otherwise(0.0))
            return F.greatest(F.lit(LEAST_RATE), (hits + 0.5) / (total(rows, mass) + 2))

        share = lambda rows: (total(rows, good) + 0.8) / (total(rows, lambda x: x["n"]) + 1.0)
        return let(
            weighed,
            lambda rows: F.concat(
                F.array(F.greatest(F.lit(0.01), F.least(F.lit(0.99), share(rows)))),
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(0), F.lit(m - 1)),
                        lambda j: F.array(rate(rows, j, 1, good), rate(rows, j, -1, good), rate(rows, j, 1, bad), rate(rows, j, -1, bad)),
                    )
                ),
            ),
        )

    start = F.array(*map(F.lit, [0.8] + sum((START_DEFECT if r.removeprefix("vote_") in DEFECTS else START_TWO_SIDED for r in rules), [])))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda p, _: step(p, F.col("patterns")))
    return table.select(fitted.alias("model"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: float = 0.5, keep_at: float = 0.5) -> DataFrame:
    """doc_id, base counts, base_failed, the votes, posterior and kept, a row for each row.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat``
    of them in repeated 3-word windows. ``kept`` needs a posterior of at least
    ``keep_at`` and not ``base_failed``. Null and empty texts have no words and
    fail. A document whose rules all abstain gets the prior. Repeated rows get
    one result each. An empty table gives no rows; other columns are ignored.
    """
    rules = rule_votes()
    names = [f"vote_{k}" for k in rules]
    votes = materialize(base_columns(docs, id_col, text_col).withColumns({f"vote_{k}": v for k, v in rules.items()}), "votes")
    # the model is one row of 4 * rules + 1 numbers
    model = materialize(fit_label_model(votes, names), "model").first()[0]
    odds = F.lit(0.0)
    if model:
        odds = F.lit(math.log(model[0] / (1 - model[0])))
        for j, name in enumerate(names):
            good1, bad1, good2, bad2 = model[1 + 4 * j : 5 + 4 * j]
            odds = odds + F.when(F.col(name) == 1, max(0.0, math.log(good1 / good2))).when(F.col(name) == -1, min(0.0, math.log(bad1 / bad2))).otherwise(
                math.log(max(LEAST_RATE, 1 - good1 - bad1) / max(LEAST_RATE, 1 - good2 - bad2))
            )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * max_repeat)
    return (
        votes.withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= keep_at))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", *names)
    )

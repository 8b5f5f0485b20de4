"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

Documents are leaves of a tree given by ``levels`` (domain, language, source).
A budget of tokens starts at the root and is split among children by weight. A
child whose subtree cannot supply its share gets all it has, and what it leaves
goes to its siblings by weight; only when a whole subtree is short does the rest
reach the siblings of its parent. Every step is exact integer arithmetic.

A leaf's budget is then read as a prefix of the tokens of its seeded epochs:
each epoch is a pseudo-random order of the leaf's documents, whole epochs count
once each, and the last one is cut where the budget ends, which may be inside a
document. So a leaf is given its budget to the token, and a very long document
early in the order costs the others nothing. The cut is found from sums over
buckets of the order, then over buckets of the one bucket that holds it, so only
a leaf's 16-millionth part is ever sorted, and a leaf with a third of all rows
is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_array

BIG = "decimal(38,0)"
#: Hexadecimal digits of a place in the order that a bucket has.
DIGITS = 3


def _split(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``budget`` to rows (parent..., node, weight, capacity, parent_budget).

    Children are ranked by capacity over weight. Those that fall short of their
    share of what is left, in that order, get their capacity; the rest share
    what remains by weight, and units lost to rounding go to the first ones.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = [F.col("capacity") / F.col("weight"), F.col("node")]
    upto = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = by.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    big = lambda c: F.col(c).cast(BIG)
    step1 = (
        children.withColumn("want", F.least(big("parent_budget"), F.sum(big("capacity")).over(by)))
        .withColumn("taken", F.coalesce(F.sum(big("capacity")).over(upto), F.lit(0).cast(BIG)))
        .withColumn("open_weight", F.sum(big("weight")).over(after))
        .withColumn("short", F.expr("cast(capacity as decimal(38,0)) * open_weight <= (want - taken) * weight"))
        # once one child can pay its share, all after it can
        .withColumn("short", F.coalesce(F.min(F.col("short").cast("int")).over(by.orderBy(*order)), F.lit(1)) == 1)
    )
    step2 = (
        step1.withColumn("rest", F.col("want") - F.coalesce(F.sum(F.when(F.col("short"), big("capacity"))).over(by), F.lit(0).cast(BIG)))
        .withColumn("rest_weight", F.coalesce(F.sum(F.when(~F.col("short"), big("weight"))).over(by), F.lit(1).cast(BIG)))
        .withColumn("given", F.when(F.col("short"), F.col("capacity")).otherwise(F.expr("cast(rest * weight div rest_weight as bigint)")))
        .withColumn("lost", F.expr("cast(want as bigint)") - F.sum("given").over(by))
    )
    payers = Window.partitionBy(*parent, "short").orderBy("node") if parent else Window.partitionBy("short").orderBy("node")
    return step2.withColumn(
        "budget",
        F.when(F.col("short"), F.col("given")).otherwise(F.least(F.col("capacity"), F.col("given") + (F.row_number().over(payers) <= F.col("lost")).cast("bigint"))),
    ).select(*children.columns, "budget")


def leaf_budgets(leaves: DataFrame, levels: list[str], weight: Column, budget: Column, epochs: int) -> DataFrame:
    """Budget of each leaf. ``leaves``: levels..., tokens. One row a leaf goes through windows of siblings, never documents.

    ``weight`` is an expression over ``level`` and ``node`` giving a positive integer.
    """
    tree = leaves.withColumn("capacity", F.col("tokens") * epochs)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    tree = tree.withColumn("parent_budget", F.lit(total).cast("bigint")).withColumn("parent_budget", budget.cast("bigint"))
    for depth, level in enumerate(levels):
        parent = levels[:depth]
        nodes = (
            tree.groupBy(*parent, F.col(level).alias("node"))
            .agg(F.sum("capacity").alias("capacity"), F.first("parent_budget").alias("parent_budget"))
            .withColumn("level", F.lit(level))
            .withColumn("weight", weight.cast("bigint"))
        )
        given = _split(nodes, parent).select(*parent, F.col("node").alias(level), F.col("budget").alias("parent_budget"))
        tree = tree.drop("parent_budget").join(given, levels[: depth + 1])
    return tree.select(*levels, "tokens", F.col("parent_budget").alias("budget"))


def mix_documents(
    docs: DataFrame,
    levels: dict[str, Column],
    weight: Column,
    budget: Column,
    epochs: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the levels, n_tokens, leaf_tokens, leaf_budget, copies, taken.

    ``copies`` is how often the whole document is taken: once for each whole
    epoch of its leaf, and once more if it ends inside the budget in the seeded
    order of the last epoch. ``taken`` counts its tokens in the budget; where that
    ends inside a document, these are its copies and the tokens before the cut, and
    the sum of ``taken`` over a leaf is the leaf's budget. ``budget`` is an
    expression that may use ``parent_budget``, the tokens there are. Tokens are
    words. A null level counts as ``""``, a null or empty text as no tokens (taken
    with whole epochs, and in the last one like any other). Ties in the order
    (repeated rows) are taken one after the other, shorter texts first. An empty
    table gives no rows; other columns are ignored.
    """
    names = list(levels)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            *[F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in levels.items()],
            F.size(word_array(F.col(text_col))).cast("bigint").alias("n_tokens"),
        ),
        "mix",
    )
    leaves = materialize(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    plan = leaf_budgets(leaves, names, weight, budget, epochs).withColumnsRenamed({"tokens": "leaf_tokens", "budget": "leaf_budget"})
    plan = plan.withColumn("whole", F.expr("case when leaf_tokens > 0 then leaf_budget div leaf_tokens else 1 end"))
    plan = materialize(plan.withColumn("rest", F.expr("case when leaf_tokens > 0 then leaf_budget % leaf_tokens else 0 end")), "budgets")
    # the epoch's number is part of the order, so each epoch has its own
    epoch_order = F.md5(F.concat(order, F.lit(":"), F.col("whole").cast("string")))
    placed = rows.join(plan, names).withColumn("place", epoch_order).withColumn("before", F.lit(0).cast("bigint"))
    done = []
    for step in range(2):
        placed = placed.withColumn("bucket", F.substring("place", 1 + DIGITS * step, DIGITS))
        placed = placed.join(materialize(_cuts(placed, names), "cuts"), names, "left")
        at_cut = F.coalesce(F.col("bucket") == F.col("cut.bucket"), F.lit(False))
        inside = F.coalesce(F.col("bucket") < F.col("cut.bucket"), F.lit(False)).cast("bigint")
        done.append(placed.where(~at_cut).withColumn("more", inside).withColumn("last", inside * F.col("n_tokens")).drop("cut", "bucket", "before"))
        placed = materialize(placed.where(at_cut).withColumn("before", F.col("cut.before")).drop("cut", "bucket"), "at-cut")
    upto = Window.partitionBy(*names).orderBy("place", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tested = placed.withColumn("upto", F.col("before") + F.sum("n_tokens").over(upto)).withColumn("more", (F.col("upto") <= F.col("rest")).cast("bigint"))
    done.append(tested.withColumn("last", F.greatest(F.lit(0).cast("bigint"), F.least("n_tokens", F.col("rest") - F.col("upto") + F.col("n_tokens")))).drop("upto", "before"))
    return done[0].unionByName(done[1]).unionByName(done[2]).select(
        "doc_id", *names, "n_tokens", "leaf_tokens", "leaf_budget", (F.col("whole") + F.col("more")).alias("copies"), (F.col("whole") * F.col("n_tokens") + F.col("last")).alias("taken")
    )


def _cuts(placed: DataFrame, names: list[str]) -> DataFrame:
    """Of each leaf the first bucket that does not fit as a whole, and the tokens before it."""
    sums = placed.groupBy(*names, "rest", "before", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    upto = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.col("before") + F.sum("bucket_tokens").over(upto)).where("upto > rest")
    return sums.groupBy(*names).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("bucket_tokens")).alias("before"))).alias("cut"))

"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of a link.

    Each round takes the least label over a node's neighbours and then jumps to
    that label's own label, which halves the depth of the label forest; rounds
    end when no label changes. Each round is written to the shared folder, so
    lineage stays short. Minimums are combined before they are shuffled, and a
    node with very many links is a splittable join key. Links with a null end
    and links of a node to itself are ignored.
    """
    a, b = F.col(left).alias("node"), F.col(right).alias("other")
    once = links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    both = materialize(once.select(a, b).unionByName(once.select(F.col(right).alias("node"), F.col(left).alias("other"))).distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "other", "component": "seen"}), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        hooked = labels.join(near, "node").select("node", F.least("component", "seen").alias("component"), F.col("component").alias("old"))
        # a label is a node too, and so has a label of its own
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("further"))
        jumped = hooked.join(roots, hooked.component == roots.root, "left").select(
            "node", F.least("component", F.coalesce("further", "component")).alias("component"), "old"
        )
        new = materialize(jumped, "labels")
        ended = new.where("component <> old").isEmpty()
        release(labels)
        if ended:
            release(both)
            return new.drop("old")
        labels = new.drop("old")
        labels._scratch = new._scratch


def contracted(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """The same as ``components``, by contraction: for links of which most form stars around their smallest node.

    Each round gives a node the first of itself and its neighbours, by number in
    the first round and in a random order after it, and puts these in place of the
    ends of all links; links within one go. So a star is gone after a round, links
    get fewer by a constant share in each, and rows are joined about twice in all.
    """
    a, b = F.col(left), F.col(right)
    once = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    edges, maps = materialize(once, "edges"), []
    kind = edges.schema["a"].dataType
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))) if maps else F.lit(0).cast("bigint"), F.col(c).alias("x"))
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        near = both.groupBy("node").agg(F.min(order("other")).alias("near"))
        label = materialize(near.select("node", F.least("near", order("node"))["x"].cast(kind).alias("label")), "label")
        ends = [label.select(F.col("node").alias(e), F.col("label").alias(f"{e}_label")) for e in "ab"]
        moved = edges.join(ends[0], "a").join(ends[1], "b").where("a_label <> b_label")
        new = materialize(moved.select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b")).distinct(), "edges")
        release(edges)
        maps.append(label)
        edges = new
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    whole = maps.pop()
    while maps:  # from the last and smallest map back to that of all nodes
        up, own = whole.select(F.col("node").alias("label"), F.col("label").alias("further")), maps.pop()
        new = materialize(own.join(up, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")
        release(whole, own)
        whole = new
    least = whole.groupBy("label").agg(F.min("node").alias("component"))
    out = materialize(whole.join(least, "label").select("node", "component"), "components")
    release(whole, edges)
    return out

"""Exact deduplication by deterministic block naming (DataFrame functions only).

A normalised text is cut into fixed-size byte blocks. Distinct blocks are
sorted and numbered, which gives each an integer name; then adjacent names are
paired, distinct pairs are sorted and numbered, and so on until every document
has one name. Two texts of one block count share a name exactly if they are
equal: no step relies on a 64-bit checksum being free of collisions. (Only where
such checksums do clash, a row finds its blocks again by its id and the SHA-256
of its text.)

To keep block contents off the network, blocks are first sorted by a 64-bit
checksum. A checksum that occurs once names its block by itself. Contents of
repeated checksums are compared, and where one checksum has several contents
they are told apart by their rank. A bitmap of the repeated checksums goes to
every task, so what travels is repeated blocks, once for each distinct content
and map task however often they occur, and of the others what the bitmap lets
through by chance (one in sixteen, until its bound is reached: more beyond).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, sift


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def _numbered(occurrences: DataFrame, keys: list[str]) -> DataFrame:
    """Replace ``keys`` by ``name``: the place of the distinct key in sorted order.

    Range partitions are ordered and each is sorted, so the generated number
    grows with the key and is unique to it. Hot keys meet only as one row for
    each map task in the distinct, and as a splittable join afterwards.
    """
    names = (
        occurrences.select(*keys)
        .distinct()
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("name", F.monotonically_increasing_id())
    )
    return occurrences.join(materialize(names, "names"), keys).drop(*keys)


def block_names(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, checksum_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``rid, doc_id, text_sha256``, final names with ``rid, level, name``)."""
    mask = (1 << checksum_bits) - 1 if checksum_bits < 64 else -1

    def checksum(block: Column) -> Column:
        return F.xxhash64(block).bitwiseAND(F.lit(mask).cast("bigint"))

    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length("bytes") - 1) / block_bytes).cast("int"))),
        lambda i: F.substring("bytes", i * block_bytes + 1, F.lit(block_bytes)),
    )
    source = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).select(
        "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.col("norm").cast("binary").alias("bytes")
    )
    rows = materialize(
        source.select("doc_id", "text_sha256", F.transform(blocks, checksum).alias("sums")).withColumn("rid", F.monotonically_increasing_id()),
        "blocks",
    )
    at = rows.select("rid", "doc_id", "text_sha256", F.size("sums").alias("n"), F.posexplode("sums").alias("pos", "h"))

    repeated = materialize(at.groupBy("h").count().where("count > 1").select("h"), "repeated")
    every = source.select(F.explode(blocks).alias("block")).select(checksum(F.col("block")).alias("h"), "block")
    contents = materialize(sift(every, F.col("h"), repeated, "h").distinct().join(repeated, "h", "left_semi"), "contents")
    clashing = contents.groupBy("h").count().where("count > 1").select("h")
    if clashing.isEmpty():
        at = at.withColumn("variant", F.lit(0))
    else:
        from pyspark.sql import Window

        ranked = contents.join(clashing, "h", "left_semi").withColumn("variant", F.row_number().over(Window.partitionBy("h").orderBy("block")))
        placed = (
            source.select("doc_id", "text_sha256", F.posexplode(blocks).alias("pos", "block"))
            .withColumn("h", checksum(F.col("block")))
            .join(ranked, ["h", "block"])
            .select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("s"), F.col("pos").alias("p"), "variant")
            .distinct()
        )
        at = at.join(placed, (at.doc_id.eqNullSafe(placed.d)) & (at.text_sha256 == placed.s) & (at.pos == placed.p), "left").select(
            at["*"], F.coalesce("variant", F.lit(0)).alias("variant")
        )
    names = materialize(_numbered(at.select("rid", "n", "pos", "h", "variant"), ["h", "variant"]), "names0")
    longest = rows.agg(F.max(F.size("sums"))).first()[0] or 1
    done, level = names.where("n = 1").select("rid", F.lit(0).alias("level"), "name"), 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        pairs = (
            names.where("n > 1")
            .groupBy("rid", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(
                F.expr("cast((max(n) + 1) div 2 as int)").alias("n"),
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
        )
        names = materialize(_numbered(pairs, ["left", "right"]), f"names{level}")
        done = done.unionByName(names.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    return rows.drop("sums"), done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, checksum_bits: int = 64) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are identical after white-space runs become
    single spaces; a null text counts as empty. The row with the smallest id
    stays; a null id comes last, and of rows that repeat one id in a group
    exactly one stays. An empty table gives no rows. Other columns are ignored,
    whatever their names. ``level`` and ``name`` are the document's identity.
    """
    rows, done = block_names(docs, id_col, text_col, block_bytes, checksum_bits)
    named = materialize(rows.join(done, "rid"), "identities")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    groups = materialize(named.groupBy("level", "name").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    # written first, so that the join is one whose large partitions Spark can split
    return named.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        "text_sha256",
        "level",
        "name",
    )

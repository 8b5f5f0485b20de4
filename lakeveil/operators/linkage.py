"""Links between documents that share identities, and graphs of entities and documents."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeveil.functions import rules as R
from lakeveil.sources.tables import kept, release


def normalized(text: Column, type_: Column) -> Column:
    """The form in which two mentions are compared: bare digits of a phone, a name without titles."""
    low = F.trim(F.lower(text))
    digits = F.regexp_replace(low, "[^0-9]", "")
    phone = F.when(F.startswith(digits, F.lit("91")) & (F.length(digits) > 10), F.substring(digits, 3, 64)).otherwise(digits)
    name = low
    for t in R.TITLES:
        name = F.trim(F.replace(name, F.lit(t), F.lit("")))
    return F.when(type_ == "PHONE", phone).when(type_ == "AADHAAR", F.replace(low, F.lit(" "), F.lit(""))).when(type_ == "PERSON_NAME", name).otherwise(low)


def mentions(entities: DataFrame) -> DataFrame:
    """doc_id, type, key, n: the linkable mentions, one row for each document, type and normal form."""
    rows = entities.where(F.col("type").isin(*R.STRONG_TYPES, *R.WEAK_TYPES))
    return rows.withColumn("key", normalized(F.col("text"), F.col("type"))).groupBy("doc_id", "type", "key").agg(F.count(F.lit(1)).alias("n"))


def _sides(m: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    left = m.select(F.col("doc_id").alias("doc_1"), "type", F.col("key").alias("key_1"), F.col("n").alias("n_1"), *extra)
    right = m.select(F.col("doc_id").alias("doc_2"), "type", F.col("key").alias("key_2"), F.col("n").alias("n_2"), *[F.col(c) for c in extra])
    return left, right


def exact_matches(m: DataFrame) -> DataFrame:
    """doc_1 < doc_2 with one type and normal form in common; n counts pairs of mentions."""
    a, b = _sides(m.withColumn("k", F.col("key")), "k")
    return a.join(b, ["type", "k"]).where("doc_1 < doc_2").select("doc_1", "doc_2", "type", F.lit("EXACT").alias("match"), (F.col("n_1") * F.col("n_2")).alias("n"))


def exact_classes(m: DataFrame) -> DataFrame:
    """doc_id, type, class_id, first_doc, docs, n: the documents of each form that several have, one row for each member, not each pair."""
    groups = kept(m.groupBy("type", "key").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("docs")).where("docs > 1"))
    return m.join(groups, ["type", "key"]).select("doc_id", "type", F.left(F.sha2("key", 256), F.lit(16)).alias("class_id"), "first_doc", "docs", "n")


def forms(m: DataFrame) -> DataFrame:
    """type, key, docs: the distinct forms; links are looked for among these, however many documents have them."""
    return m.groupBy("type", "key").agg(F.count(F.lit(1)).alias("docs"))


def name_forms(m: DataFrame) -> DataFrame:
    """key_1 < key_2, docs_1, docs_2: names that share more than half of the larger set of tokens.

    Such names share one of the rarer half of the tokens of each, so only these
    are joined; a token that very many names have seldom is one of them.
    """
    names = forms(m.where("type = 'PERSON_NAME' and key <> ''")).withColumn("tokens", F.array_distinct(F.split(F.trim(F.regexp_replace("key", r"\s+", " ")), " ")))
    by_token = kept(names.select("key", "docs", "tokens", F.explode("tokens").alias("token")))
    common = kept(by_token.groupBy("token").agg(F.count(F.lit(1)).alias("names")))
    ranked = by_token.join(common, "token").groupBy("key").agg(F.first("docs").alias("docs"), F.first("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("names", "token"))).alias("ranked"))
    rare = kept(ranked.select("key", "docs", "tokens", F.explode(F.slice("ranked", F.lit(1), F.ceil(F.size("ranked") / 2).cast("int"))).alias("r")).select("key", "docs", "tokens", "r.token"))
    a = rare.select("token", F.col("key").alias("key_1"), F.col("docs").alias("docs_1"), F.col("tokens").alias("t_1"))
    b = rare.select("token", F.col("key").alias("key_2"), F.col("docs").alias("docs_2"), F.col("tokens").alias("t_2"))
    enough = F.size(F.array_intersect("t_1", "t_2")) * 2 > F.greatest(F.size("t_1"), F.size("t_2"))
    return a.join(b, "token").where((F.col("key_1") < F.col("key_2")) & enough).select(F.lit("PERSON_NAME").alias("type"), "key_1", "key_2", "docs_1", "docs_2").distinct()


def prefix_forms(m: DataFrame) -> DataFrame:
    """Other types: forms of four characters and more whose first four fifths of the shorter one agree.

    A form is listed under its first four fifths, and meets there all forms of its
    type that begin like this: these are listed under their beginnings of every
    such length, so what is joined is what is returned. Sizes of files say little
    of either side, so neither is broadcast.
    """
    shown = F.floor(F.length("key") * 0.8).cast("int")
    other = kept(forms(m.where("type <> 'PERSON_NAME' and length(key) >= 4")).withColumn("shown", shown))
    lengths = other.groupBy("type").agg(F.collect_set("shown").alias("lengths"))  # a row a type
    a = other.select("type", F.left("key", F.col("shown")).alias("start"), F.col("key").alias("key_a"), F.col("docs").alias("docs_a"))
    each = other.join(F.broadcast(lengths), "type").withColumn("at", F.explode(F.filter("lengths", lambda n: n <= F.col("shown"))))
    b = each.select("type", F.left("key", F.col("at")).alias("start"), (F.col("at") < F.col("shown")).alias("longer"), F.col("key").alias("key_b"), F.col("docs").alias("docs_b"))
    met = a.join(b.hint("merge"), ["type", "start"]).where("longer or key_a < key_b")
    turned = F.col("key_a") > F.col("key_b")
    side = lambda c, x, y: F.when(turned, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))
    return met.select("type", side("key", "b", "a").alias("key_1"), side("key", "a", "b").alias("key_2"), side("docs", "b", "a").alias("docs_1"), side("docs", "a", "b").alias("docs_2"))


def _between(pairs: DataFrame, m: DataFrame) -> DataFrame:
    """Pairs of documents, asked for, from pairs of forms."""
    a = m.select("type", F.col("key").alias("key_1"), F.col("doc_id").alias("a"), F.col("n").alias("n_1"))
    b = m.select("type", F.col("key").alias("key_2"), F.col("doc_id").alias("b"), F.col("n").alias("n_2"))
    rows = pairs.join(a, ["type", "key_1"]).join(b, ["type", "key_2"]).where("a <> b")
    return rows.select(F.least("a", "b").alias("doc_1"), F.greatest("a", "b").alias("doc_2"), "type", F.lit("FUZZY").alias("match"), (F.col("n_1") * F.col("n_2")).alias("n"))


def name_matches(m: DataFrame) -> DataFrame:
    return _between(name_forms(m), m)


def prefix_matches(m: DataFrame) -> DataFrame:
    return _between(prefix_forms(m), m)


def linkages(matches: DataFrame) -> DataFrame:
    """doc_1, doc_2, n_matches, strength: 1 with any strong type, else the sum of strengths, raised for several and bounded."""
    strong = F.col("type").isin(*R.STRONG_TYPES)
    tenths = F.when(F.col("match") == "EXACT", F.when(strong, 10).otherwise(5)).otherwise(F.when(strong, 7).otherwise(3))
    pairs = matches.groupBy("doc_1", "doc_2").agg(F.sum("n").alias("n_matches"), F.max(strong).alias("strong"), F.sum(tenths * F.col("n")).alias("tenths"))
    total = F.col("tenths") / 10
    weak = (
        F.when(F.col("n_matches") >= 3, F.least(F.col("tenths") * 15 / 100, F.lit(1.0)))
        .when(F.col("n_matches") == 2, F.least(F.col("tenths") * 12 / 100, F.lit(0.9)))
        .otherwise(F.least(total, F.lit(0.6)))
    )
    return pairs.select("doc_1", "doc_2", "n_matches", F.when(F.col("strong"), 1.0).otherwise(weak).alias("strength"))


def profiles(m: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, profile of each document that may have links; first_doc, second_doc, profile_1, profile_2, pairs, n_matches, strength; type).

    Whether and how two documents are linked depends on their linkable forms and
    the numbers of these alone, so documents with the same ones have one profile,
    and links are found between profiles: a form that very many documents have and
    nothing else links is one row, not a row for each two of them. ``pairs`` is how
    many pairs of documents a row stands for; a profile is linked to itself where
    it has several documents. ``first_doc`` and ``second_doc`` are its smallest.
    """
    names, prefixes = name_forms(m), prefix_forms(m)
    fuzzy = kept(names.unionByName(prefixes).select("type", "key_1", "key_2"))
    several = forms(m).where("docs > 1").select("type", "key")
    ends = [fuzzy.select("type", F.col(k).alias("key")) for k in ("key_1", "key_2")]
    linkable = several.unionByName(ends[0]).unionByName(ends[1]).distinct()
    own = m.join(linkable, ["type", "key"], "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("type", "key", "n"))).alias("forms"))
    docs = kept(own.withColumn("profile", F.sha2(F.to_json("forms"), 256)))
    table = kept(docs.groupBy("profile").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("first"), F.any_value("forms").alias("forms")))
    each = kept(table.select("profile", "members", "first", F.explode("forms").alias("x")).select("profile", "members", "first", "x.type", "x.key", "x.n"))
    side = lambda k: each.select("type", F.col("key").alias(f"key_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("profile", "members", "first", "n")])
    a, b = side(1), side(2)
    itself = F.col("profile_1") == F.col("profile_2")
    equal = a.join(b, (a.type == b.type) & (a.key_1 == b.key_2)).drop(b.type).where("profile_1 <= profile_2")
    equal = equal.withColumns({"match": F.lit("EXACT"), "n": F.col("n_1") * F.col("n_2")})
    near = fuzzy.join(a, ["type", "key_1"]).join(b, ["type", "key_2"]).withColumns({"match": F.lit("FUZZY"), "n": F.col("n_1") * F.col("n_2") * F.when(itself, 2).otherwise(1)})
    sides = ["profile", "members", "first"]
    turned = F.col("profile_1") > F.col("profile_2")
    near = near.select("type", "match", "n", *[F.when(turned, F.col(f"{c}_{3 - k}")).otherwise(F.col(f"{c}_{k}")).alias(f"{c}_{k}") for c in sides for k in (1, 2)])
    rows = kept(equal.select(*near.columns).unionByName(near).where(~itself | (F.col("members_1") > 1)))
    keys = ["profile_1", "profile_2", "members_1", "members_2", "first_1", "first_2"]
    links = linkages(rows.withColumns({"doc_1": F.struct(*keys), "doc_2": F.lit(0)})).select("doc_1.*", "n_matches", "strength")
    pairs = F.when(itself, F.expr("members_1 * (members_1 - 1) div 2")).otherwise(F.col("members_1") * F.col("members_2"))
    return docs.select("doc_id", "profile"), links.select(F.col("first_1").alias("first_doc"), F.col("first_2").alias("second_doc"), "profile_1", "profile_2", pairs.alias("pairs"), "n_matches", "strength"), rows.select("type").distinct()


def profile_clusters(docs: DataFrame, links: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, cluster_id of the documents that strong links join, from profiles; a cluster's id is its smallest document."""
    strong = kept(links.where(F.col("strength") >= least))
    joined = clusters(strong.select(F.col("profile_1").alias("a"), F.col("profile_2").alias("b")))
    ends = [strong.select(F.col(p).alias("profile")) for p in ("profile_1", "profile_2")]
    nodes = ends[0].unionByName(ends[1]).distinct().join(joined.withColumnRenamed("node", "profile"), "profile", "left").withColumn("cluster", F.coalesce("cluster", "profile"))
    members = kept(docs.join(nodes, "profile").select("doc_id", "cluster"))
    return members.join(members.groupBy("cluster").agg(F.min("doc_id").alias("cluster_id")), "cluster").select("doc_id", "cluster_id")


def linkage_advice(risk: DataFrame, types: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: recommendations (joined by lines) and summary. ``types``: entity_types (array) that link; ``pairs``: doc_pairs, n_matches."""
    one = lambda df: df.withColumn("k", F.lit(1))  # noqa: E731  tables of one row
    rows = one(risk.select("level", "score")).join(one(types), "k").join(one(pairs), "k")
    critical, high = F.col("level") == "CRITICAL", F.col("level").isin("CRITICAL", "HIGH")
    listed = F.array(
        *[F.when(critical, x) for x in R.LINK_CRITICAL],
        F.when(high & (F.size("entity_types") > 0), F.concat(F.lit(R.LINK_TYPES[0]), F.array_join("entity_types", ", "), F.lit(R.LINK_TYPES[1]))),
        F.when(F.col("level") == "MEDIUM", R.LINK_MEDIUM),
        F.when(F.col("doc_pairs") > 0, R.LINK_ANY),
    )
    said = F.array_join(F.filter(listed, lambda x: x.isNotNull()), "\n")
    found = F.concat(F.lit("Found "), F.col("doc_pairs").cast("string"), F.lit(" document pair(s) with "), F.col("n_matches").cast("string"), F.lit(" matching entities. Combined risk: "), "level", F.lit("."))
    none = F.lit("No cross-document linkages detected. Documents can be shared together safely.")
    return rows.select(F.when(said == "", "No immediate action required - linkage risk is low").otherwise(said).alias("recommendations"), F.when(F.col("doc_pairs") == 0, none).otherwise(found).alias("summary"))


def linkage_risk(links: DataFrame) -> DataFrame:
    """One row: score, level, max_strength, n_matches over all links (of documents, or of profiles with their pairs)."""
    each = F.col("n_matches") * F.col("pairs") if "pairs" in links.columns else F.col("n_matches")
    total = links.agg(F.coalesce(F.max("strength"), F.lit(0.0)).alias("max_strength"), F.coalesce(F.sum(each), F.lit(0)).alias("n_matches"))
    score = F.least(F.col("max_strength") * 100 + F.col("n_matches") * 5, F.lit(100.0))
    lev = F.when(F.col("score") >= 80, "CRITICAL").when(F.col("score") >= 60, "HIGH").when(F.col("score") >= 40, "MEDIUM").otherwise("LOW")
    return total.withColumn("score", F.bround(score, 1)).withColumn("level", lev)


def clusters(edges: DataFrame) -> DataFrame:
    """node, cluster (its smallest node) for edges (a, b): minimum labels with pointer jumping until none changes."""
    pairs = edges.where("a <> b")
    both = kept(pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = kept(both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("cluster")))
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("cluster").alias("seen"))
        near = both.join(seen, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        hooked = labels.join(near, "node").select("node", F.least("cluster", "seen").alias("cluster"), F.col("cluster").alias("old"))
        up = labels.select(F.col("node").alias("root"), F.col("cluster").alias("further"))
        new = kept(hooked.join(up, hooked.cluster == up.root, "left").select("node", F.least("cluster", F.coalesce("further", "cluster")).alias("cluster"), "old"))
        ended = new.where("cluster <> old").isEmpty()
        release(labels)
        if ended:
            release(both)
            return new.drop("old")
        labels = new.drop("old")
        labels._scratch = new._scratch


def link_clusters(links: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, cluster_id over links at least as strong as ``least``."""
    found = clusters(links.where(F.col("strength") >= least).select(F.col("doc_1").alias("a"), F.col("doc_2").alias("b")))
    return found.select(F.col("node").alias("doc_id"), F.col("cluster").alias("cluster_id"))


def graph_nodes(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities: hash, type, sample; occurrences: hash, doc_id). The first mention gives type and sample."""
    rows = entities.withColumn("hash", F.left(F.sha2("text", 256), F.lit(16)))
    first = F.struct("doc_id", "start")
    nodes = rows.groupBy("hash").agg(F.min_by("type", first).alias("type"), F.left(F.min_by("text", first), F.lit(32)).alias("sample"), F.max("doc_id").alias("last_doc"))
    return nodes, rows.select("hash", "doc_id").distinct()


def top_entities(nodes: DataFrame, occurrences: DataFrame, limit: int) -> DataFrame:
    counts = occurrences.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"))
    return nodes.join(counts, "hash").orderBy(F.desc("docs"), "hash").limit(limit)


def graph_links(top: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Links between top entities and the documents that hold more than one of them."""
    among = occurrences.join(top.select("hash"), "hash", "left_semi")
    rich = among.groupBy("doc_id").count().where("count > 1").select("doc_id")
    return among.join(rich, "doc_id", "left_semi")


def chains(nodes: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Entities of several documents, their first document, and a risk of 20 for each; the documents are rows of ``occurrences``."""
    docs = occurrences.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))
    return docs.where("docs > 1").join(nodes, "hash").select("hash", "type", "docs", "first_doc", (F.col("docs") * 20).alias("risk"))


def delete_document(nodes: DataFrame, occurrences: DataFrame, doc_id: int) -> tuple[DataFrame, DataFrame]:
    """The graph without a document and without the entities that only it had."""
    left = occurrences.where(F.col("doc_id") != doc_id)
    return nodes.join(left, "hash", "left_semi"), left


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """fp, rep (its smallest doc_id), n of each distinct fingerprint: equal fingerprints count once in a search."""
    return prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))


def similarity_pairs(classes: DataFrame, most: int = 5, bands: int | None = None) -> DataFrame:
    """doc_1 < doc_2, distance of fingerprint classes (fp, rep) with at most ``most`` differing bits.

    At most ``most`` of the bands differ, so ``bands - most`` agree: a class has
    a key for each such choice, and the join on keys is exact. More classes get
    more bands, so that keys widen and chance meetings don't grow with the
    square: 56 keys of 24 bits, 252 of 32 from 2**20 classes on, 792 of 37 from
    2**28 on. The pairs are the same with any number.
    """
    if bands is None:
        classes = kept(classes)
        n = classes.count()
        bands = 8 if n < 1 << 20 else 10 if n < 1 << 28 else 12
    edges = [64 * i // bands for i in range(bands + 1)]
    width = -(-64 // bands)
    parts = F.array(*[F.shiftrightunsigned(F.col("fp"), edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1) for i in range(bands)])
    chosen = F.array(*[F.struct(F.lit(nth).cast("bigint").alias("nth"), F.array(*map(F.lit, c)).alias("bands")) for nth, c in enumerate(combinations(range(bands), bands - most))])
    key = lambda p, c: F.aggregate(c["bands"], c["nth"], lambda k, i: F.shiftleft(k, width).bitwiseOR(F.get(p, i)))
    keys = F.element_at(F.transform(F.array(parts), lambda p: F.transform(chosen, lambda c: key(p, c))), 1)
    rows = classes.select("rep", "fp", F.explode(keys).alias("key"))
    # the classes' file is small, their keys are not: a broadcast by the file's size would pass them all through the driver
    a, b = rows.alias("a"), rows.alias("b").hint("merge")
    distance = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & (distance <= most)
    return a.join(b, on).select(F.col("a.rep").alias("doc_1"), F.col("b.rep").alias("doc_2"), distance.cast("int").alias("distance")).distinct()


def simhashes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, fp: 64-bit SimHash (bigint) of the lower-cased words by the low half of their MD5.

    Votes are 64 sums, combined in the task that read the document, so that one
    row for each document is shuffled. A text without words has fingerprint 0.
    """
    texts = docs.where(F.col(text_col).isNotNull())
    words = texts.select("doc_id", F.explode_outer(F.regexp_extract_all(F.lower(text_col), F.lit(r"(?U)\w+"), F.lit(0))).alias("w"))
    hashed = words.select("doc_id", F.conv(F.substring(F.md5("w"), 17, 16), 16, -10).cast("bigint").alias("h"))
    ones = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(1)).alias(f"b{i}") for i in range(64)]
    votes = hashed.groupBy("doc_id").agg(F.count("h").alias("n"), *ones)
    fp = F.lit(0).cast("bigint")
    for i in range(64):
        value = (1 << i) if i < 63 else -(1 << 63)
        fp = fp.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit(value).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return votes.select("doc_id", fp.alias("fp"))


def keep_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert by replacement: the last row of each key, by maximums that are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("x")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])

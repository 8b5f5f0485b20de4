"""Small tables with the odd cases: nulls, empty and long texts, repeated rows, clashing column names."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PROSE = " ".join(f"word{i}" for i in range(120)) + "."
ROWS = [
    (1, PROSE), (2, PROSE.replace(" ", "\n\t ")), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "short text"), (7, "short text"), (None, PROSE), (None, None),
    (8, "The The The The " * 40), (9, "NOW!! BUY!! " * 60), (10, "é ß 漢字 \U0001f600 \x1c end"), (11, "a"), (12, LONG + " tail"),
]
CLASHES = ["kept", "score", "fp", "rid", "size", "level", "name", "key", "label", "component_id", "text_sha256", "place", "shard", "block", "ids", "n_words", "held", "seq", "p", "spans", "row", "_id", "_sha", "_score", "_text_sha", "_at_domain", "_d", "_h", "_word", "_bit", "text_hash", "pid", "bin"]


def odd(spark, rows=None):
    df = spark.createDataFrame([(i, t, "en", "src1") for i, t in (ROWS if rows is None else rows)], "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def empty(spark):
    return odd(spark).limit(0)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")

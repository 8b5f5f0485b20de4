"""Spans and boxes against all pairs."""

import random

from pyspark.sql import functions as F

from lakeveil.operators import coordinates as C


def test_boxes_of_words(spark):
    docs = spark.createDataFrame([(1, "ab  é\n\ncd\tx\x1cy"), (2, None), (3, ""), (None, "w")], "doc_id int, text string").withColumn("page", F.lit("clash"))
    got = [(r.doc_id, r.nth, r.page, r.word, r.start, r.end, r.x0, r.y0, r.x1, r.y1) for r in C.word_boxes(docs).collect()]
    assert got == [(1, 0, 0, "ab", 0, 2, 0, 0, 12, 12), (1, 1, 0, "é", 4, 5, 24, 0, 30, 12), (1, 2, 0, "cd", 7, 9, 0, 24, 12, 36), (1, 3, 0, "x\x1cy", 10, 13, 18, 24, 36, 36), (None, 0, 0, "w", 0, 1, 0, 0, 6, 12)]
    long = C.word_boxes(spark.createDataFrame([(1, "a b\n" * 120)], "doc_id int, text string")).collect()
    assert (long[-1].page, long[-1].y0, long[-1].x0) == (2, 19 * 12, 12)


def test_every_overlap_is_found_once(spark):
    rng = random.Random(3)
    spans = [(d, "T", s, s + n) for d in (1, 2) for s, n in {(rng.randrange(600), rng.choice([0, 1, 5, 64, 200])) for _ in range(80)}]
    boxes = [(d, k, 0, "w", s, s + rng.choice([1, 7, 64, 130]), s, 0, s + 1, 12) for d in (1, 3) for k, s in enumerate(rng.sample(range(700), 120))]
    a = spark.createDataFrame(spans, "doc_id int, type string, start int, `end` int")
    b = spark.createDataFrame(boxes, "doc_id int, nth int, page int, word string, start int, `end` int, x0 int, y0 int, x1 int, y1 int")
    got = sorted((r.doc_id, r.start, r.end, r.nth) for r in C.span_boxes(a, b).collect())
    assert got == sorted((d, s, e, k) for d, _, s, e in spans for d2, k, _, _, s2, e2, *_ in boxes if d == d2 and s < e2 and s2 < e and s < e) and got
    assert C.span_boxes(a.limit(0), b).count() == C.span_boxes(a, b.limit(0)).count() == 0
    area = C.entity_areas(a, b).where("doc_id = 1").first()
    own = [x for x in boxes if x[0] == 1 and x[4] < area.end and area.start < x[5]]
    assert (area.n_boxes, area.x0, area.x1) == (len(own), min(x[6] for x in own), max(x[8] for x in own))


def test_first_coordinate_by_text(spark):
    rows = spark.sql("select 'Asha Rao' t, array(named_struct('text', 'no', 'x', 1), named_struct('text', 'Asha', 'x', 2), named_struct('text', 'Dr Asha Rao', 'x', 3)) c union all select 'none', array()")
    assert [r.x for r in rows.select(C.first_by_text(F.col("t"), F.col("c"))["x"].alias("x")).collect()] == [2, None]

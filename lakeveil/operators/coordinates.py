"""Where on a page an entity stands: words with boxes, met by the spans of entities.

Spans and boxes of a text meet by bins of ``BIN`` characters: each is listed under
the bins that it touches, a few rows, and two that overlap are reported in the bin
where the later one of them begins, once. So a text of any length is spread over
tasks, and no text's words are gathered in one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import lakeveil

cloudpickle.register_pickle_by_value(lakeveil)

BIN = 64
#: A page of fixed pitch: width and height of a character, lines of a page.
WIDTH, HEIGHT, LINES = 6, 12, 50
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_boxes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, nth, page, word, start, end, x0, y0, x1, y1: the words of texts as they stand on pages of fixed pitch.

    For texts that bring no coordinates of their own. Null texts have no words.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["nth", "page", "word", "start", "end", "x0", "y0", "x1", "y1"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 50):
                some = b.slice(at, 50)
                row, out = [], []
                for i, text in enumerate(some.column("text").to_pylist()):
                    line, begins, seen = 0, 0, 0
                    for nth, m in enumerate(WORD.finditer(text)):
                        if (n := text.count("\n", seen, m.start())) > 0:
                            line, begins = line + n, text.rindex("\n", seen, m.start()) + 1
                        seen = m.start()
                        x, y = (m.start() - begins) * WIDTH, line % LINES * HEIGHT
                        row.append(i)
                        out.append((nth, line // LINES, m[0], m.start(), m.end(), x, y, x + len(m[0]) * WIDTH, y + HEIGHT))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.nulls(0, t) for t in kinds]
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(row, pa.int64())), *columns], ["doc_id", *names])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, nth int, page int, word string, start int, `end` int, x0 int, y0 int, x1 int, y1 int")


def _binned(rows: DataFrame, start: str, end: str) -> DataFrame:
    return rows.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(F.expr(f"{start} div {BIN}"), F.expr(f"(`{end}` - 1) div {BIN}"))))


def span_boxes(entities: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each entity (doc_id, start, end, ...) with each box of its text that it overlaps. Empty spans and rows with a null id meet none."""
    a = _binned(entities.withColumnsRenamed({"start": "e_start", "end": "e_end"}), "e_start", "e_end")
    b = _binned(boxes.withColumnsRenamed({"start": "b_start", "end": "b_end"}), "b_start", "b_end")
    met = a.join(b, ["doc_id", "_bin"]).where((F.col("e_start") < F.col("b_end")) & (F.col("b_start") < F.col("e_end")))
    return met.where(F.expr(f"_bin = greatest(e_start, b_start) div {BIN}")).drop("_bin").withColumnsRenamed({"e_start": "start", "e_end": "end"})


def entity_areas(entities: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, type, start, end, page, n_boxes and the area around the boxes of each entity on each page that it stands on."""
    area = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return span_boxes(entities.select("doc_id", "type", "start", "end"), boxes).groupBy("doc_id", "type", "start", "end", "page").agg(F.count(F.lit(1)).alias("n_boxes"), *area)


def first_by_text(text: Column, coordinates: Column) -> Column:
    """The first coordinate (array of structs with text) whose text holds the entity's or is held by it."""
    return F.get(F.filter(coordinates, lambda c: F.contains(c["text"], text) | F.contains(text, c["text"])), F.lit(0))

"""Entities of web pages and where they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeveil.operators import coordinates as C
from lakeveil.operators import spans
from lakeveil.sources.tables import kept, spread, table

from . import sql as S

Q, O = {}, {}


def q(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn

    return add


def texts(s, d) -> DataFrame:
    """Pages as texts, with a line that has a person, a number and an address on it."""
    body = F.regexp_replace("html", "<[^>]*>", " ")
    line = F.concat(F.lit("\nContact 98765"), F.lpad(F.col("page_id").cast("string"), 5, "4"), F.lit(" or\npage"), F.col("page_id").cast("string"), F.lit("@mail.example for\tmore"))
    return spread(table(s, d, "pages")).select(F.col("page_id").alias("doc_id"), F.concat(body, line).alias("text"))


_TEXTS = r"pages_text as (select page_id doc_id, regexp_replace(html, '<[^>]*>', ' ', 'g') || chr(10) || 'Contact 98765' || lpad(page_id::varchar, 5, '4') || ' or' || chr(10) || 'page' || page_id || '@mail.example for' || chr(9) || 'more' as text from pages)"
_BOXES = rf"""wf as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') f, string_split_regex(text, '[^\x20\x09-\x0D]+') g from pages_text),
w0 as (select doc_id, text, k - 1 nth, f[k] word, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0))::int s from wf, unnest(generate_series(1, len(f))) u(k)),
w1 as (select *, left(text, s) before, length(left(text, s)) - length(replace(left(text, s), chr(10), '')) line from w0),
boxes as (select doc_id, nth, line // {C.LINES} page, word, s b_s, s + length(word) b_e, length(string_split(before, chr(10))[-1]) * {C.WIDTH} x0, line % {C.LINES} * {C.HEIGHT} y0,
  (length(string_split(before, chr(10))[-1]) + length(word)) * {C.WIDTH} x1, line % {C.LINES} * {C.HEIGHT} + {C.HEIGHT} y1 from w1)"""
_ALL = f"with {_TEXTS}, {S.core('pages_text')}, {_BOXES}"


@q("entity_areas", f"""{_ALL} select doc_id, type, start, "end", page::int page, count(*) n_boxes, min(x0)::int x0, min(y0)::int y0, max(x1)::int x1, max(y1)::int y1
 from entities join boxes using (doc_id) where start < b_e and b_s < "end" group by doc_id, type, start, "end", page""")
def _(s, d):
    """The area of each entity on its page, by an interval join of spans and words."""
    rows = kept(texts(s, d))
    return C.entity_areas(spans.detect(rows), C.word_boxes(rows))


@q("entity_coordinates", f"""{_ALL}, hit as (select e.doc_id, e.start, e.type, e.text, b.nth, b.page, b.x0, b.y0, row_number() over (partition by e.doc_id, e.start order by b.nth) n from entities e join boxes b on b.doc_id = e.doc_id and (contains(b.word, e.text) or contains(e.text, b.word)))
select doc_id, start, type, text, nth::int nth, page::int page, x0::int x0, y0::int y0 from hit where n = 1""")
def _(s, d):
    """Of each entity the first coordinate that holds its text or is held by it, as extractors give them: a list for each text."""
    rows = kept(texts(s, d))
    listed = C.word_boxes(rows).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", F.col("word").alias("text"), "page", "x0", "y0"))).alias("coordinates"))
    found = spans.detect(rows).join(listed, "doc_id").withColumn("c", C.first_by_text(F.col("text"), F.col("coordinates"))).where("c is not null")
    return found.select("doc_id", "start", "type", "text", "c.nth", "c.page", "c.x0", "c.y0")


QUERIES, ORACLE = Q, O

"""``detect_entities(text)`` as a table function for SQL users; the DataFrame form in ``spans`` is the fast one."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lakeveil.functions.rules import CORE


def register(spark: SparkSession) -> None:
    """``select e.* from documents, lateral detect_entities(text) e``"""
    rules = [(r.type, r.pattern) for r in CORE]

    @udtf(returnType="type string, text string, start int, end int")
    class DetectEntities:
        def __init__(self):
            self.rules = [(t, re.compile(p)) for t, p in rules]

        def eval(self, text: str):
            hits = sorted((m.start(), i, m.end(), t, m.group()) for i, (t, p) in enumerate(self.rules) for m in p.finditer(text or ""))
            last = 0
            for start, _, end, type_, found in hits:
                if start >= last:
                    yield type_, found, start, end
                    last = end

    spark.udtf.register("detect_entities", DetectEntities)

"""Folders of files as tables of documents; PDF, office and image readers are optional."""

from __future__ import annotations

import importlib
import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_TYPES = ["txt", "csv", "json", "xml", "html", "md", "log"]
MOST_CHARS = 100_000
EXCLUDED = ["node_modules", ".git", "__pycache__"]


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.lower(F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit("")))


def scan_folder(spark: SparkSession, folder: str, kinds: list[str] | None = None, excluded: list[str] | None = None, most_mb: float = 50) -> DataFrame:
    """path, name, size, modified, content of the files below a folder that have a wanted extension, no excluded part in their path (whatever its case) and a size within the limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kept = extension(F.col("path")).isin(*(kinds or TEXT_TYPES + ["rtf"])) & (F.col("length") <= int(most_mb * 1024 * 1024))
    for part in EXCLUDED if excluded is None else excluded:
        kept = kept & ~F.contains(F.lower("path"), F.lit(part.lower()))
    return files.where(kept).select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


# Folders of a home that are scanned and watched unless others are named.
SCAN_ROOTS, WATCH_ROOTS = ["Documents", "Downloads", "Desktop", "Pictures"], ["Documents", "Downloads"]


def default_roots(home: str, names: list[str] | None = None) -> list[str]:
    """Those of the usual folders of a home that exist on this machine."""
    return [p for n in (SCAN_ROOTS if names is None else names) if os.path.isdir(p := os.path.join(home, n))]


def file_hash(content: Column, first: int | None = None) -> Column:
    """SHA-256 of the content, or the first 16 digits of that of its first bytes."""
    return F.sha2(content, 256) if first is None else F.left(F.sha2(F.substring(content, 1, first), 256), F.lit(16))


def unseen(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that no earlier scan has with this path and hash."""
    return files.join(seen.select("path", "hash"), ["path", "hash"], "left_anti")


def plain_rtf(text: Column) -> Column:
    """Text of a rich text file: control words and braces go."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\\[a-z]+-?\d*\s?", ""), r"[{}]", ""))


def plain_html(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " ")


def read_text(files: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """Adds text to rows with path and content: the first characters, read as UTF-8; RTF without its controls."""
    text = F.col("content").cast("string")
    kind = extension(F.col("path"))
    return files.withColumn("text", F.substring(F.when(kind == "rtf", plain_rtf(text)).otherwise(text), 1, most_chars))


def handwriting_marks(regions: DataFrame) -> DataFrame:
    """Adds handwritten, signature to OCR regions (page, nth, text, confidence, width, height).

    Handwritten: a confidence below 0.7, or wider than 15 times or less than
    half the height. A very unsure handwritten region is a signature; after a
    word for signing, an unsure region is probably one.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("page").orderBy("nth")
    ratio = F.when(F.col("height") > 0, F.col("width") / F.col("height"))
    handwritten = (F.col("confidence") < 0.7) | F.coalesce((ratio > 15) | (ratio < 0.5), F.lit(False))
    asked = F.coalesce(F.lag(F.lower("text").rlike("signature|sign|signed")).over(w), F.lit(False))
    return regions.withColumn("handwritten", handwritten).withColumn(
        "signature", F.when((F.col("confidence") < 0.3) & F.col("handwritten"), "DETECTED").when(asked & (F.col("confidence") < 0.5), "PROBABLE")
    )


def sure_tokens(tokens: DataFrame, least: float = 30) -> DataFrame:
    return tokens.where(F.col("confidence") > least)


def pdf_text(content: bytes) -> str:
    """Text of the first pages, if a PDF library is installed."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as pages:
        return "\n".join(pages[i].get_text() for i in range(min(PAGES, len(pages)))).strip()


def read_pdf(files: DataFrame) -> DataFrame:
    """path, text of PDF files, if a PDF library is installed on the workers."""
    importlib.import_module("fitz")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "text": [pdf_text(bytes(c)) for c in frame["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def review_report(regions: DataFrame) -> DataFrame:
    """One row: regions, handwritten, unsure (confidence below 0.5), signatures, and those to review (unsure or signed)."""
    marked = handwriting_marks(regions)
    unsure, signed = F.col("confidence") < 0.5, F.col("signature").isNotNull()
    return marked.agg(
        F.count(F.lit(1)).alias("regions"), F.count_if("handwritten").alias("handwritten"), F.count_if(unsure).alias("unsure"), F.count_if(signed).alias("signatures"), F.count_if(unsure | signed).alias("to_review")
    )


# How much of an office file or PDF is read.
PARAGRAPHS, TABLES, SHEETS, SHEET_ROWS, PAGES = 500, 20, 5, 1000, 20


def docx_text(content: bytes) -> str:
    """The first paragraphs, and cells of the first tables row by row."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    lines = [said(p) for p in body.findall(f"{w}p")[:PARAGRAPHS]]
    for t in body.findall(f"{w}tbl")[:TABLES]:
        lines += [" ".join(said(c) for c in row.findall(f"{w}tc")) for row in t.findall(f"{w}tr")]
    return "\n".join(x for x in lines if x)


def xlsx_text(content: bytes) -> str:
    """The first rows of the first sheets, cells with a space between."""
    import io
    import zipfile
    from xml.etree import ElementTree

    x = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{x}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))[:SHEETS]
        lines = []
        for sheet in sheets:
            for row in list(ElementTree.fromstring(z.read(sheet)).iter(f"{x}row"))[:SHEET_ROWS]:
                cells = []
                for c in row.findall(f"{x}c"):
                    value = c.findtext(f"{x}v") or "".join(t.text or "" for t in c.iter(f"{x}t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                lines.append(" ".join(v for v in cells if v))
    return "\n".join(v for v in lines if v)


def read_office(files: DataFrame) -> DataFrame:
    """path, text of docx and xlsx files; null where a file can't be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    texts.append((docx_text if path.lower().endswith(".docx") else xlsx_text)(bytes(content)))
                except Exception:  # a damaged file is a row without text, as others of the folder go on
                    texts.append(None)
            yield pd.DataFrame({"path": frame["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def read_any(files: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """path, text by extension: office files, PDFs where a library is installed, others as text; what can't be read, as text too."""
    kind = extension(F.col("path"))
    office = read_office(files.where(kind.isin("docx", "xlsx")))
    pdf = importlib.util.find_spec("fitz") is not None
    parsed = office.unionByName(read_pdf(files.where(kind == "pdf"))) if pdf else office
    plain = read_text(files.where(~kind.isin("docx", "xlsx", *(["pdf"] if pdf else []))), most_chars).select("path", "text")
    raw = read_text(files.join(parsed.where("text is null").select("path"), "path", "left_semi"), most_chars).select("path", "text")
    return plain.unionByName(parsed.where("text is not null").withColumn("text", F.substring("text", 1, most_chars))).unionByName(raw)


def boxes(regions: DataFrame) -> DataFrame:
    """Adds x0, y0, x1, y1, width and height to OCR regions from the corners (array of x and y) of their outlines."""
    xs, ys = F.transform("corners", lambda p: p["x"]), F.transform("corners", lambda p: p["y"])
    rows = regions.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)})
    return rows.withColumns({"width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0")})


def review_items(regions: DataFrame) -> DataFrame:
    """page, nth, type, action_required: unsure regions, and signatures, each an item of its own."""
    marked = handwriting_marks(regions)
    item = lambda rows, kind, action: rows.select("page", "nth", F.lit(kind).alias("type"), F.lit(action).alias("action_required"))
    return item(marked.where("confidence < 0.5"), "LOW_CONFIDENCE", "Verify text content is correctly extracted").unionByName(
        item(marked.where("signature is not null"), "SIGNATURE", "Verify signature detection and redaction")
    )

"""Office files, dispatch by extension, OCR boxes and review, quarantine, and the watcher's wait."""

import io
import time
import zipfile

from pyspark.sql import functions as F

from lakeveil.operators import crypto
from lakeveil.sources import files
from lakeveil.streaming import watch

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
X = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


DOCX = zipped(word__document=f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>One </w:t><w:t>line</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
XLSX = zipped(
    xl__sharedStrings=f'<sst xmlns="{X}"><si><t>name</t></si><si><t>Asha</t></si></sst>',
    xl__worksheets__sheet1=f'<worksheet xmlns="{X}"><sheetData><row><c t="s"><v>0</v></c><c><v>42</v></c></row><row><c t="s"><v>1</v></c><c t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
)


def test_read_any_by_extension(spark, tmp_path):
    for name, content in {"a.docx": DOCX, "b.XLSX": XLSX, "c.txt": b"plain", "d.rtf": rb"{\\rtf1 hi}", "e.docx": b"damaged"}.items():
        (tmp_path / name).write_bytes(content)
    found = files.scan_folder(spark, f"file://{tmp_path}", ["docx", "xlsx", "txt", "rtf"])
    out = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_any(found).collect()}
    assert out["a.docx"] == "One line\na b" and out["b.XLSX"] == "name 42\nAsha x" and out["c.txt"] == "plain" and out["e.docx"] == "damaged" and "hi" in out["d.rtf"]


def test_default_roots(tmp_path):
    (tmp_path / "Documents").mkdir()
    assert files.default_roots(str(tmp_path)) == [str(tmp_path / "Documents")]


def test_boxes_and_review(spark):
    rows = spark.sql("select 1 as page, nth, text, confidence, array(named_struct('x', 1.0, 'y', 2.0), named_struct('x', 31.0, 'y', 3.0)) as corners from values (1, 'signature', 0.9), (2, 'scrawl', 0.2), (3, 'plain', 0.95) as t(nth, text, confidence)")
    boxed = files.boxes(rows)
    assert {(r.x0, r.y0, r.x1, r.y1, r.width, r.height) for r in boxed.collect()} == {(1.0, 2.0, 31.0, 3.0, 30.0, 1.0)}
    assert {(r.nth, r.type) for r in files.review_items(boxed).collect()} == {(2, "LOW_CONFIDENCE"), (2, "SIGNATURE")}


def test_passwords_and_quarantine(spark):
    one, salt = crypto.password_hash("secret")
    assert crypto.password_hash("secret", salt)[0] == one != crypto.password_hash("other", salt)[0]
    rows = spark.createDataFrame([("/x/a.txt", "a.txt", bytearray(b"text"))], "path string, name string, content binary")
    row = crypto.quarantine(rows, "/q", "pw", "PII detected", F.lit("2024-01-01").cast("timestamp"), salt=b"0" * 16, iterations=10).select("*", crypto.decrypt(F.col("sealed"), "pw", b"0" * 16, 10).cast("string").alias("again")).first()
    assert row.quarantine_path == "/q/quarantine_a.txt.enc" and row.again == "text" and '"reason":"PII detected"' in row.meta


def test_a_path_waits_until_it_is_old_enough(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("first")
    rows = watch.watch_text(spark, f"file://{tmp_path}/in")
    began = time.time()
    query = watch.debounced(rows, 1.5).writeStream.format("memory").queryName("settled").outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        while time.time() - began < 60 and spark.table("settled").isEmpty():
            time.sleep(0.2)
        assert time.time() - began >= 1.5
        assert [r.text for r in spark.table("settled").collect()] == ["first"]
    finally:
        query.stop()

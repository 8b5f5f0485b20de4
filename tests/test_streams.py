from pyspark.sql import functions as F

from lakeveil.sources import files
from lakeveil.streaming import watch


def test_folder_is_watched_once_and_resumed(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("a@b.example")
    stream = lambda: watch.detect_stream(watch.watch_text(spark, str(tmp_path / "in"), "*.txt").select(F.col("path"), "text"), "path")
    watch.drained(stream(), str(tmp_path / "out"), str(tmp_path / "log"))
    (tmp_path / "in/sub/b.txt").write_text("call 9876543210")
    (tmp_path / "in/c.txt").write_text("nothing")
    watch.drained(stream(), str(tmp_path / "out"), str(tmp_path / "log"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.score) for r in rows) == [("a.txt", 15), ("b.txt", 30)]


def test_recent_contents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two")):
        (tmp_path / "in" / name).write_text(text)
    stream = watch.drop_recent_contents(watch.watch_text(spark, str(tmp_path / "in"), "*.txt"))
    query = stream.writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.text for r in spark.table("fresh").collect()) == ["one", "two"]


def test_recent_buffer(spark, tmp_path):
    write = watch.keep_recent(str(tmp_path / "recent"), size=2)
    write(spark.createDataFrame([(1, 10), (2, 30), (3, 20)], "doc_id int, score int"), 0)
    write(spark.createDataFrame([(4, 5)], "doc_id int, score int"), 1)
    assert [r.doc_id for r in watch.recent(spark, str(tmp_path / "recent"), 2).collect()] == [4, 2]


def test_folder_scan(spark, tmp_path):
    (tmp_path / "x/node_modules").mkdir(parents=True)
    (tmp_path / "x/node_modules/skip.txt").write_text("no")
    (tmp_path / "x/keep.TXT").write_text("yes")
    (tmp_path / "x/doc.rtf").write_text(r"{\rtf1 hello}")
    (tmp_path / "x/pic.bin").write_text("no")
    found = files.read_text(files.scan_folder(spark, str(tmp_path / "x"))).collect()
    assert {r.name: r.text for r in found} == {"keep.TXT": "yes", "doc.rtf": "hello"}


def test_handwriting(spark):
    rows = [("p", 0, "Sign here", 0.9, 100, 20), ("p", 1, "x", 0.4, 50, 20), ("p", 2, "~", 0.1, 50, 20)]
    out = files.handwriting_marks(spark.createDataFrame(rows, "page string, nth int, text string, confidence double, width int, height int")).orderBy("nth").collect()
    assert [(r.handwritten, r.signature) for r in out] == [(False, None), (True, "PROBABLE"), (True, "DETECTED")]

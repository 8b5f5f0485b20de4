"""The documents source, scans that stop and go on, and notifications that are sent once."""

import time
from collections import Counter

from pyspark.sql import functions as F

from lakeveil.operators.scans import Scan, counted
from lakeveil.sources import documents, files
from lakeveil.streaming.notify import Outbox
from tests.test_files import DOCX, XLSX


def folder(tmp_path, n=6):
    (tmp_path / "sub" / "node_modules").mkdir(parents=True)
    for i in range(n):
        (tmp_path / "sub" / f"t{i}.txt").write_text("é" * i)
    (tmp_path / "a.docx").write_bytes(DOCX)
    (tmp_path / "b.XLSX").write_bytes(XLSX)
    (tmp_path / "c.rtf").write_bytes(rb"{\rtf1 hi}")
    (tmp_path / "e.docx").write_bytes(b"damaged")
    (tmp_path / "raw.bin").write_bytes(b"x")
    (tmp_path / "sub" / "node_modules" / "x.txt").write_text("no")
    return f"file://{tmp_path}"


def test_documents_are_read_by_kind(spark, tmp_path):
    documents.register(spark)
    root = folder(tmp_path)
    rows = {r.name: r for r in spark.read.format("documents").option("path", root).option("partition_files", 2).load().collect()}
    assert set(rows) == {*(f"t{i}.txt" for i in range(6)), "a.docx", "b.XLSX", "c.rtf", "e.docx"}
    assert (rows["a.docx"].text, rows["b.XLSX"].text, rows["c.rtf"].text, rows["e.docx"].text, rows["t3.txt"].text) == ("One line\na b", "name 42\nAsha x", "hi", "damaged", "ééé")
    assert rows["t3.txt"].size == 6 and rows["a.docx"].path == f"{root}/a.docx" and bytes(rows["e.docx"].content) == b"damaged"
    assert spark.read.format("documents").option("path", root).option("partition_files", 2).load().rdd.getNumPartitions() == 5
    assert spark.read.format("documents").option("path", root + "/nowhere").load().count() == 0
    # the same as by Spark's own reader of files
    plain = files.read_any(files.scan_folder(spark, root, ["txt", "docx", "xlsx", "rtf"])).collect()
    assert {(r.path.rsplit("/", 1)[1], r.text) for r in plain} == {(n, r.text) for n, r in rows.items() if r.size}  # which leaves out empty ones


def test_filters_go_to_the_listing(spark, tmp_path):
    documents.register(spark)
    root = folder(tmp_path)
    df = spark.read.format("documents").option("path", root).load().where((F.col("extension") == "txt") & (F.col("size") <= 4) & (F.length("text") > 0)).select("name", "text")
    assert sorted(r.name for r in df.collect()) == ["t1.txt", "t2.txt"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "= txt" not in plan and "<= 4" not in plan and "length(text" in plan  # what was pushed is not asked again
    reader = documents.Reader({"path": root, "extensions": "txt"}, spark.createDataFrame([], documents.SCHEMA).schema)
    assert list(reader.pushFilters([documents.LessThan(("size",), 4), documents.EqualTo(("text",), "x")])) == [documents.EqualTo(("text",), "x")]
    assert [r["name"] for p in reader.partitions() for r in p.rows] == ["t0.txt", "t1.txt"]
    # names and sizes alone open no file
    (tmp_path / "sub" / "t5.txt").chmod(0)
    assert spark.read.format("documents").option("path", root).load().where("extension = 'txt'").agg(F.sum("size")).first()[0] == 2 * sum(range(6))


def test_new_and_changed_files_are_streamed(spark, tmp_path):
    documents.register(spark)
    (tmp_path / "in").mkdir()
    root = f"file://{tmp_path}/in"

    def run():
        stream = spark.readStream.format("documents").option("path", root).option("partition_files", 2).load().select("name", "text")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()
        return Counter((r.name, r.text) for r in spark.read.schema("name string, text string").parquet(str(tmp_path / "out")).collect())

    for i in range(5):
        (tmp_path / "in" / f"f{i}.txt").write_text(f"one {i}")
    assert run() == {(f"f{i}.txt", f"one {i}"): 1 for i in range(5)}
    time.sleep(0.01)
    (tmp_path / "in" / "f1.txt").write_text("two")
    (tmp_path / "in" / "g.md").write_text("new")
    assert run() == {**{(f"f{i}.txt", f"one {i}"): 1 for i in range(5)}, ("f1.txt", "two"): 1, ("g.md", "new"): 1}


def scored(rows):
    return rows.select("path", "hash", F.col("n").alias("entities_count"), F.when(F.col("n") > 2, "HIGH").when(F.col("n") > 1, "MEDIUM").otherwise("LOW").alias("risk_level"))


def slowly(rows):
    def wait(frames):
        for f in frames:
            time.sleep(0.4)
            yield f

    return scored(rows).repartition(6).mapInPandas(wait, "path string, hash string, entities_count bigint, risk_level string")


def test_a_cancelled_scan_ends_as_an_uninterrupted_one(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('/f', id) path", "md5(string(id)) hash", "id % 4 n")
    whole = Scan(rows, scored, f"file://{tmp_path}/whole", 4)
    assert whole.start() == {"status": "started"} and whole.start() == {"status": "already_scanning"}
    assert whole.join().status == "completed"
    p = whole.progress()
    assert (p["total_files"], p["files_scanned"], p["files_with_pii"], p["high_risk_files"], p["medium_risk_files"], p["low_risk_files"], p["progress_percent"]) == (40, 40, 30, 10, 10, 10, 100.0)
    scan = Scan(rows, slowly, f"file://{tmp_path}/parts", 4, F.expr("int(substr(path, 3)) % 4"))
    scan.start()
    while scan.state.files_scanned < 10:
        time.sleep(0.05)
    assert scan.pause()["status"] == "paused" and scan.cancel()["status"] == "cancelled" and scan.cancel() == {"status": "not_scanning"}
    assert scan.join().status == "cancelled" and scan.state.files_scanned < 40
    assert scan.scanned().count() == scan.state.files_scanned  # a job that was cut short left nothing
    again = Scan(rows, scored, f"file://{tmp_path}/parts", 4)
    again.start()
    assert again.join().status == "completed" and again.progress() | {"elapsed_seconds": 0} == p | {"elapsed_seconds": 0}
    assert sorted(again.scanned().collect()) == sorted(whole.scanned().collect())
    # a file that has changed is scanned again, others are not
    new = rows.withColumn("hash", F.when(F.col("path") == "/f7", "changed").otherwise(F.col("hash")))
    third = Scan(new, scored, f"file://{tmp_path}/parts", 4)
    third.start()
    third.join()
    assert third.scanned().count() == 41 and third.state.files_scanned == 40


def test_a_scan_that_fails_says_so(spark, tmp_path):
    scan = Scan(spark.range(3).selectExpr("string(id) path", "'h' hash", "1 n"), lambda r: scored(r).withColumn("x", F.raise_error(F.lit("bad"))), f"file://{tmp_path}/x", 1)
    import threading

    hook, threading.excepthook = threading.excepthook, lambda _: None
    try:
        scan.start()
        assert scan.join().status == "error" and scan.progress()["errors_count"] == 1 and scan.scanned() is None
    finally:
        threading.excepthook = hook
    none = Scan(spark.range(0).selectExpr("string(id) path", "'h' hash", "1 n"), scored, f"file://{tmp_path}/y", 2)
    none.start()
    assert none.join().status == "completed" and none.state.progress_percent == 0.0
    assert [c for c in spark.range(0).selectExpr("0 entities_count", "'' risk_level").agg(*counted()).first()] == [0] * 5


def test_replayed_batches_send_nothing_twice(spark, tmp_path):
    log = tmp_path / "received"
    log.mkdir()

    def send(key, row):
        """Takes a key that ends in 5 at the second try, and none that ends in 9."""
        import uuid

        seen = log / f"try-{key}-{uuid.uuid4().hex}"
        seen.write_text("")
        if key.endswith("9") or (key.endswith("5") and len(list(log.glob(f"try-{key}-*"))) < 2):
            raise ConnectionError
        (log / f"got-{key}-{uuid.uuid4().hex}").write_text(row["message"])
        return True

    got = lambda: Counter(p.name.split("-")[1] for p in log.glob("got-*"))
    rows = lambda a, b: spark.range(a, b).selectExpr("string(id) id", "concat('m', id) message")
    box = Outbox(f"file://{tmp_path}/box", send)
    box(rows(0, 10).unionByName(rows(0, 3)).unionByName(spark.sql("select string(null) id, 'm' message")), 0)
    assert got() == {str(i): 1 for i in range(9)} and [r.key for r in box.dead(spark).collect()] == ["9"]
    box(rows(0, 10), 0)  # the same batch again
    Outbox(f"file://{tmp_path}/box", send)(rows(5, 15), 1)  # some keys come again in another, after a restart
    assert got() == {str(i): 1 for i in (*range(9), *range(10, 15))}
    assert len(list(log.glob("try-9-*"))) == 6  # three tries in each batch that has it
    # a batch that broke off after its first try goes on with its second
    calls = []

    class Breaks(Outbox):
        def _once(self, df, path):
            if path.endswith("nth=1") and not calls:
                calls.append(1)
                raise RuntimeError("driver lost")
            return super()._once(df, path)

    broken = Breaks(f"file://{tmp_path}/box", send)
    try:
        broken(rows(20, 30), 2)
    except RuntimeError:
        assert "25" not in got() and got()["24"] == 1
    broken(rows(20, 30), 2)
    assert all(got()[str(i)] == 1 for i in range(20, 29)) and {r.key for r in box.sent(spark).where("batch = 2").collect()} == {str(i) for i in range(20, 29)}


def test_notifications_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(f'{{"id": "{i}", "message": "m"}}')
    box = Outbox(f"file://{tmp_path}/box", lambda key, row: True)

    def run():
        stream = spark.readStream.schema("id string, message string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(box).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()

    run()
    run()
    assert Counter(r.key for r in box.sent(spark).collect()) == {"0": 1, "1": 1, "2": 1}

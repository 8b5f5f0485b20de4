"""Scans of real files, scans that are stopped and taken up again, and notifications of what they find."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeveil.operators.scans import Scan
from lakeveil.sources import documents
from lakeveil.sources.files import file_hash
from lakeveil.sources.tables import kept, scratch
from lakeveil.streaming.notify import Outbox

from . import sql as S
from .detection import docs
from .extras import ORACLE as EXTRA_SQL
from .extras import QUERIES as EXTRA
from .relational import files_of

Q, O = {}, {}
KINDS = ["txt", "md", "log", "csv", "bin"]


def q(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn

    return add


@q("directory_scan", f"""with f as (select '/' || coalesce(source, '') || '/doc' || doc_id || '.' || [{', '.join(map(S.quoted, KINDS))}][doc_id % {len(KINDS)} + 1] as path, doc_id, coalesce(text, '') t from documents)
select path, string_split(path, '/')[-1] as name, string_split(path, '.')[-1] as extension, strlen(t)::bigint as size, left(sha256(t), 16) as hash, least(length(t), 100000)::int n_chars
 from f where not contains(lower(path), '/src3/') and strlen(t) <= 20000 and not path like '%.bin'""")
def _(s, d):
    """Every document written to a file of its own, and the folder scanned: some kinds, not one of the folders, up to a size."""
    root = scratch(s)
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int")))
    kept(documents.write_files(docs(s, d).select(path.alias("name"), "text"), root))
    documents.register(s)
    found = s.read.format("documents").option("path", root).option("extensions", ",".join(KINDS[:-1])).option("excluded", "/src3/").load()
    found = found.where(F.col("size") <= 20000)
    below = F.substring("path", F.lit(len(root) + 1), F.length("path"))
    return found.select(below.alias("path"), "name", "extension", "size", file_hash(F.col("content"), 1 << 20).alias("hash"), F.length("text").alias("n_chars"))


def _scan(s, d, stop_after: int) -> Scan:
    """A scan of all documents in four slices, which cancels itself."""
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = docs(s, d).withColumns({"path": path, "hash": file_hash(F.coalesce("text", F.lit("")).cast("binary"), 1 << 20)})
    done = []

    def progress(scan: Scan) -> None:
        done.append(scan.state.files_scanned)
        if len(done) == stop_after:
            scan.cancel()

    scan = Scan(rows, lambda part: files_of(part, "path", "hash"), scratch(s), 4, F.col("doc_id") % 4, progress)
    scan.start()
    scan.join()
    return scan


@q("scan_progress", f"""with {S.FILES}, p as (select * from files where doc_id % 4 <> 3) select (select count(*) from files) total_files, count(*) files_scanned, count(*) filter (entities_count > 0) files_with_pii,
 count(*) filter (entities_count > 0 and risk_level in ('HIGH', 'CRITICAL')) high_risk_files, round_even(count(*) * 100 / (select count(*) from files), 1)::double progress_percent, 'cancelled' as status from p""")
def _(s, d):
    """What the counters of a scan say that was cancelled after three of its four slices."""
    names = ["total_files", "files_scanned", "files_with_pii", "high_risk_files", "progress_percent", "status"]
    now = _scan(s, d, 3).progress()
    return s.createDataFrame([tuple(now[n] for n in names)], "total_files bigint, files_scanned bigint, files_with_pii bigint, high_risk_files bigint, progress_percent double, status string")


@q("scan_resumed", f"with {S.FILES} select doc_id, file_path, entities_count, risk_level from files")
def _(s, d):
    """The inventory of a scan that was cancelled and then taken up again."""
    scan = _scan(s, d, 2)
    scan.start()
    scan.join()
    return scan.scanned().select("doc_id", "file_path", "entities_count", "risk_level")


def _send(key: str, row: dict) -> bool:
    if row["doc_id"] % 11 == 0:
        raise OSError("the receiver is away")
    return row["doc_id"] % 7 != 0


@q("notifications_sent", f"with n as ({EXTRA_SQL['notifications']}) select priority, count(*) n, count(*) filter (doc_id % 7 <> 0 and doc_id % 11 <> 0) n_sent, count(*) filter (doc_id % 7 = 0 or doc_id % 11 = 0) n_dead from n group by 1")
def _(s, d):
    """Notifications of all files in three batches, of which two come again, one of them under a new number."""
    rows = kept(EXTRA["notifications"](s, d).withColumn("id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"))))
    box = Outbox(scratch(s), _send)
    for number, part in ((0, 0), (1, 1), (1, 1), (2, 2), (3, 0)):
        box(rows.where(F.col("doc_id") % 3 == part), number)
    sent = box.sent(s).groupBy(F.col("key").alias("id")).agg(F.count(F.lit(1)).alias("times"))
    dead = box.dead(s).select(F.col("key").alias("id")).distinct().withColumn("is_dead", F.lit(1))
    told = rows.join(sent, "id", "left").join(dead, "id", "left")
    return told.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("times"), F.lit(0)).alias("n_sent"), F.count("is_dead").alias("n_dead"))


QUERIES, ORACLE = Q, O

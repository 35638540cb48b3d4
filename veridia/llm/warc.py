"""WARC archives: writing with deduplicated payloads, and verified reading.

Writing is DataFrame work: records are text, so Spark's text writer makes the
archives (its last line end closes each record), commits them and repeats lost
tasks. Records are written by classes of size, with fewer to a file the larger
they are, so a file holds at most FILE_BYTES or one record. White space and
control characters inside a url, which no header can hold, are left out.

Reading splits every archive into ranges. A task finds all places in its range
that look like a record start and emits candidate offset, successor offset and
the first offset outside the range that the chain from there leads to. Pointer
jumping over those exits from each file's start marks the range entries that
are reachable, and only the chain from a range's entry is kept; a record start
inside a payload is never reached. A chain that stops before its file's end
fails the read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, frugal, mark, new_path, release, store

#: payloads below this are never replaced by a revisit
LEAST_REVISIT = 100
#: bytes of an archive file that holds more than one record
FILE_BYTES = 64 << 20
#: largest records of each class
CLASSES = (64 << 10, 1 << 20, None)
#: bytes of an archive that one row of the reader covers
RANGE = 4 << 20
#: ranges overlap by as much at first; those with a header that is not closed within it are read again with more
HEADER = 64 << 10
#: repeated payloads, or archive ranges, up to this number are broadcast; beyond it they are joined by a shuffle
BROADCAST_ROWS = 200_000
STAMP = "2024-01-01T00:00:00Z"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, bytes and refers_to of every page.

    Of equal payloads of at least LEAST_REVISIT bytes those with the smallest
    page_id are responses (repeated rows of that id all are); the others refer
    to it. A null html is an empty payload; a null page_id sorts last.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    first = rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = store(first.where("n > 1").drop("n"), "warc-first")
    rows = rows.join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, "digest", "left")
    return rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def record_text(revisit, page_id, url, digest, refers_to, html, size) -> F.Column:
    """A whole record but for its last line feed, which the text writer adds."""
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">\r\nWARC-Date: " + STAMP),
        F.lit("\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha256:"), digest,
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(size).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, F.when(revisit, "").otherwise(html), F.lit("\r\n\r"))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to archives below ``path``, a folder for each class of size."""
    rows = plan_records(pages)
    revisit = F.col("refers_to").isNotNull()
    text = record_text(revisit, *(F.col(c) for c in ("page_id", "url", "digest", "refers_to", "html", "bytes")))
    # a bound on a record's bytes: its fixed parts have less than 1 KiB
    size = F.lit(1024) + F.coalesce(F.octet_length("url"), F.lit(0)) + F.when(revisit, 0).otherwise(F.col("bytes"))
    plain = pages.select((F.coalesce(F.octet_length("url"), F.lit(0)) + F.coalesce(F.octet_length("html"), F.lit(0)) + 1024).alias("size"))
    most, below = plain.agg(F.max("size").cast("long")).first()[0] or 0, 0
    for i, limit in enumerate(CLASSES):
        if i and most <= below:
            break
        part = rows if most <= (limit or most) and not i else rows.where((size > below) & (size <= limit) if limit else size > below)
        per_file = max(1, file_bytes // limit) if limit else 1
        part.select(text.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(f"{path}/{i}")
        below = limit


def archives(spark: SparkSession, path: str) -> DataFrame:
    """file, length and content of all archives below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length", "content")


def header_of(data: bytes, at: int):
    """(payload offset, payload length, fields) of the record at ``at``, or None."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    found = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower()] = value.strip()
    size = found.get(b"content-length", b"")
    if not size.isdigit() or len(size) > 18:
        return None
    return end + 4, int(size), found


def range_exits(offsets: np.ndarray, nexts: np.ndarray, end: int) -> np.ndarray:
    """First offset at or beyond ``end`` on the chain from each candidate, or -1, by pointer jumping."""
    where = np.searchsorted(offsets, nexts)
    known = (where < len(offsets)) & (offsets[np.minimum(where, len(offsets) - 1)] == nexts)
    jump = np.where(known, where, len(offsets))  # the last place stands for "left the known candidates"
    final = np.concatenate((np.where(nexts >= end, nexts, -1), [-1]))
    jump = np.concatenate((jump, [len(offsets)]))
    exits = np.where(np.concatenate((known, [False])), -2, final)
    while (exits[:-1] == -2).any():
        exits = np.where(exits == -2, exits[jump], exits)
        jump = jump[jump]
    return exits[:-1]


def file_ranges(spark: SparkSession, path: str, span: int, overlap: int = HEADER) -> DataFrame:
    """file, length, start and bytes (with ``overlap`` behind) of every range of every archive."""
    files = archives(spark, path)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("length") - 1), F.lit(span).cast("long")))
    cut = F.substring("content", (F.col("start") + 1).cast("int"), F.lit(min(span + overlap, (1 << 31) - 1)))
    return files.where("length > 0").select("file", "length", "content", starts.alias("start")).select("file", "length", "start", cut.alias("part"))


def candidates(ranges: DataFrame, span: int) -> DataFrame:
    """file, start, offset, next and exit of every place that looks like a record's start.

    A range with a header that is not closed within its bytes gives one row of
    offset -1 instead of its candidates.
    """

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                file, length, start, data = (batch.column(i)[k].as_py() for i in range(4))
                offs, nexts, last = [], [], data.rfind(b"\r\n\r\n")
                for m in MAGIC.finditer(data):
                    if m.start() >= span:
                        break
                    if last < m.start():
                        if start + len(data) < length:
                            offs, nexts = [-1], [-2]  # a next of its own would be a loop
                        break
                    head = header_of(data, m.start())
                    if head and start + head[0] + head[1] + 4 <= length:
                        offs.append(start + m.start())
                        nexts.append(start + head[0] + head[1] + 4)
                offs, nexts = np.array(offs, np.int64), np.array(nexts, np.int64)
                exits = range_exits(offs, nexts, min(start + span, length))
                n = len(offs)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(offs), pa.array(nexts), pa.array(exits)], names=["file", "start", "offset", "next", "exit"])

    return ranges.mapInArrow(frugal(run), "file string, start long, offset long, next long, exit long")


def all_candidates(spark: SparkSession, path: str, span: int) -> DataFrame:
    """The candidates of all ranges, those with long headers read with as much overlap as they take."""
    overlap, whole = HEADER, None
    ranges = file_ranges(spark, path, span)
    while True:
        found = store(candidates(ranges, span), "warc-found")
        good = found.where("offset >= 0")
        whole = good if whole is None else whole.union(good)
        longer = found.where("offset < 0").select("file", "start").distinct()
        n = longer.count()
        if not n:
            return whole
        overlap *= 16
        ranges = file_ranges(spark, path, span, overlap).join(F.broadcast(longer) if n <= BROADCAST_ROWS else longer, ["file", "start"], "left_semi").select("file", "length", "start", "part")


def entries(found: DataFrame) -> DataFrame:
    """file and offset of the reachable range entries: each file's start and all exits that follow from it."""
    jump = found.where("exit >= 0").select("file", F.col("offset").alias("at"), F.col("exit").alias("to"))
    reached = found.select("file").distinct().select("file", F.lit(0).cast("long").alias("offset"))
    size = reached.count()
    while True:
        more = reached.join(jump, (reached["file"] == jump["file"]) & (reached["offset"] == jump["at"])).select(reached["file"], F.col("to").alias("offset"))
        new = store(reached.union(more).distinct(), "warc-entries")
        count = new.count()
        if count == size:
            return new
        reached, size = new, count
        a, b = jump.alias("a"), jump.alias("b")
        on = (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.at"))
        jump = store(a.join(b, on).select("a.file", "a.at", "b.to"), "warc-jumps")


def read_archives(spark: SparkSession, path: str, span: int = RANGE) -> DataFrame:
    """The reachable records of all archives below ``path``.

    Columns: file, offset, type, page_id, url, digest (as the header says),
    refers_to, payload (null where it reaches beyond the range; see
    ``payload_sha`` and ``payload_bytes``, which are computed from the bytes).
    """
    found = all_candidates(spark, path, span)
    start = (F.col("offset") - F.col("offset") % span).alias("start")
    reached = entries(found)
    files = archives(spark, path).select("file", "length").where("length > 0")
    broken = files.join(reached, (files["file"] == reached["file"]) & (files["length"] == reached["offset"]), "left_anti").first()
    if broken:
        raise ValueError(f"the records of {broken['file']} stop before its end")
    entry = reached.select("file", start, "offset").groupBy("file", "start").agg(F.min("offset").alias("entry"))
    files = archives(spark, path)
    cut = F.substring("content", (F.col("entry") + 1).cast("int"), F.col("take").cast("int"))
    last = found.groupBy("file", "start").agg(F.max("next").alias("last"))
    todo = entry.join(last, ["file", "start"]).withColumn("take", F.greatest(F.col("last"), F.col("start") + span) - F.col("entry"))
    todo = store(todo, "warc-todo")
    todo = files.join(F.broadcast(todo) if todo.count() <= BROADCAST_ROWS else todo, "file").select("file", "start", "entry", cut.alias("part"))

    def run(batches):
        import hashlib

        for batch in batches:
            for k in range(batch.num_rows):
                file, start, entry, data = (batch.column(i)[k].as_py() for i in range(4))
                at, rows = 0, []
                while at < len(data) and entry + at < start + span:
                    head = MAGIC.match(data, at) and header_of(data, at)
                    if not head or head[0] + head[1] > len(data):
                        raise ValueError(f"{file} has no whole record at {entry + at}")
                    body = data[head[0] : head[0] + head[1]]
                    f = {n.decode(): v.decode("utf-8", "replace") for n, v in head[2].items()}
                    rows.append((file, entry + at, f.get("warc-type"), urn(f.get("warc-record-id")), f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha256:"), urn(f.get("warc-refers-to")), hashlib.sha256(body).hexdigest(), len(body), body))
                    at = head[0] + head[1] + 4
                    if len(rows) == 512:
                        yield record_batch(rows)
                        rows = []
                yield record_batch(rows)

    return todo.mapInArrow(frugal(run), "file string, offset long, type string, page_id long, url string, digest string, refers_to long, payload_sha string, payload_bytes long, payload binary")


def urn(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(m[1]) if m else None


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = ("file", "offset", "type", "page_id", "url", "digest", "refers_to", "payload_sha", "payload_bytes", "payload")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages``, read them back, and describe every record read.

    A revisit's size is looked up at the response it refers to; its digest
    comes from its header. A response whose bytes do not match its header's
    digest, or another number of records than pages, fails the query.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    before = mark()
    got = store(read_archives(spark, path).drop("payload", "file", "offset", "url"), "warc-read")
    release(spark, before, got)
    drop_path(spark, path)
    read, wanted = got.count(), pages.count()
    if read != wanted:
        raise ValueError(f"{read} records read of {wanted} pages")
    size = got.where("type = 'response'").groupBy(F.col("payload_sha").alias("digest")).agg(F.max("payload_bytes").alias("full"))
    rows = got.join(size, "digest", "left")
    good = (F.col("type") == "revisit") | (F.col("digest") == F.col("payload_sha"))
    return rows.select(
        "page_id",
        F.col("full").alias("payload_bytes"),
        F.when(good, F.col("digest")).otherwise(F.raise_error(F.lit("payload does not match its digest"))).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )

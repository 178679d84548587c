"""WARC archives: records written by tasks, an index of them, and coalesced range reads.

Each task writes archives of about ``archive_bytes`` to the shared folder, every
record a gzip member of its own, and returns an index row for each record:
archive, offset, length, URL and digest.  An archive's name is new for each
attempt and only the index says which archives count, so a task that runs twice
or dies leaves nothing but an unused file.  Reading selects index rows, sorts
them by archive and offset, joins ranges that lie within ``gap`` bytes of each
other, and reads each joined range once.

Nulls and edge cases: a null payload is empty; a null URL is written as an empty
one, and line breaks in one as %0D and %0A; a null id is carried in the index and never serves as a revisit's target;
of rows that repeat an id with an equal payload one is the response and the
others revisit that id; very long payloads are held one at a time; an empty table gives
an empty index; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch
from .text import BitTable, quoted, slices

#: Payloads from this size on are written once; the others of equal content revisit it.
REVISIT_BYTES = 1000
#: Copies of one payload beyond which they are dealt over parts.
HOT_ROWS = 20_000
ARCHIVE_BYTES, GAP_BYTES, READ_BYTES, TASK_BYTES = 64 << 20, 32 << 10, 8 << 20, 64 << 20
_DATE = "2020-01-01T00:00:00Z"
_INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def _record(url: str, page: int | None, kind: str, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {kind} {digest}')}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-ID": "" if page is None else page,
        "X-Payload-Length": size,
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": len(payload),
    }
    if refers_to is not None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["X-Refers-To-Page-ID"] = refers_to
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + payload + b"\r\n\r\n", 4, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record, which is a gzip member."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        out = name = None
        at = 0
        try:
            for batch in batches:
                for part in slices(batch, "html"):
                    rows = []
                    for r in part.to_pylist():
                        if out is None or at >= archive_bytes:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = store.open_output_stream(f"{root}/{name}", compression=None)
                        payload = (r["html"] or "").encode()
                        record = _record(r["url"] or "", r["page_id"], r["record_type"], r["payload_digest"], r["bytes"], r["refers_to"], payload)
                        out.write(record)
                        rows.append((r["page_id"], r["url"], r["payload_digest"], r["record_type"], r["refers_to"], name, at, len(record)))
                        at += len(record)
                    cols = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["page_id", "url", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pages with digest, size, record type and the page that a revisit refers to.

    Roles are decided on digests and ids.  A bit table of the digests that occur
    more than once tells which pages may have a copy: the others are
    responses as they stand and are not shuffled.  Of those, pages of a digest
    with more than ``hot_rows`` copies, and more than one in ten thousand of all, so
    fewer than ten thousand digests, are dealt over parts.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc-copies")
    own = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), F.col(quoted(url_col)).alias("url"), F.coalesce(F.col(quoted(html_col)), F.lit("")).alias("html"))
    own = own.withColumns({"payload_digest": F.sha1(F.encode("html", "UTF-8")), "bytes": F.octet_length("html").cast("long")})
    long = (F.col("bytes") >= revisit_bytes) & F.col("page_id").isNotNull()
    sizes = own.filter(long).groupBy("payload_digest").agg(F.max("page_id").alias("chosen"), F.count(F.lit(1)).alias("copies"), F.countDistinct("page_id").alias("pages"))
    shared = scratch.save(sizes.filter("copies > 1"), "shared")
    table = spark.sparkContext.broadcast(BitTable(shared.select(F.xxhash64("payload_digest").alias("key")), "key", shared.count()))
    may = F.arrow_udf(lambda keys: pa.array(table.value.holds(np.asarray(keys).view(np.uint64))), "boolean")
    own = own.withColumn("may", may(F.xxhash64("payload_digest")))
    columns = ("page_id", "url", "payload_digest", "bytes", "record_type", "refers_to", "html")
    alone = own.filter("NOT may").withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})

    rows = shared.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = shared.filter(F.col("copies") > max(hot_rows, rows // 10_000)).select("payload_digest", F.ceil(F.col("copies") / hot_rows).cast("int").alias("parts"))
    hot = F.broadcast(scratch.save(hot, "hot"))
    parts = F.coalesce("parts", F.lit(1))
    marked = own.filter("may").join(hot, "payload_digest", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), parts).cast("int")).drop("parts")
    known = shared.join(hot, "payload_digest", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("payload_digest", "part", "chosen", (F.col("copies") > F.col("pages")).alias("again"))
    marked = marked.join(known, ["payload_digest", "part"], "left")
    # Rows that repeat an id: only one of those with the chosen one can be the response. There are none while ids are unique.
    first = F.row_number().over(Window.partitionBy("payload_digest", "page_id").orderBy("url"))
    again = F.coalesce("again", F.lit(False)) & F.col("page_id").eqNullSafe(F.col("chosen"))
    twice = marked.filter(again).withColumn("turn", first)
    marked = marked.filter(~again).withColumn("turn", F.lit(1)).unionByName(twice)
    revisit = (F.col("bytes") >= revisit_bytes) & F.col("chosen").isNotNull() & F.coalesce((F.col("page_id") != F.col("chosen")) | (F.col("turn") > 1), F.lit(True))
    marked = marked.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("chosen")), "html": F.when(~revisit, F.col("html"))})
    return alone.select(*columns).unionByName(marked.select(*columns))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Writes a record per page under ``folder`` and returns the index; compute it once and save it, as each run writes anew."""
    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)
    return classify(pages, **columns).mapInArrow(_write(folder, archive_bytes), _INDEX)


def coalesce_ranges(rows: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """Sorted (offset, length) rows as joined ranges: first row, row after the last, first byte, byte after the last."""
    i = 0
    while i < len(rows):
        begin, end, k = rows[i][0], sum(rows[i]), i + 1
        while k < len(rows) and rows[k][0] <= end + gap and sum(rows[k]) - begin <= most:
            end, k = max(end, sum(rows[k])), k + 1
        yield i, k, begin, end
        i = k


def _read(folder: str, with_payload: bool, gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        source = opened = None
        try:
            for batch in batches:
                names, offsets, lengths = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
                at = 0
                while at < len(names):
                    end = at
                    while end < len(names) and names[end] == names[at]:
                        end += 1
                    if opened != names[at]:
                        if source is not None:
                            source.close()
                        source, opened = store.open_input_file(f"{root}/{names[at]}"), names[at]
                    for i, k, begin, stop in coalesce_ranges(list(zip(offsets[at:end], lengths[at:end], strict=True)), gap):
                        source.seek(begin)
                        data, rows = source.read(stop - begin), []
                        for o, n in zip(offsets[at + i : at + k], lengths[at + i : at + k], strict=True):
                            head, payload = parse_record(data[o - begin : o - begin + n])
                            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            kind, size = head["WARC-Type"], int(head["X-Payload-Length"])
                            if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                                raise ValueError(f"record at {o} of {names[at]} does not match its digest")
                            page, other = head["X-Page-ID"].strip(), head.get("X-Refers-To-Page-ID")
                            rows.append((int(page) if page else None, size, digest, kind, int(other) if other else None, head["WARC-Target-URI"], payload.decode() if with_payload and kind == "response" else None))
                        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"])
                    at = end
        finally:
            if source is not None:
                source.close()

    return run


def read_records(index: DataFrame, folder: str, with_payload: bool = True, gap: int = GAP_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records that the index rows name, read by coalesced byte ranges.

    Index rows are dealt out by stretches of archives and offsets, as many as
    the selected records have ``task_bytes``; where that is fewer than there are
    cores, as many as these, of at least a MB each.
    """
    own = index.select("archive", "offset", "length")
    size = own.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-size // task_bytes), min(index.sparkSession.sparkContext.defaultParallelism, size >> 20))
    spread = own.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"
    return spread.mapInArrow(_read(folder, with_payload, gap), fields)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives for all pages, saves the index, and reads all records back."""
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.path}/archives"
    index = scratch.save(write_archives(pages, folder), "index")
    return read_records(index, folder, with_payload=False).drop("html")

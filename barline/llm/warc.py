"""WARC archives: writing, reading back, and a merged index of capture histories.

Each page becomes a record; of pages with equal payloads of at least ``REVISIT_BYTES`` bytes
the one with the smallest page_id is a response and the others are revisits that name it.
Archives are written by Spark's text writer (a record is UTF-8 text, the blank line that
ends a record is the writer's line separator) and read back by Spark's binary reader, so
they may lie in any store Spark reaches; records are found by their Content-Length, never by
searching the payload.

Reading an archive gives a capture run: its index entries sorted by URL key, time and record.
Runs are written, split by ranges of (URL key, time, record), and the slices of all runs that
fall into a range are merged by a loser tree. The ranges follow each other, so the result is
in global order of captures, however many captures one URL has.

Defined cases: a null html has an empty payload, a null url an empty key; a null page_id
takes part and is never the response of a payload that a page with an id has; repeated rows
are all responses or all revisits; an empty table gives no archives and no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import partitions, step
from barline.session import scratch_path

REVISIT_BYTES = 100
#: Records of one archive file.
FILE_RECORDS = 2000
#: Pages without a capture time were captured this many seconds after the epoch, plus their id.
FIRST_CAPTURE = 1_700_000_000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, no scheme, no fragment, lower-case host."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].lower()
    name, colon, port = host.partition(":")
    if port in ("80", "443"):
        colon = port = ""
    return ",".join(reversed(name.split("."))) + colon + port + ")" + slash + path


def classify(pages: DataFrame) -> DataFrame:
    """``pages`` as (digest, page_id, url, captured, html, size, refers_to)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    captured = F.col("captured").cast("timestamp") if "captured" in pages.columns else F.timestamp_seconds(
        F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(1_000_000_000)))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), captured.alias("captured"),
        html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    # payloads that occur more than once; written, so that Spark knows their size when it joins them
    first = step(rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "payloads")
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    return rows.join(first, "digest", "left").withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id")


def records(pages: DataFrame) -> DataFrame:
    """(record): a WARC record per page, without the blank line that ends it."""
    rows = classify(pages)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    # a line break in a URL would end the header
    url = F.regexp_replace("url", r"[\r\n]", "%0A")
    response = F.col("refers_to").isNull()
    body = F.when(response, F.col("html")).otherwise(F.lit(""))
    head = [
        F.lit("WARC/1.1" + CRLF),
        F.concat(F.lit("WARC-Type: "), F.when(response, F.lit("response")).otherwise(F.lit("revisit")), F.lit(CRLF)),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id")), F.lit(CRLF)),
        F.concat(F.lit("WARC-Target-URI: "), url, F.lit(CRLF)),
        F.concat(F.lit("WARC-Date: "), F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(CRLF)),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(CRLF)),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string"), F.lit(CRLF)),
        F.when(response, F.lit("")).otherwise(F.concat(
            F.lit("WARC-Profile: " + PROFILE + CRLF + "WARC-Refers-To: "), urn(F.col("refers_to")), F.lit(CRLF))),
        F.lit("Content-Type: text/html; charset=utf-8" + CRLF),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF)),
        body]
    return rows.select(F.concat(*head).alias("record"))


def write_archives(pages: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Writes one gzip WARC file per ``file_records`` records below ``path``."""
    (records(pages).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", file_records).text(path))


def parse(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, payload, offset, length) of the records in the uncompressed bytes of an archive."""
    held, offset, more = bytearray(), 0, True
    end = (CRLF + CRLF).encode()

    def fill(n: int) -> bool:
        nonlocal more
        while len(held) < n and more:
            block = next(stream, None)
            if block is None:
                more = False
            else:
                held.extend(block)
        return len(held) >= n

    while fill(1):
        at = held.find(end)
        while at < 0 and more:
            seen = len(held)
            fill(seen + 1)
            at = held.find(end, max(0, seen - 3))
        if at < 0:
            raise ValueError("an archive ends inside a record's header")
        lines = bytes(held[:at]).decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {offset}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        total = at + 4 + size + 4
        if not fill(total):
            raise ValueError("an archive ends inside a record")
        yield head, bytes(held[at + 4: at + 4 + size]), offset, total
        del held[:total]
        offset += total


def unzip(content: bytes) -> Iterator[bytes]:
    """Uncompressed blocks of gzip content of any number of members."""
    while content:
        member = zlib.decompressobj(31)
        at = 0
        while at < len(content) and not member.eof:
            block = member.decompress(content[at: at + (1 << 16)])
            at += 1 << 16
            if block:
                yield block
        block = member.flush()
        if block:
            yield block
        content = member.unused_data + content[at:] if member.eof else b""


INDEX = pa.schema([
    ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("run", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX_DDL = ("url_key string, captured string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, "
             "run string, offset long, length long")


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def _order(key: str, captured: str, page_id: int | None, run: str, offset: int) -> tuple:
    return key.encode(), captured, page_id is not None, page_id or 0, run, offset


def capture_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries of archives given as (path, content), each archive's in order."""
    for batch in batches:
        for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            run = path.rsplit("/", 1)[-1]
            rows = []
            for head, payload, offset, length in parse(unzip(content)):
                digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                if head["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                    raise ValueError(f"payload of the record at {offset} of {run} does not match its digest")
                rows.append((
                    url_key(head["WARC-Target-URI"]), head["WARC-Date"], _page(head["WARC-Record-ID"]), head["WARC-Type"], digest, size,
                    _page(head.get("WARC-Refers-To")), run, offset, length))
            rows.sort(key=lambda r: _order(r[0], r[1], r[2], r[7], r[8]))
            for i in range(0, len(rows), 4096):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i: i + 4096], strict=True), INDEX.types, strict=True)], schema=INDEX)


def loser_tree(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges sorted iterators of (key, value) by a tournament: each inner node holds the loser of its match."""
    k = len(runs)
    if not k:
        return
    heads = [next(r, None) for r in runs]

    def beats(a: int, b: int) -> bool:
        """Run a's head comes before run b's; a finished run loses to all, ties go to the lower run."""
        if heads[a] is None or heads[b] is None:
            return heads[a] is not None or heads[b] is None and a < b
        return (heads[a][0], a) < (heads[b][0], b)

    losers = [0] * k
    winner = [0] * (2 * k)
    winner[k:] = range(k)
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winner[1] if k > 1 else 0
    while heads[best] is not None:
        yield heads[best][1]
        heads[best] = next(runs[best], None)
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the slices of all runs in one range; appends the range's number and the place in it.

    Rows of a run come from one sorted file; their order is restored where blocks of a run
    were fetched out of turn.
    """
    from pyspark import TaskContext

    slices: dict[str, list[tuple]] = {}
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            slices.setdefault(r[7], []).append((_order(r[0], r[1], r[2], r[7], r[8]), r))
    for part in slices.values():
        part.sort(key=lambda x: x[0])  # already in order unless blocks arrived out of turn
    number = TaskContext.get().partitionId()
    out: list[tuple] = []
    place = 0
    schema = pa.schema([*INDEX, ("merge_range", pa.int64()), ("merge_place", pa.int64())])
    for row in loser_tree([iter(slices[run]) for run in sorted(slices)]):
        out.append((*row, number, place))
        place += 1
        if len(out) == 4096:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The capture runs of the archives below ``path``, written once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return step(files.mapInArrow(capture_runs, INDEX_DDL), "capture_runs")


def capture_histories(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """All runs merged: rows with merge_range and merge_place, in global order of (url_key, captured, page_id)."""
    n = ranges or partitions(runs.sparkSession)
    dealt = runs.repartitionByRange(n, "url_key", "captured", F.col("page_id").asc_nulls_first(), "run", "offset")
    return dealt.mapInArrow(partial(merge_runs), f"{INDEX_DDL}, merge_range long, merge_place long")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives, reads them back and returns their capture histories."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    return capture_histories(read_index(spark, path))

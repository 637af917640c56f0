"""WARC archives and their index, merged from sorted runs.

Every record is a gzip member of its own, so that the index's offset and length are all it takes to
read one. Members are packed into archives of bounded size, which Spark's own writer writes, with its commit
protocol, so that lost executors leave no half records. Reading an archive, a member at a time, gives a run of
captures, sorted by URL key and timestamp; runs are written to the shared folder. Key ranges of bounded
size are then cut out of all runs, whose parts keep their order, and a loser tree merges each range, one
comparison a level and row, which gives capture histories in one global order.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import lean, materialize, temporary, until_exit

#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 1000
#: Bytes from which on an archive takes no further record.
ARCHIVE_BYTES = 16 << 20
#: Captures of a range that one task merges, about.
RANGE_ROWS = 100_000
#: Bytes that a gzip member holds at most: below 2 ** 24 the last of its length's four bytes is 0.
MEMBER_BYTES = (1 << 24) - 1
#: Captures are dated from here on, a second for each page_id: pages have no time of their own.
EPOCH = 1577836800

_URN = "urn:x-tidepanel:page:"
_CAPTURE = "urlkey string, stamp string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long, seq long"
_NAMES = [c.split(" ")[0] for c in _CAPTURE.split(", ")]


def _field(value: Column) -> Column:
    """A header value on one line: control characters and blanks are percent-encoded as blanks."""
    return F.regexp_replace(value, r"[\x00-\x20\x7F]", "%20")


def records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """One column ``value``: the WARC record of each page, without the two line ends after it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload").cast("long"))
    first = rows.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    typed = rows.join(materialize(first.select("digest", "first")), "digest", "left").withColumn("revisit", F.coalesce((F.col("size") >= least) & (F.col("page_id") < F.col("first")), F.lit(False)))
    end = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("size"), F.lit(end + end))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(3_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "),
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{end}WARC-Record-ID: "),
        name(F.col("page_id")),
        F.lit(f"{end}WARC-Date: "),
        date,
        F.coalesce(F.concat(F.lit(f"{end}WARC-Target-URI: "), _field(F.col("url"))), F.lit("")),
        F.lit(f"{end}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            F.col("revisit"),
            F.concat(F.lit(f"{end}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{end}WARC-Refers-To: "), name(F.col("first"))),
        ).otherwise(F.lit("")),
        F.lit(f"{end}Content-Type: application/http; msgtype=response{end}Content-Length: "),
        F.octet_length(block),
        F.lit(end + end),
    )
    return typed.select(F.concat(head, block).alias("value"))


def _members(record: bytes) -> bytes:
    """A record with its two line ends as a gzip member; a very long one as several."""
    record += b"\r\n\r\n"
    found = []
    for first in range(0, len(record), MEMBER_BYTES):
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        found += [press.compress(record[first : first + MEMBER_BYTES]), press.flush()]
    return b"".join(found)


def _packed(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Archives, each without its last byte."""
    held, size = [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["archive"])

    for batch in batches:
        for value in batch.column(0):
            held.append(_members(value.as_buffer().to_pybytes()))
            size += len(held[-1])
            if size >= most:
                yield done()
                held, size = [], 0
    if held:
        yield done()


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to gzipped WARC files in ``path``.

    The payload is html in UTF-8, a null one empty. Of records with equal payloads of ``least``
    bytes or more, those with the largest page_id are responses and the others revisit it; smaller
    ones, and those with a null page_id, are responses. Repeated rows give repeated records;
    a null url leaves its header out; other columns are ignored; no rows give no records. An archive takes records up to
    the one that reaches ``archive_bytes``.
    """
    packed = records(pages, least).select(F.col("value").cast("binary")).mapInArrow(lambda it: lean(_packed(it, archive_bytes)), "archive binary")
    # each row is a file; what ends its line is the last byte of its last member, which is always 0
    packed.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query, in lower case."""
    found = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url or "")
    if not found:
        return (url or "").lower()
    host = re.sub(r"^www\d*\.", "", found[1].lower())
    return ",".join(reversed(host.split("."))) + ")" + (found[2].lower() or "/")


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an unpacked archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
        start = head + 4
        end = start + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end after its length")
        yield at, end + 4 - at, headers, data[start:end]
        at = end + 4


def unpacked(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member, one at a time."""
    view, at, window = memoryview(data), 0, 1 << 14
    while at < len(view):
        press, parts, upto = zlib.decompressobj(31), [], at
        while not press.eof:
            if upto >= len(view):
                raise ValueError(f"the member at {at} has no end")
            parts.append(press.decompress(view[upto : upto + window]))
            upto = min(upto + window, len(view))
        upto -= len(press.unused_data)
        yield at, upto - at, b"".join(parts)
        at = upto


def parse_archive(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive, packed or not; offset and length are those in the file."""
    if data[:2] != b"\x1f\x8b":
        yield from parse_records(data)
        return
    held, start = b"", 0
    for offset, length, content in unpacked(data):
        if not held:
            start = offset
        held += content
        head = held.find(b"\r\n\r\n")
        size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", held[:head]) if head >= 0 else None
        if size and len(held) >= head + 4 + int(size[1]) + 4:
            for _, _, headers, block in parse_records(held):
                yield start, offset + length - start, headers, block
            held = b""
    if held:
        raise ValueError(f"the record at {start} has no end")


def _page(name: str) -> int | None:
    value = name.strip("<>").removeprefix(_URN)
    return None if value == "none" else int(value)


def _captures(file: str, data: bytes) -> list[tuple]:
    """The captures of an archive, sorted by URL key and timestamp. Stored payloads must match their digest."""
    found = []
    for offset, length, headers, block in parse_archive(data):
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)[1])
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        kind = headers["warc-type"]
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload of {headers['warc-record-id']} in {file} is damaged")
        stamp = datetime.datetime.fromisoformat(headers["warc-date"]).strftime("%Y%m%d%H%M%S")
        refers = _page(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
        found.append((url_key(headers.get("warc-target-uri")), stamp, _page(headers["warc-record-id"]), kind, size, digest, refers, file, offset, length))
    found.sort(key=_order)
    return [(*row, i) for i, row in enumerate(found)]


def _order(row: tuple) -> tuple:
    """URL key, timestamp, then page (none first), file and place: no two captures are equal."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[d.split(" ")[1]]) for c, d in zip(zip(*rows, strict=True), _CAPTURE.split(", "), strict=True)], _NAMES)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = _captures(file.rsplit("/", 1)[-1], content.as_buffer().to_pybytes())
            for first in range(0, len(rows), 10_000):
                yield _batch(rows[first : first + 10_000])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives in ``path``, each archive's a run in sorted order; seq is a capture's place in its run."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lambda it: lean(_runs(it)), _CAPTURE)


def loser_tree(runs: list[Iterable[tuple]], key=_order) -> Iterator[tuple]:
    """Merge sorted runs. Inner nodes hold the losers of their matches, the winner stands apart;
    after each output only the matches on the path of its run are played again."""
    k = len(runs)
    done = (1,)
    sources = [iter(r) for r in runs]
    rows: list = [None] * k
    keys: list = [done] * k

    def advance(i: int) -> None:
        rows[i] = next(sources[i], None)
        keys[i] = done if rows[i] is None else (0, key(rows[i]))

    for i in range(k):
        advance(i)
    losers = [-1] * k

    def settle(i: int) -> int:
        """Play run i up to the top; wait at the first node without an opponent."""
        node = (i + k) // 2
        while node:
            if losers[node] == -1:
                losers[node] = i
                return -1
            if keys[losers[node]] < keys[i]:
                losers[node], i = i, losers[node]
            node //= 2
        return i

    winner = -1
    for i in range(k):
        top = settle(i)
        winner = top if top >= 0 else winner
    while k and keys[winner] is not done:
        yield rows[winner]
        advance(winner)
        winner = settle(winner)


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of a range, which come one after the other, each in its order. They are held as they came; of
    each run only a few rows at a time are unpacked."""
    runs: dict[str, list[pa.RecordBatch]] = {}
    for batch in batches:
        files = batch.column(7).to_pylist()
        first = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or files[i] != files[first]:
                runs.setdefault(files[first], []).append(batch.slice(first, i - first))
                first = i

    def rows(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for at in range(0, part.num_rows, 64):
                yield from zip(*(c.to_pylist() for c in part.slice(at, 64).columns), strict=True)

    held: list[tuple] = []
    for row in loser_tree([rows(parts) for parts in runs.values()]):
        held.append(row)
        if len(held) == 10_000:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def merge_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All runs in one order, by URL key and timestamp: partitions hold consecutive key ranges of about ``range_rows``.

    Keys are cut by URL key, timestamp, page and place, so that captures of one URL, however
    many, can be spread over several ranges. Nothing is sorted by key again: a range's rows are put back
    into the order of their runs, which the tree merges.
    """
    ranges = max(1, -(-captures.count() // range_rows))
    cut = captures.repartitionByRange(ranges, "urlkey", "stamp", "page_id", "file", "offset").sortWithinPartitions("file", "seq")
    return cut.mapInArrow(lambda it: lean(_merged(it)), _CAPTURE)


def archive_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write archives of ``pages``, read them back and return the merged index of their captures."""
    spark = pages.sparkSession
    own = path or temporary(spark, "warc")
    write_archives(pages, own)
    if not path:
        until_exit(spark, own)
    return merge_index(materialize(read_archives(spark, own)))

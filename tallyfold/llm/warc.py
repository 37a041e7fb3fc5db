"""WARC archives: a writer with revisit records, and a splittable reader.

Writer: one gzip member per record, through Spark's text sink, which writes the bytes of its one column as they
are. The sink has to end every row with a separator; that separator is an empty gzip member, so each file is a
valid gzip file throughout. Files get their names and appear by Spark's commit protocol.

Reader: files are cut into byte ranges, dealt over tasks. A task scans its range for the gzip magic, takes a
candidate for a member only if it decodes and begins with a WARC header, and owns the records that start inside its
range, reading past the end of the range to finish the last one. A candidate inside another member (an archive
stored in a record, say) is dropped by the offsets: it starts before the member around it ends.

Edge cases: a null html is an empty payload; a null url leaves the target URI out; of pages with equal payloads of
at least least_revisit bytes those with the smallest page_id are responses (several, if that page_id repeats; all,
if no page_id is known), others revisit it; an empty table gives an empty archive and an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.session import shared_path, written

MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member.
EMPTY = bytes.fromhex("1f8b080000000000000303000000000000000000")
DATE = "2024-01-01T00:00:00Z"
RANGE = 8 << 20
#: Bytes read at a time.
STEP = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@F.pandas_udf(T.StructType().add("bytes", T.LongType()).add("digest", T.StringType()))
def _digest(html: pd.Series) -> pd.DataFrame:
    payloads = (("" if h is None else h).encode("utf-8", "surrogatepass") for h in html)
    return pd.DataFrame([(len(p), digest(p)) for p in payloads], columns=["bytes", "digest"])


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, html: str | None, first: int | None, revisits: bool) -> bytes:
    """One gzip member: a response record, or a revisit record that refers to the page `first`."""
    payload = ("" if html is None else html).encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisits:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


@F.pandas_udf(T.BinaryType())
def _record(page_id: pd.Series, url: pd.Series, html: pd.Series, first: pd.Series, revisits: pd.Series) -> pd.Series:
    rows = zip(page_id.astype("Int64").astype(object), url, html, first.astype("Int64").astype(object), revisits, strict=True)
    return pd.Series([record(None if pd.isna(p) else p, u, h, None if pd.isna(f) else f, bool(r)) for p, u, h, f, r in rows])


def write_archive(pages: DataFrame, path: str, least_revisit: int = 0) -> None:
    """Write pages (page_id, url, html) as WARC files under path.

    The payloads move once, to meet their record type by page_id; copies are found over ids and digests alone. A
    digest's first page is a grouped minimum; it is written before the join, so both sides of that are plain
    scans and adaptive execution splits the rows of a payload that fills a third of the table.
    """
    own = written(pages.select("page_id", _digest("html").alias("d")).select("page_id", "d.bytes", "d.digest"), "digests")
    often = own.where(F.col("bytes") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    often = written(often.where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"), "repeated")
    later = own.where(F.col("bytes") >= least_revisit).join(often, "digest").where("page_id IS NULL OR page_id <> first_id")
    later = written(later.select("page_id", "digest", "first_id").distinct(), "revisits")
    # page_id alone can be repeated with other payloads, so a page meets the revisit of its own payload
    keyed = pages.select("page_id", "url", "html", _digest("html")["digest"].alias("digest"), F.coalesce("page_id", F.lit(-1)).alias("k"), F.col("page_id").isNull().alias("z"))
    by = later.select(F.coalesce("page_id", F.lit(-1)).alias("k"), F.col("page_id").isNull().alias("z"), "digest", "first_id")
    typed = keyed.join(by, ["k", "z", "digest"], "left")
    made = typed.select(_record("page_id", "url", "html", "first_id", F.col("first_id").isNotNull()).cast("string").alias("value"))
    made.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)


class Slice:
    """A file's bytes from an offset on, read STEP by STEP. held begins at offset start; what lies before it is let go of
    only when more is read, so that passing over a candidate copies nothing."""

    def __init__(self, source, at: int):
        self.source, self.start, self.held, self.over, self.free = source, at, b"", False, at
        source.seek(at)

    def more(self) -> bool:
        got = b"" if self.over else self.source.read(STEP)
        self.over = not got
        self.held = self.held[self.free - self.start :] + got
        self.start = self.free
        return bool(got)

    def drop(self, upto: int) -> None:
        """Bytes before `upto` are not needed any more."""
        self.free = upto


def scan_range(source, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, end, decoded member) of the WARC records that start in [start, end) of an open file."""
    data, at = Slice(source, start), start
    while at < end:
        found = data.held.find(MAGIC, at - data.start)
        if found < 0:
            at = max(at, data.start + len(data.held) - len(MAGIC) + 1)
            data.drop(at)
            if not data.more():
                return
            continue
        at = data.start + found
        if at >= end:
            return
        data.drop(at)
        member = _member(data, at)
        if member is None or (member[0] and not member[0].startswith(b"WARC/1.")):
            at += 1
            continue
        body, stop = member
        if body:
            yield at, stop, body
        at = stop
        data.drop(at)


#: Bytes given to the decoder at a time, so that a false candidate costs no more.
BITE = 1 << 14


def _member(data: Slice, at: int) -> tuple[bytes, int] | None:
    """The gzip member at offset `at` and where it ends, or None; given up early if no WARC header comes out."""
    unpack, out, head = zlib.decompressobj(31), [], b""
    while True:
        bite = data.held[at - data.start : at - data.start + BITE]
        if not bite:
            if data.more():
                continue
            return None
        try:
            out.append(unpack.decompress(bite))
        except zlib.error:
            return None
        at += len(bite)
        if unpack.eof:
            return b"".join(out), at - len(unpack.unused_data)
        head = head + out[-1][:7] if len(head) < 7 else head
        if not b"WARC/1.".startswith(head[:7]):
            return None


def parse(member: bytes) -> dict:
    """Header fields and block of a decoded record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
    return {"fields": fields, "block": rest[: int(fields.get("Content-Length", 0))]}


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


#: Schemes of Hadoop's file systems under the names that pyarrow knows.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_range(path: str):
    """A seekable binary file of a path as Spark gives it. Credentials are the executors' own (environment or instance role):
    Spark's are not passed on. For other stores, give read_archive an opener of their own."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    store, place = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}")
    return store.open_input_file(place)


def _read(batches: Iterator[pd.DataFrame], opener: Callable = open_range) -> Iterator[pd.DataFrame]:
    columns = ["path", "offset", "stop", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "intact"]
    for batch in batches:
        for path, start, end, whole in zip(batch["path"], batch["start"], batch["end"], batch["whole"], strict=True):
            rows = []
            with opener(path) as source:
                for offset, stop, member in scan_range(source, start, end):
                    got = parse(member)
                    f, block = got["fields"], got["block"]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = next((int(line[15:]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), len(payload))
                    kind, said = f.get("WARC-Type"), f.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    intact = kind != "response" or (len(payload) == size and digest(payload) == said)
                    rows.append((path, offset, stop, _page(f.get("WARC-Record-ID")), f.get("WARC-Target-URI"), kind, _page(f.get("WARC-Refers-To")), said, size, payload if whole else None, intact))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                        rows = []
            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archive(spark: SparkSession, path: str, payloads: bool = True, size: int = RANGE, opener: Callable = open_range) -> DataFrame:
    """One row per record under path: path, offset, page_id, url, record_type, refers_to, payload_digest, payload_bytes,
    payload (null unless asked for), intact (a response's payload has the length and digest that its headers give).

    opener gives an executor the seekable bytes of a path (see open_range).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    ranges = files.select("path", starts.alias("start")).select("path", "start", (F.col("start") + size).alias("end"), F.lit(payloads).alias("whole"))
    schema = "path string, offset long, stop long, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, intact boolean"
    found = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start").mapInPandas(partial(_read, opener=opener), schema)
    # a member inside another one starts before that one's end; file and offset are all this window needs, a file at a time
    around = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_reach", F.max("stop").over(around)).where("_reach IS NULL OR offset >= _reach").drop("_reach", "stop")


def archived(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from a written archive."""
    path = shared_path(pages.sparkSession, "warc")
    write_archive(pages, path, least_revisit)
    back = read_archive(pages.sparkSession, path, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS first_id FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(x, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS intact
FROM d
"""

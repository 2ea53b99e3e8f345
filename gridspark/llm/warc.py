"""WARC archives: writing pages as records, and a salvage reader that survives damage.

Writing. Each record is its own gzip member. Members go through Spark's text sink as raw bytes, so the files are committed
by Spark in any file system it knows: a member ends in a zero byte (the top byte of its length), which is the sink's line
separator; a member that does not is followed by an empty one that does. Of records with equal payloads of at least
`least` bytes the one with the smallest page id is the response, others are revisits without a block that refer to it.

Reading. A file is walked member by member (or, uncompressed, record by record). A member that fails to inflate, a bad
version line, a bad length or a digest that does not match starts a gap: the reader searches on from the next byte for a gzip magic whose
member inflates to a version line, or for a version line, resumes there, and logs the gap's byte range and reason.
A damaged or cut member is inflated as far as it goes, and its records before and after a fault are read by a search for
version lines in what inflated; such gaps have the member's range, their place in the inflated bytes is in the reason.
A member of one record whose checksum alone is wrong is a gap, as its header cannot be trusted; of several records that all pass
their checks, all are read and the gap is logged.

Bounds: files hold at most `records` records, so a task reads a bounded file. Only digests and ids are grouped; a frequent
payload is pre-aggregated, and its rows are spread by Spark's skew join.

Defined cases: a null html is an empty payload; a null url is an empty target; control characters in a url are escaped; a null page
id is never the one referred to, and where all ids of a payload are null all are responses; rows that repeat the first page id of a payload
are all responses; other columns are ignored; an empty table gives an empty archive and result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import new_path

RECORDS_PER_FILE = 2000
MAGIC = b"\x1f\x8b\x08"
PIECE = 64 << 10
CUT, CHECKSUM = "member is cut", "member's checksum is wrong"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def gzip_member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, digest: str) -> bytes:
    """One uncompressed record; a revisit (first is not None) has no block."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    name = "" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}", f"X-Full-Payload-Length: {len(payload)}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write_archive(pages: DataFrame, path: str, least: int = 0, records: int = RECORDS_PER_FILE, id_col: str = "page_id",
                  url_col: str = "url", html_col: str = "html") -> None:
    """Write the pages' records under `path` as gzip members."""
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # pages of one payload can be many: aggregate before joining
    firsts = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("i").alias("first"))
    rows = rows.join(firsts, "digest", "left").withColumn("first", F.when(F.col("first") == F.col("i"), None).otherwise(F.col("first")))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, out = batch.slice(start, 256), []
                for i, url, payload, digest, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    name = base64.b32encode(bytes.fromhex(digest)).decode()
                    member = gzip_member(record(i, url, payload, first, name))
                    if member[-1]:
                        member += gzip_member(b"")
                    out.append(member[:-1])
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    made = rows.select("i", "url", "payload", "digest", "first").mapInArrow(members, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none") \
        .option("maxRecordsPerFile", records).text(path)


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at `at`; raises ValueError if a check fails."""
    if not VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers do not end")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            raise ValueError("bad header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not {"warc-record-id", "warc-type", "warc-date"} <= set(head):
        raise ValueError("mandatory field missing")
    length = head.get("content-length", "")
    if not length.isdigit():
        raise ValueError("bad length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError("record is cut or its length is wrong")
    block, digest = data[start:stop], head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        raise ValueError("digest does not match")
    return head, block, stop + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What inflates of the gzip member at `at`, its end or how far it was read, and the fault if it is damaged or cut."""
    view = memoryview(data)[at:]
    unpack, out, done = zlib.decompressobj(31), [], 0
    try:
        while done < len(view) and not unpack.eof:     # in pieces: what follows the member is never copied
            out.append(unpack.decompress(view[done:done + PIECE]))
            done = min(done + PIECE, len(view))
        return b"".join(out), at + done - len(unpack.unused_data), None if unpack.eof else CUT
    except zlib.error as e:
        fault = CHECKSUM if "incorrect" in str(e) and "check" in str(e) and "header" not in str(e) else "member does not inflate"
    # an error discards the output of its call: feed steps, then single bytes, up to the fault
    unpack, out, done, step = zlib.decompressobj(31), [], 0, 4096
    while done < len(view):
        before = unpack.copy()
        try:
            out.append(unpack.decompress(view[done:done + step]))
        except zlib.error:
            if step == 1:
                break
            unpack, step = before, 1
            continue
        done += step
    return b"".join(out), at + done, fault


def _records(content: bytes) -> list[tuple[str, int, int, object]]:
    """Records and gaps of inflated bytes, as of `salvage`."""
    out, at = [], 0
    while at < len(content):
        try:
            head, block, end = _parse(content, at)
            out.append(("record", at, end, (head, block)))
        except ValueError as e:
            found = VERSION.search(content, at + 1)
            end = found.start() if found else len(content)
            if out and out[-1][0] == "gap":
                out[-1] = ("gap", out[-1][1], end, out[-1][3])
            else:
                out.append(("gap", at, end, str(e)))
        at = end
    return out


def _resume(data: bytes, at: int, plain: int) -> int:
    """The next member from `at` that starts with a version line, or the next version line from `plain`, or the end."""
    while at < len(data):
        member = data.find(MAGIC, at)
        # no version line behind the member matters here, so the search never runs past it
        version = VERSION.search(data, max(at, plain), len(data) if member < 0 else min(member + 32, len(data)))
        places = [p for p in (member, version.start() if version else -1) if p >= 0]
        at = min(places, default=len(data))
        if at == len(data) or not data.startswith(MAGIC, at) or _begins(data, at):
            break
        at += 1
    return min(at, len(data))


def _begins(data: bytes, at: int) -> bool:
    """Whether a member at `at` starts with a version line, judged by its first bytes."""
    try:
        return bool(VERSION.match(zlib.decompressobj(31).decompress(data[at:at + 4096], 64)))
    except zlib.error:
        return False


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, (headers, block)) and ("gap", start, end, reason), in order, covering every byte but padding."""
    at, size = 0, len(data)
    gap: tuple[int, str] | None = None
    while at < size:
        try:
            if data.startswith(MAGIC, at):
                content, end, fault = _inflate(data, at)
                found = _records(content)
                good, bad = ([x for x in found if x[0] == kind] for kind in ("record", "gap"))
                if (fault or bad) and (not good or fault == CHECKSUM and len(found) == 1):
                    raise ValueError(fault or bad[0][3])
                if fault:
                    end = _resume(data, at + 1, end)
                    if not bad:
                        found.append(("gap", len(content), len(content), fault))
            else:
                head, block, end = _parse(data, at)
                found = [("record", at, end, (head, block))]
        except ValueError as e:
            if gap is None:
                gap = (at, str(e))
            at = _resume(data, at + 1, at + 1)
            continue
        if gap is not None:
            yield "gap", gap[0], at, gap[1]
            gap = None
        for kind, low, high, what in found:
            yield kind, at, end, what if kind == "record" else f"{what} (inflated bytes {low} to {high})"
        at = end
    if gap is not None:
        yield "gap", gap[0], size, gap[1]


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per record or quarantined gap: file, start, end, kind, reason, page_id, url, record_type, refers_to, payload_digest,
    payload_bytes, payload."""
    schema = ("file string, start long, end long, kind string, reason string, page_id long, url string, record_type string, "
              "refers_to long, payload_digest string, payload_bytes long, payload binary")
    names = [x.split()[0] for x in schema.split(", ")]
    types = dict(zip(names, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                             pa.string(), pa.int64(), pa.binary()], strict=True))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), types[n]) for n, c in zip(names, columns, strict=True)], names)

        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out, held = [], 0
                for kind, start, end, what in salvage(content.as_py()):
                    if kind == "gap":
                        out.append((file, start, end, kind, what, *[None] * 7))
                    else:
                        head, block = what
                        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        n = int(head.get("x-full-payload-length", len(block))) if head.get("warc-type") == "revisit" else len(block)
                        out.append((file, start, end, kind, None, _page(head.get("warc-record-id")), head.get("warc-target-uri"), head.get("warc-type"),
                                    _page(head.get("warc-refers-to")), digest, n, block))
                        held += len(block)
                    if held > 4 << 20 or len(out) >= 1000:
                        yield batch_of(out)
                        out, held = [], 0
                yield batch_of(out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(rows, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to a new archive in the shared folder and read the records back."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path, least)
    return read_archive(pages.sparkSession, path).filter("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

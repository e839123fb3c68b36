"""Legacy web archives: ARC files, their conversion to WARC, and reading both back.

Archives are written by Spark's own text writer, one file a row, and read by its binary file reader, so any
store that Spark reaches will do. Each record is a gzip member of its own, and a file takes records until it
has a bounded size. Records are found by the lengths that their headers declare, never by what a payload looks
like, while the file is unpacked piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import cut, ease, if_small, needs, remove_folder, shared_folder

#: Bytes of records after which an archive file ends, before they are compressed; bytes that are packed as one
#: gzip member at most, which keeps the last byte of each member 0; bytes that are unpacked at a time, and those of a
#: member that are tried first.
FILE_BYTES, MEMBER_BYTES, PIECE_BYTES, FIRST_BYTES = 16 << 20, 8 << 20, 1 << 20, 4 << 10
#: How hard gzip tries: the archives are read once or twice and removed, so time counts more than their size.
LEVEL = 1
#: Fixed values of the formats: the fields of a URL record's header line in ARC versions 1 and 2.
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_MEANING = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
#: An instant for captures that have none, as the archive's date.
NO_DATE = "19960101000000"
PAGE_HEADER = "X-Page-Id"


def digest_of(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _packed(record: bytes) -> bytes:
    """The record as a gzip member, or several if it is very long."""
    return b"".join(zlib_member(record[i : i + MEMBER_BYTES]) for i in range(0, max(1, len(record)), MEMBER_BYTES))


def zlib_member(data: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, wbits=31)
    return pack.compress(data) + pack.flush()


def _files(records: Iterator[bytes], head) -> Iterator[bytes]:
    """Archive files of records, each begun by head(number of the file)."""
    held, size, n = [], 0, 0
    for record in records:
        if not held:
            held.append(_packed(head(n)))
        held.append(_packed(record))
        size += len(record)
        if size >= FILE_BYTES:
            yield b"".join(held)
            held, size, n = [], 0, n + 1
    if held:
        yield b"".join(held)


def _write(rows: DataFrame, files, path: str) -> None:
    """Write what `files` makes of the batches of rows, one file for each bytes object that it gives.

    The text writer ends each row with a separator. As a gzip member ends with the number of its bytes, whose
    highest byte is 0 here, that byte is left to it.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in files(batches):
            yield pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["value"])

    written = rows.mapInArrow(made, "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


class _Unpacked:
    """The bytes of a file, gzip members one after another unpacked piece by piece; as they are if not gzip."""

    def __init__(self, data: bytes):
        self.pieces = self._pieces(data)
        self.held = bytearray()

    @staticmethod
    def _pieces(data: bytes) -> Iterator[bytes]:
        if data[:2] != b"\x1f\x8b":
            yield data
            return
        at, end = 0, len(data)
        while at < end:
            # most members are short, and what a piece has beyond its member is copied
            one, size = zlib.decompressobj(31), FIRST_BYTES
            while not one.eof and at < end:
                part = data[at : at + size]
                at, size = at + len(part), min(2 * size, PIECE_BYTES)
                while part and not one.eof:
                    if piece := one.decompress(part, PIECE_BYTES):
                        yield piece
                    part = one.unconsumed_tail
                at -= len(one.unused_data)
            if not one.eof:
                raise ValueError("the file ends within a gzip member")

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.held += piece
        return piece is not None

    def empty(self) -> bool:
        return not self.held and not self.more()

    def until(self, mark: bytes) -> bytes:
        """What comes before the next mark, which is passed."""
        begin = 0
        while (end := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                raise ValueError(f"the file ends within a header: {bytes(self.held[:200])!r}")
        out = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the file ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


# ---------------------------------------------------------------- ARC


def _http(payload: bytes, page_id: int | None) -> bytes:
    mark = "" if page_id is None else f"{PAGE_HEADER}: {page_id}{CRLF}"
    return f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{mark}Content-Length: {len(payload)}{CRLF}{CRLF}".encode() + payload


def _arc_line(version: int, url: str, block: bytes, date: str = NO_DATE) -> bytes:
    """A header line of that version; white space in a URL is percent-encoded, as it would end the field."""
    clean = "".join(c if c > " " and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or "-"
    own = {"url": clean, "ip": "0.0.0.0", "date": date, "content_type": "text/html", "status": "200", "checksum": hashlib.md5(block).hexdigest(), "location": "-", "offset": "0", "filename": "pages.arc", "length": str(len(block))}
    return " ".join(own[f] for f in ARC_FIELDS[version]).encode()


def write_arc(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as gzipped ARC files: a version block, then a URL record a page.

    A null html is an empty payload, a null url `-`. Files of even partitions have version 1, others 2.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        about = f"{version} 0 Archive\n{ARC_MEANING[version]}\n".encode()
        head = f"filedesc://pages.arc 0.0.0.0 {NO_DATE} text/plain " + ("" if version == 1 else "200 - - 0 pages.arc ") + str(len(about))
        first = head.encode() + b"\n" + about + b"\n"

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, html in zip(*(batch[c] for c in ("page_id", "url", "html"))):
                    block = _http((html.as_py() or "").encode(), page.as_py())
                    yield _arc_line(version, url.as_py() or "-", block) + b"\n" + block + b"\n"

        return _files(records(), lambda n: first)

    _write(needs(pages, "page_id", "url", "html"), files, path)


def arc_records(data: bytes) -> Iterator[dict]:
    """The URL records of an ARC file: header fields of the version that the file's first block states, and
    the block of the declared length. The version block itself isn't one. A line that can't be a header is an
    error, as nothing after it could be trusted."""
    file, version = _Unpacked(data), 1
    while not file.empty():
        if file.held[:1] == b"\n":
            file.take(1)
            continue
        line = file.until(b"\n")
        fields = line.decode("utf-8", "replace").rstrip("\r").split(" ")
        if fields[0].startswith("filedesc:"):
            version = int(file.take(int(fields[-1])).split(b" ", 1)[0])
            continue
        names = ARC_FIELDS[version]
        if len(fields) != len(names) or not fields[-1].isdigit():
            raise ValueError(f"no header line of ARC version {version}: {line[:200]!r}")
        got = dict(zip(names, fields))
        yield got | {"version": version, "block": file.take(int(got["length"]))}


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, date, version, http, payload, digest) of each URL record in the ARC files of a folder."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ease()
            for data in batch["content"]:
                rows, held = [], 0
                for r in arc_records(data.as_py()):
                    head, _, payload = r["block"].partition(b"\r\n\r\n")
                    page = re.search(rb"(?im)^" + PAGE_HEADER.encode() + rb": (-?\d+)", head)
                    rows.append((page and int(page[1]), r["url"], r["date"], r["version"], head + b"\r\n\r\n", payload, digest_of(payload)))
                    held += len(payload)
                    if held > FILE_BYTES or len(rows) == 2000:
                        yield _batch(rows, _ARC_ROW)
                        rows, held = [], 0
                yield _batch(rows, _ARC_ROW)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parsed, "page_id long, url string, date string, version int, http binary, payload binary, digest string")


_ARC_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("version", pa.int32()), ("http", pa.binary()), ("payload", pa.binary()), ("digest", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# ---------------------------------------------------------------- WARC


def record_id(page_id: int | None, url: str, date: str, digest: str) -> str:
    """A URN that depends on the capture alone, so that converting again gives the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {page_id} {digest}')}>"


def _instant(date: str) -> str:
    d = (date + "00000000000000")[:14] if date.isdigit() else NO_DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc(page: int | None, url: str, date: str, http: bytes, payload: bytes, digest: str, first: int | None, first_url: str | None, first_date: str | None, revisit: bool) -> bytes:
    """A record. A revisit keeps the HTTP header alone, which still states the payload's length."""
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page, url, date, digest)}",
        f"WARC-Date: {_instant(date)}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(first, first_url or '-', first_date or NO_DATE, digest)}", f"WARC-Refers-To-Target-URI: {first_url or '-'}", f"WARC-Refers-To-Date: {_instant(first_date or NO_DATE)}"]
    return _closed(lines, block)


def _closed(lines: list[str], block: bytes) -> bytes:
    return (CRLF.join([*lines, f"Content-Length: {len(block)}"]) + CRLF + CRLF).encode() + block + (CRLF + CRLF).encode()


def _warcinfo(name: str) -> bytes:
    """The record that a file begins with; it takes the place of an ARC file's version block."""
    block = f"software: strata{CRLF}format: WARC File Format 1.1{CRLF}description: converted from ARC{CRLF}".encode()
    about = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {_instant(NO_DATE)}"]
    return _closed([*about, f"WARC-Block-Digest: sha1:{digest_of(block)}", "Content-Type: application/warc-fields"], block)


def convert(arc: DataFrame, path: str, least: int = 0) -> None:
    """Write the captures of read_arc as gzipped WARC files, each with a warcinfo record first.

    Of captures with equal payloads of at least `least` bytes, those with the smallest page_id are responses
    and the others revisits of it; a capture without a page_id is a response.
    """
    firsts = cut(
        arc.where("page_id is not null").groupBy("digest").agg(
            F.min(F.struct("page_id", "url", "date")).alias("first"), F.count("*").alias("n"), F.max(F.length("payload")).alias("size")
        ).where((F.col("n") > 1) & (F.col("size") >= least))
        .select(F.col("digest").alias("_same"), F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date"))
    )
    rows = arc.join(if_small(firsts), F.col("digest") == F.col("_same"), "left").withColumn("revisit", F.coalesce(F.col("page_id") > F.col("first"), F.lit(False)))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        from pyspark import TaskContext

        names = ("page_id", "url", "date", "http", "payload", "digest", "first", "first_url", "first_date", "revisit")
        part = TaskContext.get().partitionId()
        made = (_warc(*(x.as_py() for x in row)) for batch in batches for row in zip(*(batch[c] for c in names)))
        return _files(made, lambda n: _warcinfo(f"{part}-{n}.warc"))

    _write(rows.drop("_same", "version"), files, path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by the declared lengths."""
    file = _Unpacked(data)
    while not file.empty():
        first, *lines = file.until(b"\r\n\r\n").decode("utf-8", "replace").split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:200]}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        yield head, file.take(int(head["content-length"]))
        file.take(4)


_WARC_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("payload", pa.binary())])


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, payload) of each record.

    refers_to is the page of the response whose record ID a revisit refers to. payload is null for revisits, and
    for all with payloads=False. A response whose payload doesn't have the stated digest is an error.
    """
    return _resolved(_records(spark, path, payloads))


def _records(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ease()
            for data in batch["content"]:
                rows, held = [], 0
                for head, block in warc_records(data.as_py()):
                    kind = head["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    page = re.search(rb"(?im)^" + PAGE_HEADER.encode() + rb": (-?\d+)", http)
                    size = re.search(rb"(?im)^Content-Length: (\d+)", http)
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest_of(payload) != digest:
                        raise ValueError(f"the payload of {head['warc-record-id']} has another digest")
                    own = payload if payloads and kind == "response" else None
                    rows.append((page and int(page[1]), int(size[1]), digest, kind, head.get("warc-refers-to"), head["warc-record-id"], head["warc-target-uri"], own))
                    held += len(own or b"")
                    if held > FILE_BYTES or len(rows) == 2000:
                        yield _batch(rows, _WARC_ROW)
                        rows, held = [], 0
                yield _batch(rows, _WARC_ROW)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parsed, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string, record_id string, url string, payload binary")


def _resolved(rows: DataFrame) -> DataFrame:
    named = rows.select("record_id", "page_id", "record_type", "refers_to_id")
    asked = named.where("refers_to_id is not null").select(F.col("refers_to_id").alias("_id")).distinct()
    there = named.where("record_type = 'response'").join(asked, F.col("record_id") == F.col("_id")).groupBy("_id").agg(F.min("page_id").alias("refers_to"))
    out = rows.join(if_small(cut(there)), F.col("refers_to_id") == F.col("_id"), "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "payload")


def archived(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id) for every row of pages.

    The pages (page_id, url, html) go to ARC files, these to WARC files, which are read back. A null html is
    an empty payload; all empty payloads are equal. Rows that repeat the smallest page_id of a payload are all
    responses; a null page_id is one too, and comes back null. An empty table gives no rows. The archives are
    under spark.checkpoint.dir; the result is kept there as well, and the archives are removed.
    """
    spark = pages.sparkSession
    old, new = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    rows = needs(pages, "page_id", "url", "html")
    write_arc(rows, old)
    convert(read_arc(spark, old), new)
    records = cut(_records(spark, new, payloads=False))
    remove_folder(spark, old)
    remove_folder(spark, new)
    return _resolved(records).drop("payload", "url")

"""WARC archives: a deduplicating writer and a reader that salvages damaged files.

Writing: the payload is the html in UTF-8 (null is empty). Of records with equal
payloads of at least `least_bytes` bytes the one with the largest page_id is a
`response`; the others are `revisit` records that refer to it and carry no payload.
Smaller payloads are all responses. Rows that repeat the largest page_id are responses
too; a null page_id is below every other, and alone among its equals it is a response.
Each task writes gzip members, one a record, to files of its own of about `rotate`
bytes; the finished tasks' file names come back as one row a file.

Reading: a task takes one file. A record is good if its member inflates (or its version
line and header parse), the length is right and block and payload digests agree. After a
failed check the reader logs the bytes as a gap and searches on: in compressed files for
the next member that inflates to a version line, in plain files for the next version
line with a header. Every byte of a file is in a record or in a logged gap.

Extra columns are ignored; an empty table gives no files and no rows.
"""

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa

from pyspark.sql import functions as F

from rollspan.llm.files import attempt_name, file_size, new_folder, open_input, open_output
from rollspan.session import cut

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
WINDOW = 1 << 20
HEADER_LIMIT = 1 << 16
SCHEMA = (
    "kind string, file string, start long, end long, reason string, record_type string, "
    "uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, "
    "payload binary"
)


def digest(data):
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, payload_digest):
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def format_record(page_id, uri, payload, refers_to):
    """One record, ready to be compressed; `refers_to` makes it a revisit."""
    mark = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    kind = "response" if refers_to is None else "revisit"
    uri = quote(uri, safe=":/?#[]@!$&'()*+,;=%~-._") if uri else f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, mark)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("WARC-Payload-Digest", "sha1:" + mark),
        ("X-Payload-Length", len(payload)),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to, mark)),
            ("X-Refers-To-Page", refers_to),
        ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def deflate(record):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _writer(folder, rotate):
    def write(batches):
        stream = name = None
        size = count = 0
        done = []
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in ("page_id", "url", "html", "refers_to")]):
                page_id, url, html, refers_to = row
                if stream is None:
                    name, size, count = attempt_name("pages") + ".warc.gz", 0, 0
                    stream = open_output(folder, name)
                member = deflate(format_record(page_id, url, (html or "").encode(), refers_to))
                stream.write(member)
                size, count = size + len(member), count + 1
                if size >= rotate:
                    stream.close()
                    stream = None
                    done.append((name, size, count))
        if stream is not None:
            stream.close()
            done.append((name, size, count))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
                names=["file", "bytes", "records"],
            )

    return write


def plan_records(pages, least_bytes=0):
    """page_id, url, html and refers_to (null for a response) per page."""
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    )
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.withColumn("mark", F.sha1(payload))
    latest = cut(
        rows.filter(F.octet_length(payload) >= least_bytes)
        .groupBy("mark")
        .agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
        .filter("n > 1 and latest is not null")
        .select("mark", "latest")
    )
    older = F.coalesce(F.col("page_id") < F.col("latest"), F.col("latest").isNotNull())
    return rows.join(latest, "mark", "left").select(
        "page_id", "url", "html", F.when(older, F.col("latest")).alias("refers_to")
    )


def write_archives(pages, least_bytes=0, rotate=128 << 20):
    """Write all pages; returns (folder, names of the finished files)."""
    folder = new_folder(pages.sparkSession)
    files = plan_records(pages, least_bytes).mapInArrow(
        _writer(folder, rotate), "file string, bytes long, records long"
    )
    return folder, sorted(r["file"] for r in files.collect())


class _Window:
    """Random access to a stream through one cached window."""

    def __init__(self, stream, size):
        self.stream, self.size, self.at, self.data = stream, size, 0, b""

    def read(self, start, length):
        if start < self.at or start + length > self.at + len(self.data):
            self.stream.seek(start)
            self.at, self.data = start, self.stream.read(max(length, WINDOW))
        return self.data[start - self.at : start - self.at + length]


def _inflate(window, start, limit=None):
    """(bytes, end) of the member at `start`; None as end if it was cut at `limit`."""
    inflater, at, out = zlib.decompressobj(31), start, []
    while not inflater.eof:
        chunk = window.read(at, min(1 << 16, window.size - at))
        if not chunk:
            raise ValueError("member is cut off")
        out.append(inflater.decompress(chunk))
        at += len(chunk)
        if limit and sum(map(len, out)) >= limit:
            return b"".join(out), None
    return b"".join(out), at - len(inflater.unused_data)


def _parse_header(head):
    lines = head.decode("utf-8").split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise ValueError("no version line")
    fields = dict(line.split(":", 1) for line in lines[1:] if line)
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    return fields, int(fields["content-length"])


def _check(fields, block):
    """The record's payload after all checks of its block."""
    want = fields.get("warc-block-digest")
    if want and want != "sha1:" + digest(block):
        raise ValueError("block digest differs")
    payload = block.partition(b"\r\n\r\n")[2] if "http" in fields.get("content-type", "") else block
    mark = fields.get("warc-payload-digest")
    if fields.get("warc-type") != "revisit" and mark and mark != "sha1:" + digest(payload):
        raise ValueError("payload digest differs")
    return payload


def _record(data):
    """(fields, payload) of one whole record."""
    if not data.startswith(VERSION):
        raise ValueError("no version line")
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no header end")
    fields, length = _parse_header(head)
    if length < 0 or rest[length:] != b"\r\n\r\n":
        raise ValueError("length differs")
    return fields, _check(fields, rest[:length])


def _plain(window, start):
    """(fields, payload, end) of the uncompressed record at `start`."""
    head = window.read(start, min(HEADER_LIMIT, window.size - start))
    if not head.startswith(VERSION):
        raise ValueError("no version line")
    head, found, _ = head.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no header end")
    fields, length = _parse_header(head)
    begin = start + len(head) + 4
    if length < 0 or begin + length + 4 > window.size:
        raise ValueError("record is cut off")
    if window.read(begin + length, 4) != b"\r\n\r\n":
        raise ValueError("length differs")
    return fields, _check(fields, window.read(begin, length)), begin + length + 4


def _starts(window, start, mark):
    """Positions of a mark from `start` on."""
    at = start
    while at < window.size:
        data = window.read(at, min(WINDOW, window.size - at))
        found = data.find(mark)
        while found >= 0:
            yield at + found
            found = data.find(mark, found + 1)
        at += max(1, len(data) - len(mark) + 1)
        if len(data) < len(mark):
            return


def _next_start(window, start, packed):
    """The next member that opens with a version line, or plain version line with a header."""
    for at in _starts(window, start, MAGIC if packed else VERSION):
        try:
            if packed:
                if _inflate(window, at, len(VERSION))[0].startswith(VERSION):
                    return at
            else:
                head = window.read(at, min(HEADER_LIMIT, window.size - at)).partition(b"\r\n\r\n")
                if head[1]:
                    _parse_header(head[0])
                    return at
        except (ValueError, KeyError, zlib.error):
            continue
    return window.size


def salvage(stream, size):
    """Records and gaps of a file in order: (kind, start, end, reason, fields, payload)."""
    window, at = _Window(stream, size), 0
    packed = window.read(0, min(3, size)).startswith(b"\x1f\x8b")
    if not packed and size:
        packed = next(_starts(window, 0, VERSION), None) is None
    while at < size:
        end = None
        try:
            if packed:
                data, end = _inflate(window, at)
                fields, payload = _record(data)
            else:
                fields, payload, end = _plain(window, at)
            yield "record", at, end, None, fields, payload
        except (ValueError, KeyError, zlib.error) as failed:
            end = end or _next_start(window, at + 1, packed)
            yield "gap", at, end, str(failed), {}, None
        at = end


def _number(fields, name):
    value = fields.get(name)
    return int(value) if value is not None else None


def _reader(folder, files, payloads):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    schema = pa.schema(
        [
            (n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t])
            for n, t in (f.split() for f in SCHEMA.split(", "))
        ]
    )

    def batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(names))], schema=schema
        )

    def read(batches):
        for numbers in batches:
            for k in numbers.column(0).to_pylist():
                size, rows, held = file_size(folder, files[k]), [], 0
                with open_input(folder, files[k]) as stream:
                    for kind, start, end, reason, fields, payload in salvage(stream, size):
                        mark = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        length = _number(fields, "x-payload-length")
                        if payload is not None and fields.get("warc-type") != "revisit":
                            mark, length = digest(payload), len(payload)
                        kept = payload if payloads else None
                        rows.append(
                            (kind, files[k], start, end, reason, fields.get("warc-type"), fields.get("warc-target-uri"),
                             _number(fields, "x-page-id"), length, mark, _number(fields, "x-refers-to-page"), kept)
                        )
                        held += len(kept or b"")
                        if len(rows) >= 2000 or held >= 8_000_000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return read


def read_archives(spark, folder, files, payloads=False):
    """Records and logged gaps of the files, one file a task (kind: record or gap)."""
    if not files:
        return spark.createDataFrame([], SCHEMA)
    return spark.range(0, len(files), 1, len(files)).mapInArrow(_reader(folder, list(files), payloads), SCHEMA)

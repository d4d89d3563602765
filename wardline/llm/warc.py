"""WARC archives: a writer that Spark commits, and a reader that salvages damaged ones.

An archive is a file of gzip members, one for each record (or of plain
records).  The reader checks every record: member checksum, header, length,
trailing blank lines, block and payload digest.  Where a check fails it looks
for the next member or version line from which a whole record can be read, goes
on there, and logs the bytes between as quarantined.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha1
from urllib.parse import quote
from uuid import UUID

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import Batches, emit, give_back_memory, long_id, materialize, rows_of_batches

LEAST_REVISIT = 1000
BYTES_IN_ARCHIVE = 16 << 20
BYTES_IN_MEMBER = 8 << 20
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC, _MARK, _LINE, _BLANK = b"\x1f\x8b\x08", b"WARC/", b"\r\n", b"\r\n\r\n"
_VERSION_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
MOST_HEADER = 1 << 20


# --- writing -----------------------------------------------------------------------------------------------------


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1(data).digest()).decode()


def _hex(named: str) -> str:
    """Lower-case hex of a digest as archives name it (base 32 or hex)."""
    text = named.split(":", 1)[-1].strip()
    try:
        return base64.b32decode(text.upper()).hex() if len(text) == 32 else text.lower()
    except ValueError:
        return text.lower()


def record_id(page_id: int, payload_sha1: bytes) -> str:
    """The same URI for the same page and payload, so that a repeated task writes the same archive."""
    return f"<urn:uuid:{UUID(bytes=sha1(b'%d/' % page_id + payload_sha1).digest()[:16], version=5)}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _BLANK + block + _BLANK


def page_record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response, or a revisit of page ``refers_to`` which holds the same payload; both keep the HTTP header."""
    raw = sha1(payload).digest()
    digest = "sha1:" + base64.b32encode(raw).decode()
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, raw)),
              ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("Page-Id", str(page_id))]
    block = http
    if refers_to is None:
        block = http + payload
    else:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, raw)), ("Refers-To-Page-Id", str(refers_to))]
    return _record([*fields, ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response")], block)


def gzip_members(record: bytes) -> bytes:
    """One member for a record, several for one of over ``BYTES_IN_MEMBER``; so the last byte, the size's highest, is always 0."""
    out = []
    for at in range(0, len(record), BYTES_IN_MEMBER):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(packer.compress(record[at : at + BYTES_IN_MEMBER]) + packer.flush())
    return b"".join(out)


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload of ``least`` bytes or more a larger page_id holds as well.

    Payloads are compared by SHA-256 and length; only hashes and ids move, and
    copies of one payload are reduced to one row in each task before they meet.
    """
    ids = pages.where(F.octet_length("html") >= least).select("page_id", F.unhex(F.sha2("html", 256)).alias("digest")).distinct()
    last = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return ids.join(last, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to")


def write_archives(
    pages: DataFrame, path: str, compressed: bool = True, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    least_revisit: int = LEAST_REVISIT, bytes_in_archive: int = BYTES_IN_ARCHIVE,
) -> None:
    """A record for every page, in archives below ``path`` of about ``bytes_in_archive`` payload bytes.

    A null html is an empty payload; rows without an id are left out; repeated
    rows are records of their own.  Of equal payloads of ``least_revisit`` bytes
    or more the largest page_id is the response (every row of that id is), the
    others revisit it.  Spark's text writer commits the files: what stands
    between two rows, a zero byte or two blank lines, is the end of a record.
    """
    rows = pages.select(
        long_id(id_column, "page_id"), F.col(f"`{url_column}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_column}`").cast("string"), F.lit("")).alias("html")).where("page_id IS NOT NULL")
    known = materialize(revisits(rows, least_revisit), "revisits")
    total = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    keyed = rows.withColumn("digest", F.when(F.octet_length("html") >= least_revisit, F.unhex(F.sha2("html", 256))))
    joined = keyed.join(known, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    schema = pa.schema([("record", pa.binary())])

    def records(batches: Batches) -> Iterator[pa.RecordBatch]:
        info = b"software: Spark\r\nformat: WARC File Format 1.1\r\n"
        first = _record([
            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(0, b"info")), ("WARC-Date", DATE), ("WARC-Block-Digest", _digest(info)),
            ("Content-Type", "application/warc-fields")], info)
        ends = 1 if compressed else len(_BLANK)
        for part in rows_of_batches(batches, size=4 << 20):
            made = [first] if first else []
            first = None
            for row in part.to_pylist():
                made.append(page_record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"]))
            yield emit(schema, record=[(gzip_members(r) if compressed else r)[:-ends] for r in made])

    parts = max(1, -(-total // bytes_in_archive))
    out = joined.repartition(parts, "page_id").mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    separator = "\0" if compressed else "\r\n\r\n"
    out.write.option("lineSep", separator).text(path)


# --- reading -----------------------------------------------------------------------------------------------------


@dataclass
class Found:
    """A record of an archive, or (with ``problem``) a gap of bytes that belong to no whole record."""

    offset: int
    length: int
    problem: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


class _Bad(ValueError):
    """A check that failed; ``end``: where the damaged record ends, if its frame is whole."""

    def __init__(self, problem: str, end: int | None = None):
        super().__init__(problem)
        self.problem, self.end = problem, end


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and where it ends; zlib checks its CRC and size."""
    if not data.startswith(_MAGIC, at):
        raise _Bad("no member")
    unpack, parts, step = zlib.decompressobj(31), [], 1 << 16
    here = at
    try:
        while not unpack.eof:
            if here >= len(data):
                raise _Bad("cut off")
            parts.append(unpack.decompress(data[here : here + step]))
            here += step
    except zlib.error:
        raise _Bad("member checksum") from None
    return b"".join(parts), min(here, len(data)) - len(unpack.unused_data)


def _parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and end of the record at ``at``; ``IndexError`` if the data end before it does."""
    head = data[at : at + len(_MARK)]
    if head != _MARK:
        raise IndexError if _MARK.startswith(head) else _Bad("no version line")
    stop = data.find(_BLANK, at, at + MOST_HEADER)
    if stop < 0:
        raise _Bad("header") if len(data) >= at + MOST_HEADER else IndexError
    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            fields.setdefault(last, value.strip())
        else:
            raise _Bad("header")
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or "warc-type" not in fields:
        raise _Bad("header")
    begin, end = stop + 4, stop + 4 + int(size)
    if end + 4 > len(data):
        raise IndexError
    if data[end : end + 4] != _BLANK:
        raise _Bad("length")
    block = data[begin:end]
    if "warc-block-digest" in fields and not _agrees(fields["warc-block-digest"], block):
        raise _Bad("block digest", end + 4)
    if fields["warc-type"] == "response" and "warc-payload-digest" in fields and not _agrees(fields["warc-payload-digest"], payload(fields, block)):
        raise _Bad("payload digest", end + 4)
    return fields, block, end + 4


def _agrees(named: str, data: bytes) -> bool:
    """Whether a SHA-1 digest is that of ``data``; other kinds are not checked."""
    return not named.lower().startswith("sha1:") or _hex(named) == sha1(data).hexdigest()


def payload(fields: dict[str, str], block: bytes) -> bytes:
    """The HTTP body of a response, else the block."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.split(_BLANK, 1)[1] if _BLANK in block else b""
    return block


def _whole(data: bytes, at: int) -> list[Found]:
    """The records that begin at ``at``: a plain one, or those of one member (and of the next ones, if a record spans them)."""
    if not data.startswith(_MAGIC, at):
        try:
            fields, block, end = _parsed(data, at)
        except IndexError:
            raise _Bad("cut off") from None
        return [Found(at, end - at, None, fields, block)]
    content, end = _member(data, at)
    found, begin = [], 0
    while begin < len(content) or not found:
        try:
            fields, block, stop = _parsed(content, begin)
        except IndexError:  # the record goes on in the next member
            try:
                more, end = _member(data, end)
            except _Bad:
                raise _Bad("cut off") from None
            content += more
            continue
        except _Bad as bad:
            raise _Bad(bad.problem, end if bad.end == len(content) else None) from None
        found.append(Found(at, 0, None, fields, block))
        begin = stop
    found[-1].length = end - at
    return found


def _next_start(raw: bytes, at: int) -> int:
    """The next place from ``at`` on where a member or a version line may begin; the end without one."""
    member, line = raw.find(_MAGIC, at), _VERSION_LINE.search(raw, at)
    return min([x for x in (member, line.start() if line else -1) if x >= 0], default=len(raw))


def salvage_bytes(raw: bytes) -> Iterator[Found]:
    """Records and gaps of an archive in the order of their bytes; together they cover all of it."""
    at, gap, why = 0, None, ""
    while at < len(raw):
        try:
            found = _whole(raw, at)
        except _Bad as bad:
            if gap is None:
                gap, why = at, bad.problem
            # a whole frame with a wrong digest ends where it says, if a record or nothing follows
            if bad.end is not None and (bad.end == len(raw) or _next_start(raw, bad.end) == bad.end):
                at = bad.end
            else:
                at = _next_start(raw, at + 1)
            continue
        if gap is not None:
            yield Found(gap, at - gap, why)
            gap = None
        yield from found
        at += found[-1].length
    if gap is not None:
        yield Found(gap, len(raw) - gap, why)


_ROW = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("problem", pa.string()), ("record_type", pa.string()),
    ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("fields", pa.map_(pa.string(), pa.string())),
    ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
_ROW_DDL = (
    "archive string, offset long, length long, problem string, record_type string, record_id string, target_uri string, date string, "
    "fields map<string,string>, payload binary, payload_bytes long, payload_digest string")


def _row(archive: str, f: Found, with_payload: bool) -> dict:
    row = dict.fromkeys(_ROW.names) | {"archive": archive, "offset": f.offset, "length": f.length, "problem": f.problem}
    if f.problem is None:
        kind, body = f.fields["warc-type"], payload(f.fields, f.block)
        size, digest = len(body), sha1(body).hexdigest()
        if kind == "revisit":  # what the record says of the payload it does not hold
            head = f.block.split(_BLANK, 1)[0].decode("latin-1").lower().split("\r\n")
            sizes = [h.split(":", 1)[1].strip() for h in head if h.startswith("content-length:")]
            size = int(sizes[0]) if sizes and sizes[0].isdigit() else None
            named = f.fields.get("warc-payload-digest")
            digest = _hex(named) if named else None
        row |= {
            "record_type": kind, "record_id": f.fields.get("warc-record-id"), "target_uri": f.fields.get("warc-target-uri"),
            "date": f.fields.get("warc-date"), "fields": list(f.fields.items()), "payload": body if with_payload else None,
            "payload_bytes": size, "payload_digest": digest}
    return row


def salvage(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record and each gap of ``archives`` (columns path, content).

    archive, offset, length (bytes in the file; of several records in one
    member the last bears its length), problem (null for a record; else the
    check that failed where the gap begins), record_type, record_id, target_uri,
    date, fields (the header, names in lower case), payload, payload_bytes and
    payload_digest (hex SHA-1; of a revisit those it states).  Null or empty
    content gives no row.
    """
    def read(batches: Batches) -> Batches:
        for batch in batches:
            for n in range(batch.num_rows):
                path, raw = batch.column("path")[n].as_py(), batch.column("content")[n].as_py() or b""
                held, size = [], 0
                for f in salvage_bytes(raw):
                    held.append(_row(path, f, with_payload))
                    size += len(f.block) if with_payload else 200
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=_ROW)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_ROW)
        give_back_memory()

    return archives.select("path", "content").mapInArrow(read, _ROW_DDL)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """``salvage`` of all files below ``path``; a task holds archives of ``maxPartitionBytes`` at once, or one that is larger."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return salvage(files, with_payload)


def records(found: DataFrame) -> DataFrame:
    return found.where("problem IS NULL")


def quarantine_log(found: DataFrame) -> DataFrame:
    """The gaps: archive, offset, length, problem."""
    return found.where("problem IS NOT NULL").select("archive", "offset", "length", "problem")


def resolved(found: DataFrame) -> DataFrame:
    """Records with revisits given the payload of the response they refer to (null if it is not among them)."""
    whole = records(found)
    held = whole.where("record_type = 'response'").select(F.col("record_id").alias("held_id"), F.col("payload").alias("held")).dropDuplicates(["held_id"])
    joined = whole.withColumn("held_id", F.when(F.col("record_type") == "revisit", F.col("fields").getItem("warc-refers-to"))).join(held, "held_id", "left")
    return joined.withColumn("payload", F.coalesce("held", F.when(F.col("record_type") != "revisit", F.col("payload")))).drop("held", "held_id")


def pages_of(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the pages among the records."""
    def number(name: str) -> Column:
        return F.col("fields").getItem(name).try_cast("long")

    return records(found).where("record_type IN ('response', 'revisit')").select(
        number("page-id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers-to-page-id").alias("refers_to"))


def oracle(least: int = LEAST_REVISIT) -> str:
    """The same rows from the table alone, as DuckDB SQL."""
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
    last AS (SELECT html, max(page_id) AS keeper FROM p GROUP BY html)
    SELECT page_id, CAST(octet_length(CAST(encode(html) AS BLOB)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
           CASE WHEN octet_length(encode(html)) >= {least} AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN octet_length(encode(html)) >= {least} AND page_id < keeper THEN keeper END AS refers_to
    FROM p JOIN last USING (html)"""

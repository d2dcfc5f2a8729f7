"""Converter from the legacy ARC archive format to WARC, with readers and writers for both.

An ARC file opens with a version block; its line gives the fields of the header line of every record. Version 1 has
URL, address, date, type and length; version 2 adds result code, checksum, location, offset and file name. The content
follows at the declared length. The converter makes of each record a WARC record: identifiers from the file's content
and place (so a repeated task makes the same), the date in its newer form, the type (HTTP responses are ``response`` or
``revisit``, others ``resource``), and SHA-256 digests of block and payload.

Records are compressed one by one, so an index of (file, offset) reaches each. Tasks write under names of their own and
report them; the reports are the list of files. Revisits are settled by a shuffle on digests between reading an archive
and writing the new one: of equal payloads of at least ``REVISIT_BYTES`` the record with the smallest page id is the
response.

Defined results: a null html is an empty payload; a null url or one with spaces is percent-coded into the header line
and decoded again (null as ``-``); a null page id sorts after all others and is not referred to by a number; repeated
rows are records of their own, of which one (the first in its file) is the response; an empty table gives no files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, materialise, shared_dir, table, unique_name

#: Fixed values of the two formats.
FIELDS_1 = "URL IP-address Archive-date Content-type Archive-length"
FIELDS_2 = ("URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length")
VERSIONS = {1: FIELDS_1, 2: FIELDS_2}
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_BYTES = 100
ROW_HEADER = "X-Page-Id"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space for URLs
_SCAN = 1 << 20


def gzip_member(raw: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def members(stream, first: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each compressed record of an open file, one in memory at a time."""
    stream.seek(first)
    at, rest = first, b""
    while True:
        if not rest:
            rest = stream.read(_SCAN)
            if not rest:
                return
        unpacker, parts, size = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not rest:
                rest = stream.read(_SCAN)
                if not rest:
                    raise ValueError(f"record at {at} is cut off")
            parts.append(unpacker.decompress(rest))
            size += len(rest)
            rest = unpacker.unused_data
        yield at, b"".join(parts)
        at += size - len(rest)


def url_field(url: str | None) -> str:
    if url is None:
        return "-"
    return "".join(c if "!" <= c <= "~" and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass"))
                   for c in url) if url not in ("", "-") else {"": "%", "-": "%2D"}[url]


def url_value(field: str) -> str | None:
    from urllib.parse import unquote
    return None if field == "-" else "" if field == "%" else unquote(field)


@dataclass(frozen=True)
class ArcRecord:
    url: str | None
    address: str
    date: str
    kind: str
    status: int | None
    content: bytes


def arc_record(version: int, url: str | None, date: str, kind: str, content: bytes, *, address: str = "0.0.0.0",
               status: str = "200", file: str = "-", offset: int = 0) -> bytes:
    """A record: header line, content and the line break after it."""
    head = [url_field(url), address, date, kind]
    if version == 2:
        head += [status, hashlib.sha1(content).hexdigest(), "-", str(offset), file]
    return " ".join([*head, str(len(content))]).encode() + b"\n" + content + b"\n"


def arc_version(version: int, name: str, date: str) -> bytes:
    """The version block that opens a file."""
    body = f"{version} 0 none\n{VERSIONS[version]}\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body + b"\n"


def parse_version(raw: bytes) -> list[str]:
    """The header fields that a version block declares."""
    head, _, body = raw.partition(b"\n")
    if not head.startswith(b"filedesc://"):
        raise ValueError("an ARC file opens with a version block")
    number, fields = body.decode("latin-1").split("\n")[:2]
    if fields.split(" ") != VERSIONS.get(int(number.split(" ")[0]), "").split(" "):
        raise ValueError(f"unknown ARC version: {number}")
    return fields.split(" ")


def parse_arc(raw: bytes, fields: list[str]) -> ArcRecord:
    """One record by the fields of its file's version; the content has the declared length."""
    line, _, rest = raw.partition(b"\n")
    values = line.decode("latin-1").split(" ")
    if len(values) != len(fields):
        raise ValueError(f"header line has {len(values)} fields, not {len(fields)}")
    head = dict(zip(fields, values))
    size = int(head["Archive-length"])
    if len(rest) < size:
        raise ValueError("record is shorter than its declared length")
    status = head.get("Result-code")
    return ArcRecord(url_value(head["URL"]), head["IP-address"], head["Archive-date"], head["Content-type"],
                     int(status) if status and status.isdigit() else None, rest[:size])


def payload_of(content: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(HTTP head, its fields, payload) of a record's content; content without an HTTP head is all payload."""
    if content.startswith(b"HTTP/"):
        head, gap, body = content.partition(b"\r\n\r\n")
        if gap:
            lines = head.decode("latin-1").split("\r\n")[1:]
            return head + gap, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body
    return b"", {}, content


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*fields, ("Content-Length", str(len(block)))])
    return WARC_VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.decode().lower(): v.decode().strip() for k, _, v in (x.partition(b":") for x in lines)}
    return fields, rest[:int(fields["content-length"])]


def convert(record: ArcRecord, place: str, digest: str, refers_to: tuple[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record. ``refers_to``: identifier and page id of the response with the same payload."""
    head, _, _ = payload_of(record.content)
    d = record.date.ljust(14, "0")
    fields = [("WARC-Type", "revisit" if refers_to else "response" if head else "resource"),
              ("WARC-Record-ID", record_id(place)),
              ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
              ("WARC-Target-URI", url_field(record.url)), ("WARC-IP-Address", record.address)]
    block = head if refers_to else record.content
    if refers_to:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to[0])]
        if refers_to[1]:
            fields.append(("WARC-Refers-To-Page", refers_to[1]))
    fields += [("Content-Type", "application/http;msgtype=response" if head else record.kind),
               ("WARC-Payload-Digest", f"sha256:{digest}"),
               ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    return warc_record(fields, block)


def record_id(place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, place)}>"


def pages_to_arc(pages: DataFrame, folder: str, version: int = 2, date: str = "20240101000000", id_col: str = "page_id",
                 url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write an ARC record per page; returns (path, records). The page id travels as an HTTP field."""
    rows = pages.select(pages[f"`{id_col}`"].cast("bigint").alias("page_id"), pages[f"`{url_col}`"].alias("url"),
                        pages[f"`{html_col}`"].cast("binary").alias("html"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        stream, n = None, 0
        for batch in batches:
            for i, url, html in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html")]):
                if stream is None:
                    fs, at = file_system(folder)
                    fs.create_dir(at, recursive=True)
                    name = unique_name(TaskContext.get().partitionId(), ".arc.gz")
                    stream = fs.open_output_stream(f"{at}/{name}", compression=None)
                    stream.write(gzip_member(arc_version(version, name, date)))
                page = "" if i is None else f"{ROW_HEADER}: {i}\r\n"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}\r\n".encode()
                stream.write(gzip_member(arc_record(version, url, date, "text/html", http + (html or b""), file=name,
                                                    offset=stream.tell())))
                n += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})

    return materialise(rows.mapInArrow(run, "path string, records bigint"))


def _one_each(files: DataFrame) -> DataFrame:
    """The paths, each in a task of its own: small rows that stand for large files must not be put together."""
    return files.select("path").repartition(max(1, files.count()))


def arc_index(files: DataFrame) -> DataFrame:
    """(path, offset, page_id, bytes, digest) of every record but the version blocks."""
    schema = "path string, offset bigint, page_id bigint, bytes bigint, digest string"

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = file_system(path)
                with fs.open_input_file(at) as stream:
                    found, out = members(stream), []
                    fields = parse_version(next(found)[1])
                    for offset, raw in found:
                        _, head, payload = payload_of(parse_arc(raw, fields).content)
                        page = head.get(ROW_HEADER.lower())
                        out.append((path, offset, int(page) if page else None, len(payload),
                                    hashlib.sha256(payload).hexdigest()))
                columns = list(zip(*out)) or [()] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 ["path", "offset", "page_id", "bytes", "digest"])

    return _one_each(files).mapInArrow(run, schema)


def revisits(index: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(path, offset, to_path, to_offset, to_page) of each record that repeats another's payload."""
    order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.col("path").alias("c"),
                     F.col("offset").alias("d"))
    large = index.where(F.col("bytes") >= least)
    heads = large.groupBy("digest").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return large.join(heads, "digest").where(order != F.col("head")).select(
        "path", "offset", F.col("head.c").alias("to_path"), F.col("head.d").alias("to_offset"),
        F.col("head.b").alias("to_page"))


def arc_to_warc(files: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Convert ARC files to WARC files below ``folder``; returns (path, records). Runs two jobs when called."""
    index = materialise(arc_index(files))
    # every record comes along in file order, a revisit with what it refers to, so that a task holds one at a time
    plan = index.join(revisits(index, least), ["path", "offset"], "left").select(
        "path", "offset", "digest", "to_path", "to_offset", "to_page")
    plan = plan.repartition(max(1, files.count()), "path").sortWithinPartitions("path", "offset")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        stream, n, path, found = None, 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path = row["path"]
                    fs, at = file_system(path)
                    source = fs.open_input_file(at)
                    found = members(source)
                    fields = parse_version(next(found)[1])
                if stream is None:
                    fs, at = file_system(folder)
                    fs.create_dir(at, recursive=True)
                    name = unique_name(TaskContext.get().partitionId(), ".warc.gz")
                    stream = fs.open_output_stream(f"{at}/{name}", compression=None)
                    info = b"software: trafficlens\r\nformat: WARC File Format 1.1\r\n"
                    stream.write(gzip_member(warc_record(
                        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)),
                         ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], info)))
                offset, raw = next(found)
                if offset != row["offset"]:
                    raise ValueError(f"{path}: record expected at {row['offset']}, found at {offset}")
                to = row["to_path"] and (record_id(f"{row['to_path']}@{row['to_offset']}"),
                                         "" if row["to_page"] is None else str(row["to_page"]))
                stream.write(gzip_member(convert(parse_arc(raw, fields), f"{path}@{offset}", row["digest"], to or None)))
                n += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})

    return materialise(plan.mapInArrow(run, "path string, records bigint"))


def read_warc(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of WARC files but the warcinfo ones; ``bytes`` and the payload are null for revisits."""
    schema = ("record_id string, page_id bigint, url string, date string, record_type string, bytes bigint, digest string,"
              " refers_to_id string, refers_to bigint" + ", payload binary" * with_payload)

    def run(batches):
        import pyarrow as pa
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        shape = pa.schema([(c, kinds[k]) for c, k in (x.split() for x in schema.split(","))])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = file_system(path)
                with fs.open_input_file(at) as stream:
                    out = []
                    for _, raw in members(stream):
                        head, block = parse_warc(raw)
                        kind = head["warc-type"]
                        if kind == "warcinfo":
                            continue
                        if hashlib.sha256(block).hexdigest() != head["warc-block-digest"].partition(":")[2]:
                            raise ValueError(f"{path}: the block of {head['warc-record-id']} is damaged")
                        _, http, payload = payload_of(block)
                        page, whole = http.get(ROW_HEADER.lower()), kind != "revisit"
                        out.append({"record_id": head["warc-record-id"], "page_id": int(page) if page else None,
                                    "url": url_value(head["warc-target-uri"]), "date": head["warc-date"],
                                    "record_type": kind, "bytes": len(payload) if whole else None,
                                    "digest": head["warc-payload-digest"].partition(":")[2],
                                    "refers_to_id": head.get("warc-refers-to"),
                                    "refers_to": int(head["warc-refers-to-page"]) if "warc-refers-to-page" in head else None}
                                   | ({"payload": payload if whole else None} if with_payload else {}))
                        if len(out) >= 256:
                            yield pa.RecordBatch.from_pylist(out, schema=shape)
                            out = []
                    yield pa.RecordBatch.from_pylist(out, schema=shape)

    return _one_each(files).mapInArrow(run, schema)


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    arcs = pages_to_arc(table(spark, sf_dir, "pages"), f"{folder}/arc")
    records = materialise(read_warc(arc_to_warc(arcs, f"{folder}/warc")))
    # a revisit has no payload of its own: its size is that of the response it refers to
    referred = records.where("record_type = 'revisit'").select("refers_to_id").distinct()
    sizes = records.select(F.col("record_id").alias("refers_to_id"), F.col("bytes").alias("full")).join(
        referred, "refers_to_id")
    return records.join(sizes, "refers_to_id", "left").select(
        "page_id", F.coalesce("bytes", "full").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", "refers_to")

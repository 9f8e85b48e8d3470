"""Conversion of legacy ARC archives to WARC, and both formats' readers and writers.

ARC header lines are parsed by the version that the file's first block names
(five fields in version 1, ten in version 2), and the declared length tells
where the record ends. For WARC, identifiers, timestamps, types and digests are
made from what ARC has. Records of equal payloads become revisits of one.

Archives are files of records whose payloads make up about ``SEGMENT_BYTES``,
each record a gzip member of its own. Spark's text writer makes them, one row a
file, so they go to whatever store the shared folder is in; its rows are bytes,
so payloads may be in any encoding or in none. They are read as binary files, one
at a time, and named as Spark names its files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, new_path, ship, stage

SEGMENT_BYTES = 16 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT_BYTES = 1000
#: When pages carry no time of capture.
CAPTURED = "20240101000000"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"


def http_response(page_id, payload: bytes) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_version_block(name: str, version: int) -> bytes:
    body = f"{version} 0 loomtab\n{V1_FIELDS if version == 1 else V2_FIELDS}\n".encode()
    extra = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain {extra}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str | None, block: bytes, ip: str = "0.0.0.0", date: str = CAPTURED, kind: str = "text/html") -> bytes:
    place = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "about:blank"
    extra = "" if version == 1 else f"200 - - {offset} {name} "
    return f"{place} {ip} {date} {kind} {extra}{len(block)}\n".encode() + block + b"\n"


def header_text(line: bytes) -> str:
    """A header line as text; where it isn't UTF-8, its bytes beyond ASCII as in a URL."""
    try:
        return line.decode().strip()
    except UnicodeDecodeError:
        return "".join(chr(b) if b < 128 else f"%{b:02X}" for b in line).strip()


def parse_arc(data: bytes) -> Iterator[dict]:
    """url, ip, date, type and block of each record after the version block."""
    at, version = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0 or not (line := header_text(data[at:end])):
            at = len(data) if end < 0 else end + 1
            continue
        fields = line.split(" ")
        length = int(fields[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"the record of {fields[0]} ends before its declared length")
        at = end + 1 + length
        if version is None:
            if not fields[0].startswith("filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            version = int(block.split(b" ", 1)[0])
            if version not in (1, 2):
                raise ValueError(f"no ARC version {version} is known")
            continue
        if len(fields) != (5 if version == 1 else 10):
            raise ValueError(f"a header of ARC version {version} has other fields: {line[:200]}")
        yield {"url": fields[0], "ip": fields[1], "date": fields[2], "type": fields[3], "block": block}


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header, with the empty line, and payload of an HTTP message; without such a header all is payload."""
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if block.startswith(b"HTTP/") and end >= 0 else (b"", block)


def header(head: bytes, name: str) -> str | None:
    m = re.search(rb"^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r$", head, re.M | re.I)
    return m[1].decode("utf-8", "replace") if m else None


def labelled(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_type(url: str, head: bytes) -> str:
    return "response" if head or url.startswith("dns:") else "resource"


def warc_date(date: str) -> str:
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() and len(date) >= 4 else CAPTURED
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, record_id: str, url: str | None, date: str, block: bytes, payload_digest: str | None, content_type: str, ip: str | None = None, original: tuple[str, str, str] | None = None) -> bytes:
    """A WARC record; original is the identifier, URI and date of the record that a revisit refers to."""
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-IP-Address", ip),
        ("WARC-Payload-Digest", payload_digest), ("WARC-Block-Digest", labelled(hashlib.sha1(block).digest())),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{original[0]}>"), ("WARC-Refers-To-Target-URI", original[1]), ("WARC-Refers-To-Date", original[2])] if original else []),
        ("Content-Type", content_type), ("Content-Length", str(len(block))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"


def warc_info(name: str, date: str) -> bytes:
    """The record that opens a WARC file."""
    block = f"software: loomtab\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
    return warc_record("warcinfo", str(uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {name}")), None, date, block, None, "application/warc-fields")


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of each record."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        if not data.startswith(b"WARC/", at):
            raise ValueError("a WARC record begins with its version")
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end]
        length = int(header(head, "Content-Length"))
        yield head, data[end : end + length]
        at = end + length + 4


class Archive:
    """Collects a task's records, each a gzip member, and gives them out as files."""

    def __init__(self, task: int, opening):
        self.task, self.opening, self.number, self.held, self.size = task, opening, 0, [], 0

    def name(self) -> str:
        return f"{self.task:06d}-{self.number:05d}"

    def add(self, record: bytes) -> bool:
        """Whether the archive is full with this record."""
        if not self.held:
            self.held.append(gzip.compress(self.opening(self.name()), 6, mtime=0))
        self.held.append(gzip.compress(record, 6, mtime=0))
        self.size += len(record)
        return self.size > SEGMENT_BYTES

    def taken(self) -> pa.RecordBatch:
        # The writer ends each row with a zero byte, as does a gzip member of under 16 MB; an empty one is added for longer records.
        if self.held[-1][-1]:
            self.held.append(gzip.compress(b"", mtime=0))
        whole = pa.RecordBatch.from_arrays([pa.array([b"".join(self.held)[:-1]], pa.binary())], names=["value"])
        self.number, self.held, self.size = self.number + 1, [], 0
        return whole


def write_archives(rows: DataFrame, run, path: str) -> None:
    """Write the files that run makes, one a row."""
    made = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """name and content of each archive in path; tasks without records leave none, or an empty one."""
    read = spark.read.format("binaryFile").load(path).filter("length > 0")
    return read.select(F.col("path").alias("archive"), "content")


def batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def in_batches(rows, names: list[str], kinds: list[pa.DataType], size) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total > SEGMENT_BYTES // 2:
            yield batch(names, kinds, held)
            held, total = [], 0
    if held:
        yield batch(names, kinds, held)


def pages_to_arc(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as ARC files, of versions 1 and 2 in turn."""
    ship(spark)

    def run(batches):
        from pyspark import TaskContext

        from loomtab.llm import warc as w

        made = w.Archive(TaskContext.get().partitionId(), lambda name: w.arc_version_block(f"{name}.arc", int(name[-1]) % 2 + 1))
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                for page_id, url, html in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html").cast(pa.binary()).to_pylist(), strict=True):
                    if made.add(w.arc_record(made.number % 10 % 2 + 1, f"{made.name()}.arc", made.size, url, w.http_response(page_id, html or b""))):
                        yield made.taken()
        if made.held:
            yield made.taken()

    write_archives(pages.select("page_id", "url", "html"), run, path)


def unpacked(content: bytes) -> bytes:
    """The whole of a file of gzip members; a file that isn't compressed is given back.

    A member's rest is looked for in small pieces, so that no member copies all
    those that follow it.
    """
    if content[:2] != b"\x1f\x8b":
        return content
    out, at = [], 0
    while at < len(content):
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = content[at : at + 8192]
            if not piece:
                raise ValueError("an archive ends within a gzip member")
            out.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
    return b"".join(out)


def arc_records(archive: str, content: bytes) -> Iterator[dict]:
    """The records of an ARC file with what WARC needs: uid, place in the file, url, ip, date, type, HTTP header and payload."""
    name = archive.rsplit("/", 1)[-1]
    for k, r in enumerate(parse_arc(unpacked(content))):
        head, payload = split_http(r["block"])
        uid = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{k}|{r['url']}|{r['date']}"))
        yield r | {"uid": uid, "place": k, "date": warc_date(r["date"]), "kind": warc_type(r["url"], head), "head": head, "payload": payload}


def arc_to_warc(spark: SparkSession, source: str, target: str) -> None:
    """Convert the ARC files in source, compressed or not, to WARC files in target.

    Of records with one payload of LEAST_REVISIT_BYTES or more, that with the
    largest page_id stays (null ids come last; of equal ids the largest uid),
    the others become revisits of it, with their HTTP header as the block.
    Payloads are any bytes. Verdicts are joined to whole archives, not payloads
    to verdicts.
    """
    ship(spark)

    def keys(batches):
        from loomtab.llm import warc as w

        names = ["archive", "place", "uid", "url", "date", "page_id", "sha256"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def rows():
            for b in batches:
                for archive, content in zip(b.column("archive").to_pylist(), b.column("content").to_pylist(), strict=True):
                    for r in w.arc_records(archive, content):
                        if len(r["payload"]) >= w.LEAST_REVISIT_BYTES:
                            page = w.header(r["head"], "X-Page-Id")
                            yield archive, r["place"], r["uid"], r["url"], r["date"], int(page) if page else None, hashlib.sha256(r["payload"]).digest()

        yield from w.in_batches(rows(), names, kinds, lambda r: 200 + len(r[3]))

    all_archives = archives(spark, source)
    known = all_archives.mapInArrow(keys, "archive string, place int, uid string, url string, date string, page_id long, sha256 binary")
    known = stage(spark, known, "payloads")
    chosen = known.groupBy("sha256").agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page"), "uid", "url", "date")).alias("chosen"), F.count("*").alias("n")).filter("n > 1")
    met = join_counted(known.select("archive", "place", "uid", "sha256"), stage(spark, chosen, "chosen"), ["sha256"], known.count()).filter("uid <> chosen.uid")
    # An archive has a bounded number of records of that length.
    verdicts = met.groupBy("archive").agg(F.collect_list(F.struct("place", "chosen.uid", "chosen.url", "chosen.date")).alias("verdicts"))
    joined = all_archives.join(stage(spark, verdicts, "verdicts"), "archive", "left")

    def run(batches):
        from pyspark import TaskContext

        from loomtab.llm import warc as w

        made = w.Archive(TaskContext.get().partitionId(), lambda name: w.warc_info(f"{name}.warc.gz", w.warc_date(w.CAPTURED)))
        for b in batches:
            for archive, content, verdicts in zip(*(b.column(c).to_pylist() for c in ("archive", "content", "verdicts")), strict=True):
                originals = {v["place"]: (v["uid"], v["url"], v["date"]) for v in verdicts or ()}
                for r in w.arc_records(archive, content):
                    original = originals.get(r["place"])
                    record = w.warc_record(
                        "revisit" if original else r["kind"], r["uid"], r["url"], r["date"], r["head"] if original else r["block"], w.labelled(hashlib.sha1(r["payload"]).digest()),
                        "application/http;msgtype=response" if r["head"] else r["type"] if "/" in r["type"] else "application/octet-stream", r["ip"], original,
                    )
                    if made.add(record):
                        yield made.taken()
        if made.held:
            yield made.taken()

    write_archives(joined.select("archive", "content", "verdicts"), run, target)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """uid, page_id, payload_bytes, payload_digest (hex), record_type and refers (a uid) of each record below path.

    The digest of a payload that the archive holds is computed and must be the recorded one.
    """
    ship(spark)

    def run(batches):
        from loomtab.llm import warc as w

        names = ["uid", "page_id", "payload_bytes", "payload_digest", "record_type", "refers"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def rows():
            for b in batches:
                for content in b.column("content").to_pylist():
                    for head, block in w.parse_warc(w.unpacked(content)):
                        kind = w.header(head, "WARC-Type")
                        if kind == "warcinfo":
                            continue
                        message, payload = w.split_http(block)
                        page, size = w.header(message, "X-Page-Id"), w.header(message, "Content-Length")
                        digest = base64.b32decode(w.header(head, "WARC-Payload-Digest")[5:])
                        if kind != "revisit" and hashlib.sha1(payload).digest() != digest:
                            raise ValueError("a payload doesn't have its recorded digest")
                        refers = w.header(head, "WARC-Refers-To")
                        yield (w.header(head, "WARC-Record-ID")[10:-1], int(page) if page else None, int(size) if size else len(payload), digest.hex(), kind, refers[10:-1] if refers else None)

        yield from w.in_batches(rows(), names, kinds, lambda r: 400)

    return archives(spark, path).mapInArrow(run, "uid string, page_id long, payload_bytes long, payload_digest string, record_type string, refers string")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, read back from WARC files.

    Pages go to ARC files, these are converted, and the WARC files are read. A
    null html is an empty payload, a null url stands as about:blank, and a null
    page_id stays null. Equal rows make as many records, of which one is the
    response if they are long enough. Other columns are ignored; an empty table
    gives an empty one.
    """
    source, target = new_path(spark, "arc"), new_path(spark, "warc")
    pages_to_arc(spark, pages, source)
    arc_to_warc(spark, source, target)
    found = stage(spark, read_warc(spark, target), "records")
    responses = found.filter("record_type = 'response'").select(F.col("uid").alias("refers"), F.col("page_id").alias("refers_to"))
    revisits = found.filter("record_type = 'revisit'")
    # A page that very many others repeat is one key.
    named = revisits.groupBy("refers").agg(F.count("*").alias("n")).join(responses, "refers", "left")
    joined = join_counted(revisits, stage(spark, named, "responses"), ["refers"], found.count())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).select(*names).union(joined.select(*names))

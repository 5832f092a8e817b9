"""WARC archives: written from pages in Spark tasks, read back in one pass.

Writing. Equal payloads (by SHA-256) of at least ``LEAST_REVISIT`` bytes are stored once: the page with the least id is a response, the others are
revisit records that name it and repeat its HTTP head without a body. Every record is a gzip member of its own. A task appends to archives of
some ``ARCHIVE_BYTES`` in the shared folder under names no other attempt uses, and hands on one row per archive; only archives listed in that table
count, so what a lost or repeated attempt left behind is never read.

Reading. One archive is one task's work: it is streamed in blocks, each member is inflated incrementally, its head is parsed, and the block is framed
by Content-Length and digested as it arrives. Payload and block digests are compared with those in the head. A record that fails says so in ``fault``; after a
damaged member reading goes on at the next gzip mark, after a cut one it ends. Records of other types (warcinfo, request, metadata) and of other writers are read too.

Nulls: a null html is an empty payload; a null url leaves the target out; a null page id is written without a number, comes after all others and gives null. Repeated rows
are a record each, with equal results: copies of the first page are responses. Blanks and control characters of an url are
percent-encoded. An empty table writes no archive. Other columns go no further. A payload is held by one task at a time, whole only when it is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.session import shared_path

LEAST_REVISIT = 100
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
LEVEL = 6

# Fixed by the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
NO_DATE = "1970-01-01T00:00:00Z"
_GZIP = b"\x1f\x8b\x08"

_ARCHIVES = "path string, n_records long, n_bytes long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, content_type string, archive string, offset long, fault string")


def with_types(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, first): bytes, digest, and the least page id of an equal payload long enough to be revisited. Only digests that come twice are
    joined back, and only their count and minimum are shuffled first."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256))
    groups = p.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n"))
    return p.join(groups.filter("_n > 1").drop("_n"), "digest", "left")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def target(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(fields: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """One gzip member: head, block, two line ends."""
    fields = [*fields, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n"
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, html: bytes, digest: str, first: int | None, date: str = NO_DATE, level: int = LEVEL) -> bytes:
    """Response with its payload, or a revisit with the response's HTTP head alone; ``first`` is the page to refer to, if any."""
    revisit = first is not None and first != page_id
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("Content-Type", HTTP), ("WARC-Payload-Digest", "sha256:" + digest)]
    if url is not None:
        fields.append(("WARC-Target-URI", target(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page-ID", str(first))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    return record(fields, http if revisit else http + html, level)


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write (page_id, url, html) pages to archives under ``folder`` (a URI that workers can open; a fresh one in the shared folder by default) and return the stored table
    of archives (path, n_records, n_bytes)."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        out, path, n, size, k = None, "", 0, 0, 0
        for b in batches:
            for row in zip(*(b.column(c) for c in ("page_id", "url", "html", "digest", "first"))):
                if out is None:
                    path = f"{root}/{name}-{k}.warc.gz"
                    out, n = store.open_output_stream(path, compression=None), 0
                    size = out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, path)), ("WARC-Date", NO_DATE), ("Content-Type", "application/warc-fields")], b"format: WARC file version 1.1\r\n", level))
                size += out.write(page_record(*(v.as_py() for v in row), level=level))
                n += 1
                if size >= archive_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}-{k}.warc.gz", "n_records": n, "n_bytes": size}])
                    out, k = None, k + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}-{k}.warc.gz", "n_records": n, "n_bytes": size}])

    listed = folder + "-archives"
    with_types(pages).mapInArrow(run, _ARCHIVES).write.parquet(listed)
    return spark.read.schema(_ARCHIVES).parquet(listed)


class Members:
    """Bytes of a stream's gzip members, inflated as they are asked for."""

    def __init__(self, stream, block: int = READ_BYTES):
        self.stream, self.block = stream, block
        self.raw, self.at = b"", 0  # compressed bytes not used yet, and where they begin
        self.z, self.plain = None, b""

    def begin(self) -> int | None:
        """Go to the next member; its offset, or None at the end. What the last one still held is passed over."""
        while self.more():
            self.plain = b""
        if not self.raw and not self._read():
            return None
        self.z, self.plain = zlib.decompressobj(31), b""
        return self.at

    def _read(self) -> bool:
        got = self.stream.read(self.block)
        self.raw += got
        return bool(got)

    def more(self) -> bool:
        """Inflate a little more of this member; False at its end. Raises zlib.error where the bytes are damaged, EOFError where they are cut."""
        if self.z is None:
            return False
        if self.z.eof:
            self.z = None
            return False
        if not self.raw and not self._read():
            raise EOFError
        held = len(self.raw)
        out = self.z.decompress(self.raw, self.block)
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        self.at += held - len(self.raw)
        self.plain += out
        return True

    def skip(self) -> bool:
        """After damage: go to the next gzip mark past the member's beginning."""
        self.z, self.plain = None, b""
        self.raw, self.at = self.raw[1:], self.at + min(1, len(self.raw))
        while (k := self.raw.find(_GZIP)) < 0:
            keep = self.raw[-2:]
            self.at += len(self.raw) - len(keep)
            self.raw = keep
            if not self._read():
                return False
        self.raw, self.at = self.raw[k:], self.at + k
        return True

    def line(self) -> bytes:
        """Up to the next line end, which goes too."""
        while b"\r\n" not in self.plain:
            if not self.more():
                line, self.plain = self.plain, b""
                return line
        line, self.plain = self.plain.split(b"\r\n", 1)
        return line

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces; fewer at the member's end."""
        while n:
            if not self.plain and not self.more():
                return
            got, self.plain = self.plain[:n], self.plain[n:]
            n -= len(got)
            yield got


def fields_of(members: Members) -> dict[str, str]:
    """Named fields up to the empty line, names in lower case; folded lines are joined."""
    out, name = {}, None
    while line := members.line():
        if line[:1] in b" \t" and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        k, _, v = line.partition(b":")
        name = k.strip().lower().decode("latin-1")
        out[name] = v.strip().decode("utf-8", "replace")
    return out


def same_digest(named: str, data: "hashlib._Hash") -> bool:
    """A digest as ``algorithm:value``, in hex or base 32 of any case."""
    value = named.partition(":")[2]
    return value.lower() == data.hexdigest() or value.upper().rstrip("=") == base64.b32encode(data.digest()).decode().rstrip("=")


def _hash(named: str | None):
    kind = (named or "sha256:").partition(":")[0].lower().replace("-", "")
    return hashlib.new(kind) if kind in ("sha1", "sha256", "md5", "sha512") else None


def _whole(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,18}", value) else None


def read_record(members: Members, keep: bool) -> dict:
    """One record from a member just begun; ``payload`` holds its bytes if ``keep``."""
    out = {"fault": None, "payload": None}
    if not members.line().startswith(b"WARC/"):
        return out | {"record_type": None, "fault": "version"}
    f = fields_of(members)
    out |= {"page_id": _whole(f.get("x-page-id")), "url": f.get("warc-target-uri"), "record_type": f.get("warc-type"), "refers_to": _whole(f.get("x-refers-to-page-id")), "content_type": f.get("content-type")}
    length = _whole(f.get("content-length"))
    if length is None or length < 0:
        return out | {"fault": "length"}
    block, payload, full = _hash(f.get("warc-block-digest")), _hash(f.get("warc-payload-digest")), hashlib.sha256()
    held, head, n, size = [], b"", 0, 0
    inside = not (f.get("content-type") or "").startswith("application/http")  # past the HTTP head
    for piece in members.take(length):
        n += len(piece)
        if block:
            block.update(piece)
        if not inside:
            head += piece
            if b"\r\n\r\n" not in head:
                continue
            head, piece = head.split(b"\r\n\r\n", 1)
            inside = True
        size += len(piece)
        full.update(piece)
        if payload:
            payload.update(piece)
        if keep:
            held.append(piece)
    if out["record_type"] == "revisit":
        stated = re.search(rb"(?i)\ncontent-length: *([0-9]{1,18})", head)
        digest = f.get("warc-payload-digest", "").partition(":")
        out |= {"payload_bytes": int(stated[1]) if stated else None, "payload_digest": digest[2] if digest[0] == "sha256" else None}
        payload = None
    else:
        out |= {"payload_bytes": size, "payload_digest": full.hexdigest(), "payload": b"".join(held) if keep else None}
    if n < length:
        out["fault"] = "short"
    elif block and "warc-block-digest" in f and not same_digest(f["warc-block-digest"], block):
        out["fault"] = "block digest"
    elif payload and "warc-payload-digest" in f and not same_digest(f["warc-payload-digest"], payload):
        out["fault"] = "payload digest"
    elif b"".join(members.take(4)) != b"\r\n\r\n":
        out["fault"] = "frame"
    return out


def read_stream(stream, keep: bool = False) -> Iterator[dict]:
    """Every record of an archive, in order."""
    members, at = Members(stream), None
    while True:
        try:
            at = members.begin()
            if at is None:
                return
            yield read_record(members, keep) | {"offset": at}
        except EOFError:
            yield {"offset": at, "fault": "cut"}
            return
        except zlib.error:
            yield {"offset": at, "fault": "gzip"}
            if not members.skip():
                return


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the archives under a folder, listed by Spark; contents are not read here."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).select("path")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the archives in ``path``, with their place, and ``payload`` on request (null for revisits)."""
    schema = RECORDS + (", payload binary" if with_payload else "")
    arrow = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                store, name = pafs.FileSystem.from_uri(path)
                held, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for r in read_stream(stream, with_payload):
                        held.append(r | {"archive": path})
                        size += len(r.get("payload") or b"") + 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, arrow)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, arrow)

    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(tasks, "path").mapInArrow(run, schema)


def payloads(records: DataFrame) -> DataFrame:
    """Records read with their payloads; a revisit gets that of the response with its digest."""
    held = records.filter("record_type = 'response' and fault is null").groupBy("payload_digest").agg(F.first("payload").alias("_found"))
    revisits = records.filter("record_type = 'revisit'").join(held, "payload_digest", "left").withColumn("payload", F.col("_found")).select(*records.columns)
    return records.filter("record_type is null or record_type <> 'revisit'").unionByName(revisits)


def digest(records: DataFrame) -> DataFrame:
    """The page records: responses and revisits."""
    return records.filter(F.col("record_type").isin("response", "revisit")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault")

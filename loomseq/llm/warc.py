"""WARC archives: a writer with revisit records and a reader that splits files at any byte.

Every record is a gzip member of its own.  A reading task gets a byte range, looks for the gzip magic in it, validates a place by
decoding there, and owns the records whose members start inside its range; it reads past the end of the range to finish the last
one.  A payload may itself hold members of an archive, as they are: DEFLATE stores bytes in blocks of STORED at most, so such
members follow each other for no more than that.  A place is a member's start if valid members follow each other from it for
longer, or to the file's end; and the range before has checked the same of the place where its own members end.  So records don't
depend on where files are split, and damage is always found.  Files are opened by their URI on the executors, so they can be in
any store that pyarrow's file systems open.

A writing task gives its files names of their own and returns them; only files in the returned manifest count, so a task that is
lost and run again leaves no record twice.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm.cluster import partitions, scratch, written

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
READ_BYTES = 1 << 18
#: The longest stored block of DEFLATE (fixed value).
STORED = 65_535


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None, date: str) -> bytes:
    """One record, not compressed.  A revisit has the HTTP head of its payload only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def first_copies(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(sha1, least): the smallest page_id of each payload of at least so many bytes.  Aggregates before its shuffle."""
    return pages.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("least"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = 1 << 28, level: int = 6, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one record a row and returns the manifest (path, size, records), read back from a written table.

    Of rows with equal payloads of ``least_bytes`` or more, that with the smallest id is a response and the others revisit it;
    smaller ones are all responses.  A null html is an empty payload; a null id never is the smallest; rows that repeat the
    smallest id are all responses.  No rows give no files.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    known = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    known = known.withColumns({"size": F.length("payload").cast("long"), "sha1": F.unhex(F.sha1("payload"))})
    # written, so that the join below is between two plain exchanges, which adaptive execution splits at a very common payload
    first = written(first_copies(known.select("page_id", "size", "sha1"), least_bytes), "warc-first")
    typed = known.join(first, "sha1", "left").select("page_id", "url", "payload", "size", "sha1", F.when((F.col("least") != F.col("page_id")) | F.col("page_id").isNull() & F.col("least").isNotNull(), F.col("least")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        out, path, count, done = None, "", 0, []
        for b in batches:
            for page_id, url, body, size, sha1, refers_to in zip(*(b.column(i) for i in range(6)), strict=True):
                if out is None:
                    path, count = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                refers = refers_to.as_py()
                raw = record(page_id.as_py(), url.as_py(), body.as_py() if refers is None else b"", size.as_py(), base64.b32encode(sha1.as_py()).decode(), refers, date)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(z.compress(raw) + z.flush())
                count += 1
                if out.tell() >= file_bytes:
                    done.append((f"{folder}/{path}", out.tell(), count))
                    out.close()
                    out = None
        if out is not None:
            done.append((f"{folder}/{path}", out.tell(), count))
            out.close()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "size", "records"), map(list, zip(*done, strict=True)), strict=True)))

    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return written(typed.mapInArrow(run, "path string, size long, records long"), "warc-manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of all ``.warc.gz`` files below a folder, for archives that others have written."""
    store, root = pafs.FileSystem.from_uri(folder)
    scheme = folder.split("://")[0] if "://" in folder else "file"
    files = [f for f in store.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".warc.gz")]
    return spark.createDataFrame([(f"{scheme}://{f.path}", f.size) for f in files], "path string, size long")


class Member:
    """A gzip member, decoded step by step from a file."""

    def __init__(self, file: pa.NativeFile, start: int, size: int):
        self.file, self.at, self.size = file, start, size
        self.z = zlib.decompressobj(31)
        self.ready = bytearray()

    def more(self) -> bool:
        """Decodes on; false at the member's end."""
        if self.z.eof:
            return False
        raw = self.z.unconsumed_tail
        if not raw:
            raw = self.file.read_at(min(READ_BYTES, self.size - self.at), self.at) if self.at < self.size else b""
            if not raw:
                raise zlib.error("the file ends inside a member")
            self.at += len(raw)
        self.ready += self.z.decompress(raw, 4 * READ_BYTES)
        return True

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise zlib.error("the member ends inside a record")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def skip(self, n: int) -> None:
        while len(self.ready) < n:
            n -= len(self.ready)
            self.ready.clear()
            if not self.more():
                raise zlib.error("the member ends inside a record")
        del self.ready[:n]

    def head(self) -> dict[str, str] | None:
        """The next record's fields, of any length once they begin with WARC/; None at the end of the member; ValueError where no record begins."""
        while True:
            while self.ready[:2] == b"\r\n":
                del self.ready[:2]
            end = self.ready.find(b"\r\n\r\n")
            if end >= 0 or len(self.ready) >= 8 and not self.ready.startswith(b"WARC/"):
                break
            if not self.more():
                if self.ready.strip():
                    raise ValueError("no head")
                return None
        if end < 0 or not self.ready.startswith(b"WARC/"):
            raise ValueError("no head")
        lines = self.take(end + 4).decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
            raise ValueError("no head")
        return fields

    def end(self) -> int:
        """Where the member ends in the file, once it is decoded."""
        while self.more():
            self.ready.clear()
        return self.at - len(self.z.unused_data)


def length_of(fields: dict[str, str]) -> int:
    return int(fields["content-length"])


def chain(file: pa.NativeFile, size: int, at: int) -> int | None:
    """None if valid members follow each other from here for more than STORED bytes or to the file's end, else where they end."""
    start = at
    while at < size and at - start <= STORED:
        try:
            member = Member(file, at, size)
            fields = member.head()
            if fields is None and at == start:
                return at
            while fields is not None:
                member.skip(length_of(fields))
                fields = member.head()
            at = member.end()
        except (ValueError, zlib.error):
            return at
    return None


def first_member(file: pa.NativeFile, size: int, at: int, stop: int) -> int | None:
    """The first member's start in [at, stop) that decoding confirms."""
    while at < stop:
        # a magic that starts before stop may end after it
        raw = file.read_at(min(READ_BYTES, stop - at) + len(MAGIC) - 1, at)
        found = raw.find(MAGIC)
        if found < 0:
            at += max(1, len(raw) - len(MAGIC) + 1)
            continue
        at += found
        if at >= stop:
            return None
        broken = chain(file, size, at)
        if broken is None:
            return at
        # all members of a chain that breaks off lie inside a payload
        at = max(at + 1, broken)
    return None


class Damage(Exception):
    """A place where no member follows the one before it."""

    def __init__(self, offset: int, why: str):
        super().__init__(why)
        self.offset = offset


def records(file: pa.NativeFile, size: int, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes] | Damage]:
    """(offset of the member, fields, block) of the records whose members start in [start, stop), and the damage found there.

    The records of a member that is damaged anywhere are left out.  Members up to STORED bytes before a damage belong to the range
    that finds it, as none that starts there could confirm them.
    """
    at, sure = start, start == 0
    while at < size:
        if not sure:
            at = first_member(file, size, at, stop)
            if at is None:
                return
        end = stop
        while at < size:
            if at >= end:
                broken = chain(file, size, at) if at < stop or end == stop else at
                if broken is None:
                    return
                end = broken
            try:
                if at >= end and at >= stop:
                    raise ValueError("no member")
                member, found = Member(file, at, size), []
                fields = member.head()
                while fields is not None:
                    found.append((at, fields, member.take(length_of(fields))))
                    fields = member.head()
                after = member.end()
            except (ValueError, zlib.error) as e:
                yield Damage(at, str(e))
                break
            yield from found
            at = after
        if at >= stop or at >= size:
            return
        at, sure = at + 1, False


RECORD = "path string, offset long, record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def read(files: DataFrame, split_bytes: int = 1 << 26, payloads: bool = True, damage: str = "raise") -> DataFrame:
    """The records of the files (path, size), one row each (RECORD), read by splits of so many bytes.

    A file that isn't members end to end (cut off, overwritten, not an archive) raises a ValueError with its path and offset; with
    ``damage="report"`` the place is a row of type ``damaged`` and reading goes on at the next member that decoding confirms.

    ``payload_digest`` and ``payload_bytes`` are of the full payload: taken from it where the record has it (a digest in the head
    that differs raises a ValueError), from the heads of a revisit.  ``payload`` is null in revisits and unless ``payloads``.
    Fields that a record lacks are null; no files give no rows.
    """
    spark = files.sparkSession
    splits = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    bare = lambda x: x.strip("<>") if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in RECORD.split(", ")])
        rows, held = [], 0
        for b in batches:
            for path, size, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    for got in records(f, size, start, min(size, start + split_bytes)):
                        if isinstance(got, Damage):
                            if damage == "raise":
                                raise ValueError(f"{path} is damaged at {got.offset}: {got}")
                            rows.append((path, got.offset, None, "damaged", *[None] * 6))
                            continue
                        offset, fields, block = got
                        given = (fields.get("warc-payload-digest") or "").rpartition(":")[2] or None
                        body, length = block, len(block)
                        if fields.get("content-type", "").startswith("application/http"):
                            head, _, body = block.partition(b"\r\n\r\n")
                            sizes = [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                            length = len(body)
                            if fields["warc-type"] == "revisit":
                                length = int(sizes[0]) if sizes and sizes[0].isdigit() else None
                        own = None
                        if fields["warc-type"] != "revisit":
                            own = digest(body)
                            if given is not None and len(given) == 32 and own != given.upper():
                                raise ValueError(f"{path}, record at {offset}: the payload's digest is {own}, not {given}")
                        rows.append((path, offset, bare(fields.get("warc-record-id")), fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-date"), own or given, length, bare(fields.get("warc-refers-to")), body if payloads and own else None))
                        held += len(block) if payloads else 200
                        if held > 1 << 24:
                            yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(names)}, schema=kinds)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(names)}, schema=kinds)

    return splits.repartition(partitions(spark), "path", "start").mapInArrow(run, RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all pages to archives in the shared folder and back.

    A null html is an empty payload; a null page_id never is the smallest and comes back null; rows that repeat an id are records
    each (see ``write``).
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    files = write(pages, scratch(spark, "warc"), least_bytes=0)
    page = lambda c: F.nullif(F.replace(F.col(c), F.lit(ID_PREFIX), F.lit("")), F.lit("")).cast("long")
    return read(files, split_bytes=1 << 22, payloads=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))

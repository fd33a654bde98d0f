"""WARC archives: written by Spark, normalised, indexed and read back.

``write_archives`` turns pages into WARC/1.1 records, one archive a partition,
each archive one gzip stream as a whole: what many crawlers leave behind, and
what nobody can read from the middle.  Of pages with equal payloads that with
the largest id becomes a ``response``, the others become ``revisit`` records
that refer to it and carry no payload.

``normalise`` is the monolithic gzip normaliser: one task inflates an archive
once, as a stream, and writes every record as a gzip member of its own, with a
sidecar index of offsets beside it.  Only a piece of a record is in memory at
a time, whatever the size of the archive or the record.  A file gets its name
when it is whole, and its bytes depend on the input alone, so a task that runs
again after its executor is lost puts the same file in the same place.

``read_records`` reads an archive's members by the index, in any split: each
is found by its offset, inflated as a stream, and its payload's digest is
computed again and held against the header.

The archives lie in a folder that all executors reach: a path, or a URI that
Spark and pyarrow both know.

Defined results: a null text is an empty payload; a null address has no
``WARC-Target-URI``, line breaks in one are percent-encoded; repeated (id,
payload) rows get equal records, and the rows that have the largest id of
their payload are all responses; a null id is smaller than any other; an empty
table gives an empty archive; other columns of the pages are ignored.  Payloads
are equal if their SHA-1 and their length are.  What is no WARC record, or does
not match its digest, is an error that names file and offset.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.relational import salted_join

from .tables import fixed

WARC_DATE = "2024-01-01T00:00:00Z"
PIECE, MOST_HEADER = 1 << 20, 1 << 22
#: Copied payloads that are broadcast (some 60 bytes each); more are joined
#: by a salted shuffle.
BROADCAST_PAYLOADS = 100_000
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(text: Column) -> Column:
    """SHA-1 in base 32: each five hexadecimal digits are four of its own."""
    digits = F.upper(F.sha1(text))
    fours = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*fours), _CONV32, _BASE32)


def with_roles(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``html`` with ``digest``, ``size`` and ``top``:
    the page that a payload's records refer to."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), base32_sha1(html).alias("digest"),
                        F.octet_length(html).cast("long").alias("size"))
    key = ["digest", "size"]
    copied = fixed(rows.groupBy(*key).agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("_n"))
                   .where(F.col("_n") > 1).drop("_n").withColumn("_copied", F.lit(True)))
    if copied.count() <= BROADCAST_PAYLOADS:
        joined = rows.join(F.broadcast(copied), key, "left")
    else:
        joined = salted_join(rows, copied, key, "left", spread=["page_id", "url"])
    return joined.withColumn("top", F.when(F.col("_copied"), F.col("top")).otherwise(F.col("page_id"))).drop("_copied")


def record_id(page_id: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """``record``: the text of each page's WARC record, without the two line
    breaks that end it."""
    rows = with_roles(pages)
    response = F.col("page_id").eqNullSafe(F.col("top"))

    def lines(*parts: Column) -> Column:
        return F.concat(F.concat_ws("\r\n", *parts), F.lit("\r\n\r\n"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    http = lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                 field("Content-Length", F.col("size").cast("string")))
    block = F.when(response, F.concat(http, "html")).otherwise(http)
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = lines(
        F.lit("WARC/1.1"),
        field("WARC-Type", F.when(response, "response").otherwise("revisit")),
        field("WARC-Record-ID", record_id("page_id")),
        F.lit(f"WARC-Date: {WARC_DATE}"),
        field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(~response, field("WARC-Refers-To", record_id("top"))),
        F.when(~response, F.lit(f"WARC-Profile: {_REVISIT}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", F.octet_length(block).cast("string")))
    return rows.select(F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Writes the pages (``page_id``, ``url``, ``html``) as archives, each one
    gzip stream.  Spark's text writer ends every record with ``lineSep``."""
    (records(pages).write.option("compression", "gzip").option("lineSep", "\r\n\r\n")
     .option("zlib.compress.level", "BEST_SPEED").text(folder))


# ---------------------------------------------------------------- files
def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a path or URI as Spark writes it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class Whole:
    """A file that gets its name when it is whole."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path, self.part = fs, path, f"{path}.{uuid.uuid4().hex}.part"
        self.stream, self.size = fs.open_output_stream(self.part), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def done(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.path)


class Inflated:
    """The bytes of a gzip stream, of one member or several, piece by piece."""

    def __init__(self, raw):
        self.raw, self.inflater, self.held, self.at, self.place = raw, zlib.decompressobj(31), b"", 0, 0
        self.inside = False  # of a member

    def _more(self) -> bool:
        """Holds another piece; false at the end of the stream."""
        rest = self.inflater.unconsumed_tail
        if self.inflater.eof:
            rest = self.inflater.unused_data
            self.inflater = zlib.decompressobj(31)
            self.inside = False
        fed = rest or self.raw.read(PIECE)
        if not fed:
            if self.inside:
                raise ValueError("the gzip stream is cut off")
            return False
        self.inside = True
        self.held = self.held[self.at:] + self.inflater.decompress(fed, PIECE)
        self.at = 0
        return True

    def until(self, mark: bytes) -> bytes:
        """The bytes to the end of the next mark; without one, the rest of the
        stream or as much as a header may have."""
        while (end := self.held.find(mark, self.at)) < 0:
            if len(self.held) - self.at > MOST_HEADER or not self._more():
                end = len(self.held) - len(mark)
                break
        out = self.held[self.at:end + len(mark)]
        self._pass(len(out))
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes; fewer where the stream ends."""
        while n:
            if self.at == len(self.held) and not self._more():
                return
            out = self.held[self.at:self.at + n]
            self._pass(len(out))
            n -= len(out)
            yield out

    def _pass(self, n: int) -> None:
        self.at += n
        self.place += n


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in pairs}


def head_of(source: Inflated, path: str, start: bytes = b"WARC/") -> tuple[bytes, dict[str, str]] | None:
    """A record's header; none at the end of the stream."""
    place, head = source.place, source.until(b"\r\n\r\n")
    if not head.strip():
        return None
    if not head.startswith(start) or not head.endswith(b"\r\n\r\n"):
        raise ValueError(f"{path}: no record at byte {place} of the stream")
    return head, fields_of(head)


def _normalised(path: str, folder: str, level: int) -> dict:
    """Rewrites one archive; what the index says of it as a whole."""
    source_fs, source_path = open_fs(path)
    target_fs, target = open_fs(folder)
    name = os.path.basename(source_path).removesuffix(".gz").removesuffix(".txt").removesuffix(".warc")
    archive, index = (Whole(target_fs, f"{target}/{name}.{end}") for end in ("warc.gz", "idx"))
    count = 0
    with source_fs.open_input_stream(source_path, compression=None) as raw:
        source = Inflated(raw)
        while found := head_of(source, path):
            head, fields = found
            member, start, place = zlib.compressobj(level, zlib.DEFLATED, 31), archive.size, source.place
            archive.write(member.compress(head))
            size = int(fields["content-length"])
            for piece in source.pieces(size):
                archive.write(member.compress(piece))
            if source.place - place != size or b"".join(source.pieces(4)) != b"\r\n\r\n":
                raise ValueError(f"{path}: the record before byte {source.place} of the stream is cut off")
            archive.write(member.compress(b"\r\n\r\n") + member.flush())
            index.write(json.dumps({"archive": f"{folder}/{name}.warc.gz", "offset": start,
                                    "length": archive.size - start, "record_id": fields["warc-record-id"],
                                    "record_type": fields["warc-type"], "uri": fields.get("warc-target-uri"),
                                    "digest": fields.get("warc-payload-digest")}).encode() + b"\n")
            count += 1
    archive.done()
    index.done()  # last: what has an index is whole
    return {"archive": f"{folder}/{name}.warc.gz", "index": f"{folder}/{name}.idx", "n_records": count}


def normalise(spark: SparkSession, source: str, folder: str, level: int = 1) -> DataFrame:
    """Rewrites the gzipped archives in ``source`` into ``folder``, a record a
    member, each with its index; (``archive``, ``index``, ``n_records``)."""
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    schema = "archive string, index string, n_records long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                done = _normalised(name, folder, level)
                yield pa.RecordBatch.from_pylist([done])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    return fixed(files.mapInArrow(run, schema))


INDEX = ("archive string, offset long, length long, record_id string, record_type string, uri string, "
         "digest string")


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of a normalised folder: one row a record."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(folder)


class Part:
    """A stretch of a file as a stream."""

    def __init__(self, file, offset: int, length: int):
        self.file, self.left = file, length
        file.seek(offset)

    def read(self, n: int) -> bytes:
        out = self.file.read(min(n, self.left))
        self.left -= len(out)
        return out


def _record(file, row: dict) -> dict:
    where = f"{row['archive']}, offset {row['offset']}"
    source = Inflated(Part(file, row["offset"], row["length"]))
    found = head_of(source, where)
    if found is None or found[1]["warc-record-id"] != row["record_id"]:
        raise ValueError(f"{where}: not the record of the index")
    fields, place = found[1], source.place
    http = head_of(source, where, b"HTTP/")
    if http is None:
        raise ValueError(f"{where}: no HTTP header")
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    size, digest = int(http[1]["content-length"]), said
    if fields["warc-type"] == "response":
        sha, size = hashlib.sha1(), 0
        for piece in source.pieces(int(fields["content-length"]) - (source.place - place)):
            sha.update(piece)
            size += len(piece)
        digest = base64.b32encode(sha.digest()).decode()
        if digest != said:
            raise ValueError(f"{where}: the payload does not match its digest")
    return {"archive": row["archive"], "offset": row["offset"], "record_id": fields["warc-record-id"],
            "uri": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
            "refers_to": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest}


def read_records(index: DataFrame) -> DataFrame:
    """The records that index rows point to: ``archive``, ``offset``,
    ``record_id``, ``uri``, ``record_type``, ``refers_to``, ``payload_bytes``
    and ``payload_digest`` (of the full payload, for revisits as their headers
    say)."""
    schema = ("archive string, offset long, record_id string, uri string, record_type string, refers_to string, "
              "payload_bytes long, payload_digest string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["archive"] != name:
                    if file is not None:
                        file.close()
                    name = row["archive"]
                    fs, path = open_fs(name)
                    file = fs.open_input_file(path)
                out.append(_record(file, row))
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return index.mapInArrow(run, schema)


def page_of(record_id: str) -> Column:
    """The page id in a record id; null without one."""
    digits = F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1)
    return F.nullif(digits, F.lit("")).cast("long")

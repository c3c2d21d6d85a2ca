"""WARC archives: writing, normalising monolithic gzip files, and reading back by offset.

Pages become records of archives, each archive one gzip stream over the whole
file, as some crawlers write them. The normaliser inflates such a stream once,
in pieces, writes every record as a gzip member of its own to a new file, and
gives a sidecar index with each member's offset and length. Reading seeks to the
members by that index.

Files lie in the folder that all executors share (any file system that
pyarrow.fs opens by URI). Each task writes under a name of its own and returns
it; only files named in the manifest tables count, so tasks that are lost and
run again, or twice, do no harm. Memory: one record and a piece of the stream.

Records with equal payloads of at least `least_bytes` are written once: the one
with the smallest id is the response, others revisit it. A revisit record holds
no payload; it names the payload's digest and length and the response's id.

Defined results: a null payload is empty; null addresses are left out; line ends
in an address become spaces; ids that repeat are told apart by their payload
only (equal ids never revisit each other); a page without an id gets a record
whose id is random, and is null when read back; it revisits the smallest id of
its payload, or is a response where none has one; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, delete

#: Uncompressed bytes after which a new archive is begun.
ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 20
INDEX = "file string, offset long, length long, record_id string, record_type string, archive string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long"


def _open(uri: str, how: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    if how == "w":
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(path, compression=None)
    return fs.open_input_file(path)


def record(page_id: int | None, url: str | None, digest: str, payload: bytes | None, length: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit of refers_to; without a page id it gets a random id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http + (payload or b"" if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>" if page_id is None else f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {length}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


class Records:
    """Splits a stream of bytes, given in pieces, into whole records by their Content-Length."""

    def __init__(self):
        self.held, self.need = bytearray(), 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += piece
        at = 0
        while True:
            if not self.need or len(self.held) - at >= self.need:
                end = self.held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                head = parse_head(bytes(self.held[at:end]))
                self.need = end - at + 4 + int(head["content-length"]) + 4
            if len(self.held) - at < self.need:
                break
            yield head, bytes(self.held[at : at + self.need])
            at += self.need
            self.need = 0
        del self.held[:at]


def _inflated(stream) -> Iterator[bytes]:
    """Pieces of a gzip file of one member or several; one that is cut off is an error, wherever the cut lies."""
    z, open_member = zlib.decompressobj(31), False
    while piece := stream.read(PIECE):
        while piece:
            open_member = True
            yield z.decompress(piece, PIECE)
            while z.unconsumed_tail and not z.eof:
                yield z.decompress(z.unconsumed_tail, PIECE)
            piece = z.unused_data
            if z.eof:
                z, open_member = zlib.decompressobj(31), False
    if rest := z.flush():
        yield rest
    if open_member and not z.eof:
        raise ValueError("the gzip stream is cut off")


def write_monolithic(folder: str):
    """Writes rows (page_id, url, html, payload_digest, payload_bytes, refers_to) as archives of one gzip stream each."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, z, held, records, name, made = None, None, 0, 0, "", []
        for b in batches:
            for row in b.itertuples(index=False):
                if out is None:
                    name, held, records = f"{folder}/mono/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = _open(name, "w"), zlib.compressobj(6, zlib.DEFLATED, 31)
                refers = None if row.refers_to is None else int(row.refers_to)
                page_id = None if row.page_id is None else int(row.page_id)
                data = record(page_id, row.url, row.payload_digest, row.html, int(row.payload_bytes), refers)
                out.write(z.compress(data))
                held += len(data)
                records += 1
                if held >= ARCHIVE_BYTES:
                    out.write(z.flush())
                    out.close()
                    made.append((name, records))
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
            made.append((name, records))
        yield pd.DataFrame(made, columns=["file", "records"])

    return go


def normalise_file(source: str, target: str) -> Iterator[tuple]:
    """Rewrites one monolithic archive with a gzip member for each record; yields the index rows."""
    at = 0
    with _open(source, "r") as stream, _open(target, "w") as out:
        records = Records()
        for piece in _inflated(stream):
            for head, data in records.feed(piece):
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(data) + z.flush()
                out.write(member)
                yield target, at, len(member), head["warc-record-id"].strip("<>"), head["warc-type"], source
                at += len(member)
        if records.held:
            raise ValueError(f"{source} ends within a record")


def _normalise(folder: str):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        for b in batches:
            for source in b.file:
                rows = []
                for row in normalise_file(source, f"{folder}/members/{uuid.uuid4().hex}.warc.gz"):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return go


def read_record(stream, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Head and payload of the member at an offset."""
    stream.seek(offset)
    data = zlib.decompress(stream.read(length), 31)
    head, _, body = data.partition(b"\r\n\r\n")
    return parse_head(head), body[:-4].partition(b"\r\n\r\n")[2]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in READ.split(", ")]
    stream, opened = None, None
    for b in batches:
        rows = []
        for row in b.itertuples(index=False):
            if row.file != opened:
                stream, opened = _open(row.file, "r"), row.file
            head, payload = read_record(stream, int(row.offset), int(row.length))
            number = lambda k: int(head[k][10:-1]) if head.get(k, "").startswith("<urn:page:") else None
            digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(head["x-payload-length"])
            if head["warc-type"] == "response":
                if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                    raise ValueError(f"{row.file} at {row.offset}: the payload isn't what was written")
            rows.append((number("warc-record-id"), size, digest, head["warc-type"], number("warc-refers-to"), head.get("warc-target-uri"), row.file, row.offset))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pd.DataFrame({n: pd.array(c, "Int64") if n in ("page_id", "payload_bytes", "refers_to", "offset") else pd.Series(c, dtype=object) for n, c in zip(names, columns, strict=True)})


def with_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with payload digest, payload length and the id of the response that they revisit."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    named = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes")
    )
    # only ids and digests are grouped; a payload that a third of all pages share is one row here for each task
    first = named.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    out = named.join(first.drop("_n"), "payload_digest", "left")
    other = F.col("page_id").isNull() | (F.col("_first") != F.col("page_id"))
    revisits = F.when((F.col("payload_bytes") >= least_bytes) & other, F.col("_first"))
    return out.select("page_id", "url", F.when(revisits.isNull(), F.col("html")).alias("html"), "payload_digest", "payload_bytes", revisits.alias("refers_to"))


def archive(pages: DataFrame, least_bytes: int = 100) -> tuple[DataFrame, Scratch]:
    """Writes pages (page_id, url, html) to archives and normalises them: the sidecar index, one row for each record.

    As many records must be found as were written. The folder of the archives is the
    scratch folder's; it goes when the process ends, or by `delete`.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    named = with_revisits(pages, least_bytes)
    # pandas has no null among integers
    named = named.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    mono = scratch.write(named.mapInPandas(write_monolithic(scratch.folder), "file string, records long"), "manifest")
    made = mono.agg(F.count("*").alias("files"), F.sum("records").alias("records")).first()
    files = mono.select("file").repartition(max(1, min(made.files, 10_000)), "file")
    index = scratch.write(files.mapInPandas(_normalise(scratch.folder), INDEX), "index")
    if (found := index.count()) != (made.records or 0):
        raise RuntimeError(f"{made.records} records were written, {found} found")
    delete(spark, f"{scratch.folder}/mono")  # the members hold all of it now
    return index, scratch


def read_archive(index: DataFrame) -> DataFrame:
    """All records of normalised archives, by offset, checked against their digests."""
    rows = index.select("file", "offset", "length")
    return rows.sortWithinPartitions("file", "offset").mapInPandas(_read, READ)

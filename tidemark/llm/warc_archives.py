"""Operator 13: normalise WARC archives that are one gzip stream into one gzip member per record, with an offset index.

An archive compressed as a whole can only be read from its start. The normaliser inflates such a stream once, piece by
piece, cuts it into records, compresses each record as a gzip member of its own and writes beside the archive a sidecar
index (``.cdxj``: URI, date and a JSON object with offset, length, type and digest). A record can then be read with one
seek. Archives that have a member per record already, or no compression, are taken as well. Memory is bounded by one
piece and one record's header, however large archives and records are.

Every task writes files under names of its own in the shared folder (see ``session.shared_dir``) and returns their names
as rows; rows of a task that was lost or ran twice are replaced by those of the attempt that Spark keeps, whose files are
complete. Files of other attempts are named by no row. The folder may be any that ``pyarrow.fs`` opens by its URI.

``write`` makes one monolithic archive per partition (more beyond ``ARCHIVE_BYTES``): a record per page, payload the html
in UTF-8. Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest id is written as response,
the others as revisits of it, without payload. ``read_back`` inflates the members that an index names.

Defined results. Null html: empty payload. Null id: written as ``none``; it refers to the largest id of an equal payload
and is itself a response where no page with an id has that payload. Rows that repeat the largest id are responses all.
Null URL: ``urn:none``; line breaks in URLs are percent-encoded. An archive that breaks off: its whole records, with
``complete`` false in the report; bytes between records that are no record end the archive in the same way. Very long
payloads: streamed by the normaliser, whole in memory where rows hold them. Empty tables give empty results; further
columns of the pages are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import scratch_path, small, written

#: A monolithic archive is closed, and another begun, after so many bytes of records.
ARCHIVE_BYTES = 1 << 30
PIECE = 1 << 20
#: A header beyond this length is no header.
HEADER_BYTES = 1 << 20
LEVEL = 6
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digests of more than this share of all pages are taken apart: there are at most as many as its inverse.
HOT_SHARE = 1e-4
ARCHIVES = "archive string, records long"
INDEX = ("archive string, offset long, length long, record_id string, warc_type string, uri string, date string, digest string, "
         "source_archive string, number long, complete boolean")
PAGES = "page_id long, uri string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


# -- records ----------------------------------------------------------------------------------------


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    tail = urn.strip("<>").rsplit(":", 1)[-1]
    return None if tail == "none" else int(tail)


def encode(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit that has the response's HTTP header only."""
    target = (uri or "urn:none").replace("%0D", "%250D").replace("%0A", "%250A").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def header_fields(header: bytes) -> dict[str, str]:
    """Names in lower case with their values; lines that begin with a blank continue the one before."""
    out: dict[str, str] = {}
    last = None
    for line in header.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


# -- streams ----------------------------------------------------------------------------------------


def inflated(read: Callable[[int], bytes], done: Callable[[], None] = lambda: None) -> Iterator[bytes]:
    """Pieces of a stream of gzip members, or of a plain one. ``done`` is called when it ended where a member ends."""
    data = read(PIECE)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = read(PIECE)
        done()
        return
    engine = zlib.decompressobj(31)
    while data:
        try:
            out = engine.decompress(data, PIECE)
        except zlib.error:
            return
        if out:
            yield out
        data = engine.unconsumed_tail
        if engine.eof:
            data = engine.unused_data or read(PIECE)
            if not data:
                done()
                return
            engine = zlib.decompressobj(31)
        elif not data:
            data = read(PIECE)
    yield engine.flush()


@dataclass
class Records:
    """Cuts a stream of bytes into records; a record's block is handed on in pieces."""

    stream: Iterator[bytes]
    held: bytearray = field(default_factory=bytearray)
    complete: bool = True

    def _fill(self) -> bool:
        piece = next(self.stream, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def header(self) -> bytes | None:
        """The next header with its blank line; None at the end, and where no record begins."""
        while True:
            while self.held[:1] in (b"\r", b"\n"):
                del self.held[:1]
            if self.held or not self._fill():
                break
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(self.held) - 3)
            if len(self.held) > HEADER_BYTES or not self._fill():
                self.complete = self.complete and not self.held
                return None
        if self.held[:5] != b"WARC/":
            self.complete = False
            return None
        head = bytes(self.held[:end + 4])
        del self.held[:end + 4]
        return head

    def block(self, length: int) -> Iterator[bytes]:
        """The next so many bytes; fewer, and not complete, if the stream ends before."""
        while length:
            if not self.held and not self._fill():
                self.complete = False
                return
            piece = bytes(self.held[:min(length, PIECE)])
            del self.held[:len(piece)]
            length -= len(piece)
            yield piece


def normalise_stream(read: Callable[[int], bytes], write: Callable[[bytes], object]) -> tuple[list[dict], bool]:
    """Write each record of an archive as its own member; the index entries, and whether the archive was whole.

    A record that breaks off leaves bytes at the end of the new archive that no entry names.
    """
    ended: list[bool] = []
    records = Records(inflated(read, lambda: ended.append(True)))
    entries, offset = [], 0
    while (header := records.header()) is not None:
        named = header_fields(header)
        size = named.get("content-length", "")
        if not size.isdecimal():
            records.complete = False
            break
        engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        length, left = _put(write, engine.compress(header)), int(size)
        for piece in records.block(left):
            length += _put(write, engine.compress(piece))
            left -= len(piece)
        length += _put(write, engine.compress(b"\r\n\r\n") + engine.flush())
        if left:
            break
        entries.append({"offset": offset, "length": length, "record_id": named.get("warc-record-id"), "warc_type": named.get("warc-type"),
                        "uri": named.get("warc-target-uri"), "date": named.get("warc-date"), "digest": named.get("warc-payload-digest")})
        offset += length
    return entries, records.complete and bool(ended)


def _put(write: Callable[[bytes], object], data: bytes) -> int:
    if data:
        write(data)
    return len(data)


def cdxj_line(entry: dict, archive: str) -> bytes:
    fields = {"offset": entry["offset"], "length": entry["length"], "type": entry["warc_type"], "digest": entry["digest"],
              "id": entry["record_id"], "filename": archive.rsplit("/", 1)[-1]}
    date = "".join(c for c in entry["date"] or "" if c.isdigit())[:14] or "-"
    return f"{entry['uri'] or '-'} {date} {json.dumps(fields, sort_keys=True)}\n".encode()


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _new_file(folder: str, kind: str) -> str:
    return f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}.warc.gz"


# -- writing ----------------------------------------------------------------------------------------


def base32_of_hex(hex40: Column) -> Column:
    """Base32 of a SHA-1 in hexadecimal: 20 bits, five digits, give four letters."""
    value = [F.conv(F.substring(hex40, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    letters = [F.substring(F.lit(BASE32), F.shiftright(v, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for v in value for j in range(4)]
    return F.concat(*letters)


def deduplicated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, uri, payload, digest, refers_to (null for responses) and revisit, of every page.

    Digests are counted first. The few very frequent ones, and the others if they are few, go to every executor; otherwise
    pages and digests meet in a shuffle in which no digest is frequent.
    """
    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("uri"),
                         F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit("").cast("binary")).alias("payload"))
    given = given.withColumn("sha1", F.sha1("payload"))
    groups = written(given.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(
        F.count("*").alias("pages"), F.max("page_id").alias("largest")), "digests")
    total = groups.agg(F.sum("pages")).first()[0] or 0
    copied = groups.where("pages > 1 and largest is not null")
    hot = F.broadcast(copied.where(F.col("pages") > HOT_SHARE * total).select("sha1", F.col("largest").alias("hot_largest")))
    rest = small(copied.where(F.col("pages") <= HOT_SHARE * total).select("sha1", "largest"))
    # Pages of frequent digests meet none of the rest; there they have keys of their own, which spreads them.
    key = F.when(F.col("hot_largest").isNull(), F.col("sha1")).otherwise(F.concat_ws(":", F.lit("page"), "page_id", "uri"))
    joined = given.join(hot, "sha1", "left").withColumn("key", key).join(rest.withColumnRenamed("sha1", "key"), "key", "left")
    refers = F.coalesce("hot_largest", "largest")
    revisit = refers.isNotNull() & ~F.col("page_id").eqNullSafe(refers)
    return joined.select("page_id", "uri", "payload", base32_of_hex(F.col("sha1")).alias("digest"), revisit.alias("revisit"),
                         F.when(revisit, refers).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Monolithic archives of all pages in the folder (by default a new one in the shared folder); their names and records."""
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, home = opened(folder)
        files.create_dir(home, recursive=True)
        out, done = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    name, size, count = _new_file(folder, "whole"), 0, 0
                    out, engine = files.open_output_stream(opened(name)[1], compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                page_id, uri, payload, digest, revisit, refers_to = row
                record = encode(page_id, uri, payload, digest, refers_to, revisit)
                _put(out.write, engine.compress(record))
                size, count = size + len(record), count + 1
                if size >= ARCHIVE_BYTES:
                    _put(out.write, engine.flush())
                    out.close()
                    done.append((name, count))
                    out = None
        if out is not None:
            _put(out.write, engine.flush())
            out.close()
            done.append((name, count))
        if done:
            names, counts = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["archive", "records"])

    return written(deduplicated(pages, min_bytes).mapInArrow(run, ARCHIVES), "archives")


# -- normalising and reading ------------------------------------------------------------------------


def _apart(rows: DataFrame, column: str) -> DataFrame:
    """Rows dealt by a column over all tasks that the session shuffles to."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def normalise(archives: DataFrame, folder: str | None = None) -> DataFrame:
    """Per record of the named archives (column ``archive``) where it stands in the archives written for them, one for each.

    Beside each new archive lies its sidecar index. ``complete`` tells whether the source was read to a regular end; a
    source without any whole record has one row with null offset.
    """
    folder = folder or scratch_path(archives.sparkSession, "warc-records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in INDEX.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        kinds = [types[f.split()[1]] for f in INDEX.split(", ")]
        files, home = opened(folder)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                files.create_dir(home, recursive=True)
                target = _new_file(folder, "records")
                read_from, path = opened(source)
                with read_from.open_input_stream(path, compression=None) as given, files.open_output_stream(opened(target)[1], compression=None) as out:
                    entries, complete = normalise_stream(given.read, out.write)
                with files.open_output_stream(opened(target)[1].removesuffix(".warc.gz") + ".cdxj") as index:
                    for entry in entries:
                        index.write(cdxj_line(entry, target))
                rows = [(target, e["offset"], e["length"], e["record_id"], e["warc_type"], e["uri"], e["date"], e["digest"], source, i, complete)
                        for i, e in enumerate(entries)] or [(target, *(None,) * 7, source, None, complete)]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at:at + 10_000]), kinds)], names)

    return written(_apart(archives.select("archive"), "archive").mapInArrow(run, INDEX), "index")


def member(read_at: Callable[[int, int], bytes], offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record at an index entry."""
    records = Records(iter([zlib.decompress(read_at(offset, length), 31)]))
    named = header_fields(records.header() or b"")
    return named, b"".join(records.block(int(named.get("content-length", 0))))


def read_back(index: DataFrame) -> DataFrame:
    """The pages of an index's response and revisit records; payload is null for revisits. Checks every payload's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PAGES.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        name, given = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if archive != name:
                    if given is not None:
                        given.close()
                    files, path = opened(archive)
                    name, given = archive, files.open_input_file(path)
                named, block = member(lambda at, n: given.read_at(n, at), offset, length)
                http, _, payload = block.partition(b"\r\n\r\n")
                digest, kind = named["warc-payload-digest"].removeprefix("sha1:"), named["warc-type"]
                if kind == "response":
                    found = sha1_base32(payload)
                    if found != digest:
                        raise ValueError(f"{named['warc-record-id']} in {archive}: digest {digest} in the header, {found} of the payload")
                refers = page_of(named["warc-refers-to"]) if kind == "revisit" else None
                rows.append((page_of(named["warc-record-id"]), named.get("warc-target-uri"), payload if kind == "response" else None,
                             int(header_fields(http)["content-length"]), digest, kind, refers))
                held += len(payload)
                if held > PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        if given is not None:
            given.close()

    wanted = index.where(F.col("offset").isNotNull() & F.col("warc_type").isin("response", "revisit")).select("archive", "offset", "length")
    return wanted.mapInArrow(run, PAGES)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Per page what its record in the normalised archives says: size and digest of the payload, kind, and what it refers to."""
    index = normalise(write(pages, min_bytes=min_bytes))
    return read_back(index).drop("uri", "payload")

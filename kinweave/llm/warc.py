"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record, headers and lengths validated."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the published formats: magic numbers of the dictionary frame and of a Zstandard frame, the revisit profile.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary: its bytes at most, and the bounded sample it is trained on (pages, bytes of each).
DICTIONARY_BYTES, SAMPLE_PAGES, SAMPLE_BYTES = 112_640, 400, 16_384
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """An archive that is not as the format has it."""


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record. A revisit holds the HTTP header alone, whose Content-Length tells the payload's length."""
    clean = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(pages: DataFrame) -> bytes:
    """A dictionary trained on a bounded sample of payloads, or b'' where there are too few to train on."""
    # The ids first, so that no pages but these travel.
    some = pages.where("html is not null and page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.substring("html", 1, SAMPLE_BYTES).alias("h"))
    ids = common.cut(some.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES).distinct())
    sample = some.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("h").alias("h")).orderBy("page_id").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.h.encode() for r in sample]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive: the dictionary from the leading frame, then one decoded frame after another."""
    head = stream.read(8)
    if not head:
        return
    if len(head) < 8:
        raise WarcError("the file is shorter than a frame's header")
    magic, size = struct.unpack("<II", head)
    data, rest = None, head
    if magic == DICTIONARY_MAGIC:
        raw = stream.read(size)
        if len(raw) != size:
            raise WarcError("the dictionary is cut short")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        data, rest = zstandard.ZstdCompressionDict(raw), b""
    decoder = zstandard.ZstdDecompressor(dict_data=data)
    while rest or (rest := stream.read(chunk)):
        frame, parts = decoder.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            rest = b""
            if frame.eof:
                rest = frame.unused_data
                break
            rest = stream.read(chunk)
            if not rest:
                raise WarcError("the last frame is cut short")
        yield b"".join(parts)


def _headers(block: bytes, first: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(first):
        raise WarcError(f"no {first.decode()} header")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name.strip() != name:
            raise WarcError(f"not a header line: {line[:80]!r}")
        if name.lower() in out:
            raise WarcError(f"{name} comes twice")
        out[name.lower()] = value.strip()
    return out, rest


def parse(raw: bytes) -> tuple:
    """A record as a row of ROWS. Raises WarcError if headers, lengths or the payload's digest do not agree."""
    head, rest = _headers(raw, b"WARC/1.")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "x-page-id"):
        if name not in head:
            raise WarcError(f"no {name}")
    length = int(head["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError("the block's length is not what Content-Length tells")
    http, payload = _headers(rest[:length], b"HTTP/1.")
    told, digest = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
    revisit = head["warc-type"] == "revisit"
    if revisit:
        if payload or head.get("warc-profile") != PROFILE or "x-refers-to-page-id" not in head:
            raise WarcError("not a revisit of an identical payload")
    elif head["warc-type"] != "response":
        raise WarcError(f"a record of type {head['warc-type']}")
    elif len(payload) != told or hashlib.sha1(payload).hexdigest() != digest:
        raise WarcError("the payload is not what its length or digest tells")
    number = lambda x: int(x) if x else None
    return number(head["x-page-id"]), told, digest, head["warc-type"], number(head["x-refers-to-page-id"]) if revisit else None


def write_archives(pages: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Writes every row of pages (page_id, url, html; null html: empty) as a record and returns the archives: path, records.

    Of equal payloads of at least REVISIT_BYTES bytes, the rows with the largest page_id are responses, the others revisit them; rows
    repeated with that page_id are all responses, and each row is a record of its own. A null page_id is never the largest. An empty
    table gives archives without records, or none.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    twice = large.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(twice, "digest", "left")
    trained = dictionary(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/pages-{TaskContext.get().partitionId():08d}.warc.zst"
        out, n = common.Publisher(path), 0
        if trained:
            out.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained)
        encoder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True, write_content_size=True)
        for big in batches:
            for batch in common.sliced(big):
                for r in batch.to_pylist():
                    revisit = r["response_id"] is not None and r["page_id"] != r["response_id"]
                    out.out.write(encoder.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["response_id"], revisit)))
                    n += 1
        out.done()
        yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return common.cut(marked.select("page_id", "url", "payload", "digest", "response_id").mapInArrow(write, "path string, records long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of all archives (path, records), each decoded from its own frame and validated, as ROWS."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        batch_of = lambda held: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for archive in batch.to_pylist():
                fs, path = common.place(archive["path"])
                n, held = 0, []
                with fs.open_input_stream(path, compression=None) if not isinstance(fs, pafs.LocalFileSystem) else open(path, "rb") as stream:
                    for raw in frames(stream):
                        held.append(parse(raw))
                        n += 1
                        if len(held) == 1000:
                            yield batch_of(held)
                            held = []
                if held:
                    yield batch_of(held)
                if n != archive["records"]:
                    raise WarcError(f"{path} has {n} records, not {archive['records']}")

    return archives.repartition(common.partitions(archives.sparkSession), "path").mapInArrow(read, ROWS)

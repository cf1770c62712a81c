"""WARC archives with one Zstandard frame per record and a shared dictionary.

Every archive starts with a skippable frame that carries its dictionary, itself a
Zstandard frame; each record follows as one frame.  Archives are written from
Arrow batches to the folder that driver and executors share, rolled over at a
fixed number of payload bytes, and read back as binary files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_ROWS, Scratch, partitions, qualified

#: Fixed values of the formats.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed at so many payload bytes; a reader holds one archive.
ARCHIVE_BYTES = 16 << 20
#: The dictionary of an archive is trained on its first records, so many at most.
DICT_RECORDS, DICT_RECORD_BYTES, DICT_BYTES = 200, 16 << 10, 16 << 10

RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: response with its payload, or revisit with the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """Parses and validates one record; ``ValueError`` where header, length or digest don't hold."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] != VERSION.decode():
        raise ValueError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in fields:
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"):
        if need not in fields:
            raise ValueError(f"header {need} is missing")
    if not fields["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't match the record")
    block = rest[:n]
    if fields["warc-block-digest"] != f"sha1:{digest32(block)}":
        raise ValueError("block digest doesn't match")
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header in the block")
    lengths = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    size, kind = int(lengths[0]) if lengths else len(payload), fields["warc-type"]
    named = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if size != len(payload) or named != digest32(payload):
            raise ValueError("payload doesn't match its length or digest")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise ValueError("revisit with a payload or without WARC-Refers-To")
    else:
        raise ValueError(f"unknown record type {kind}")
    return {"page_id": _page(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": named, "record_type": kind,
            "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
            "target_uri": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def dictionary(records: list[bytes]):
    """A dictionary for these records: a trained one, or their own first bytes where training finds too little."""
    import zstandard as zstd

    samples = [r[:DICT_RECORD_BYTES] for r in records[:DICT_RECORDS]]
    try:
        return zstd.train_dictionary(DICT_BYTES, samples, level=3)
    except (zstd.ZstdError, ValueError):  # too few samples, or too alike
        return zstd.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def pack_archive(records: list[bytes]) -> bytes:
    """A whole archive: the dictionary in a skippable frame, then one frame for each record."""
    import zstandard as zstd

    cdict = dictionary(records)
    body = zstd.ZstdCompressor(level=3).compress(cdict.as_bytes())
    packer = zstd.ZstdCompressor(level=3, dict_data=cdict, write_content_size=True, write_checksum=True)
    return struct.pack("<II", DICT_MAGIC, len(body)) + body + b"".join(map(packer.compress, records))


def unpack_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time.

    A leading skippable frame holds the dictionary, plain or compressed; other
    skippable frames are passed over.  A cut or unknown frame is a ``ValueError``.
    """
    import zstandard as zstd

    at, unpacker, view = 0, zstd.ZstdDecompressor(), memoryview(data)
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError("cut frame at the end of the archive")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            body = bytes(view[at + 8:at + 8 + size])
            if len(body) < size:
                raise ValueError("cut skippable frame")
            if at == 0 and magic == DICT_MAGIC:
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstd.ZstdDecompressor().decompress(body)
                unpacker = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(body))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"unknown frame {magic:#x}")
        frame = unpacker.decompressobj()
        # the frame's end shows in unused_data; feeding in steps avoids copies of the rest
        out, fed = [], at
        while not frame.eof and fed < len(view):
            out.append(frame.decompress(view[fed:fed + 65536]))
            fed = min(fed + 65536, len(view))
        if not frame.eof:
            raise ValueError("cut frame")
        at = fed - len(frame.unused_data)
        yield b"".join(out)


def plan_records(pages: DataFrame) -> DataFrame:
    """Adds ``__digest`` and ``__refers``: the page to revisit, null for a response.

    Of equal payloads the largest page_id answers.  A repeated row with that id
    is a response too, and so are all rows of a group without any page_id.
    """
    keyed = pages.withColumn("__digest", F.sha1(F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")))
    # digests and ids alone tell which pages answer
    found = keyed.select("page_id", "__digest").groupBy("__digest").agg(F.max("page_id").alias("__last"), F.count("*").alias("__n"))
    last = Scratch(pages.sparkSession, "warc-digests").keep(found.filter("__n > 1"), "last")
    total, top = last.agg(F.sum("__n"), F.max("__n")).first()
    limit = max(HOT_ROWS, (total or 0) // (4 * partitions(pages.sparkSession)))
    planned = keyed
    if (top or 0) > limit:  # pages of a digest that very many share get it by broadcast: at most four such digests a partition
        hot = F.broadcast(last.filter(F.col("__n") > limit).select("__digest", "__last"))
        planned = keyed.join(hot.select("__digest"), "__digest", "left_anti")
    planned = planned.join(last.filter(F.col("__n") <= limit).select("__digest", "__last"), "__digest", "left")
    if (top or 0) > limit:
        planned = planned.unionByName(keyed.join(hot, "__digest"))
    return planned.withColumn("__refers", F.when(~F.col("page_id").eqNullSafe(F.col("__last")), F.col("__last")))


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``path``; run the returned frame (path, records, bytes).

    File names are unique to a task attempt and an archive counts only if it is
    listed in the result, so a task that runs twice leaves no double records.
    """
    planned = plan_records(pages).select("page_id", "url", "html", "__refers")
    path = qualified(pages.sparkSession, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)

        def close(records: list[bytes]) -> pa.RecordBatch:
            name, data = f"part-{uuid.uuid4().hex}.warc.zst", pack_archive(records)
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"name": [name], "records": [len(records)], "bytes": [len(data)]})

        store.create_dir(root, recursive=True)
        held, size = [], 0
        for batch in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(encode_record(page_id, url, (html or "").encode("utf-8"), refers, refers is not None))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return planned.mapInArrow(work, "name string, records long, bytes long")


def read_archives(spark: SparkSession, path: str, names: DataFrame | None = None, *, payload: bool = True) -> DataFrame:
    """The records of the archives below ``path``, or of those that ``names`` lists."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")
    if names is not None:
        found = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(names.select("name"), "name", "left_semi").select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for i, raw in enumerate(unpack_archive(data.as_buffer())):
                    try:
                        row = decode_record(raw)
                    except ValueError as e:
                        raise ValueError(f"{where}, record {i}: {e}") from e
                    rows.append(row if payload else row | {"payload": None})
                    size += len(raw) * payload + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(kept, types, strict=True)], kept)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(kept, types, strict=True)], kept)

    return found.mapInArrow(work, RECORD_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all ``pages`` (page_id, url, html) as archives and returns what is read back, without payloads.

    Null payloads are empty, null and repeated page_ids are kept, a payload of any
    length is one record, other columns play no part, an empty table gives none.
    """
    spark = pages.sparkSession
    tables = Scratch(spark, "warc")
    path = tables.path("archives")
    names = tables.keep(write_archives(pages, path), "listed")
    if not names.limit(1).count():
        return spark.createDataFrame([], RECORD_SCHEMA).drop("payload", "target_uri")
    conf = "spark.sql.sources.binaryFile.maxLength"
    assert int(spark.conf.get(conf)) > 2 * ARCHIVE_BYTES, f"{conf} is below the size of an archive"
    return read_archives(spark, path, names, payload=False).drop("payload", "target_uri")

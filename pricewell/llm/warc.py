"""WARC archives compressed with Zstandard, one frame for each record.

An archive begins with a skippable frame that holds the dictionary of its records; every record is a
frame of its own, so a reader needs one record in memory. Archives are files of bounded size in a
shared folder, written by the tasks through the folder's own file system. A file's name comes from
its partition and is taken only when the file is complete, so a repeated task puts the same file
in the same place.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm.tables import sampled, whole_text
from pricewell.session import materialized, scratch_dir

#: Fixed values of the formats: the magic numbers of the dictionary's frame and of a frame, line ends, versions.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
CRLF = b"\r\n"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: Records are put into one file up to so many bytes of payload.
ARCHIVE_BYTES = 16_000_000
#: The dictionary is trained on at most so many payloads, of each at most so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 16_384, 65_536

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record before compression; line ends inside header values become spaces."""
    lines = [VERSION]
    for name, value in headers:
        clean = value.replace("\r", " ").replace("\n", " ")
        lines.append(f"{name}: {clean}".encode())
    lines.append(f"Content-Length: {len(block)}".encode())
    return CRLF.join(lines) + CRLF + CRLF + block + CRLF + CRLF


def parsed_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, or ValueError where they don't hold."""
    head, mark, rest = raw.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not mark or not lines[0].startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("a header line without a name")
        headers[name.strip().decode().lower()] = value.strip().decode()
    if missing := {"warc-type", "warc-record-id", "content-length"} - headers.keys():
        raise ValueError(f"headers are missing: {sorted(missing)}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != CRLF + CRLF:
        raise ValueError(f"the block has {len(rest) - 4} bytes, the header says {length}")
    return headers, rest[:length]


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame with the compressed dictionary."""
    import zstandard

    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def frames(raw: bytes) -> Iterator[bytes]:
    """The decompressed frames of an archive, one at a time, read with the dictionary at its head."""
    import zstandard

    at, dictionary = 0, None
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", raw, 4)[0]
        body = raw[8 : 8 + size]
        if len(body) != size:
            raise ValueError("the dictionary is cut off")
        if body[:4] == FRAME_MAGIC:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        dictionary, at = zstandard.ZstdCompressionDict(body), 8 + size
    view = memoryview(raw)
    step = 1 << 16
    while at < len(raw):
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj() if dictionary else zstandard.ZstdDecompressor().decompressobj()
        parts = []
        while not one.eof:
            if at >= len(raw):
                raise ValueError("a frame is cut off")
            chunk = view[at : at + step]
            parts.append(one.decompress(chunk))
            at += len(chunk)
        at -= len(one.unused_data)
        yield b"".join(parts)


def page_record(page_id, url, record_type: str, refers_to, size: int, digest: str, payload: bytes, place: str = "") -> bytes:
    """The record of a page: a response with its payload, or a revisit that names the response it repeats.

    ``place`` is told apart from that of every other record, so that equal pages have ids of their own.
    """
    number = "" if page_id is None else str(page_id)
    headers = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{number} {url} {record_type} {digest} {place}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url or ""),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(size)),
        ("X-Page-ID", number),
    ]
    if record_type == "revisit":
        headers += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
    return record_bytes(headers, payload if record_type == "response" else b"")


def checked_page(raw: bytes) -> tuple:
    """The page of a record, after its headers, lengths and digest were checked."""
    headers, block = parsed_record(raw)
    kind, size = headers["warc-type"], int(headers["x-payload-length"])
    algorithm, _, digest = headers["warc-payload-digest"].partition(":")
    if algorithm != "sha1" or len(digest) != 32:
        raise ValueError("no SHA-1 payload digest")
    if kind == "response" and (len(block) != size or base32_digest(hashlib.sha1(block).digest()) != digest):
        raise ValueError("the payload is not what the headers say")
    if kind == "revisit" and (block or headers.get("warc-profile") != PROFILE):
        raise ValueError("a revisit with a payload or without its profile")
    number = lambda name: int(headers[name]) if headers.get(name) else None
    payload = block if kind == "response" else None
    return number("x-page-id"), headers.get("warc-target-uri"), kind, number("x-refers-to-page-id"), size, digest, payload


def trained_dictionary(payloads: DataFrame) -> bytes | None:
    """A dictionary from a bounded sample of payloads, or none where there are too few."""
    import zstandard

    ids = sampled(payloads.select("page_id").where("page_id is not null"), "page_id", SAMPLE_ROWS).distinct()
    beginning = F.substring("payload", 1, SAMPLE_BYTES).alias("p")
    rows = payloads.join(F.broadcast(ids), "page_id").select("page_id", beginning).where(F.octet_length("p") > 8)
    sample = [bytes(r.p) for r in sorted(rows.dropDuplicates(["page_id"]).collect(), key=lambda r: r.page_id)]
    if len(sample) < 20:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return None


def deduplicated(pages: DataFrame) -> DataFrame:
    """Pages as records: page_id, url, first (a response), response, size, sha1 and payload (of responses only).

    Of pages with equal payloads the one with the largest page_id is the response (null ids are the
    smallest); all others are revisits and lose their payload. Only ids and digests are grouped. Where the
    response's row is repeated, whichever files the copies are in, one of them, of the least url, is the response.
    """
    payload = F.encode(whole_text("html"), "UTF-8")
    ids = F.struct(F.col("page_id").isNull().alias("n"), F.coalesce("page_id", F.lit(0)).alias("i"))
    wide = pages.select(
        "page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("content"), ids.alias("key")
    )
    pairs = wide.groupBy("key", "page_id", "content").agg(F.count(F.lit(1)).alias("rows"))
    groups = pairs.groupBy("content").agg(F.max("page_id").alias("response"), F.sum("rows").alias("copies")).where("copies > 1")
    same = F.col("page_id").eqNullSafe(F.col("response"))
    decided = pairs.join(groups, "content").select("key", "content", "response", F.lit(True).alias("shared"), (same & (F.col("rows") > 1)).alias("contested"))
    decided = materialized(decided, "shared-payloads")
    size, sha1 = F.octet_length("payload").cast("long").alias("size"), F.unhex(F.sha1("payload")).alias("sha1")

    joined = wide.join(decided, ["key", "content"], "left").where(~F.coalesce("contested", F.lit(False)))
    first = ~F.coalesce("shared", F.lit(False)) | same
    alone = joined.select("page_id", "url", first.alias("first"), "response", size, sha1, F.when(first, F.col("payload")).alias("payload"))

    # copies of a response's row: counted in each part where they are, then one of them is taken out
    copies = wide.join(decided.where("contested").select("key", "content"), ["key", "content"])
    counts = copies.groupBy("page_id", "key", "content", "url", F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialized(counts, "copies")
    chosen = counts.groupBy("key", "content").agg(F.min(F.struct("url", "part")).alias("chosen"))
    bodies = copies.groupBy("page_id", "key", "content").agg(F.min("payload").alias("payload")).join(chosen, ["key", "content"])
    responses = bodies.select("page_id", F.col("chosen.url").alias("url"), F.lit(True).alias("first"), F.col("page_id").alias("response"), size, sha1, "payload")
    told = bodies.select("key", "content", "chosen", size, sha1)
    left = F.col("n") - F.struct("url", "part").eqNullSafe(F.col("chosen")).cast("long")
    again = counts.join(told, ["key", "content"]).withColumn("left", left).where("left > 0")
    again = again.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), "left")))
    revisits = again.select("page_id", "url", F.lit(False).alias("first"), F.col("page_id").alias("response"), "size", "sha1", F.lit(None).cast("binary").alias("payload"))
    return alone.union(responses).union(revisits).sortWithinPartitions("page_id", "sha1", "url", "first")


def write_archives(records: DataFrame, folder: str, dictionary: bytes | None) -> DataFrame:
    """Writes deduplicated pages as archive files into a folder that all executors reach.

    Returns one row for each file: path, records, bytes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out, path, held, records, line = None, "", 0, 0, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            size = out.tell()
            out.close()
            store.move(f"{path}.{attempt}", path)
            done.append((path, records, size))

        attempt = f"{TaskContext.get().taskAttemptId()}.part"
        for batch in batches:
            for row in batch.to_pylist():
                line += 1
                kind = "response" if row["first"] else "revisit"
                refers = row["response"] if kind == "revisit" else None
                payload = row["payload"] if kind == "response" else b""
                raw = page_record(row["page_id"], row["url"], kind, refers, row["size"], base32_digest(row["sha1"]), payload, f"{part}-{line}")
                if out is not None and held + len(raw) > ARCHIVE_BYTES:
                    close()
                    out = None
                if out is None:
                    path = f"{root}/part-{part:06d}-{number:04d}.warc.zst"
                    out, held, records, number = store.open_output_stream(f"{path}.{attempt}"), 0, 0, number + 1
                    if dictionary:
                        out.write(dictionary_frame(dictionary))
                out.write(packer.compress(raw))
                held += len(raw)
                records += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(
            [{"path": p, "records": r, "bytes": b} for p, r, b in done],
            schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
        )

    return records.mapInArrow(write, "path string, records long, bytes long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of all archives in a folder: ``RECORD``. A broken record fails the read.

    Payloads of revisits are null; ``refers_to`` names the page with the payload.
    """
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("payload", pa.binary()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for raw in frames(content.as_py()):
                    rows.append(checked_page(raw))
                    held += len(raw)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages as archives into the scratch folder and reads them back: ``RECORD``.

    Rows that repeat, in one file or several, are records of their own: one response, the others revisit it.
    Null pages have an empty payload, and empty payloads are equal payloads too. A null url is an
    empty one; further columns are ignored. An empty table gives no files and no rows.
    """
    spark = pages.sparkSession
    folder = scratch_dir(spark, "warc")
    payloads = pages.select("page_id", F.encode(whole_text("html"), "UTF-8").alias("payload"))
    written = materialized(write_archives(deduplicated(pages), folder, trained_dictionary(payloads)), "warc-files")
    if written.isEmpty():
        return spark.createDataFrame([], RECORD)
    return read_archives(spark, folder)

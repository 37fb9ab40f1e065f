"""WARC archives compressed by zstandard with a dictionary, written and read.

An archive begins with a skippable frame of magic 0x184D2A5D that holds the dictionary, itself a
zstandard frame; then comes one frame a record. The reader takes the dictionary from there, decodes
frame by frame, and refuses a record whose version line, mandatory headers, lengths or digests are
wrong.

Of records with equal payloads of at least `least` bytes the one with the largest page_id is the
response; the others are revisits that refer to it and carry no payload. Smaller ones are all
responses.

Defined cases: null html is the empty payload; null url is "urn:page:<page_id>"; rows with an equal
page_id and payload are each kept, and those that hold the largest page_id are all responses; null
page_id sorts below all others; an empty table gives no archive and no row; other columns are
ignored, whatever they are called. A record is whole in memory, an archive never is.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AtomicFile, cut_points, file_system, hash_sample, lean, new_folder, range_of, saved

SKIPPABLE, DATE = 0x184D2A5D, "2024-01-01T00:00:00Z"
#: Pages that train the dictionary, by the order of a hash of page_id, and bytes of such a page at most: a
#: bounded sample, on which compression alone depends.
DICTIONARY_PAGES, DICTIONARY_PAGE, DICTIONARY_BYTES = 1000, 1 << 16, 112 * 1024
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KINDS = ("response", "revisit")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one WARC/1.1 record: an HTTP response, its payload left out of a revisit."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        ("WARC-Type", KINDS[revisit]), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", "".join((url or f"urn:page:{page_id}").split())),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
    ]
    if revisit:
        lines += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", REVISIT)]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in lines), "\r\n"]).encode() + block + b"\r\n\r\n"


class BadRecord(ValueError):
    """A record or archive that isn't well-formed."""


def parse_record(raw: bytes) -> dict:
    """Fields of one record, after all checks."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not gap or first not in ("WARC/1.0", "WARC/1.1"):
        raise BadRecord(f"not a record: {first[:40]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        key, colon, value = line.partition(":")
        if not colon or not key.strip() or key.lower() in headers:
            raise BadRecord(f"bad or repeated header {line[:60]!r}")
        headers[key.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise BadRecord(f"without {sorted(missing)}")
    if not headers["content-length"].isdigit():
        raise BadRecord(f"length {headers['content-length']!r}")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadRecord(f"{len(rest) - 4} bytes where Content-Length says {n}")
    block = rest[:n]
    if headers.get("warc-block-digest", (d := f"sha1:{digest_of(block)}")) != d:
        raise BadRecord("the block's digest differs")
    if headers["warc-type"] not in KINDS:
        return {"headers": headers, "payload": None, "length": n}
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = next((v for k, v in (x.split(b":", 1) for x in http.split(b"\r\n")[1:]) if k.lower() == b"content-length"), None)
    if not gap or length is None or not length.strip().isdigit():
        raise BadRecord("not an HTTP response with a length")
    if headers["warc-type"] == "response" and (int(length) != len(payload) or headers.get("warc-payload-digest", (d := f"sha1:{digest_of(payload)}")) != d):
        raise BadRecord("the payload's length or digest differs")
    if headers["warc-type"] == "revisit" and not {"warc-refers-to", "warc-profile", "warc-payload-digest"} <= headers.keys():
        raise BadRecord("a revisit that refers to nothing")
    return {"headers": headers, "payload": payload, "length": int(length)}


def start_archive(dictionary: bytes) -> tuple[bytes, zstandard.ZstdCompressor]:
    """The leading skippable frame, and what compresses records behind it."""
    body = zstandard.ZstdCompressor(level=10).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(body)) + body, zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)


def read_archive(file) -> Iterator[bytes]:
    """The records of an archive, a file object, one at a time."""
    magic, n = struct.unpack("<II", file.read(8).ljust(8, b"\0"))
    if magic != SKIPPABLE:
        raise BadRecord("no leading dictionary frame")
    body = file.read(n)
    if len(body) != n:
        raise BadRecord("the dictionary frame is cut off")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body) if body[:4] == b"\x28\xb5\x2f\xfd" else body)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    frame, parts, left, begun = decoder.decompressobj(), [], b"", False
    while chunk := left or file.read(1 << 20):
        left, begun = b"", True
        parts.append(frame.decompress(chunk))
        if frame.eof:
            yield b"".join(parts)
            left = frame.unused_data
            frame, parts, begun = decoder.decompressobj(), [], False
    if begun:
        raise BadRecord("the last frame is cut off")


def trained(pages: DataFrame) -> bytes:
    small = pages.where(F.octet_length("html") <= DICTIONARY_PAGE)
    sample = [r.html.encode() for r in hash_sample(small, "page_id", DICTIONARY_PAGES).select("html").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES].ljust(8, b"\0")


def roles(pages: DataFrame, least: int) -> DataFrame:
    """page_id, payload's hash and refers_to of each revisit, and nothing of responses.

    Only hashes travel: a group of copies is summed up before the shuffle and then joined, and a
    join of a group that is too large for a task is split."""
    marks = pages.where(F.octet_length("html") >= least).select(F.col("page_id"), F.sha1("html").alias("sha"), F.octet_length("html").alias("n"))
    groups = marks.groupBy("sha", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1")
    groups = groups.select(F.col("sha").alias("g_sha"), F.col("n").alias("g_n"), "last")
    found = marks.join(groups.hint("merge"), (marks.sha == groups.g_sha) & (marks.n == groups.g_n) & ~marks.page_id.eqNullSafe(groups.last))
    return found.select(F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"), "last").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = 0, pages_per_archive: int = 2000) -> DataFrame:
    """Writes a record for every page (page_id, url, html) and returns the manifest: path, records."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    cuts = cut_points(pages, "page_id", max(1, pages.count() // pages_per_archive + 1))
    dictionary = trained(pages)
    revisits = roles(pages, least)
    # html travels once: a page's role comes just before it, rather than by a join that deals html anew
    notes = revisits.select(F.col("r_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "last", F.col("r_sha").alias("sha"))
    rows = pages.select("page_id", "url", "html", F.lit(None).cast("long").alias("last"), F.lit(None).cast("string").alias("sha")).unionByName(notes)
    rows = rows.select(range_of(F.col("page_id"), cuts).alias("part"), "*").repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "page_id", F.col("sha").desc_nulls_last())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        row = next(source, None)
        while row is not None:
            part, n, path = row[0], 0, f"{folder}/pages-{row[0]:06d}.warc.zst"
            head, squeeze = start_archive(dictionary)
            at, noted = None, {}
            with AtomicFile(path) as out:
                out.write(head)
                while row is not None and row[0] == part:
                    _, page_id, url, html, last, sha = row
                    if page_id != at:
                        at, noted = page_id, {}
                    if sha is not None:
                        noted[sha] = last
                    else:
                        payload = html.encode()
                        key = hashlib.sha1(payload).hexdigest() if noted else ""
                        out.write(squeeze.compress(record_of(page_id, url, payload, noted.get(key), key in noted)))
                        n += 1
                    row = next(source, None)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return saved(rows.mapInArrow(lean(write), "path string, records long"), "archives")


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives at the manifest's paths; payload is null in a revisit."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda uri: None if uri == "<urn:page:none>" else int(uri.removeprefix("<urn:page:").rstrip(">"))
        for batch in batches:
            for path, records in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = file_system(path)
                rows: list[tuple] = []
                seen = 0
                with store.open_input_stream(name, compression=None) as file:
                    for raw in read_archive(file):
                        r = parse_record(raw)
                        h, revisit = r["headers"], r["headers"]["warc-type"] == "revisit"
                        rows.append((number(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], r["length"], h["warc-payload-digest"].removeprefix("sha1:"), number(h["warc-refers-to"]) if revisit else None, None if revisit else r["payload"]))
                        seen += 1
                        if len(rows) == 200:
                            yield as_batch(rows)
                            rows = []
                if rows:
                    yield as_batch(rows)
                if seen != records:
                    raise BadRecord(f"{path} has {seen} records, not {records}")

    return manifest.select("path", "records").repartition(max(1, manifest.count()), "path").mapInArrow(lean(read), RECORD)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows)), kinds)], names=[c.split()[0] for c in RECORD.split(", ")])


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""Web archives: revisit resolution and deduplicated WARC files with fresh headers.

Headers - not payloads - are shuffled by payload digest.  Of the responses with one digest the first one is the original; it
is found with partial results and joined to all records of the digest, so that a payload that every site has is no task of
its own.  Revisit records and later responses of the same payload become revisit records that refer to the original.  Then
the originals' headers are joined to their payloads; revisits are written from their headers alone.  Each partition is written
as WARC files of gzip members, a member for each record, so that a record can be read by its offset; a file is closed when it
has ``ROLL`` bytes, and records go out as they come.  Record identifiers are derived from what identifies a capture, so
writing again gives the same bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfold.llm import files
from nearfold.llm.frames import new_folder, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date in the headers of captures that come without one.
WRITTEN = "2026-01-01T00:00:00Z"
#: Bytes after which an archive is closed and the next one begun.
ROLL = 1 << 30
#: Bytes that are read of an archive at once, and bytes of payloads that go out in a batch.
READ = 1 << 20
ENTRY_SCHEMA = "page_id long, url string, captured string, warc_type string, payload_digest string, n_bytes long, original_page_id long, original_url string, archive string, record_offset long, record_length long"
ENTRY_NAMES = [part.split()[0] for part in ENTRY_SCHEMA.split(", ")]
RECORD_SCHEMA = "archive string, record_offset long, record_length long, record_id string, warc_type string, target_uri string, captured string, payload_digest string, digest string, refers_to string, refers_to_uri string, payload binary"
RECORD_NAMES = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
CAPTURE = ["page_id", "url", "captured", "payload_digest", "n_bytes", "is_revisit", "refers_to", "refers_to_uri", "payload"]


def record_id(page_id: int | None, url: str | None, captured: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{captured}|{digest}')}>"


def _line(text: str | None) -> str:
    return (text or "").replace("\r", "").replace("\n", "")


def record(r: dict) -> bytes:
    """A WARC record: header, HTTP header and, in a response, the payload."""
    whole, payload = r["warc_type"] == "response", r["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if whole else 0}\r\n\r\n".encode()
    block = http + payload if whole else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {r['warc_type']}",
        f"WARC-Record-ID: {record_id(r['page_id'], r['url'], r['captured'], r['payload_digest'])}",
        f"WARC-Date: {_line(r['captured'] or WRITTEN)}",
        f"WARC-Target-URI: {_line(r['url'])}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(r['payload_digest'])).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if not whole:
        head.append(f"WARC-Profile: {PROFILE}")
        if r["has_original"]:
            first = r["original_page_id"], r["original_url"], r["original_captured"]
            head += [f"WARC-Refers-To: {record_id(*first, r['payload_digest'])}", f"WARC-Refers-To-Target-URI: {_line(first[1])}", f"WARC-Refers-To-Date: {_line(first[2] or WRITTEN)}"]
        else:
            # Its original is in no archive here: it goes on referring to what it did.
            head += [f"{name}: {_line(r[k])}" for name, k in (("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_uri")) if r[k]]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """The captures (CAPTURE) of ``pages(page_id, url, html)``: responses, all without a date of their own."""
    none = F.lit(None).cast("string")
    own = pages.where("html IS NOT NULL").select("page_id", "url", "html")
    return own.select("page_id", "url", none.alias("captured"), F.sha1("html").alias("payload_digest"), F.octet_length("html").cast("long").alias("n_bytes"), F.lit(False).alias("is_revisit"), none.alias("refers_to"), none.alias("refers_to_uri"), F.col("html").cast("binary").alias("payload"))


def captures_of_records(records: DataFrame) -> DataFrame:
    """The captures (CAPTURE) of what read_archives gives: responses and revisits; other records and unknown digests are left out."""
    is_revisit = F.col("warc_type") == "revisit"
    kept = records.where("warc_type IN ('response', 'revisit') AND digest IS NOT NULL")
    size = F.when(~is_revisit, F.octet_length("payload").cast("long"))
    return kept.select(F.lit(None).cast("long").alias("page_id"), F.col("target_uri").alias("url"), "captured", F.col("digest").alias("payload_digest"), size.alias("n_bytes"), is_revisit.alias("is_revisit"), "refers_to", "refers_to_uri", "payload")


def resolve(headers: DataFrame) -> DataFrame:
    """Headers (CAPTURE without payload) with the kind each record gets and its original, once for each capture.

    The original is the first response of the digest by (page_id, url, captured), nulls last; a revisit whose digest has no
    response stays a revisit without an original.  A capture that is there as a response and as a revisit is a response.
    n_bytes of a revisit is that of its original.
    """
    key = ["page_id", "url", "captured", "payload_digest"]
    place = F.struct(*[c for k in key[:3] for c in (F.col(k).isNull().alias(f"no_{k}"), F.col(k))])
    each = headers.groupBy(*key).agg(F.min("is_revisit").alias("is_revisit"), F.max("n_bytes").alias("n_bytes"), F.min("refers_to").alias("refers_to"), F.min("refers_to_uri").alias("refers_to_uri"))
    originals = each.where("NOT is_revisit").groupBy("payload_digest").agg(F.min(place).alias("first"), F.max("n_bytes").alias("size"))
    own = ~F.col("is_revisit")
    for k in key[:3]:
        own = own & F.col(k).eqNullSafe(F.col(f"first.{k}"))
    return each.join(originals, "payload_digest", "left").select(
        *key,
        F.coalesce("n_bytes", "size").alias("n_bytes"),
        F.when(own, "response").otherwise("revisit").alias("warc_type"),
        F.col("first").isNotNull().alias("has_original"),
        *[F.col(f"first.{k}").alias(f"original_{k}") for k in key[:3]],
        "refers_to",
        "refers_to_uri",
    )


def write_captures(captures: DataFrame, folder: str | None = None, roll: int = ROLL) -> DataFrame:
    """Writes ``captures`` (CAPTURE) as deduplicated archives when the result is computed; a row for each record.

    Rows have the record's kind, digest, size of payload, original, and its file, offset and length in it.

    Defined results: null page_ids, urls and dates are values that come last; equal captures are one; a revisit without an
    original keeps what it refers to; an empty payload is a capture of no bytes; other columns are ignored; an empty table
    writes nothing.
    """
    folder = folder or new_folder(captures.sparkSession, "archives")
    files.make(folder)
    decided = stored(resolve(captures.select(*CAPTURE[:-1])), "headers")
    # One text key, never null, so that the join and what follows it share a partitioning: payloads move once.
    ident = F.to_json(F.struct("page_id", "url", "captured")).alias("ident")
    keyed = captures.where("NOT is_revisit").select("payload_digest", ident, "payload")
    joined = decided.where("warc_type = 'response'").select("*", ident).join(keyed, ["payload_digest", "ident"])
    # Of equal rows one is taken.
    numbered = Window.partitionBy("payload_digest", "ident").orderBy(F.lit(0))
    responses = joined.withColumn("nth", F.row_number().over(numbered)).where("nth = 1").drop("nth", "ident")
    revisits = decided.where("warc_type = 'revisit'").withColumn("payload", F.lit(None).cast("binary"))
    order = ["page_id", "url", "captured", "payload_digest"]
    records = responses.sortWithinPartitions(*order).unionByName(revisits.sortWithinPartitions(*order))

    def run(batches):
        part, number, out, name = TaskContext.get().partitionId(), 0, None, ""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None:
                    name = f"part-{part:06d}-{number:04d}.warc.gz"
                    out = files.Draft(folder, name)
                member = gzip.compress(record(r), 6, mtime=0)
                rows.append((name, out.size, len(member)))
                out.write(member)
                if out.size >= roll:
                    out.finish()
                    out, number = None, number + 1
            if rows:
                columns = [batch.column(c) for c in ENTRY_NAMES[:-3]]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64())))], names=ENTRY_NAMES)
        if out is not None:
            out.finish()

    return records.mapInArrow(run, ENTRY_SCHEMA)


def write_archives(pages: DataFrame, folder: str | None = None, roll: int = ROLL) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` as deduplicated archives; see write_captures.  A null html is no capture and left out."""
    return write_captures(captures_of_pages(pages), folder, roll)


def rewrite_archives(spark: SparkSession, source: str, folder: str | None = None, roll: int = ROLL) -> DataFrame:
    """Reads the archives of a folder, revisits among them, and writes them deduplicated; see write_captures."""
    return write_captures(captures_of_records(read_archives(spark, source)), folder, roll)


def parse(raw: bytes):
    """Of each record in ``raw`` its header by lower-case name, and its payload (of an HTTP response, what follows the HTTP header)."""
    at = 0
    while raw[at : at + 5] == b"WARC/":
        end = raw.index(b"\r\n\r\n", at)
        fields = dict(line.split(":", 1) for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
        fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
        size = int(fields.get("content-length", 0))
        block = raw[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("a record is shorter than its header says")
        at = end + 4 + size
        while raw[at : at + 2] == b"\r\n":
            at += 2
        if fields.get("content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        yield fields, block
    if at < len(raw):
        raise ValueError("what follows a record is none")


def members(stream):
    """(offset, length, content) of each gzip member of a stream, which is read piece by piece; cut ones are errors."""
    at, have = 0, b""
    while True:
        have = have or stream.read(READ)
        if not have:
            return
        inflate, parts, length = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not have:
                raise ValueError(f"the member at {at} is cut off")
            parts.append(inflate.decompress(have))
            length += len(have) - len(inflate.unused_data)
            have = inflate.unused_data if inflate.eof else stream.read(READ)
        yield at, length, b"".join(parts)
        at += length


def _digest(text: str | None) -> str | None:
    """A digest like ``sha1:BASE32`` as hexadecimal digits, null for any other."""
    kind, _, value = (text or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if len(value) == 40:
        return value.lower()
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the .warc.gz files of a folder, with the offset and length of the gzip member that each is in.

    digest is the payload's SHA-1 in hexadecimal digits, of a response taken from the payload itself.  Payloads of other
    records than responses are null.  A file is read as a stream, so its size doesn't matter; a damaged one is an error, an
    empty one has no records, and a folder without archives gives an empty table.
    """

    def run(batches):
        rows, held = [], 0

        def batch_of(rows):
            kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 8, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=RECORD_NAMES)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                at, name = files.opened(path)
                with at.open_input_stream(name, compression=None) as stream:
                    for offset, length, raw in members(stream):
                        for f, payload in parse(raw):
                            kind, payload_digest = f.get("warc-type"), f.get("warc-payload-digest")
                            whole = kind == "response"
                            digest = hashlib.sha1(payload).hexdigest() if whole else _digest(payload_digest)
                            rows.append((name.rsplit("/", 1)[-1], offset, length, f.get("warc-record-id"), kind, f.get("warc-target-uri"), f.get("warc-date"), payload_digest, digest, f.get("warc-refers-to"), f.get("warc-refers-to-target-uri"), payload if whole else None))
                            held += len(payload)
                            if held > READ:
                                yield batch_of(rows)
                                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    # Only the paths are asked for, so Spark lists the files and doesn't read them.
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path").mapInArrow(run, RECORD_SCHEMA)

"""WARC archives: one gzip member per record, written and read in sequence.

The reader takes any stream of byte chunks. It inflates incrementally, finds the header's end, frames the block by ``Content-Length``,
checks the closing blank lines, that the member ends there, and the payload's digest; memory is one record's. Damage of any kind raises
``WarcError`` with the record's number.

Payloads are UTF-8 of the page. Of equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest page id is stored; the others
become ``revisit`` records that name it and carry only the HTTP head. Which page that is comes from one pre-aggregated count by digest;
a digest that very many pages share is one row of that table, and Spark splits its side of the join.

Archives are values of Parquet rows, since only Spark reaches the shared store; each value is a complete .warc.gz file.

Defined cases: null html is an empty payload; a null url becomes a URN of the page; line breaks in a url are percent-encoded; a null page id
is written and read as null and never referred to; repeated rows stay separate records, and rows equal in payload and page id are all responses.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, bounded_batches, utf8

MIN_REVISIT, ARCHIVE_BYTES = 1000, 8 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(urn: str) -> int | None:
    found = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "null" else int(found)


def write_record(page: int | None, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member; a record that refers to another leaves its payload out."""
    target = (url or _urn(page).strip("<>")).replace("\r", "%0D").replace("\n", "%0A")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", _urn(page)), ("WARC-Target-URI", target), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is None:
        block += payload
    else:
        fields[0] = ("WARC-Type", "revisit")
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", _PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + press.flush()


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, found, v = line.partition(b":")
        if not found:
            raise WarcError(f"a header line without a colon: {line[:60]!r}")
        out[k.strip().lower().decode()] = v.strip().decode("utf-8", "surrogatepass")
    return out


def read_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields with lower-cased names, block) of each record in turn."""
    source, pending, number = iter(chunks), b"", 0
    while True:
        while not pending:
            pending = next(source, None)
            if pending is None:
                return
        member, text, fields, need = zlib.decompressobj(31), bytearray(), None, -1
        while not member.eof:
            try:
                text += member.decompress(pending)
            except zlib.error as e:
                raise WarcError(f"record {number}: {e}") from e
            pending = member.unused_data
            if fields is None and (end := text.find(b"\r\n\r\n")) >= 0:
                if not text.startswith(b"WARC/"):
                    raise WarcError(f"record {number}: no WARC version line")
                fields = _fields(bytes(text[:end]))
                need = end + 4 + int(fields.get("content-length", -1 << 60))
                if need < 0:
                    raise WarcError(f"record {number}: no content length")
            if fields is not None and len(text) > need + 4:
                raise WarcError(f"record {number}: longer than its content length")
            if not member.eof:
                pending = next(source, None)
                if pending is None:
                    raise WarcError(f"record {number}: the file ends inside it")
        if fields is None or len(text) != need + 4 or text[need:] != b"\r\n\r\n":
            raise WarcError(f"record {number}: its length isn't its content length")
        start = need - int(fields["content-length"])
        yield fields, bytes(text[start:need])
        number += 1


def page_of(fields: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page id, payload bytes, digest, record type and referred page of a record; a response's payload is verified."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("a block without an HTTP head")
    n, digest = int(_fields(head)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise WarcError(f"payload of {fields['warc-record-id']} doesn't match its digest")
    refers = fields.get("warc-refers-to")
    return _page(fields["warc-record-id"]), n, digest, kind, None if refers is None else _page(refers)


def write_archives(scratch: Scratch, pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Archives (blob) of ``pages`` (page_id, url, html)."""
    bounded_batches(pages.sparkSession)
    own = pages.select("page_id", "url", utf8("html").alias("payload")).withColumn("n_bytes", F.octet_length("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    stored = own.where((F.col("n_bytes") >= min_revisit) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("stored"), F.count("*").alias("n")).where("n > 1")
    stored = scratch.write(stored.select("digest", "stored"), "stored")
    both = own.join(stored, "digest", "left")
    refers = F.when((F.col("n_bytes") >= min_revisit) & ~F.col("stored").eqNullSafe(F.col("page_id")), F.col("stored"))
    both = both.select("page_id", F.when(refers.isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "url", "n_bytes", "digest", refers.alias("refers_to"))

    def archive(batches):
        kept, size = [], 0
        for b in batches:
            for page, payload, url, n, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kept.append(write_record(page, url, payload, n, digest, refers_to))
                size += len(kept[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(kept)], pa.binary())], names=["blob"])
                    kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(kept)], pa.binary())], names=["blob"])

    return scratch.write(both.mapInArrow(archive, "blob binary"), "archives", "none")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of every record."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def read(batches):
        for b in batches:
            for blob in b.column(0):
                view, rows = memoryview(blob.as_buffer()), []
                for fields, block in read_records(bytes(view[i : i + 65536]) for i in range(0, len(view), 65536)):
                    rows.append((*page_of(fields, block), fields["warc-target-uri"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.select("blob").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def warc_round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    return read_archives(write_archives(Scratch(pages.sparkSession, "warc"), pages, min_revisit))

"""WARC archives, index first: write records with an index, then read selected records by coalesced byte ranges.

Each record is a gzip member of its own, so an index entry (file, offset, length) is enough to read it alone. Archives
go to the shared folder under names of their task attempt: the index, written once, lists those of the attempts that
counted, so repeated or speculative tasks leave files that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadrille.llm.storage import filesystem, materialise, new_path

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SMALLEST_REVISIT = 1000
FILE_BYTES = 256 << 20
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to, refers_url for each row; the latter two are null for responses.

    Copies are counted by digest with map-side combining; only digests that occur more than once meet the rows again,
    in a join whose hot keys Spark can split.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("large", F.octet_length("html") >= smallest)
    copies = (
        rows.where("large")
        .groupBy(F.col("digest").alias("d"))
        .agg(F.max(F.struct("page_id", "url")).alias("last"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and last.page_id is not null")
    )
    joined = rows.join(copies, (rows["digest"] == copies["d"]) & rows["large"], "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last.page_id"))
    return joined.select(
        "page_id", "url", "html", "digest",
        F.when(again, F.col("last.page_id")).alias("refers_to"),
        F.when(again, F.col("last.url")).alias("refers_url"),
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One uncompressed WARC record. A revisit has the HTTP head of its payload, but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    names = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        names.append(("WARC-Target-URI", _header(url)))
    if refers_to is not None:
        names += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        if refers_url is not None:
            names.append(("WARC-Refers-To-Target-URI", _header(refers_url)))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in names)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _header(value: str) -> str:
    """``value`` with control characters and line ends quoted, so that it stays on one line."""
    return "".join(c if c.isprintable() and c != "\x85" else quote(c, errors="surrogatepass") for c in value)


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers (names in lower case), HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    named = dict((k.lower(), v) for k, _, v in (line.partition(": ") for line in lines[1:]))
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict((k.lower(), v) for k, _, v in (line.partition(": ") for line in http.decode().split("\r\n")[1:]))
    return named, fields, payload


def write(pages: DataFrame, path: str | None = None, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` as archives below ``path`` (a folder that all executors share) and return their index: page_id,
    url, digest, record_type, file, offset, length. The index is itself written in the shared folder.

    A null html is an empty payload, a null url has no target header, a null page_id is written as ``none``; equal
    payloads of at least 1000 bytes are written once, with the largest page_id (rows that repeat it are responses
    too). An empty table gives no archive. Other columns are not read.
    """
    folder = path or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    raw = record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["digest"], r["refers_to"], r["refers_url"], date)
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    member = packer.compress(raw) + packer.flush()
                    out.write(member)
                    kind = "response" if r["refers_to"] is None else "revisit"
                    rows.append({"page_id": r["page_id"], "url": r["url"], "digest": r["digest"], "record_type": kind, "file": f"{folder}/{name}", "offset": at, "length": len(member)})
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_index_schema())
        finally:
            if out is not None:
                out.close()

    return materialise(decide(pages, id_col, url_col, html_col).mapInArrow(run, INDEX), "warc-index")


def _index_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in INDEX.split(", "))])


def ranges(entries: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> list[tuple[int, int, list[int]]]:
    """Coalesce sorted (offset, length) entries: (start, end, positions). Ranges join over gaps of ``gap`` bytes or
    less while they stay within ``most`` bytes."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(entries):
        if out and offset - out[-1][1] <= gap and max(offset + length, out[-1][1]) - out[-1][0] <= most:
            start, end, held = out[-1]
            held.append(i)
            out[-1] = (start, max(end, offset + length), held)
        else:
            out.append((offset, offset + length, [i]))
    return out


def read(index: DataFrame, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """Read the records that ``index`` lists (all of a ``write`` or any selection of it): page_id, url, payload_bytes,
    payload_digest (SHA-1, lower-case hex), record_type, refers_to, payload (null for revisits).

    Entries are dealt by file and stretch of ``most`` bytes, sorted, and read in ranges that span small gaps. Payload
    digests are computed from the bytes that were read and compared with the record's own header.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // (2 * most)))  # by bytes of the archives: the index alone looks too small to spread
    dealt = index.withColumn("stretch", F.floor(F.col("offset") / most)).repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*(batch.column(n).to_pylist() for n in ("file", "offset", "length")), strict=True):
                at.setdefault(file, []).append((offset, length))
            for file, entries in at.items():
                files, name = filesystem(file)
                with files.open_input_file(name) as source:
                    for start, end, held in ranges(entries, gap, most):
                        source.seek(start)
                        data = source.read(end - start)
                        rows = [_row(zlib.decompress(data[entries[i][0] - start : entries[i][0] - start + entries[i][1]], 31)) for i in held]
                        yield pa.RecordBatch.from_pylist(rows, schema=_record_schema())

    return dealt.select("file", "offset", "length").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _record_schema() -> pa.Schema:
    return pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _number(urn: str | None) -> int | None:
    tail = (urn or "none").rstrip(">").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def _row(raw: bytes) -> dict:
    named, fields, payload = parse(raw)
    digest = base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = named["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {named['warc-record-id']} does not match its digest")
    return {
        "page_id": _number(named["warc-record-id"]),
        "url": named.get("warc-target-uri"),
        "payload_bytes": int(fields["content-length"]) if revisit else len(payload),
        "payload_digest": digest,
        "record_type": named["warc-type"],
        "refers_to": _number(named.get("warc-refers-to")),
        "payload": None if revisit else payload,
    }


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all of ``pages``, then read every record back: one row per page, without the payload."""
    return read(write(pages)).drop("payload", "url")

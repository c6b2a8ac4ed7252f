"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Each record is a gzip member of its own. The reader checks every member (inflates, checks
its sum), the version line, the headers, the stated length, the two closing line ends and
the block digest. Where a check fails it looks on from the next byte for a member, or in
plain files a version line, that passes all checks, goes on from there, and reports the
bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import DataFrame, functions as F

from mailloom.llm.common import kept, small_batches, store_file
from mailloom.session import fresh_path, salted_join

ARCHIVE_BYTES = 8_000_000
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
MANIFEST = "file string, n_records long, n_bytes long"
RECORD = ("file string, at long, size long, kind string, page_id long, url string,"
          " payload_bytes long, payload_digest string, record_type string, refers_to long,"
          " payload binary, problem string")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to=None, refers_to_url=None) -> bytes:
    """One record, not compressed. With `refers_to` a revisit, else a response."""
    block = b"" if refers_to is not None else _HTTP % len(payload) + payload
    line = lambda v: re.sub(r"[\r\n]+", " ", v)  # noqa: E731  a header is one line
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2020-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", line(url)))
    if refers_to is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        if refers_to_url is not None:
            head.append(("WARC-Refers-To-Target-URI", line(refers_to_url)))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record at `at`; ValueError names the failed check."""
    if not VERSION.match(data, at):
        raise ValueError("version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("headers do not end")
    head = {}
    for row in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = row.partition(b":")
        if not colon:
            raise ValueError("header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise ValueError("length")
    start, end = stop + 4, stop + 4 + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("record end")
    block = data[start:end]
    stated = head.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != base32_sha1(block):
        raise ValueError("block digest")
    return head, block, end + 4


def _next_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    if data.startswith(MEMBER, at):
        d = zlib.decompressobj(31)
        try:
            # Slices, as the member's length is not known and the file may be long.
            out, i = [], at
            while not d.eof and i < len(data):
                out.append(d.decompress(data[i:i + 65536]))
                i += 65536
        except zlib.error as e:
            raise ValueError("gzip member") from e
        if not d.eof:
            raise ValueError("gzip member cut off")
        plain = b"".join(out)
        head, block, end = parse_record(plain)
        if end != len(plain):
            raise ValueError("bytes after record")
        return head, block, min(i, len(data)) - len(d.unused_data)
    return parse_record(data, at)


_STARTS = re.compile(re.escape(MEMBER) + rb"|WARC/1\.[01]\r\n")


def salvage(data: bytes):
    """Yield ("record", at, end, headers, block) and ("gap", at, end, problem, b"") in order.

    Together they cover the file. An empty file yields nothing.
    """
    at = 0
    while at < len(data):
        try:
            head, block, end = _next_record(data, at)
            yield "record", at, end, head, block
            at = end
            continue
        except ValueError as e:
            problem = str(e)
        end = len(data)
        for found in _STARTS.finditer(data, at + 1):
            try:
                _next_record(data, found.start())
            except ValueError:
                continue
            end = found.start()
            break
        yield "gap", at, end, problem, b""
        at = end


def _page(value: str | None):
    got = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(got[1]) if got else None


def with_first_pages(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """(page_id, url, html, first_id, first_url): the smallest page with an equal payload.

    A payload below `min_payload` bytes is its own first. Payloads are told apart by SHA-1;
    their texts are not shuffled for it. A payload that a third of all pages share is one
    row on the right side of a salted join.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sums = p.select("page_id", "url", F.sha1("html").alias("sum"), F.octet_length("html").alias("n"))
    firsts = sums.filter(F.col("n") >= min_payload).groupBy("sum").agg(
        F.min_by(F.struct("page_id", "url"), F.col("page_id")).alias("first"),
        F.count("*").alias("copies"),
    ).filter("copies > 1 AND first IS NOT NULL").select(
        "sum", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    return salted_join(p.withColumn("sum", F.sha1("html")), kept(firsts, "firsts"), ["sum"],
                       "left", F.struct("page_id", "url")).drop("sum")


def write_archives(pages: DataFrame, folder: str | None = None, min_payload: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Write one record for each row of `pages` (page_id, url, html); null html is empty.

    Of equal payloads of at least `min_payload` bytes the rows with the smallest page_id are
    responses, all others (null page_ids too) revisit it. Returns the folder and the
    manifest of files that count (file, n_records, n_bytes); repeated tasks write other
    names. An empty table writes no file. Further columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    small_batches(spark)

    def run(batches):
        import pandas as pd

        held, size = [], 0

        def flush():
            data = b"".join(held)
            return pd.DataFrame({"file": [store_file(folder, "pages", data)],
                                 "n_records": [len(held)], "n_bytes": [len(data)]})

        none = lambda v: None if v is None or v != v else int(v)
        for pdf in batches:
            for page, url, html, first, first_url in zip(
                    pdf["page_id"], pdf["url"], pdf["html"], pdf["first_id"], pdf["first_url"]):
                page, first, payload = none(page), none(first), html.encode()
                again = first is not None and first != page
                held.append(member(record_bytes(
                    page, url, payload, base32_sha1(payload), *((first, first_url) if again else ()))))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return folder, kept(with_first_pages(pages, min_payload).mapInPandas(run, MANIFEST), "manifest")


def read_archives(folder: str, manifest: DataFrame) -> DataFrame:
    """Records and quarantined gaps of the files that the manifest names (schema RECORD).

    kind is "record" or "gap"; at and size are the place and length in the file. Payload
    bytes and digest of a response are taken from the payload itself.
    """
    spark = manifest.sparkSession

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in RECORD.split(", ")]

        def frame(rows):
            return pd.DataFrame(rows, columns=names).astype(
                {"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                file, rows = path.rsplit("/", 1)[-1], []
                for kind, at, end, head, block in salvage(content):
                    if kind == "gap":
                        rows.append((file, at, end - at, kind, *[None] * 7, head))
                        continue
                    revisit = head.get("warc-type") == "revisit"
                    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                    if revisit:
                        n = head.get("x-payload-length", "")
                        n = int(n) if n.isascii() and n.isdigit() else None
                        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    else:
                        n, digest = len(payload), base32_sha1(payload)
                    rows.append((file, at, end - at, kind, _page(head.get("warc-record-id")),
                                 head.get("warc-target-uri"), n, digest, head.get("warc-type"),
                                 _page(head.get("warc-refers-to")), payload, None))
                    if len(rows) >= 200:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInPandas(run, RECORD).join(manifest.select("file"), "file", "left_semi")

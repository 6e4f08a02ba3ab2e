"""WARC archives with a two-level capture index.

Writing: every task writes one archive of gzipped records, one record per member, to the shared
folder, and hands on where each record lies.  Of pages with equal payloads (of at least
``REVISIT_BYTES`` bytes) that with the least id is a response, the others are revisit records.

Index: captures are range-partitioned and sorted by (reversed-host URL key, page id).  Runs of
``BLOCK_LINES`` lines are compressed into blocks, the first level; the sparse block directory, one
line per block with its first key, is the second.

Lookup: a key is bisected in the directory, its block read by range and unpacked, the key bisected
in the block's lines, and the record read by range from its archive.  Requests are dealt by key,
so a task unpacks each of its blocks once per batch; a popular URL is split by page id.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.shared import as_table, work_folder

REVISIT_BYTES = 100
BLOCK_LINES = 3000
CAPTURE_DATE = "2000-01-01T00:00:00Z"

CAPTURES = "key string, page_id long, archive string, start long, length long"
_CAPTURES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()),
                       ("start", pa.int64()), ("length", pa.int64())])
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
           "payload_bytes long, payload binary")
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                      ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                      ("payload", pa.binary())])
_HOST = re.compile(r"^(?:www\d*\.)?(.*?)\.?$")


def url_key(url: str | None) -> str:
    """Sortable key of a URL: host labels reversed, then path and query, in lower case."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:  # not a URL: filed under its own text
        return ")" + re.sub(r"\s", "", url).lower()
    labels = ",".join(reversed(_HOST.sub(r"\1", host.lower()).split(".")))
    labels += f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{labels}){re.sub(r'[\s\x00-\x1f]', '', rest).lower()}"


def _sort_key(key: str, page) -> str:
    """Key and page id as one string that sorts by both (no id before all others)."""
    return f"{key} {'' if page is None else f'{page + (1 << 63):020d}'}"


@functools.lru_cache(maxsize=8)
def _file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or ":/" in folder else f"file://{folder}")


def record(page, url, payload: bytes | None, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record; ``payload`` None makes it a revisit of page ``refers_to``."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = head + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {CAPTURE_DATE}",
             *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=_PLAIN)}"]),
             f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(body)}"]
    if payload is None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


_PLAIN = "".join(chr(c) for c in range(33, 127) if chr(c) not in "%<>\"")


def parse(raw: bytes) -> dict:
    """Fields of one unpacked record; a response's digest is computed from what was read."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = body[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    page = fields["WARC-Record-ID"][10:-1]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"page {page}: the payload differs from its digest")
    return {"page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "record_type": kind,
            "refers_to": int(fields["WARC-Refers-To"][10:-1]) if kind == "revisit" else None,
            "payload_digest": digest, "payload_bytes": size, "payload": payload if kind == "response" else None}


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        # a name of its own for every attempt: only the attempt that Spark commits is indexed
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in batches:
            rows = []
            for page, url, html, digest, size, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                packed = _gzip(record(page, url, html.encode() if refers is None else None, digest, size, refers))
                out.write(packed)
                rows.append((url_key(url), page, name, at, len(packed)))
                at += len(packed)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CAPTURES)],
                                                 schema=_CAPTURES)
        if out is not None:
            out.close()

    return run


def decide(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Pages with digest, size and, for revisits, the id of the response they refer to.

    Only pages of payloads that occur more than once are matched; the least id of equal payloads is
    found by partial aggregation, so a payload with very many copies costs no more than another.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"),
                       F.octet_length("html").cast("long").alias("size"))
    copies = (rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    return rows.join(copies, "digest", "left").select(
        "page_id", "url", "html", "digest", "size",
        F.when(F.col("first").isNotNull() & other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write WARC files below ``folder``/archives; returns the table of captures (``CAPTURES``)."""
    written = decide(pages, id_col, url_col, html_col).mapInArrow(_write(f"{folder}/archives"), CAPTURES)
    return as_table(written, f"{folder}/captures")


def _write_blocks(folder: str):
    schema = pa.schema([("first", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        name = f"cdx-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.gz"
        out, at, lines = None, 0, []

        def flush():
            nonlocal at, lines
            packed = _gzip("\n".join(lines).encode())
            out.write(packed)
            row = {"first": lines[0].split("\t", 1)[0], "file": name, "start": at, "length": len(packed)}
            at, lines = at + len(packed), []
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for key, page, archive, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                lines.append(f"{_sort_key(key, page)}\t{archive}\t{start}\t{length}")
                if len(lines) == BLOCK_LINES:
                    yield flush()
        if lines:
            yield flush()
        if out is not None:
            out.close()

    return run


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the compressed blocks below ``folder``/index; returns the block directory."""
    ordered = captures.select("key", F.col("page_id"), "archive", "start", "length")
    ordered = ordered.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return as_table(ordered.mapInArrow(_write_blocks(f"{folder}/index"),
                                       "first string, file string, start long, length long"), f"{folder}/directory")


class Index:
    """The directory of one index and the blocks last unpacked."""

    def __init__(self, folder: str) -> None:
        import pyarrow.dataset as ds

        self.fs, self.base = _file_system(folder)
        rows = ds.dataset(f"{self.base}/directory", filesystem=self.fs, format="parquet").to_table().sort_by("first")
        self.first, self.file = rows["first"].to_pylist(), rows["file"].to_pylist()
        self.start, self.length = rows["start"].to_pylist(), rows["length"].to_pylist()
        self.block_no, self.keys, self.lines = -1, [], []
        self.open_name, self.open_file = "", None

    def find(self, key: str, page) -> tuple[str, int, int] | None:
        """Archive, start and length of a capture."""
        wanted = _sort_key(key, page)
        no = bisect.bisect_right(self.first, wanted) - 1
        if no < 0:
            return None
        if no != self.block_no:
            with self.fs.open_input_file(f"{self.base}/index/{self.file[no]}") as f:
                packed = f.read_at(self.length[no], self.start[no])
            self.lines = zlib.decompress(packed, 31).decode().split("\n")
            self.keys = [x.split("\t", 1)[0] for x in self.lines]
            self.block_no = no
        at = bisect.bisect_left(self.keys, wanted)
        if at == len(self.keys) or self.keys[at] != wanted:
            return None
        _, archive, start, length = self.lines[at].split("\t")
        return archive, int(start), int(length)

    def read(self, archive: str, start: int, length: int) -> dict:
        """The record in a range of an archive."""
        if archive != self.open_name:
            if self.open_file:
                self.open_file.close()
            self.open_name, self.open_file = archive, self.fs.open_input_file(f"{self.base}/archives/{archive}")
        return parse(zlib.decompress(self.open_file.read_at(length, start), 31))


def _look_up(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or Index(folder)
            found = [index.find(k, p) for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rows = [index.read(*x) for x in sorted(x for x in found if x)]
            if not payloads:
                for r in rows:
                    r["payload"] = None
            yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    return run


def look_up(wanted: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
            payloads: bool = True) -> DataFrame:
    """Records (``RECORDS``) of the captures that rows of ``wanted`` ask for by URL and page id.

    A capture that the index lacks gives no row; with ``payloads`` false the payload is checked
    against its digest but left out.
    """
    keys = wanted.select(_key(url_col).alias("key"), F.col(id_col).cast("long").alias("page_id"))
    return (keys.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
            .mapInArrow(_look_up(folder, payloads), RECORDS))


def _key(url_col: str) -> Column:
    @F.pandas_udf("string")
    def keys(urls):
        return urls.map(lambda u: url_key(u if isinstance(u, str) else None))

    return keys(F.col(url_col).cast("string"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive every row of ``pages``, index the archives and read every record back.

    A null html is an empty payload, a null or malformed URL is filed under its own text, a null
    page id never is a response's id unless all its equal pages lack one.  Rows that repeat page id
    and url each give a record; both lookups find the last written, so repeated rows give repeated
    results of equal payload.  An empty table gives an empty table; other columns are ignored.
    """
    folder = work_folder(pages.sparkSession)
    captures = write_archives(pages, folder, id_col, url_col, html_col)
    write_index(captures, folder)
    return look_up(pages, folder, id_col, url_col, payloads=False)


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """The block directory of an index written before."""
    return spark.read.parquet(f"{folder}/directory")

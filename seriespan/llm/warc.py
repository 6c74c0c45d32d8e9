"""Operator 4: WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per record to ``part-*.warc.gz`` and returns the capture
lines. ``write_index`` sorts the lines by their reversed-host URL key into compressed blocks of
``BLOCK_LINES`` lines and keeps a sparse directory with the first key, place and length of every
block. ``lookup`` finds a key's block by binary search in the directory, reads only that range and
finds the lines by binary search in the block; ``read_records`` reads only the records' ranges.

Of records with equal payloads of at least ``min_payload`` bytes, the one with the smallest page id
is the response and the others are revisits that refer to it and carry no payload.

Defined results: a null html is an empty payload; a null url gets the key ``""`` and the target
``about:blank``; a url that cannot be split is its own key; blanks, controls and other characters outside ASCII are percent-encoded in a url;
each repeated row is a record, and those of the smallest page id are all responses; a record without
page id is a revisit if a numbered page has its payload, else a response; an empty table writes no
file and gives no rows; columns other than page_id, url and html are not read.

Files are written below the shared folder through Arrow's file systems, under a name with the
attempt's own suffix, and only the names that the finished tasks report are read: a task that is lost
or runs twice leaves a file that nothing refers to.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import attach
from ..session import settle, shared_folder

BLOCK_LINES = 1024
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 2 << 20
MOST_TASKS = 100_000
DATE = "2026-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a URI or a path, and the path in it."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    return fs.LocalFileSystem(), folder


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Reversed host, then path and query: ``com,example,www)/a?b``; the url itself where it has no valid form."""
    try:
        parts = urlsplit(url if "://" in url else "//" + url)
    except ValueError:  # brackets that hold no address
        return url
    try:
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        host, port = parts.netloc.lower(), None
    if not host:
        return url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return key + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def safe_url(url: str | None) -> str:
    return quote(url, safe="".join(map(chr, range(33, 127)))) if url else ""


def record(kind: str, target: str, page: str, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record, not yet compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target or 'about:blank'}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-Id: {page}",
    ]
    if kind == "revisit":
        head += [
            f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page: {refers_to}",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>",
        ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, the payload as stored, and the payload length that the response announced."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    announced = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return fields, payload, announced


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def roles(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to``: null for responses, else the page that holds the payload.

    Payloads are compared by their SHA-256 and length; only these travel, never the texts.
    """
    rows = pages.select(
        "page_id", "url", "html", F.coalesce(F.octet_length("html"), F.lit(0)).alias("_bytes"),
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("_sha"),
    )
    narrow = rows.where(F.col("_bytes") >= min_payload).select("page_id", "_sha")
    groups = settle(
        narrow.groupBy("_sha").agg(F.count("*").alias("_n"), F.min("page_id").alias("_least")).where("_n > 1")
    )
    total = groups.agg(F.sum("_n")).first()[0] or 0
    rows = attach(
        rows, groups, "_sha", count="_n", total=total, spread=F.coalesce(F.col("page_id"), F.length("url"))
    )
    revisit = (F.col("_bytes") >= min_payload) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("_least")))
    return rows.select("page_id", "url", "html", F.when(revisit, F.col("_least")).alias("refers_to"))


CAPTURES = {"archive": pa.string(), "key": pa.string(), "offset": pa.int64(), "length": pa.int64(), "page_id": pa.int64()}
PLACES = {"file": pa.string(), "key": pa.string()}
INDEX_FILES = {"file": pa.string(), "first_key": pa.string(), "last_key": pa.string(), "blocks": pa.int64(), "captures": pa.int64()}
RECORDS = {
    "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
    "refers_to": pa.int64(), "target": pa.string(), "payload": pa.string(),
}


def ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {'long' if kind == pa.int64() else 'string'}" for name, kind in kinds.items())


def batch_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def write_archives(pages: DataFrame, folder: str, *, min_payload: int = 0) -> DataFrame:
    """Write the archives below ``folder``; returns the capture lines, read back from a table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        for batch in batches:
            lines = []
            for page, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    store, path = open_folder(folder)
                    store.create_dir(path, recursive=True)
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(posixpath.join(path, name), compression=None)
                payload, target = (html or "").encode(), safe_url(url)
                member = gzip_member(
                    record("response" if refers is None else "revisit", target, str(page), payload_digest(payload), payload, refers)
                )
                out.write(member)
                lines.append((name, url_key(target), at, len(member), page))
                at += len(member)
            yield batch_of(lines, CAPTURES)
        if out is not None:
            out.close()

    return settle(roles(pages, min_payload).mapInArrow(write, ddl(CAPTURES)))


def write_index(captures: DataFrame, folder: str, *, lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures into compressed blocks below ``folder``, with a sparse directory beside them.

    The sort deals by range of (key, archive, offset), so a host with a third of all captures is
    spread over many files. Each file ``x.cdx.gz`` is a run of gzip blocks; its directory ``x.dir``
    has a line per block: offset, length and first key. Returns ``file, first_key, last_key,
    blocks, captures``, a row per file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, held, blocks, rows = None, uuid.uuid4().hex, 0, [], [], 0
        first = last = None

        def flush() -> None:
            nonlocal at
            member = gzip_member("".join(held).encode())
            out.write(member)
            blocks.append(f"{at} {len(member)} {held[0].partition(' ')[0]}\n")
            at += len(member)
            held.clear()

        store, path = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(posixpath.join(path, f"{name}.cdx.gz"), compression=None)
                last = row.pop("key")
                first = last if first is None else first
                held.append(f"{last} {json.dumps(row, sort_keys=True)}\n")
                rows += 1
                if len(held) >= lines:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            with store.open_output_stream(posixpath.join(path, f"{name}.dir"), compression=None) as f:
                f.write("".join(blocks).encode())
            yield batch_of([(name, first, last, len(blocks), rows)], INDEX_FILES)

    order = [F.encode("key", "UTF-8"), F.col("archive"), F.col("offset")]
    ordered = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(ordered.mapInArrow(write, ddl(INDEX_FILES)))


class IndexFile:
    """One index file: binary search in its directory, then in the one block that is read."""

    def __init__(self, folder: str, name: str):
        self.store, self.path = open_folder(folder)
        self.name = posixpath.join(self.path, f"{name}.cdx.gz")
        with self.store.open_input_stream(posixpath.join(self.path, f"{name}.dir"), compression=None) as f:
            rows = [line.split(" ", 2) for line in f.read().decode().splitlines()]
        self.ranges = [(int(offset), int(length)) for offset, length, _ in rows]
        self.keys = [key.encode() for _, _, key in rows]
        self.held = -1, [], []

    def _block(self, at: int) -> tuple[list[bytes], list[bytes]]:
        if self.held[0] != at:
            with self.store.open_input_file(self.name) as f:
                raw = f.read_at(self.ranges[at][1], self.ranges[at][0])
            lines = zlib.decompress(raw, 31).split(b"\n")[:-1]
            self.held = at, [line.partition(b" ")[0] for line in lines], lines
        return self.held[1:]

    def captures(self, key: str) -> Iterator[dict]:
        """The captures of a key; a key may run over several blocks."""
        wanted = key.encode()
        at = max(bisect.bisect_left(self.keys, wanted) - 1, 0)
        while at < len(self.keys) and self.keys[at] <= wanted:
            keys, lines = self._block(at)
            for i in range(bisect.bisect_left(keys, wanted), bisect.bisect_right(keys, wanted)):
                yield json.loads(lines[i].partition(b" ")[2])
            at += 1


def keys_of(urls: DataFrame, column: str = "url") -> DataFrame:
    """The distinct index keys of a column of URLs, as ``key``."""

    @F.pandas_udf("string")
    def key(values: pd.Series) -> pd.Series:
        return values.map(lambda url: url_key(safe_url(url)))

    return urls.select(key(F.col(column)).alias("key")).distinct()


def lookup(keys: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """All captures of the distinct ``keys``, found through the index that ``files`` describes.

    Only a row per index file reaches the driver: as many as the sort had partitions. A task takes
    the keys of an index file in order, so it reads each of that file's blocks at most once.
    """
    known = sorted(((r["first_key"].encode(), r["last_key"].encode(), r["file"]) for r in files.collect()))
    lasts = [k[1] for k in known]  # ascending as well: the files are successive ranges

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in batch.column("key").to_pylist():
                at = bisect.bisect_left(lasts, key.encode())
                while at < len(known) and known[at][0] <= key.encode():
                    rows.append((known[at][2], key))
                    at += 1
            yield batch_of(rows, PLACES)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            rows = []
            for name, key in zip(batch.column("file").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if index is None or not index.name.endswith(f"{name}.cdx.gz"):
                    index = IndexFile(folder, name)
                rows += [(c["archive"], key, c["offset"], c["length"], c["page_id"]) for c in index.captures(key)]
                if len(rows) >= 8192:
                    yield batch_of(rows, CAPTURES)
                    rows = []
            yield batch_of(rows, CAPTURES)

    placed = keys.select("key").mapInArrow(place, ddl(PLACES))
    dealt = placed.repartition(max(len(known), 1), "file").sortWithinPartitions("file", F.encode("key", "UTF-8"))
    return dealt.mapInArrow(search, ddl(CAPTURES))


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records of ``captures(archive, offset, length)``, each by a read of its own range.

    A task takes captures of about ``READ_BYTES`` in the order of their offsets: there are as many
    tasks as the archives' bytes ask for, however few bytes the places themselves have. A stored payload
    is digested anew and must match its header.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        held, source = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if name != held:
                    if source is not None:
                        source.close()
                    held, source = name, store.open_input_file(posixpath.join(path, name))
                fields, payload, announced = parse(zlib.decompress(source.read_at(length, offset), 31))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                if kind == "response" and (payload_digest(payload) != digest or len(payload) != announced):
                    raise ValueError(f"{name}, {offset}: the payload does not match its digest")
                page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page")
                rows.append((
                    None if page == "None" else int(page), announced, digest, kind,
                    None if refers is None else int(refers), unquote(fields["WARC-Target-URI"]),
                    payload.decode() if kind == "response" else None,
                ))
                if len(rows) == 256:
                    yield batch_of(rows, RECORDS)
                    rows = []
            yield batch_of(rows, RECORDS)
        if source is not None:
            source.close()

    places = settle(captures.select("archive", "offset", "length"))
    tasks = -(-(places.agg(F.sum("length")).first()[0] or 0) // READ_BYTES)
    dealt = places.repartition(min(max(tasks, 1), MOST_TASKS), "archive", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(scan, ddl(RECORDS))


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"

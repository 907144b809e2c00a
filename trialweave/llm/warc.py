"""WARC archives with revisit records, and a globally ordered index of captures by external merge.

*Write.* Payload digests are aggregated first (map-side combined), so every task knows which records are
responses: of equal payloads of at least ``least`` bytes the one with the smallest page_id. Each task writes
its rows to archives of its own, one gzip member a record, in the shared folder, and returns their paths; only
archives that a finished task returned are read, so a retried task leaves nothing double.

*Read and merge.* Each archive is read back as a stream and gives a capture run sorted by URL key, timestamp
and id. Runs are cut at common split points of the key (a range exchange of index rows only), and one task per
range merges its pieces of all runs with a loser tree: one comparison per level for each row. The ranges in
order are the capture histories in order; a hot URL or host is cut by timestamp and id.

A null html is an empty payload; a null url has no target and an empty key; a null page_id counts as larger than any. Rows
that repeat a page_id with an equal payload are both responses if it is the smallest. Control characters in a
url are percent-encoded in its header. Extra columns are ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, joined

_LAST = 2**63 - 1
_EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
_PIECE = 1 << 20


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels reversed, no scheme, www, default port or fragment, parameters sorted."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    labels = ",".join(reversed(host.split(".")))
    at = f":{port}" if port and port != {"http": 80, "https": 443}.get(u.scheme) else ""
    query = "?" + "&".join(sorted(u.query.lower().split("&"))) if u.query else ""
    return f"{labels}{at}){(u.path.rstrip('/') or '/').lower()}{query}"


def capture_time(page_id: int | None) -> str:
    """The table has no capture times; page_id seconds after a fixed day stand for them."""
    return (_EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder as Spark names it. Credentials are those of the executors' environment."""
    scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):/", uri)
    if scheme and scheme[1] in ("s3a", "s3n"):
        uri = "s3" + uri[3:]
    return fs.FileSystem.from_uri(uri if scheme else f"file://{uri}")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member. A revisit has no payload, but says its length, digest and source."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {clean} {digest}')}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if clean is not None:
        head.append(f"WARC-Target-URI: {clean}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
        payload = b""
    block = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def read_records(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of an archive, read piece by piece."""
    at, start, pending = 0, 0, b""
    z, out = zlib.decompressobj(31), []
    while True:
        piece = pending or stream.read(_PIECE)
        pending = b""
        if not piece:
            return
        out.append(z.decompress(piece))
        at += len(piece) - len(z.unused_data)
        if z.eof:
            yield start, b"".join(out)
            pending, start = z.unused_data, at
            z, out = zlib.decompressobj(31), []


def parse_record(record: bytes) -> dict:
    """Headers and, for responses, length and digest of the payload as it was read."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    h = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    _, _, payload = block[: int(h["content-length"])].partition(b"\r\n\r\n")
    revisit = h["warc-type"] == "revisit"
    number = lambda k: int(h[k]) if k in h else None
    return {
        "page_id": number("x-page-id"),
        "payload_bytes": number("x-payload-length") if revisit else len(payload),
        "payload_digest": h["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
        "record_type": h["warc-type"],
        "refers_to": number("x-refers-to-page"),
        "url": h.get("warc-target-uri"),
        "timestamp": h["warc-date"],
    }


def write_archives(pages: DataFrame, folder: str, least: int = 100, roll_bytes: int = 64 << 20) -> DataFrame:
    """Writes all rows to archives under ``folder``; their (archive, records, bytes)."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    big = rows.filter(F.octet_length("payload") >= least).groupBy(F.col("digest").alias("_digest")).agg(F.min(F.coalesce("page_id", F.lit(_LAST))).alias("first"), F.count("*").alias("n"))
    same = F.col("digest") == F.col("_digest")
    known = Scratch(pages.sparkSession, "digests").keep(big.filter("n > 1").select("_digest", "first"), "equal")
    marked = joined(rows, known, same, "left").withColumn("refers_to", F.when(F.coalesce("page_id", F.lit(_LAST)) != F.col("first"), F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        out, name, done = None, "", []

        def close() -> None:
            if out is not None:
                done[-1][2] = out.tell()
                out.close()

        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None or out.tell() >= roll_bytes:
                    close()
                    name = f"run-{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                    done.append([f"{folder}/{name}", 0, 0])
                out.write(record_bytes(page_id, url, payload, digest, refers, capture_time(page_id)))
                done[-1][1] += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return marked.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "archive string, records long, bytes long")


class LoserTree:
    """Merges k sorted iterators. Inner nodes keep the loser of their match; a new row replays one path to the root."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.head: list = [next(r, None) for r in runs]
        self.keys: list = [None if h is None else key(h) for h in self.head]
        self.loser = [-1] * max(1, self.k)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.loser[node] = (a, b) if self._before(a, b) else (b, a)
        self.top = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's row comes first; a run that has ended comes last, and equal rows keep the order of their runs."""
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator:
        while self.k and self.keys[self.top] is not None:
            w = self.top
            yield self.head[w]
            self.head[w] = next(self.runs[w], None)
            self.keys[w] = None if self.head[w] is None else self.key(self.head[w])
            node = (w + self.k) // 2
            while node:
                if self._before(self.loser[node], w):
                    w, self.loser[node] = self.loser[node], w
                node //= 2
            self.top = w


_ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, timestamp string, url_key string, archive string, offset long"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_TYPES = [pa.int64() if c.endswith("long") else pa.string() for c in _ROW.split(", ")]


def _order(row: tuple) -> tuple:
    page_id = _LAST if row[0] is None else row[0]
    return row[7], row[6], page_id, row[8], row[9]


def _batches(rows: Iterator[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _TYPES, strict=True)], _NAMES)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _TYPES, strict=True)], _NAMES)


def capture_runs(archives: DataFrame) -> DataFrame:
    """Index rows of every archive, sorted inside it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch["archive"].to_pylist():
                system, path = _file_system(archive)
                with system.open_input_stream(path, compression=None) as stream:
                    found = [(offset, parse_record(record)) for offset, record in read_records(stream)]
                rows = [(*(r[c] for c in _NAMES[:7]), url_key(r["url"]), archive, offset) for offset, r in found]
                yield from _batches(iter(sorted(rows, key=_order)))

    return archives.select("archive").mapInArrow(read, _ROW)


def merged_captures(runs: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """All index rows in global order of (url_key, timestamp, page_id): partitions in order, rows in order inside them.

    There are as many ranges as give about ``range_rows`` rows each, which bounds what a merging task holds.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces.setdefault(row[8], []).append(row)
        for piece in pieces.values():
            if any(_order(a) > _order(b) for a, b in zip(piece, piece[1:], strict=False)):
                piece.sort(key=_order)  # blocks of one run may arrive out of order
        yield from _batches(iter(LoserTree([iter(pieces[k]) for k in sorted(pieces)], _order)))

    key = [F.col("url_key"), F.col("timestamp"), F.coalesce("page_id", F.lit(_LAST))]
    ranges = max(1, -(-runs.count() // range_rows))
    return runs.repartitionByRange(ranges, *key).mapInArrow(merge, _ROW)


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = 100) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives, reads them back and returns the merged capture index."""
    scratch = Scratch(pages.sparkSession, "warc")
    archives = scratch.keep(write_archives(pages, folder or f"{scratch.path}/warc", least), "archives")
    files = archives.filter("records > 0")
    runs = scratch.keep(capture_runs(files.repartition(max(1, files.count()), F.xxhash64("archive"))), "runs")
    return merged_captures(runs)

"""Operator 11, WARC: archives of pages with a two-level capture index.

Writing. Each task writes its pages as gzip-pressed WARC records, one member each, to files of about ``file_mb``. Of the pages with one payload (by
SHA-1 and SHA-256) that with the largest page_id is a response with the payload; the others are revisits, records of the identical-payload-digest profile,
which refer to it and hold no payload. Payloads aren't shuffled: only those of digests that occur twice or more meet the row that decides them.
Payloads under ``least_bytes`` bytes are always responses.

Index, first level: one line per record, ``key page_id kind file offset length digest refers_to``, sorted by (key, page_id) over range partitions. The key is the URL with
its host reversed (``com,example)/path``), cut at ``MOST_KEY`` characters. Each partition's lines are cut into blocks, pressed one by one
into an index file. Second level: a directory at the end of each index file, one entry per block, with its first line. A table of the index files, at most
``MOST_FILES`` of them, has the first and the last key of each: only that is ever sent to all tasks.

Lookup. A URL's key goes to the files whose range has it; there the directory is read from the file's end and searched by bisection, the blocks from
there on are read by their ranges and searched the same way, and records are read by theirs. Reading all goes through the index too: captures are dealt out by file and offset
and neighbours are read in one piece. A revisit's payload is that of the record it refers to, which is looked up by its URL.

Files have names of their own for each attempt, so a task that runs again can't mix with what it left; such leftovers are in no index line.

Null or empty html is an empty payload. A null url is the key ''. A null page_id is a record without one, and never the largest if there is another. Rows that share page_id
and payload, if that page_id is the largest, are all responses. Control characters in URLs are written as %XX. Empty tables give an archive without
files. Other columns aren't read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import flagged, written
from rasterlake.stages import shared_folder

MOST_KEY, MOST_FILES = 1000, 4096
#: Base 32 as Spark counts it, and as RFC 4648 writes it.
COUNTED, WRITTEN = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "key string, page_id long, kind string, file string, offset long, length long, digest string, refers_to long, refers_url string"
LINE_NAMES = [c.split(" ")[0] for c in LINE.split(", ")]
RECORD = "page_id long, url string, kind string, payload_bytes long, digest string, refers_to long, refers_url string, payload binary"
RECORD_NAMES = [c.split(" ")[0] for c in RECORD.split(", ")]


def base32(sha1):
    """A SHA-1 in hexadecimal as base 32, five bytes at a time."""
    parts = (F.lpad(F.conv(F.substring(sha1, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4))
    return F.translate(F.concat(*parts), COUNTED, WRITTEN)


_HOST = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(:[0-9]+)?([^#]*)", re.S)
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def clean_url(url: str | None) -> str:
    """Control characters and spaces as %XX, so that a URL is one header's value and one field of a line."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")


def url_key(url: str) -> str:
    """``com,example,www:port)/path?query``, cut at MOST_KEY characters; what isn't a URL with a host stays as it is."""
    if m := _HOST.match(url):
        url = f"{','.join(reversed(m[1].lower().split('.')))}{m[2] or ''}){m[3]}"
    return url[:MOST_KEY]


def opened(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class Files:
    """Writes pieces to files of about ``most`` bytes in a folder; says where each piece stands."""

    def __init__(self, folder: str, prefix: str, most: int):
        self.fs, self.root = opened(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.prefix, self.most, self.out, self.name, self.at = prefix, most, None, "", 0

    def put(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= self.most:
            self.close()
            self.name, self.at = f"{self.prefix}-{uuid.uuid4().hex}", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
        self.out.write(raw)
        place = (self.name, self.at, len(raw))
        self.at += len(raw)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def record(kind: str, page_id: int | None, url: str, digest: str, size: int, payload: bytes, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    block = HEAD % size + payload
    name = lambda p: f"<urn:page:{'' if p is None else p}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Target-URI: {refers_url}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """A record's bytes as a row of RECORD; the payload's digest and size are taken from the payload where there is one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    if lines[0] != "WARC/1.1" or rest[int(fields["Content-Length"]) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda x: int(t) if (t := x.removeprefix("<urn:page:").rstrip(">")) else None
    size, digest = int(http.rpartition(b"Content-Length: ")[2]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page_id, kind, url = number(fields["WARC-Record-ID"]), fields["WARC-Type"], fields["WARC-Target-URI"]
    if kind == "revisit":
        return page_id, url, kind, size, digest, number(fields["WARC-Refers-To"]), fields["WARC-Refers-To-Target-URI"], None
    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of page {page_id} isn't what its record says")
    return page_id, url, kind, size, digest, None, None, payload


def records_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], RECORD_NAMES)


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, file_mb: int = 512, block_lines: int = 512, level: int = 6, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the records and their index to ``folder`` (any address that pyarrow opens); returns the table of index files: file, first, last, n_lines."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"sha1": F.sha1("html"), "sha2": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    same = ["sha1", "sha2"]
    # Only digests that occur twice or more need a decision; their rows are picked out by flags before the join.
    several = rows.where(F.col("size") >= least_bytes).groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("top")).where("n > 1")
    several = written(several.withColumn("mark", F.xxhash64("sha2")).drop("n"), "copies")
    marked = rows.withColumn("mark", F.xxhash64("sha2"))
    undecided, marks = flagged(marked, "mark", several.select("mark")), several.select("mark")
    alone = flagged(marked, "mark", marks, "left_anti").select("page_id", "url", "html", "sha1", "size", F.lit(False).alias("revisit"), F.lit(None).cast("struct<page_id:bigint,url:string>").alias("top"))
    decided = undecided.join(several.drop("mark").hint("merge"), same, "left").select("page_id", "url", "html", "sha1", "size", (F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top.page_id"))).alias("revisit"), "top")
    dealt = alone.union(decided).select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), base32(F.col("sha1")).alias("digest"), "size", "revisit", "top.page_id", "top.url")
    dealt = dealt.toDF("page_id", "url", "html", "digest", "size", "revisit", "refers_to", "refers_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder, "pages", file_mb << 20)
        for batch in batches:
            lines = []
            for page_id, url, payload, digest, size, revisit, refers_to, refers_url in zip(*(c if c.type == pa.binary() else c.to_pylist() for c in batch.columns), strict=True):
                kind, press = "revisit" if revisit else "response", zlib.compressobj(level, wbits=31)
                url, refers_url = clean_url(url), clean_url(refers_url)
                raw = record(kind, page_id, url, digest, size, payload.as_py() or b"", refers_to, refers_url, date)
                file, offset, length = files.put(press.compress(raw) + press.flush())
                lines.append((url_key(url), page_id, kind, file, offset, length, digest, refers_to if revisit else None, refers_url if revisit else None))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True) if lines else [()] * 9, kinds, strict=True)], LINE_NAMES)
        files.close()

    lines = written(dealt.mapInArrow(write, LINE), "captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, entries, first, last, n = Files(folder, "index", 1 << 62), [], [], None, None, 0

        def block() -> None:
            nonlocal held
            _, offset, length = files.put(zlib.compress("\n".join(held).encode(), level))
            entries.append([json.loads(held[0])[:2], offset, length, len(held)])
            held = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, last, n = row[0] if first is None else first, row[0], n + 1
                held.append(json.dumps(row, ensure_ascii=False))
                if len(held) == block_lines:
                    block()
        if held:
            block()
        if n:
            directory = zlib.compress(json.dumps(entries, ensure_ascii=False).encode(), level)
            files.put(directory + struct.pack("<Q", len(directory)))
        files.close()
        yield pa.RecordBatch.from_pydict({"file": pa.array([files.name] * bool(n), pa.string()), "first": pa.array([first] * bool(n), pa.string()), "last": pa.array([last] * bool(n), pa.string()), "n_lines": pa.array([n] * bool(n), pa.int64())})

    parts = min(MOST_FILES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = lines.repartitionByRange(parts, "key", "page_id", "digest").sortWithinPartitions("key", "page_id", "digest")
    return written(ordered.mapInArrow(index, "file string, first string, last string, n_lines long"), "index-files")


def directory_of(fs, path: str) -> list:
    with fs.open_input_file(path) as f:
        size = f.size()
        (length,) = struct.unpack("<Q", f.read_at(8, size - 8))
        return json.loads(zlib.decompress(f.read_at(length, size - 8 - length)))


def lines_of(f, entry: list) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(f.read_at(entry[2], entry[1])).decode().split("\n")]


def lines_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 9, kinds, strict=True)], LINE_NAMES)


def captures(files: DataFrame, folder: str) -> DataFrame:
    """All lines of the index, block by block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                entries = directory_of(fs, f"{root}/{name}")
                with fs.open_input_file(f"{root}/{name}") as f:
                    yield from (lines_batch(lines_of(f, entry)) for entry in entries)

    return files.select("file").repartition("file").mapInArrow(read, LINE)


def found_lines(f, entries: list, key: str) -> Iterator[list]:
    """The lines of a key in one index file: bisection in the directory, then in each block that can have it."""
    # A block starts at its first line's key: the key can begin in the block before the first one that starts at it.
    at = max(0, bisect.bisect_left(entries, key, key=lambda e: e[0][0]) - 1)
    while at < len(entries) and entries[at][0][0] <= key:
        lines = lines_of(f, entries[at])
        lo = bisect.bisect_left(lines, key, key=lambda x: x[0])
        while lo < len(lines) and lines[lo][0] == key:
            yield lines[lo]
            lo += 1
        at += 1


def lookup(files: DataFrame, folder: str, urls: DataFrame) -> DataFrame:
    """Captures of ``urls`` (one column of URLs): lines of the index with the URL's key, by binary search. Keys that are asked for often are looked up once."""
    asked = urls.select(F.col(urls.columns[0]).alias("url")).distinct()
    ranges = sorted((r["first"], r["last"], r["file"]) for r in files.collect())  # MOST_FILES rows with keys of MOST_KEY characters

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key in {url_key(clean_url(url)) for url in batch.column(0).to_pylist()}:
                # Files are in order and touch at most at their ends.
                at = bisect.bisect_left(ranges, key, key=lambda r: r[1])
                while at < len(ranges) and ranges[at][0] <= key:
                    out.append((ranges[at][2], key))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["file", "asked"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        name, f, entries, out = None, None, [], []
        for batch in batches:
            for file, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != name:
                    name, f, entries = file, fs.open_input_file(f"{root}/{file}"), directory_of(fs, f"{root}/{file}")
                out += found_lines(f, entries, key)
                if len(out) >= 4096:
                    yield lines_batch(out)
                    out = []
        yield lines_batch(out)

    asked = asked.mapInArrow(deal, "file string, asked string").distinct().repartition("file", "asked").sortWithinPartitions("file", "asked")
    return asked.mapInArrow(search, LINE)


def records(lines: DataFrame, folder: str, payloads: bool = True, piece: int = 4 << 20) -> DataFrame:
    """The records of index lines, checked against their digests. Lines are dealt out by file and offset; neighbouring records are read in pieces of about ``piece`` bytes."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = lines.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        name, f = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            at = 0
            while at < len(rows):
                end = at + 1
                while end < len(rows) and rows[end][0] == rows[at][0] and rows[end][1] <= rows[end - 1][1] + rows[end - 1][2] and rows[end][1] + rows[end][2] - rows[at][1] <= piece:
                    end += 1
                if rows[at][0] != name:
                    name, f = rows[at][0], fs.open_input_file(f"{root}/{rows[at][0]}")
                base = rows[at][1]
                raw = f.read_at(rows[end - 1][1] + rows[end - 1][2] - base, base)
                made = [parsed(zlib.decompress(raw[o - base : o - base + n], wbits=31)) for _, o, n in rows[at:end]]
                yield records_batch(made if payloads else [(*r[:-1], None) for r in made])
                at = end

    return places.mapInArrow(read, RECORD)


def archived(pages: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """Write, then read all back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    files = write_archive(pages, folder, **settings)
    read = written(records(captures(files, folder), folder, payloads=False).drop("payload"), "records")
    revisits = read.where("kind = 'revisit'")
    # What a revisit stands for is looked up by the URL that it refers to; many revisits of one record are one request.
    targets = written(revisits.select("refers_url", F.col("refers_to").alias("page_id"), "digest").distinct(), "targets")
    lines = lookup(files, folder, targets.select("refers_url")).where("kind = 'response'").join(targets, ["page_id", "digest"], "left_semi")
    full = records(lines, folder, payloads=False).select(F.col("page_id").alias("refers_to"), F.col("digest"), F.col("payload_bytes").alias("full_bytes")).distinct()
    resolved = revisits.join(full.hint("merge"), ["refers_to", "digest"], "left").select("page_id", F.coalesce("full_bytes", F.raise_error(F.lit("a revisit refers to a record that isn't there"))).alias("payload_bytes"), "digest", "kind", "refers_to")
    both = read.where("kind = 'response'").select("page_id", "payload_bytes", "digest", "kind", "refers_to").union(resolved)
    return both.withColumnsRenamed({"digest": "payload_digest", "kind": "record_type"})


#: From the definition; base 32 by twenty bits, five of the forty digits, at a time.
SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
s AS (SELECT page_id, octet_length(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p),
b AS (SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1) FOR i IN range(32)], '') AS digest FROM s)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM b
"""

"""WARC archives with a two-level capture index (operator 4).

Writing: each distinct payload is a ``response`` record of the capture with the
smallest page id, every other capture a ``revisit`` of it.  Records are gzip
members of archive files in a shared folder, one file a task.

Index: captures are sorted by reversed-host URL key and page id and packed in
compressed blocks of lines; each index file has a sparse directory with the
first key of every block beside it, and the list of index files (one row a
task) names the first key of each.

Reading: wanted keys are sorted; a task finds the index file and the block by
binary search, reads that block's byte range, searches the lines, and the
records found are read from their archives by byte range, in file order.

Payloads are shuffled once (by digest, a task's copies dropped first); a hot
payload's revisits are narrow rows of a plain join, which Spark splits.  A file
is named for its task attempt and only files that the written capture lists
name are read, so what lost tasks leave behind does no harm.

Cases: a null html is the empty payload; null urls share the key ``-``; null
page ids come last, and a null cannot be referred to; rows equal in page id and
payload are separate captures, exactly one of them (the smallest url) the
response; an empty table gives an empty index and result; only the named
columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelhouse.llm.common import text_of, written

#: Lines of an index block.
BLOCK_LINES = 512
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
CAPTURES = ("key string, page_id bigint, url string, record_type string, digest string, payload_bytes bigint, "
            "refers_to bigint, file string, at bigint, length bigint")
_CAPTURES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                       ("record_type", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()),
                       ("refers_to", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared path and the path inside it."""
    if re.match(r"file:/+", path):
        path = "file:///" + re.sub(r"^file:/+", "", path)
    elif path.startswith("/"):
        path = "file://" + path
    return fs.FileSystem.from_uri(path)


def surt(url: str | None) -> str:
    """Reversed-host key: ``http://a.example.com:80/x?y`` is ``com,example,a)/x?y``."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:  # not a URL: its own key
        return re.sub(r"\s", "%20", url)
    host = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        host += f":{port}"
    key = f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"
    return re.sub(r"\s", "%20", key)


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sorts by URL key, then page id, nulls last."""
    return f"{surt(url)} {'~' if page_id is None else format(page_id + (1 << 63), '020d')}"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _head(fields: list[tuple[str, str]], first: str) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes,
           refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One record as a gzip member; ``payload`` is left out of a revisit."""
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))], "HTTP/1.1 200 OK")
    body = http + (payload if kind == "response" else b"")
    clean = lambda x: re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", x)
    name = uuid.UUID(bytes=hashlib.md5(f"{page_id}|{url}|{digest}|{kind}".encode()).digest())
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(body)))]
    if url is not None:
        fields.append(("WARC-Target-URI", clean(url)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if kind == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if refers_to is not None:
            fields.append(("X-Refers-To-Page-Id", str(refers_to)))
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", clean(refers_url)))
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(_head(fields, "WARC/1.1") + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class _Writer:
    """One file of this task attempt, opened at its first record."""

    def __init__(self, folder: str, kind: str) -> None:
        self.name = f"{kind}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        self.folder, self.out, self.at = folder, None, 0

    def add(self, data: bytes) -> int:
        if self.out is None:
            where, path = opened(self.folder)
            where.create_dir(path, recursive=True)
            self.out = where.open_output_stream(f"{path}/{self.name}")
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _order(page_id: int | None, url: str | None) -> tuple:
    return page_id is None, page_id or 0, url is None, url or ""


def _own_smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows with equal digests, only those smaller than all before."""
    least: dict[bytes, tuple] = {}
    for batch in batches:
        keep = []
        for i, (digest, page_id, url) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
            key = _order(page_id, url)
            if digest not in least or key < least[digest]:
                least[digest] = key
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep, pa.int64()))


def _write_responses(folder: str):
    def rows(batches: Iterator[pa.RecordBatch], out: _Writer) -> Iterator[tuple]:
        last = None
        for batch in batches:
            for digest, page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if digest == last:
                    continue
                last, payload, name = digest, html.encode(), base32(digest)
                data = record("response", page_id, url, name, len(payload), payload)
                yield (capture_key(url, page_id), page_id, url, "response", name, len(payload), None, out.name,
                       out.add(data), len(data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, "response")
        yield from _batches(rows(batches, out), _CAPTURES)
        out.close()
    return run


def _write_revisits(folder: str):
    def rows(batches: Iterator[pa.RecordBatch], out: _Writer) -> Iterator[tuple]:
        for batch in batches:
            for page_id, url, name, size, to, to_url, times in zip(*(c.to_pylist() for c in batch.columns)):
                for _ in range(times):
                    data = record("revisit", page_id, url, name, size, b"", to, to_url)
                    yield (capture_key(url, page_id), page_id, url, "revisit", name, size, to, out.name,
                           out.add(data), len(data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, "revisit")
        yield from _batches(rows(batches, out), _CAPTURES)
        out.close()
    return run


def _base32_column(digest: str) -> Column:
    """Base32 text of a binary SHA-1: four groups of five bytes, eight letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for g in range(4):
        value = F.conv(F.hex(F.substring(digest, 5 * g + 1, 5)), 16, 10).cast("long")
        parts += [F.substring(F.lit(letters), (F.shiftright(value, 35 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1))
                  for j in range(8)]
    return F.concat(*parts)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write all captures under ``folder``; returns the capture list."""
    payload = text_of(html_col)
    digest = F.unhex(F.sha1(payload.cast("binary")))
    own = pages.select(digest.alias("digest"), F.col(id_col).cast("long").alias("page_id"),
                       F.col(url_col).alias("url"), payload.alias("html"))
    kind = "digest binary, page_id bigint, url string, html string"
    first = own.mapInArrow(_own_smallest, kind).repartition("digest").sortWithinPartitions(
        "digest", F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last())
    responses = written(first.mapInArrow(_write_responses(folder), CAPTURES), "responses")

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), digest.alias("digest"))
    same = narrow.groupBy("page_id", "url", "digest").agg(F.count(F.lit(1)).cast("int").alias("times"))
    to = responses.select(F.col("digest").alias("name"), F.col("payload_bytes").alias("size"),
                          F.col("page_id").alias("to"), F.col("url").alias("to_url"))
    itself = F.col("page_id").eqNullSafe(F.col("to")) & F.col("url").eqNullSafe(F.col("to_url"))
    others = (same.withColumn("name", _base32_column("digest")).join(to, "name")
              .withColumn("times", F.col("times") - itself.cast("int")).where(F.col("times") > 0)
              .select("page_id", "url", "name", "size", "to", "to_url", "times"))
    revisits = written(others.mapInArrow(_write_revisits(folder), CAPTURES), "revisits")
    return responses.unionByName(revisits)


@dataclass(frozen=True)
class Index:
    """The archives' folder and, by first key, the index files."""

    folder: str
    first_keys: tuple[str, ...]
    files: tuple[str, ...]


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> Index:
    """Sort captures into index files of compressed blocks with sparse directories."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, block = _Writer(folder, "index"), [], []

        def pack() -> None:
            data = zlib.compress("\n".join(block).encode(), LEVEL)
            directory.append([block[0].split("\t", 1)[0], out.add(data), len(data)])
            block.clear()

        for batch in batches:
            for row in batch.to_pylist():
                block.append(row["key"] + "\t" + json.dumps([row["file"], row["at"], row["length"]]))
                if len(block) == block_lines:
                    pack()
        if block:
            pack()
        if directory:
            out.close()
            where, path = opened(folder)
            with where.open_output_stream(f"{path}/{out.name}.dir") as f:
                f.write(zlib.compress(json.dumps(directory).encode(), LEVEL))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([out.name])], ["first_key", "file"])

    sorted_ = captures.select("key", "file", "at", "length").repartitionByRange("key").sortWithinPartitions("key")
    # one row an index file, at most as many as tasks
    files = sorted(tuple(r) for r in sorted_.mapInArrow(run, "first_key string, file string").collect())
    return Index(folder, tuple(k for k, _ in files), tuple(f for _, f in files))


class _Finder:
    """Binary search in the index, with the last blocks and directories kept."""

    def __init__(self, index: Index) -> None:
        self.index = index
        self.where, self.path = opened(index.folder)
        self.directories: OrderedDict[int, tuple[list[str], list[list]]] = OrderedDict()
        self.blocks: OrderedDict[tuple[int, int], list[str]] = OrderedDict()

    def directory(self, k: int) -> tuple[list[str], list[list]]:
        if k not in self.directories:
            with self.where.open_input_file(f"{self.path}/{self.index.files[k]}.dir") as f:
                rows = json.loads(zlib.decompress(f.read()))
            self.directories[k] = [r[0] for r in rows], rows
            if len(self.directories) > 8:
                self.directories.popitem(last=False)
        return self.directories[k]

    def block(self, k: int, b: int) -> list[str]:
        if (k, b) not in self.blocks:
            _, at, length = self.directory(k)[1][b]
            with self.where.open_input_file(f"{self.path}/{self.index.files[k]}") as f:
                f.seek(at)
                self.blocks[k, b] = zlib.decompress(f.read(length)).decode().split("\n")
            if len(self.blocks) > 8:
                self.blocks.popitem(last=False)
        return self.blocks[k, b]

    def find(self, key: str) -> Iterator[list]:
        """``[file, at, length]`` of every capture with this key."""
        # equal keys may fill several blocks, and files: start at the last first key below it
        k = max(bisect_left(self.index.first_keys, key) - 1, 0)
        while k < len(self.index.files) and self.index.first_keys[k] <= key:
            firsts = self.directory(k)[0]
            b = max(bisect_left(firsts, key) - 1, 0)
            while b < len(firsts) and firsts[b] <= key:
                lines = self.block(k, b)
                for line in lines[bisect_left(lines, key + "\t"):bisect_right(lines, key + "\n")]:
                    yield json.loads(line.split("\t", 1)[1])
                b += 1
            k += 1


def keys_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The distinct capture keys of the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [capture_key(u, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col)).mapInArrow(run, "key string").distinct()


def _tasks(df: DataFrame) -> int:
    """Tasks of a read: the rows are narrow, so merging partitions by their size would leave one for all archives."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def look_up(keys: DataFrame, index: Index) -> DataFrame:
    """``(key, file, at, length)`` of every capture of the given keys."""
    kind = pa.schema([("key", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(index)
        yield from _batches(((key, *hit) for batch in batches for key in batch.column(0).to_pylist()
                             for hit in finder.find(key)), kind)

    return keys.select("key").repartitionByRange(_tasks(keys), "key").sortWithinPartitions("key").mapInArrow(
        run, "key string, file string, at bigint, length bigint")


def read_records(hits: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records at the given places, each archive read in order by one task.

    A response's size and digest are those of the payload read; a digest that
    differs from the record's field is an error.
    """
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                      ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                      *([("payload", pa.binary())] if with_payload else [])])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        where, path = opened(folder)
        name, source = None, None
        for batch in batches:
            for file, at, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, where.open_input_file(f"{path}/{file}")
                source.seek(at)
                fields, http, payload = parse(source.read(length))
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                if fields["WARC-Type"] == "response":
                    size, read = len(payload), base32(hashlib.sha1(payload).digest())
                    if read != digest:
                        raise ValueError(f"{file} at {at}: payload digest {read}, its record says {digest}")
                number = lambda k: int(fields[k]) if k in fields else None
                yield (number("X-Page-Id"), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"],
                       number("X-Refers-To-Page-Id"), *([payload] if with_payload else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), kind, 500 if with_payload else 5000)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return hits.select("file", "at", "length").repartition(_tasks(hits), "file").sortWithinPartitions("file", "at").mapInArrow(
        run, schema + (", payload binary" if with_payload else ""))


def archive(pages: DataFrame, folder: str) -> Index:
    """Write the pages' captures and their index."""
    return build_index(write_archives(pages, folder), folder)


#: The capture list in DuckDB SQL (tables: pages).
WARC_SQL = """
with own as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
named as (
  select page_id, hex, octet_length(encode(html))::bigint as payload_bytes,
    min(page_id) over (partition by hex) as least,
    array_to_string(flatten(list_transform([0, 1, 2, 3], lambda g: list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             (((('0x' || substr(hex, g * 10 + 1, 10))::bigint >> s) & 31) + 1)::bigint, 1)))), '') as payload_digest
  from own)
select page_id, payload_bytes, payload_digest,
  case when page_id = least then 'response' else 'revisit' end as record_type,
  case when page_id = least then null else least end as refers_to
from named
"""

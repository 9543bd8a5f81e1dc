"""WARC archives with a two-level capture index.

Writing: each page is a record in a gzip member of its own, `response` with the HTTP headers and the
payload, or `revisit` if an equal payload (SHA-1 and length) of at least `least_bytes` is stored for a
smaller page_id; a revisit names that page and keeps the payload's digest and length. Every task
attempt writes files of new names and returns where its records are; that table is written out, so it
names only what the successful attempts wrote, and what a lost attempt left is never read.

Index: captures are sorted by key (host labels reversed, then path and query: com,example,www)/path),
cut into blocks of `block_lines` lines and compressed block by block into one file a range of keys.
Beside each file lies its directory: the first key of every block with its place. The table of ranges
has one row a file. Lookup: a key is searched by bisection among the ranges, then in the directory of
its range, then in the one or few blocks that can hold it, and records are read by byte range. Keys
with very many captures span blocks and are dealt out block by block.

Files are opened with pyarrow's file systems under a folder that all executors share.

Defined cases: a null html is an empty payload; a null url has the empty key; a null page_id is always
a response and is never referred to; rows with the least page_id of their payload are all responses;
equal rows are written and read one by one; an empty table gives empty archives; other columns are not
read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadscope.llm.common import checkpoint_dir, cut_lineage, ship_package, text_bytes

#: Bytes of an archive, and keys, that one task reads.
TASK_BYTES, TASK_KEYS = 4 << 20, 512
BLOCK_LINES = 1000
#: Bytes after which a task begins another archive file.
FILE_BYTES = 1 << 30
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort key of a url: reversed host labels, ')', then path and query; the scheme, port and fragment do not count."""
    if not url:
        return ""
    m = re.match(r"(?:[^:/?#]+:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)", url, re.S)
    if not m:
        return url
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _head(lines: list[tuple[str, str]]) -> bytes:
    return "WARC/1.1\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, n: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record; `n` and `digest` are those of the full payload, which a revisit leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", date)]
    if url is not None:
        lines.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(refers_to))]
    lines += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(lines) + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != n or base32_sha1(payload) != digest):
        raise ValueError("a payload does not agree with its header")
    page = lambda k: int(m[1]) if (m := re.match(r"<urn:page:(-?[0-9]+)>", fields.get(k, ""))) else None
    return {
        "page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": n, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload": payload,
    }


class Folder:
    """Files of a shared folder: new ones to append to, and byte ranges of old ones."""

    def __init__(self, uri: str) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(uri)
        self.opened: tuple[str, object] | None = None

    def new(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def read(self, name: str, offset: int | None = None, length: int = -1) -> bytes:
        if self.opened is None or self.opened[0] != name:
            if self.opened:
                self.opened[1].close()
            self.opened = name, self.fs.open_input_file(f"{self.root}/{name}")
        file = self.opened[1]
        file.seek(offset or 0)
        return file.read() if length < 0 else file.read(length)


def _integer(value) -> int | None:
    return None if value is None or value == "" else int(value)


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, out, name, at = Folder(folder), None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, n, first in zip(batch["page_id"], batch["url"], batch["payload"], batch["n"], batch["first"], strict=True):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.new(name)
                page, full, refers = _integer(page_id), bytes(payload), _integer(first)
                member = gzip.compress(record(page, url, full, int(n), base32_sha1(full), refers), LEVEL, mtime=0)
                out.write(member)
                rows.append((url_key(url), page, name, at, len(member)))
                at += len(member)
            yield pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return write


def _indexer(folder: str, block_lines: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, name = Folder(folder), f"index-{uuid.uuid4().hex}"
        out, at, lines, entries, last = None, 0, [], [], ""

        def flush() -> None:
            nonlocal at
            packed = zlib.compress("\n".join(lines).encode(), LEVEL)
            entries.append((json.loads(lines[0])[0], at, len(packed)))
            out.write(packed)
            at += len(packed)
            lines.clear()

        for batch in batches:
            for row in zip(batch["key"], batch["page_id"], batch["file"], batch["offset"], batch["length"], strict=True):
                if out is None:
                    out = store.new(f"{name}.blocks")
                lines.append(json.dumps([row[0], _integer(row[1]), row[2], int(row[3]), int(row[4])]))
                last = row[0]
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with store.new(f"{name}.directory") as directory:
                directory.write(zlib.compress(json.dumps(entries).encode()))
            yield pd.DataFrame({"file": [name], "first_key": [entries[0][0]], "last_key": [last], "blocks": [len(entries)]})

    return write


@dataclass
class Archive:
    """A written archive: its folder and the ranges of its index, one (first key, last key, file) an index file."""

    folder: str
    ranges: list[tuple[str, str, str]]
    n_bytes: int = 0

    def tasks(self, n_keys: int) -> int:
        """Tasks for reading what the keys name: rows are small and stand for much reading, so their bytes say nothing."""
        return max(1, min(-(-self.n_bytes // TASK_BYTES), -(-n_keys // TASK_KEYS)))


def write_archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, block_lines: int = BLOCK_LINES, file_bytes: int = FILE_BYTES) -> Archive:
    """Write (page_id, url, html) rows and their index under `folder` (default: a new one in the checkpoint folder)."""
    spark = pages.sparkSession
    ship_package(spark)
    folder = folder or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(text_bytes(F.col("html")), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload").cast("bigint"), "sha": F.sha1("payload")})
    first = rows.where(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = cut_lineage(first.where("copies > 1 and first is not null").select("sha", "n", "first"))
    known = rows.join(first, ["sha", "n"], "left").withColumn("first", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    # Ids travel as text: a nullable integer column would become floating point in pandas.
    told = known.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "n", F.col("first").cast("string").alias("first"))
    captures = cut_lineage(told.mapInPandas(_writer(folder, file_bytes), "key string, page_id bigint, file string, offset bigint, length bigint"))
    by_key = captures.withColumn("page_id", F.col("page_id").cast("string"))
    by_key = by_key.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    ranges = cut_lineage(by_key.mapInPandas(_indexer(folder, block_lines), "file string, first_key string, last_key string, blocks int"))
    n_bytes = captures.agg(F.sum("length")).first()[0] or 0
    return Archive(folder, sorted((r["first_key"], r["last_key"], r["file"]) for r in ranges.collect()), int(n_bytes))


def _find_blocks(archive: Archive):
    """(key) rows to (key, index file, block place): bisection among the ranges, then in a range's directory."""
    firsts, lasts = [r[0] for r in archive.ranges], [r[1] for r in archive.ranges]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, directories = Folder(archive.folder), {}
        for batch in batches:
            out = []
            for key in batch["key"]:
                for r in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                    name = archive.ranges[r][2]
                    if name not in directories:
                        directories = {name: json.loads(zlib.decompress(store.read(f"{name}.directory")))}
                    entries = directories[name]
                    begin = max(0, bisect_left(entries, key, key=lambda e: e[0]) - 1)
                    for e in entries[begin : bisect_right(entries, key, key=lambda e: e[0])]:
                        out.append((key, name, e[1], e[2]))
            yield pd.DataFrame(out, columns=["key", "file", "offset", "length"])

    return find


def _find_captures(folder: str):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, held, lines, keys = Folder(folder), None, [], []
        for batch in batches:
            out = []
            for key, name, offset, length in zip(batch["key"], batch["file"], batch["offset"], batch["length"], strict=True):
                if held != (name, offset):
                    held = name, offset
                    lines = [json.loads(x) for x in zlib.decompress(store.read(f"{name}.blocks", int(offset), int(length))).decode().split("\n")]
                    keys = [x[0] for x in lines]
                out += [x[:1] + x[2:] for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]]
            yield pd.DataFrame(out, columns=["key", "file", "offset", "length"])

    return find


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _read_records(folder: str, with_payload: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Folder(folder)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                found = [parse(gzip.decompress(store.read(f, int(o), int(n)))) for f, o, n in zip(part["file"], part["offset"], part["length"], strict=True)]
                pdf = pd.DataFrame(found).astype({"page_id": "Int64", "refers_to": "Int64"})
                yield pdf if with_payload else pdf.drop(columns="payload")

    return read


def lookup(archive: Archive, keys: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of all captures of the keys (column key, as `url_key` makes them)."""
    named = cut_lineage(keys.select("key").distinct())
    tasks = archive.tasks(named.count())
    wanted = named.repartitionByRange("key").sortWithinPartitions("key")
    blocks = wanted.mapInPandas(_find_blocks(archive), "key string, file string, offset bigint, length bigint")
    blocks = blocks.repartition(tasks, "file", "offset").sortWithinPartitions("file", "offset", "key")
    captures = blocks.mapInPandas(_find_captures(archive.folder), "key string, file string, offset bigint, length bigint")
    # Neighbouring records of a file are one task's reads.
    near = captures.withColumn("piece", F.expr(f"offset div {TASK_BYTES}L")).repartition(tasks, "file", "piece").sortWithinPartitions("file", "offset").drop("piece")
    return near.mapInPandas(_read_records(archive.folder, with_payload), RECORD + (", payload binary" if with_payload else ""))


def keys_of(pages: DataFrame) -> DataFrame:
    ship_package(pages.sparkSession)

    @F.pandas_udf("string")
    def key(url: pd.Series) -> pd.Series:
        return url.map(url_key, na_action=None)

    return pages.select(key(F.col("url").cast("string")).alias("key"))

"""WARC archives with a two-level capture index.

Every page becomes one gzip member of a WARC 1.1 file; equal payloads of at least MIN_REVISIT bytes are
stored once, by the largest page_id, and the others are revisit records that point to it. The index sorts captures by
reversed-host URL key. Its first level are compressed blocks of BLOCK_LINES captures; its second level is a
sparse directory with each block's first key, kept beside the blocks of each key range. A lookup
bisects the ranges, then the range's directory, reads one block by byte range, bisects its lines, and reads the
record by byte range.

Files lie under the shared folder and are named by task attempt; the index lists only those of attempts whose
rows were committed, so a retried task leaves at most an unread file behind. They are reached through
pyarrow's file systems (local, HDFS, object stores).

A null html is an empty payload. A null url has the empty key. A row without page_id is a response that
nothing refers to. Repeated rows are captures of their own.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MIN_REVISIT = 1000
FILE_BYTES = 512 << 20
BLOCK_LINES = 2048
READ_ROWS = 512
#: Parts that the rows of one payload are dealt to.
SALTS = 64
DATE = "1970-01-01T00:00:00Z"


def url_key(url: str) -> Column:
    """Sort key: host labels reversed and joined by commas, `)`, then the rest of the URL."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.when(u == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", "")))


def _payload() -> Column:
    return F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))


def payloads(pages: DataFrame) -> DataFrame:
    """The digests of payloads that may be revisits, as a written table; part deals the rows of one payload."""
    n = F.octet_length(F.coalesce("html", F.lit("")))
    part = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("part")
    rows = pages.select("page_id", n.alias("n"), F.sha1(_payload()).alias("digest"), part)
    return common.materialize(rows.where(F.col("n") >= MIN_REVISIT), "payloads")


def decided(pages: DataFrame, narrow: DataFrame | None = None) -> DataFrame:
    """The pages with record type's refers_to (null: response) and URL key; narrow: their payloads().

    Copies meet their response by payload and part, so that no task gets all copies of a payload.
    """
    narrow = payloads(pages) if narrow is None else narrow
    parts = narrow.groupBy("digest", "n", "part").agg(F.max("page_id").alias("first"), F.count("*").alias("k"))
    whole = Window.partitionBy("digest", "n")
    groups = parts.select("digest", "n", "part", F.max("first").over(whole).alias("first"), F.sum("k").over(whole).alias("k"))
    revisits = narrow.join(groups.where("k > 1").drop("k"), ["digest", "n", "part"]).where("page_id <> first").select(
        F.col("page_id").alias("__id"), "digest", F.col("first").alias("refers_to"))
    # an id may stand for rows of different payloads; the digest decides
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(_payload()).alias("__digest"), url_key("url").alias("key"))
    joined = rows.join(revisits.distinct(), (F.col("page_id") == F.col("__id")) & (F.col("__digest") == F.col("digest")), "left")
    return joined.select("page_id", "url", "html", "key", "refers_to")


def _open(base: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(base)


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, serial: str) -> bytes:
    """One gzip member: a response, or a revisit whose block has the HTTP header only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    ident = f"urn:page:{page_id}" if page_id is not None else f"urn:unnamed:{serial}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {DATE}",
            *([f"WARC-Target-URI: {_header(url)}"] if url else []), f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def _header(text: str) -> str:
    """A header value holds no line breaks; they are percent-encoded as in any URL."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def parse(member: bytes) -> dict:
    """Fields of a record; the payload's digest is checked against its header."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = fields["WARC-Record-ID"][1:-1]
    refers = fields.get("WARC-Refers-To", "")[1:-1].removeprefix("urn:page:")
    return {"page_id": int(page.removeprefix("urn:page:")) if page.startswith("urn:page:") else None, "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None,
            "payload_bytes": length, "payload_digest": digest.hex(), "record_type": kind, "refers_to": int(refers) if refers else None}


def write_archive(pages: DataFrame, base: str) -> DataFrame:
    """Write decided pages to WARC files under base; the captures (key, page_id, file, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(base)
        task, part, out, at = TaskContext.get().taskAttemptId(), 0, None, 0
        try:
            for batch in batches:
                for piece in common.text_slices(batch, 2):
                    keys, ids, names, offsets, lengths = [], [], [], [], []
                    for page, url, html, key, refers in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                        if out is None or at > FILE_BYTES:
                            if out:
                                out.close()
                            part, at, name = part + 1, 0, f"{task}-{part}.warc.gz"
                            out = files.open_output_stream(f"{root}/{name}", compression=None)
                        member = record(page, url, html.encode(), refers, f"{task}-{part}-{at}")
                        out.write(member)
                        keys.append(key)
                        ids.append(page)
                        names.append(name)
                        offsets.append(at)
                        lengths.append(len(member))
                        at += len(member)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                                                     names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    files, root = _open(base)
    files.create_dir(root, recursive=True)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", "key", F.col("refers_to").cast("bigint").alias("refers_to"))
    return common.materialize(rows.mapInArrow(run, "key string, page_id bigint, file string, offset bigint, length bigint"), "captures")


def _line(key: str, page_id: int | None) -> bytes:
    """Sortable head of an index line."""
    safe = key.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")
    return f"{safe}\t{'' if page_id is None else page_id}\t".encode()


def write_index(captures: DataFrame, base: str) -> DataFrame:
    """Write the captures' index under base; its ranges (first, file): the first line head and the name of each range."""
    spark = captures.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(base)
        name = f"{TaskContext.get().taskAttemptId()}"
        lines: list[bytes] = []
        directory: list[bytes] = []
        out, at, first = None, 0, None

        def flush() -> None:
            nonlocal out, at, first
            out = out or files.open_output_stream(f"{root}/{name}.blocks", compression=None)
            block = zlib.compress(b"\n".join(lines))
            out.write(block)
            head = lines[0].rsplit(b"\t", 3)[0] + b"\t"
            first = head if first is None else first
            directory.append(head + f"{at}\t{len(block)}".encode())
            at += len(block)
            lines.clear()

        for batch in batches:
            # sorted by their bytes, as a lookup compares them
            for head, file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                lines.append(head + f"{file}\t{offset}\t{length}".encode())
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out:
            out.close()
            with files.open_output_stream(f"{root}/{name}.directory", compression=None) as d:
                d.write(zlib.compress(b"\n".join(directory)))
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary()), pa.array([name])], names=["first", "file"])

    files, root = _open(base)
    files.create_dir(root, recursive=True)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = captures.select(line_head("key", "page_id").alias("head"), "file", "offset", "length").repartitionByRange(parts, "head").sortWithinPartitions("head", "file", "offset")
    return common.materialize(ordered.mapInArrow(run, "first binary, file string"), "ranges")


def line_head(key: str, page_id: str) -> Column:
    """_line as a column."""
    safe = F.replace(F.replace(F.replace(F.col(key), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    return F.encode(F.concat(safe, F.lit("\t"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit("\t")), "UTF-8")


class CaptureIndex:
    """Lookups in an archive: ranges are (first line head, file) in order, a few bytes for each range."""

    def __init__(self, index: str, archive: str, ranges: list[tuple[bytes, str]], blocks: int = 4, handles: int = 16):
        self.files, self.root = _open(index)
        self.archive = _open(archive)[1]
        self.ranges = sorted(ranges)
        self.firsts = [bytes(first) for first, _ in self.ranges]
        self.kept_blocks, self.kept_files, self.kept_directories = _Cache(blocks), _Cache(handles, lambda f: f.close()), _Cache(2)

    def _file(self, path: str):
        return self.kept_files.get(path, lambda: self.files.open_input_file(path))

    def _read(self, path: str, offset: int, length: int) -> bytes:
        f = self._file(path)
        f.seek(offset)
        return f.read(length)

    def _directory(self, name: str) -> tuple[list[bytes], list[tuple[int, int]]]:
        def load():
            with self.files.open_input_stream(f"{self.root}/{name}.directory", compression=None) as f:
                rows = [x.rsplit(b"\t", 2) for x in zlib.decompress(f.read()).split(b"\n")]
            return [x[0] + b"\t" for x in rows], [(int(x[1]), int(x[2])) for x in rows]

        return self.kept_directories.get(name, load)

    def _block(self, name: str, k: int) -> list[bytes]:
        offset, length = self._directory(name)[1][k]
        return self.kept_blocks.get((name, k), lambda: zlib.decompress(self._read(f"{self.root}/{name}.blocks", offset, length)).split(b"\n"))

    def captures(self, head: bytes) -> Iterator[tuple[str, int, int]]:
        """Places (file, offset, length) of all captures whose line starts with head."""
        at = max(0, bisect_left(self.firsts, head) - 1)
        while at < len(self.ranges) and (self.firsts[at] <= head or self.firsts[at].startswith(head)):
            name = self.ranges[at][1]
            heads = self._directory(name)[0]
            k = max(0, bisect_left(heads, head) - 1)
            while k < len(heads) and (heads[k] <= head or heads[k].startswith(head)):
                lines = self._block(name, k)
                for i in range(bisect_left(lines, head), len(lines)):
                    if not lines[i].startswith(head):
                        break
                    file, offset, length = lines[i].rsplit(b"\t", 3)[1:]
                    yield file.decode(), int(offset), int(length)
                k += 1
            at += 1

    def read(self, place: tuple[str, int, int]) -> dict:
        file, offset, length = place
        return parse(self._read(f"{self.archive}/{file}", offset, length))

    def lookup(self, key: str) -> list[dict]:
        """All records of a URL key."""
        return [self.read(p) for p in self.captures(_line(key, None)[:-1])]

    def close(self) -> None:
        self.kept_files.clear()


class _Cache:
    """The last few values; what leaves is closed."""

    def __init__(self, size: int, close=lambda x: None):
        self.size, self.close, self.held = size, close, OrderedDict()

    def get(self, key, make):
        if key in self.held:
            self.held.move_to_end(key)
        else:
            self.held[key] = make()
            if len(self.held) > self.size:
                self.close(self.held.popitem(last=False)[1])
        return self.held[key]

    def clear(self) -> None:
        while self.held:
            self.close(self.held.popitem()[1])


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_back(heads: DataFrame, index: str, archive: str, ranges: DataFrame) -> DataFrame:
    """The records of line heads (column head), each found through the index.

    Ranges are as many as the index was given partitions, whatever the corpus; heads are sorted so that
    a task reads each block once.
    """
    spark: SparkSession = heads.sparkSession
    listed = [(bytes(r["first"]), r["file"]) for r in ranges.collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = CaptureIndex(index, archive, listed)
        fields = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        try:
            for batch in batches:
                places = (p for head in batch.column(0).to_pylist() for p in found.captures(head))
                # one payload is held at a time: what stays of a record are its narrow fields
                while rows := [tuple(map(found.read(p).get, fields)) for p in islice(places, READ_ROWS)]:
                    columns = zip(zip(*rows, strict=True), types, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=fields)
        finally:
            found.close()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return heads.repartitionByRange(parts, "head").sortWithinPartitions("head").mapInArrow(run, RECORD)


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages, index them, and read every record back through the index."""
    spark = pages.sparkSession
    base = common.work_path(spark, "warc")
    narrow = payloads(pages)
    captures = write_archive(decided(pages, narrow), f"{base}/records")
    common.drop_table(narrow)
    ranges = write_index(captures, f"{base}/index")
    common.drop_table(captures)
    heads = pages.select(url_key("url").alias("key"), "page_id").distinct().select(line_head("key", "page_id").alias("head"))
    return read_back(heads, f"{base}/index", f"{base}/records", ranges)


def query(spark, sf_dir: str) -> DataFrame:
    return archive(common.table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT payload_digest, n, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY payload_digest, n)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.payload_digest AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.n = g.n
"""

"""WARC archives with a two-level capture index.

Tasks write pages as WARC/1.1 records, each a gzip member of its own, to the shared folder.
The index sorts a line for each capture by its reversed-host URL key, cuts the sorted lines
into compressed blocks, and keeps a sparse directory with the first key of each block. A
lookup binary-searches the directory, reads one block by its byte range, binary-searches its
lines, and reads the record by its byte range.

Files are written under a task's own name and moved into place, so a repeated task replaces
its file with the same content; rows that name files are kept in the shared folder.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.llm.common import materialize, shared_dir

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "page_id long, key string, file string, offset long, length long"
BLOCK = "first_key string, last_key string, file string, offset long, length long, n_lines long"
FOUND = "query string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Reversed-host key: http://www.Example.com:80/a?b -> com,example,www)/a?b; the fragment goes."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return re.sub(r"\s", "%20", url or "")
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"\s", "%20", f"{','.join(reversed(host.split('.')))}{port}){path}")


def capture_key(url: str | None, page_id: int | None) -> str:
    """The index key of one capture: URL key, then the id in 20 digits that sort by value (null: ~)."""
    return f"{url_key(url)} {'~' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def folder(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/+", path):
        path = re.sub(r"file:/+", "file:///", path)
    return fs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    name = "null" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url or '')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Page-Id: {name}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> dict:
    """What a record tells: page_id, url, payload (None for a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record of page {fields['X-Page-Id']}")
    number = lambda x: None if x in (None, "null", "None") else int(x)
    return {
        "page_id": number(fields["X-Page-Id"]), "url": fields["WARC-Target-URI"], "payload": None if revisit else payload, "payload_bytes": size,
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("X-Refers-To-Page")),
    }


class Part:
    """A file that a task writes under a name of its attempt and moves into place when it is whole."""

    def __init__(self, path: str, kind: str, number: int):
        task = TaskContext.get()
        self.files, root = folder(path)
        self.name = f"{kind}-{task.partitionId() if task else 0:06d}-{number:04d}.gz"
        self.last, self.first = f"{root}/{self.name}", f"{root}/_{self.name}.{task.taskAttemptId() if task else 0}"
        self.stream, self.size = self.files.open_output_stream(self.first), 0

    def add(self, data: bytes) -> tuple[int, int]:
        self.stream.write(data)
        self.size += len(data)
        return self.size - len(data), len(data)

    def done(self) -> None:
        self.stream.close()
        self.files.move(self.first, self.last)


def with_first(rows: DataFrame, same: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """rows with `first`, the response's page_id, for those of a repeated payload. same: (sha, first).

    Beyond max_rows repeated payloads, page numbers and digests alone are joined by digest; the
    payloads follow by page number and digest, so that no task gets all copies of a page.
    """
    if same.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(same), "sha", "left")
    narrow = rows.where("sha is not null").select("page_id", "sha").join(same, "sha").distinct()
    narrow = narrow.select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "first")
    return rows.join(narrow, rows["page_id"].eqNullSafe(F.col("_page")) & (rows["sha"] == F.col("_sha")), "left")


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, file_bytes: int = 1 << 30, level: int = 4) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) below path; (page_id, key, file, offset, length) of each.

    Of rows with equal payloads of min_payload bytes or more, that with the smallest page_id is
    written as response, others as revisits that refer to it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.when(F.length("payload") >= min_payload, F.sha1("payload")))
    same = rows.where("sha is not null").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = materialize(same.where("n > 1 and first is not null").select("sha", "first"))
    tagged = with_first(rows, same).select("page_id", "url", "payload", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = None, 0
        for batch in batches:
            out = []
            for page_id, url, payload, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                page_id, url, first = page_id.as_py(), url.as_py(), first.as_py()
                if part is None:
                    part = Part(path, "warc", number)
                revisit = first is not None and first != page_id
                data = gzip.compress(record(page_id, url, payload.as_py(), first, revisit), level, mtime=0)
                out.append((page_id, capture_key(url, page_id), part.name, *part.add(data)))
                if part.size >= file_bytes:
                    part.done()
                    part, number = None, number + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=["page_id", "key", "file", "offset", "length"])
        if part is not None:
            part.done()

    folder(path)[0].create_dir(folder(path)[1], recursive=True)
    return materialize(tagged.mapInArrow(write, CAPTURE))


def write_index(captures: DataFrame, path: str, block_lines: int = 1000, task_lines: int = 100_000) -> DataFrame:
    """Sort the captures by key into compressed blocks below path; the sparse directory: a row for each block.

    Each task sorts about task_lines captures and writes them to a file of its own.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, lines, blocks = None, [], []

        def cut() -> None:
            nonlocal part, lines
            if lines:
                part = part or Part(path, "index", 0)
                keys = [" ".join(x.split(" ")[:2]) for x in (lines[0], lines[-1])]
                blocks.append((*keys, part.name, *part.add(zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))), len(lines)))
                lines = []

        for batch in batches:
            for row in batch.itertuples(index=False):
                lines.append(f"{row.key} {row.file} {row.offset} {row.length}")
                if len(lines) >= block_lines:
                    cut()
        cut()
        if part is not None:
            part.done()
        yield pd.DataFrame(blocks, columns=["first_key", "last_key", "file", "offset", "length", "n_lines"])

    folder(path)[0].create_dir(folder(path)[1], recursive=True)
    ordered = captures.select("key", "file", "offset", "length").repartitionByRange(max(1, -(-captures.count() // task_lines)), "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return materialize(ordered.mapInPandas(write, BLOCK))


def lookup(queries: DataFrame, directory: DataFrame, path: str, with_payload: bool = False, max_blocks: int = 200_000, task_queries: int = 5_000) -> DataFrame:
    """The captures for each query: all whose key starts with it.

    queries: one string column; "<url key> " finds a URL's captures, a whole capture key one of
    them. The directory is sent to the tasks in slices of max_blocks blocks, each with the
    queries of its key range in tasks of about task_queries; of several slices each is read to
    the shared folder, and released, before the next.
    """
    n = directory.count()
    names = [c.split(" ")[0] for c in FOUND.split(", ")]
    queries = queries.select(F.col(queries.columns[0]).alias("query")).where("query is not null").distinct()
    slices = -(-n // max_blocks) or 1
    bounds: list[str | None] = [None, None]
    if slices > 1:  # the first key of each slice
        place = directory.select("first_key").sort("first_key").rdd.zipWithIndex()
        bounds[1:1] = place.filter(lambda x: x[1] and x[1] % max_blocks == 0).map(lambda x: x[0][0]).collect()
    parts = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        inside = F.lit(True)
        if high is not None:
            inside &= F.col("first_key") < high
        if low is not None:
            inside &= F.col("last_key") >= low
        rows = sorted(tuple(r) for r in directory.where(inside).select("first_key", "file", "offset", "length").collect())
        mine = F.lit(True)
        if high is not None:
            mine &= F.col("query") < high
        if low is not None:
            mine &= F.col("query") >= low
        shared = queries.sparkSession.sparkContext.broadcast(rows)

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            blocks = shared.value
            firsts = [b[0] for b in blocks]
            files, root = folder(path)
            opened: dict[str, object] = {}
            held: tuple[int, list[str]] = (-1, [])

            def read(name: str, offset: int, length: int) -> bytes:
                if name not in opened:
                    if len(opened) > 200:
                        opened.clear()
                    opened[name] = files.open_input_file(f"{root}/{name}")
                return opened[name].read_at(length, offset)

            for batch in batches:
                out = []
                for query in batch["query"]:
                    k = max(0, bisect_right(firsts, query) - 1)
                    # Equal keys may reach back over blocks; a prefix may reach on over them.
                    while k and firsts[k].startswith(query):
                        k -= 1
                    while k < len(blocks) and (firsts[k] <= query or firsts[k].startswith(query)):
                        if held[0] != k:
                            held = (k, zlib.decompress(read(*blocks[k][1:])).decode("utf-8", "surrogatepass").split("\n"))
                        for line in held[1][bisect_left(held[1], query) :]:
                            if not line.startswith(query):
                                break
                            name, offset, length = line.split(" ")[2:]
                            told = read_record(gzip.decompress(read(name, int(offset), int(length))))
                            out.append({"query": query, **told, "file": name, "offset": int(offset), "length": int(length)})
                        k += 1
                frame = pd.DataFrame(out, columns=names + ["payload"] * with_payload)
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

        wanted = queries.where(mine)
        tasks = max(1, -(-wanted.count() // task_queries))
        part = wanted.repartitionByRange(tasks, "query").sortWithinPartitions("query").mapInPandas(find, FOUND + ", payload binary" * with_payload)
        if slices > 1:
            part = materialize(part)
            shared.unpersist()
        parts.append(part)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def archive(pages: DataFrame, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Archives and index of pages below path: (captures, directory).

    A null html counts as an empty payload; a null url has an empty key; rows that repeat a
    page_id have a record each, and of equal payloads all with the smallest page_id are
    responses; a null page_id is written as null and refers to the response like others; an
    empty table writes no file; other columns aren't read.
    """
    captures = write_archives(pages, path, **options)
    return captures, write_index(captures, path)


def warc_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4()}"
    _, directory = archive(pages, path)

    @F.pandas_udf("string")
    def key(urls: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([capture_key(u, None if i is None else int(i)) for u, i in zip(urls, ids, strict=True)], dtype=object)

    found = lookup(pages.select(key("url", F.col("page_id").cast("long").cast("string")).alias("query")), directory, path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")

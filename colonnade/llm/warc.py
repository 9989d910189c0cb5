"""WARC archives with a two-level capture index.

Every record is a gzip member of its own, so that one record can be read by its byte
range. The capture index sorts its lines by the key of the page's address (host reversed,
``com,example)/path``) and packs them into compressed blocks; a sparse directory holds the
first and last key of every block. A lookup searches the directory by bisection, opens the
one block (or the run of blocks) that can hold the key, bisects its lines, and reads the
record's byte range from its archive.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.shared import fresh_path, shuffle_partitions, small_batches, written

#: An empty gzip member; Spark's text writer puts it after every record's own member.
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"

#: Index lines of one block.
BLOCK_LINES = 3000
#: Directory rows that a lookup broadcasts at most (each some 200 bytes); beyond, keys
#: and lines meet in a join on the key.
DIRECTORY_ROWS = 200_000

CAPTURES = (
    "key string, page_id long, file string, offset long, length long, record_type string, "
    "payload_digest string, payload_bytes long"
)
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


@dataclass
class Archive:
    """A folder of archives, the capture index beside it, and its directory."""

    path: str
    blocks: DataFrame
    directory: DataFrame


def url_key(url: str) -> str:
    """The sort key of an address: reversed host, then path and query; no scheme, port or fragment."""
    match = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url or "", re.S)
    host, rest = match[1].lower(), match[2]
    return ",".join(reversed(host.split("."))) + ")" + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", rest or "/")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """The gzip member of one record; ``refers_to`` is None for a response."""
    name = lambda i: "<urn:page:" + ("" if i is None else str(i)) + ">"
    url = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    kind = "response" if refers_to is None else "revisit"
    block = _HTTP + payload if refers_to is None else _HTTP
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, compresslevel=6, mtime=0)


def parse_record(raw: bytes) -> dict:
    """The fields of an unpacked record; raises where its lengths or digest are wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda name: int(n) if (n := fields[name][len("<urn:page:") : -1]) else None
    out = {
        "page_id": number("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To") if "WARC-Refers-To" in fields else None,
    }
    if out["record_type"] == "response" and (len(payload) != out["payload_bytes"] or digest_of(payload) != out["payload_digest"]):
        raise ValueError(f"record {out['page_id']} has a wrong payload")
    return out | {"html": payload.decode("utf-8", "surrogatepass") if out["record_type"] == "response" else None}


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, unpacked bytes) of each non-empty gzip member."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpack, parts, end = zlib.decompressobj(31), [], at
        while not unpack.eof:
            piece = view[end : end + 65536]
            if not piece:
                raise ValueError("a gzip member is cut off")
            parts.append(unpack.decompress(piece))
            end += len(piece)
        end -= len(unpack.unused_data)
        raw = b"".join(parts)
        if raw:
            yield at, end - at, raw
        at = end


def write(pages: DataFrame, min_revisit_bytes: int = 0) -> str:
    """Write a record per row of ``pages`` (page_id, url, html); returns the archives' folder.

    Of rows with equal payloads of at least ``min_revisit_bytes`` the one with the
    smallest page_id is a response, the others revisit it; a null html is an empty
    payload, a null url an empty one. Repeated rows with that smallest page_id are
    responses each. A row without a page_id revisits if another row has its payload and
    an id. An empty table gives no archive. Other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), html.alias("html"))
    rows = rows.withColumn("size", F.octet_length("html")).withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    # Only digests are grouped; a group of copies of any size folds into one row per task.
    first = rows.groupBy("sha1", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    first = first.where((F.col("copies") > 1) & (F.col("size") >= min_revisit_bytes)).select("sha1", "size", "first_id")
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.join(first, ["sha1", "size"], "left").select(
        "page_id", "url", "html", F.when(revisits, F.col("first_id")).alias("refers_to")
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lambda i: None if pd.isna(i) else int(i)
        for batch in batches:
            out = [
                record_of(known(i), u, t.encode("utf-8", "surrogatepass"), known(r))
                for i, u, t, r in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True)
            ]
            yield pd.DataFrame({"record": out})

    path = fresh_path(spark, "warc")
    (
        rows.select("page_id", "url", "html", "refers_to")
        .mapInPandas(pack, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1")).text(path)
    )
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def index(spark: SparkSession, path: str, block_lines: int = BLOCK_LINES) -> Archive:
    """Read the archives once and build the capture index over them."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                rows = []
                for offset, length, raw in members(content):
                    r = parse_record(raw)
                    rows.append((url_key(r["url"]), r["page_id"], file, offset, length, r["record_type"], r["payload_digest"], r["payload_bytes"]))
                yield _typed(rows, CAPTURES)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines: list[str] = []
        keys: list[str] = []

        def block() -> pd.DataFrame:
            blob = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))
            return pd.DataFrame([(keys[0], keys[-1], len(lines), blob)], columns=["first_key", "last_key", "lines", "blob"])

        for batch in batches:
            for key, line in zip(batch["key"], batch["line"], strict=True):
                if len(lines) == block_lines:
                    yield block()
                    lines, keys = [], []
                keys.append(key)
                lines.append(line)
        if lines:
            yield block()

    captures = _files(spark, path).mapInPandas(scan, CAPTURES)
    rest = ["page_id", "file", "offset", "length", "record_type", "payload_digest", "payload_bytes"]
    line = F.concat_ws("\t", "key", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest])
    # Sorted by all of the line, so that captures of one busy address can be cut as well. Keys hold no control characters.
    blocks = (
        captures.select("key", line.alias("line"))
        .repartitionByRange(shuffle_partitions(spark), "key", "line")
        .sortWithinPartitions("key", "line")
        .mapInPandas(pack, "first_key string, last_key string, lines int, blob binary")
        .withColumn("block", F.monotonically_increasing_id())
    )
    blocks = written(blocks, "warc-index")
    return Archive(path, blocks, blocks.select("block", "first_key", "last_key"))


def _typed(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split() for c in schema.split(", ")]
    frame = pd.DataFrame(rows, columns=[n for n, _ in names])
    return frame.astype({n: "Int64" for n, kind in names if kind == "long"})


def parse_line(line: str) -> tuple:
    key, page_id, file, offset, length, kind, digest, size = line.split("\t")
    return key, int(page_id) if page_id else None, file, int(offset), int(length), kind, digest, int(size)


def search_block(blob: bytes, keys: list[str]) -> list[tuple]:
    """The captures of ``keys`` in one block, found by bisection."""
    lines = zlib.decompress(blob).decode("utf-8", "surrogatepass").split("\n")
    out = []
    for key in sorted(set(keys)):
        at = bisect.bisect_left(lines, key + "\t")
        while at < len(lines) and lines[at].startswith(key + "\t"):
            out.append(parse_line(lines[at]))
            at += 1
    return out


def lookup(archive: Archive, urls: DataFrame, directory_rows: int = DIRECTORY_ROWS) -> DataFrame:
    """All captures of the addresses in ``urls`` (url), through directory and blocks."""
    spark = urls.sparkSession

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["url"].map(url_key)})

    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x1f\x7f]", "%").alias("url")
    keys = urls.select(F.when(F.col("url").rlike(r"[\x00-\x1f\x7f]"), _escaped("url")).otherwise(clean).alias("url"))
    keys = keys.mapInPandas(keyed, "key string").distinct()
    if archive.directory.limit(directory_rows + 1).count() > directory_rows:
        lines = archive.blocks.select(F.explode(_lines(archive.blocks)).alias("line"))
        return lines.withColumn("key", F.substring_index("line", "\t", 1)).join(keys, "key", "left_semi").mapInPandas(_parse_lines, CAPTURES)
    entries = sorted(tuple(r) for r in archive.directory.select("first_key", "last_key", "block").collect())
    table = spark.sparkContext.broadcast(([e[0] for e in entries], [e[1] for e in entries], [e[2] for e in entries]))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last, block = table.value
        for batch in batches:
            out = []
            for key in batch["key"]:
                at = bisect.bisect_left(last, key)
                while at < len(first) and first[at] <= key:
                    out.append((key, block[at]))
                    at += 1
            yield pd.DataFrame(out, columns=["key", "block"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob, keys in zip(batch["blob"], batch["keys"], strict=True):
                yield _typed(search_block(blob, list(keys)), CAPTURES)

    asked = keys.mapInPandas(locate, "key string, block long").groupBy("block").agg(F.collect_list("key").alias("keys"))
    return asked.join(archive.blocks, "block").select("blob", "keys").mapInPandas(read, CAPTURES)


def _escaped(name: str):
    """Control characters percent-encoded, as the records' headers hold them."""
    chars = F.split(F.coalesce(F.col(name), F.lit("")), "")
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike(r"[\x00-\x1f\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")


def _lines(blocks: DataFrame):
    unpack = F.udf(lambda blob: zlib.decompress(blob).decode("utf-8", "surrogatepass").split("\n"), "array<string>")
    return unpack("blob")


def _parse_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _typed([parse_line(x) for x in batch["line"]], CAPTURES)


def fetch(archive: Archive, captures: DataFrame) -> DataFrame:
    """The records of ``captures``, each read from its byte range.

    Ranges of one archive are read together by the task that holds its bytes.
    """

    def ranges(asked: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for content in files["content"]:
            view = memoryview(content)
            for offset, length in zip(asked["offset"], asked["length"], strict=True):
                r = parse_record(gzip.decompress(view[offset : offset + length]))
                rows.append(tuple(r[c.split()[0]] for c in RECORDS.split(", ")))
        return _typed(rows, RECORDS)

    asked = captures.select("file", "offset", "length").groupBy("file")
    return asked.cogroup(_files(captures.sparkSession, archive.path).groupBy("file")).applyInPandas(ranges, RECORDS)


def read_range(spark: SparkSession, file: str, offset: int, length: int) -> dict:
    """One record by its byte range, through Hadoop's file system: for single lookups."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        raw = bytes(stream.readNBytes(length))
    finally:
        stream.close()
    return parse_record(gzip.decompress(raw))

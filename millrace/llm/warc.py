"""WARC archives: a distributed writer of record-at-a-time gzip members, and a splittable reader.

Reader: the tasks of Spark's line reader scan byte ranges with the gzip magic as the line separator, so each task
gets, in order, the candidate members that start in its range, whatever store the archive is in. A candidate is a
member if its deflate stream decodes and its content starts with a WARC header; magic bytes inside a member only cut
it into pieces, which are joined again. Pieces cut by a range boundary are the one thing that needs a second step:
the open end of a range and the leading pieces of the next meet in a small grouped pass over each file.

Writer: Spark's line writer with the separator NUL. A gzip member ends in the high byte of its length, which is NUL for
records under 16 MB, so every row is a member without its last byte; longer records are followed by an empty
member, whose last byte is NUL too. The files are plain concatenated members, committed by Spark's protocol.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, hadoop_path, new_table_path, prepare

MAGIC = b"\x1f\x8b\x08"
_EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + b"\x00" * 8
#: Files that are read by one set of links.
MAX_LINKS = 5000
_DATE = "2024-01-01T00:00:00Z"
RECORD = "row long, row_null boolean, url string, record_type string, payload binary, payload_bytes long, digest string, refers_to long, http_bytes long"


def gzip_member(content: bytes, level: int = 6) -> bytes:
    """One gzip member without name or time, so the same content gives the same bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(content) + z.flush()


def _header_value(s: str) -> str:
    return " ".join(s.split())


def record(row_id: int | None, url: str | None, payload: bytes | None, digest_hex: str, size: int, revisit_of: int | None, is_revisit: bool) -> bytes:
    """A response or an identical-payload revisit; the revisit keeps the HTTP header, with the full length, only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if is_revisit else http + (payload or b"")
    name = lambda i: f"<urn:x-row:{'null' if i is None else i}>"
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {name(row_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(revisit_of)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """``row, url, payload, digest, size, revisit, refers_to`` for each page.

    Of pages with equal payloads (SHA-1 and length) of at least ``min_bytes`` bytes, those with the largest id are
    responses and the others revisit it. The groups are reduced before they are exchanged; the join back is one that
    Spark splits where a payload is very common, and only groups of two and more take part in it.
    """
    payload = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("row"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    keyed = rows.select("row", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    groups = Table(keyed.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("row").alias("last"), F.count("*").alias("n"))
                   .filter("n > 1").select(F.col("digest").alias("d"), F.col("size").alias("z"), "last"), "warc-groups")
    full = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    return full.join(groups.df, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("z")), "left").select(
        "row", "url", "payload", "digest", "size",
        F.coalesce(~F.col("row").eqNullSafe(F.col("last")) & F.col("d").isNotNull(), F.lit(False)).alias("revisit"),
        F.col("last").alias("refers_to"))


def write_warc(records: DataFrame, path: str, level: int = 6) -> None:
    """Write the planned records as gzip members, a file for each task."""
    prepare(records.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for r in batch.to_pylist():
                content = record(r["row"], r["url"], r["payload"], r["digest"], r["size"], r["refers_to"], r["revisit"])
                member = gzip_member(content, level)
                if member[-1]:
                    member += _EMPTY
                out.append(member[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    packed = records.select("row", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "digest", "size", "revisit", "refers_to")
    packed.mapInArrow(pack, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


def _looks_like_header(data: bytes) -> bool:
    """Whether the candidate's decoded beginning can be a WARC header. Reads a little only."""
    z = zlib.decompressobj(31)
    try:
        head = z.decompress(data[:4096], 64)
    except zlib.error:
        return False
    return b"WARC/"[: len(head)] == head[:5] and (len(head) >= 5 or z.eof or len(data) < 4096)


def parse_record(content: bytes) -> dict | None:
    """Fields of one WARC record; None if the content is not one."""
    head, sep, rest = content.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/"):
        return None
    fields = {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
    size = fields.get("content-length", "")
    block = rest[: int(size)] if size.isdigit() else rest
    http, _, payload = block.partition(b"\r\n\r\n")
    http_bytes = next((int(n) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:") and (n := x.split(b":", 1)[1].strip()).isdigit()), None)
    kind = fields.get("warc-type")
    row = lambda v: (lambda s: int(s) if s.lstrip("-").isdigit() else None)(v.rsplit(":", 1)[-1].rstrip(">")) if v else None
    how, _, digest = fields.get("warc-payload-digest", "").partition(":")
    given = base64.b32decode(digest).hex() if how.lower() == "sha1" and re.fullmatch("[A-Z2-7]{32}", digest) else digest.lower() or None
    return {
        "row": row(fields.get("warc-record-id")), "row_null": "x-row:null" in fields.get("warc-record-id", ""), "url": fields.get("warc-target-uri"), "record_type": kind,
        "payload": payload if kind == "response" else None, "payload_bytes": len(payload) if kind == "response" else http_bytes,
        "digest": hashlib.sha1(payload).hexdigest() if kind == "response" else given,
        "refers_to": row(fields.get("warc-refers-to")), "http_bytes": http_bytes}


class _Open:
    """The member being put together from the pieces between magic bytes; each byte is inflated once."""

    def __init__(self):
        self.drop()

    def drop(self) -> None:
        self.pieces: list[bytes] = []
        self.content: list[bytes] = []
        self.z = zlib.decompressobj(31)

    def push(self, piece: bytes) -> tuple[bool, bytes | None]:
        """Whether the piece continues the open member, or begins one, and the content once the member is complete."""
        if not self.pieces and not _looks_like_header(piece):
            return False, None
        try:
            self.content.append(self.z.decompress(piece))
        except zlib.error:
            begun = bool(self.pieces)
            self.drop()
            return self.push(piece) if begun else (True, None)  # what was open is damaged; the piece may begin anew
        self.pieces.append(piece)
        if not self.z.eof:
            return True, None
        content = b"".join(self.content)
        self.drop()
        return True, content


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, piece``: what lies between magic bytes, by byte ranges. Files named ``.gz``, which Spark would inflate whole, are
    read under other names, by links of Hadoop's view of file systems that only this read knows of."""
    fs, p = hadoop_path(spark, path)
    found = [x for top in fs.globStatus(p) or [] for x in (fs.listStatus(top.getPath()) if top.isDirectory() else [top])]
    names = [str(x.getPath()) for x in found if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    zipped = sorted(n for n in names if n.lower().endswith(".gz"))

    def read(paths: list[str], options: dict[str, str]) -> DataFrame:
        lines = spark.read.options(**options).option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(paths)
        return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))

    if not zipped:
        return read([path], {})
    plain = sorted(set(names) - set(zipped))
    parts = [read(plain, {})] if plain else []
    for i in range(0, len(zipped), MAX_LINKS):
        view, links = f"warc-{uuid.uuid4().hex}", {f"/{k}/archive.warc": n for k, n in enumerate(zipped[i : i + MAX_LINKS])}
        parts.append(read([f"viewfs://{view}{k}" for k in links], {f"fs.viewfs.mounttable.{view}.link.{k}": n for k, n in links.items()}))
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives under ``path`` (see RECORD), in any order.

    Files are cut into byte ranges by ``spark.sql.files.maxPartitionBytes``; a record belongs to the range in which its
    magic lies. Damaged members and members without a WARC header give no record. Files named ``.gz`` are cut like any
    other. Records of other types and of other writers have nulls where they don't say what a field holds. An empty
    archive gives no rows. The one case read wrongly is a member that holds another WARC member uncompressed just where a
    range begins.
    """
    prepare(spark)
    lines = _lines(spark, path)
    names = [f.split()[0] for f in RECORD.split(", ")]
    schema = f"{RECORD}, file string, block long, n int, piece binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records, and as rows with a file the pieces that other ranges need: leading ones and the open end."""
        at, open_, n = None, _Open(), 0
        found: list[dict] = []

        def left(data: bytes) -> None:
            nonlocal n
            found.append({"file": at[0], "block": at[1], "n": n, "piece": data})
            n += 1

        for batch in batches:
            for r in batch.to_pylist():
                if (r["file"], r["block"]) != at:
                    if open_.pieces:
                        left(b"".join(open_.pieces))
                        open_.drop()
                    at, n = (r["file"], r["block"]), 0
                    if r["block"] == 0:
                        continue  # what precedes the first magic of a file
                piece = MAGIC + r["piece"]
                mine, content = open_.push(piece)
                if not mine:
                    left(piece)
                elif content is not None and (fields := parse_record(content)):
                    found.append(fields if payloads else fields | {"payload": None})
                if len(found) >= 256:
                    yield _batch(found)
                    found = []
        if open_.pieces:
            left(b"".join(open_.pieces))
        if found:
            yield _batch(found)

    out_schema = spark.createDataFrame([], schema).schema
    arrow = pa.schema([pa.field(f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in out_schema])

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

    seen = Table(lines.mapInArrow(scan, out_schema), "warc-scan")

    def join_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        """Records of one file that range boundaries cut: at most one open end a range, and what follows it."""
        open_, rows = _Open(), []
        for piece in pdf.sort_values(["block", "n"])["piece"]:
            content = open_.push(bytes(piece))[1]
            if content is not None and (fields := parse_record(content)):
                rows.append(fields if payloads else fields | {"payload": None})
        return pd.DataFrame(rows, columns=names, dtype=object)

    whole = seen.df.filter("file is null").select(*names)
    cut = seen.df.filter("file is not null").groupBy("file").applyInPandas(join_pieces, RECORD)
    return whole.unionByName(cut)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Write a record for each page and read the archives back: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, payload``.

    payload: the text in UTF-8, empty for null; equal payloads under ``min_bytes`` bytes are all responses. A null id is
    the smallest; rows that share the largest id of a group are all responses. Empty input, no rows.
    """
    spark = pages.sparkSession
    path = new_table_path(spark, "warc")
    write_warc(plan_records(pages, id_col, url_col, text_col, min_bytes), path)
    return read_warc(spark, path).select(
        F.col("row").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url", "payload")

"""WARC archives: a writer with revisit records and a splittable reader.

The reader needs no index. Spark's text source, with the gzip magic as the line separator,
has each task scan a byte range for the magic and hand over what lies between; a candidate
is a member if its header is a gzip header and its first bytes decode to a WARC version
line. A member belongs to the task in whose range it starts. Where the magic shows up by
chance inside a member, the task goes on feeding the following pieces to the open member;
members that a range's end cuts at such a place are put together in a second, small step.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, table

MAGIC = b"\x1f\x8b\x08"
#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
FRAGMENT = "file string, start long, head binary, tail binary, opened boolean"


def member(record_type: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as one gzip member. A revisit keeps the HTTP head, with the payload's length, and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if record_type == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {' '.join(uri.split())}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def parse_record(data: bytes) -> tuple | None:
    """The RECORD columns of a decompressed member; None if it is no WARC record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields.get("content-length", len(rest)))]
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        for x in http.decode("latin-1").split("\r\n")[1:]:
            if x.lower().startswith("content-length:"):
                size = int(x.partition(":")[2])
    digest = fields.get("warc-payload-digest", "").partition(":")[2]
    revisit = fields.get("warc-type") == "revisit"
    return (
        fields.get("warc-type"), fields.get("warc-record-id", "").strip("<>"), fields.get("warc-target-uri"),
        base64.b32decode(digest).hex() if digest else None, fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        size, None if revisit else payload,
    )


class Reader:
    """Takes the pieces between magics in order; yields records."""

    def __init__(self):
        self.z, self.parts, self.raw = None, [], []

    def starts(self, piece: bytes) -> bool:
        """Decodes a candidate's headers: gzip's own, then the record's first line."""
        if len(piece) < 7 or piece[0] & 0xE0:
            return False
        try:
            first = zlib.decompressobj(31).decompress(MAGIC + piece[:4096], 16)
        except zlib.error:
            return False
        if len(first) >= 5:
            return first.startswith(b"WARC/")
        # Cut short by another magic: it must be a plain gzip header, without optional fields, of a known system.
        plain = piece[0] == 0 and piece[5] in (0, 2, 4) and (piece[6] <= 13 or piece[6] == 255)
        return plain and len(piece) < 4096 and b"WARC/".startswith(first)

    def feed(self, data: bytes) -> tuple | None:
        """Goes on with the open member; a record if that completes it."""
        self.raw.append(data)
        try:
            self.parts.append(self.z.decompress(data))
        except zlib.error:
            self.z = None
            return None
        if not self.z.eof:
            return None
        self.z = None
        return parse_record(b"".join(self.parts))

    def open(self, data: bytes) -> tuple | None:
        self.z, self.parts, self.raw = zlib.decompressobj(31), [], []
        return self.feed(data)


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES) -> None:
    """A record per row, in archives below ``path``, which all executors share. Null html is an empty payload.

    Of records with equal payloads of at least ``revisit_bytes`` bytes those with the largest page_id are responses,
    the others revisits of it; rows that repeat that page_id are responses too, as are rows of a group whose ids are all null.
    """
    rows = pages.select(
        pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), F.encode(F.coalesce(pages[html], F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    kept = (
        rows.where(F.octet_length("payload") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ).select(F.col("digest").alias("same"), "kept")
    dealt = rows.join(kept, rows["digest"] == kept["same"], "left").drop("same")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = lambda i: f"urn:page:{'' if pd.isna(i) else int(i)}"
        for batch in batches:
            out = []
            for i, u, payload, digest, to in zip(*(batch[c].astype(object) for c in ("page_id", "url", "payload", "digest", "kept")), strict=True):
                again = not pd.isna(to) and (pd.isna(i) or int(i) != int(to))
                x = member("revisit" if again else "response", name(i), u, payload, digest, name(to) if again else None)
                # The line separator written after each row is the member's last byte, zero below 16 MB; else padding.
                out.append(x[:-1] if x[-1] == 0 else x)
            yield pd.DataFrame({"value": out})

    # Long ids as strings on the way, since pandas turns nullable longs into floats.
    text_ids = dealt.select(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("kept").cast("string"))
    text_ids.mapInPandas(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\u0000").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at ``path`` (a folder, file or glob of concatenated gzip members), as RECORD.

    Archives of every name are split, those that end in .gz too (see ``byte_ranges``). Damaged members are skipped. A record is
    held whole while it is decoded, so payloads have to fit in a task's memory.
    """
    pieces = (
        byte_ranges(spark, path, "\u001f\u008b\u0008")
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    )
    none = [None] * len(RECORD.split(","))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, at, head, opened = Reader(), None, [], False

        def leave() -> list[list]:
            """What the range leaves to its neighbours."""
            tail = b"".join(reader.raw) if reader.z else b""
            reader.z = None
            return [[*none, *at, b"".join(head), tail, opened]] if at and (head or tail) else []

        for batch in batches:
            out = []
            for file, start, value in zip(batch["file"], batch["start"], batch["value"], strict=True):
                if (file, start) != at:
                    out += leave()
                    at, head, opened = (file, start), [], False
                    if start == 0:
                        continue  # what stands before the file's first magic
                record = None
                if reader.z:
                    record = reader.feed(MAGIC + value)
                elif reader.starts(value):
                    opened = True
                    record = reader.open(MAGIC + value)
                elif not opened:
                    head.append(MAGIC + value)
                if record:
                    out.append([*record, None, None, None, None, None])
            yield frame(out)
        yield frame(leave())

    def frame(rows: list) -> pd.DataFrame:
        names = [x.split()[0] for x in f"{RECORD}, {FRAGMENT}".split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64", "start": "Int64", "opened": "boolean"})

    def stitch(group: pd.DataFrame) -> pd.DataFrame:
        """Members cut at ranges' ends: a range's tail goes on with the heads of the ranges after it."""
        reader, found = Reader(), []
        for head, tail, opened in group.sort_values("start")[["head", "tail", "opened"]].itertuples(index=False):
            if reader.z and head and (record := reader.feed(head)):
                found.append(record)
            if opened:
                reader.z = None
            if tail and (record := reader.open(tail)):
                found.append(record)
        return pd.DataFrame(found, columns=[x.split()[0] for x in RECORD.split(", ")]).astype({"payload_bytes": "Int64"})

    read = pieces.mapInPandas(scan, f"{RECORD}, {FRAGMENT}")
    names = [x.split()[0] for x in RECORD.split(", ")]
    whole = read.where(F.col("file").isNull()).select(*names)
    cut_up = read.where(F.col("file").isNotNull()).select("file", "start", "head", "tail", "opened").groupBy("file").applyInPandas(stitch, RECORD)
    return whole.unionByName(cut_up)


def byte_ranges(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """The bytes at ``path``, a row between two separators, split into ranges whatever the files are called.

    By its suffix a .gz file would be unpacked, by one task from its start. So where there are such files, all get names without
    one, as links of a file system view (viewfs) that only this reader's options define; executors follow the links.
    """
    reader = spark.read.option("lineSep", separator).option("encoding", "ISO-8859-1")
    files = spark.read.text(path).inputFiles()
    if not any(f.endswith(".gz") for f in files):
        return reader.text(path)
    view = f"warc-{uuid.uuid4().hex}"
    links = {f"fs.viewfs.mounttable.{view}.link./{k}": f for k, f in enumerate(files)}
    return reader.options(**links).text([f"viewfs://{view}/{k}" for k in range(len(files))])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path)
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return records.select(
        F.substring_index("record_id", ":", -1).try_cast("long").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"),
        "record_type", F.substring_index("refers_to", ":", -1).try_cast("long").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT page_id, n, sha1(html) AS digest, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS kept FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to FROM g
"""

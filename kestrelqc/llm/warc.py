"""WARC archives: one record a page, and reading by verified chains of record boundaries.

Records may be compressed each by itself (``.warc.gz``). Where the gzip header has the extra field ``sl`` with the member's
sizes, as in the archives written here, the next record's place is known without decompressing; else it is where
the member ends. An uncompressed record has it from its ``Content-Length``. Reading tasks take any range of a file and
emit, for every place that looks like the beginning of a record, that place and its successor. Pointer jumping from the
file's start keeps what is reachable; a magic string inside a payload is not. A chain that does not end where the
file ends is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelqc.cluster import new_path, ship, written
from kestrelqc.llm.joins import attached
from kestrelqc.llm.store import create, opened

#: Bytes after which an archive is closed, and bytes of an archive that one task scans.
FILE_BYTES, RANGE_BYTES = 1 << 28, 1 << 25
_DATE = "2024-01-01T00:00:00Z"
_PLAIN = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = re.compile(rb"\x1f\x8b\x08")
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", re.I)
_STEP = 1 << 16


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: dict[str, str], payload: bytes, compress: bool) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    raw = f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"
    if not compress:
        return raw
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def clean(value: str | None) -> str:
    """A header value: no line ends."""
    return re.sub(r"[\r\n]+", " ", value or "").strip()


def written_records(pages: DataFrame, least: int = 0, compress: bool = True, path: str | None = None) -> DataFrame:
    """Write ``page_id, url, html`` as WARC records; returns ``file, bytes`` of the archives.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of ``least`` bytes or more, that of
    the largest ``page_id`` is a ``response``; the others are ``revisit`` records that refer to it and hold no payload.
    Rows that repeat the largest id with the same payload are all responses. A null id is less than any other.

    The digests are grouped without the html (a group's size does not matter: sums are partial). Pages meet the
    digests that repeat by a broadcast where these are counted few; beyond that by digest, the commonest still by broadcast.
    """
    spark = pages.sparkSession
    ship(spark)
    path = path or new_path(spark, "warc")
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    # Java's SHA-1 of the full payload, with its size.
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("d"), F.octet_length(html).cast("long").alias("full"))
    rank = F.coalesce("page_id", F.lit(-(1 << 63)))
    groups = written(rows.where(F.col("full") >= least).groupBy("d").agg(F.max(rank).alias("top"), F.count("*").alias("n")).where("n > 1"), "digests")
    refers = (F.col("full") >= least) & (rank < F.col("top"))
    rows = attached(rows, groups, "d").withColumn("top", F.when(refers, F.col("top"))).withColumn("html", F.when(F.col("top").isNull(), F.col("html")))

    def run(batches):
        # Each attempt of a task has names of its own: an attempt that is given up late overwrites nothing.
        part, attempt, no, names = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, []
        todo = (r for batch in batches for k in range(0, batch.num_rows, 256) for r in batch.slice(k, 256).to_pylist())
        r = next(todo, None)
        while r is not None:
            name, size = f"{path}/part-{part:06d}-{no:04d}-{attempt}.warc{'.gz' * compress}", 0
            with create(name) as file:
                size += file.write(record("warcinfo", {"WARC-Record-ID": f"<urn:kestrelqc:info:{part}:{no}>", "WARC-Date": _DATE}, b"", compress))
                while r is not None and size < FILE_BYTES:
                    digest = base64.b32encode(bytes.fromhex(r["d"])).decode()
                    fields = {"WARC-Record-ID": f"<urn:kestrelqc:page:{'null' if r['page_id'] is None else r['page_id']}>", "WARC-Date": _DATE, "WARC-Target-URI": clean(r["url"]), "WARC-Payload-Digest": f"sha1:{digest}"}
                    if r["top"] is None:
                        size += file.write(record("response", fields, r["html"], compress))
                    else:
                        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:kestrelqc:page:{r['top']}>", "X-Payload-Bytes": str(r["full"])}
                        size += file.write(record("revisit", fields, b"", compress))
                    r = next(todo, None)
            names.append((name, size))
            no += 1
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in names], pa.string()), pa.array([s for _, s in names], pa.int64())], names=["file", "bytes"])

    return written(rows.mapInArrow(run, "file string, bytes long"), "archives")


class Range:
    """A stretch of a file in memory; what lies past it is read in steps."""

    def __init__(self, f, start: int, end: int):
        self.f, self.start, self.past, self.at = f, start, end + 16, start
        f.seek(start)
        self.data = f.read(self.past - start)

    def read(self, at: int, n: int) -> bytes:
        a = at - self.start
        if 0 <= a < len(self.data):
            return self.data[a : a + n]
        self.f.seek(at)
        return self.f.read(n)


def plain_end(part: Range, at: int) -> int | None:
    """Where the record of the header at ``at`` ends; None if the header does not end, or has no length."""
    head, a = b"", at
    while True:
        more = part.read(a, _STEP)
        if not more:
            return None
        old = max(0, len(head) - 3)
        head, a = head + more, a + len(more)
        stop = head.find(b"\r\n\r\n", old)
        if stop >= 0:
            length = _LENGTH.search(head, 0, stop + 2)
            return at + stop + 4 + int(length[1]) + 4 if length else None


def member_end(part: Range, at: int) -> int | None:
    """Where the gzip member at ``at`` ends, if it is whole and begins with a record."""
    head = part.read(at, 24)
    if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl" and struct.unpack("<HHHII", head[10:24])[0] == 12 and struct.unpack("<HHHII", head[10:24])[2] == 8:
        return at + struct.unpack("<HHHII", head[10:24])[3]
    z, a, begun = zlib.decompressobj(31), at, b""
    try:
        while not z.eof:
            more = part.read(a, _STEP)
            if not more:
                return None
            a += len(more)
            out = z.decompress(more, _STEP)
            while True:
                if len(begun) < 5:
                    begun += out[:5]
                    if not b"WARC/".startswith(begun[:5]):
                        return None
                if z.eof or not z.unconsumed_tail and len(out) < _STEP:
                    break
                out = z.decompress(z.unconsumed_tail, _STEP)
    except zlib.error:
        return None
    return a - len(z.unused_data) if len(begun) >= 5 else None


def candidates(f, start: int, end: int, compressed: bool):
    """``offset, successor`` of what looks like a record that begins in ``start:end`` of the file ``f``, however long."""
    part = Range(f, start, end)
    for m in (_GZIP if compressed else _PLAIN).finditer(part.data):
        at = start + m.start()
        if at >= end:
            break
        after = member_end(part, at) if compressed else plain_end(part, at)
        if after is not None:
            yield at, after


def reachable(offsets: np.ndarray, successors: np.ndarray, start: int = 0) -> np.ndarray:
    """Which of the candidates a chain from ``start`` meets, by pointer jumping: each round doubles the jumps.

    Offsets are distinct and ascending.
    """
    n = len(offsets)
    jump = np.searchsorted(offsets, successors)
    jump = np.where((jump < n) & (offsets[np.minimum(jump, n - 1)] == successors), jump, n) if n else np.zeros(0, np.int64)
    jump = np.append(jump, n)  # past the end, or nowhere
    seen = np.zeros(n + 1, bool)
    at = np.searchsorted(offsets, start)
    if n and at < n and offsets[at] == start:
        seen[at] = True
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        if (more == seen).all() and (jump == jump[jump]).all():
            return seen[:n]
        seen, jump = more, jump[jump]


def parse_records(raw: bytes):
    """``fields, block`` of each record in ``raw``: one, or all that share a gzip member."""
    at = 0
    while at < len(raw):
        stop = raw.find(b"\r\n\r\n", at)
        if stop < 0 or not _PLAIN.match(raw, at):
            raise ValueError("no record where one must begin")
        lines = raw[at:stop].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        end = stop + 4 + int(fields["content-length"])
        if end + 4 > len(raw):
            raise ValueError("a record goes on past its end")
        yield fields, raw[stop + 4 : end]
        at = end + 4


_PAGE = re.compile(r"<urn:kestrelqc:page:(null|-?\d+)>")


def _page(field: str | None) -> int | None:
    """The page's number in a record id of this module."""
    m = _PAGE.fullmatch(field or "")
    return int(m[1]) if m and m[1] != "null" else None


def listed(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes`` of the archives at a path or glob."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read_records(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, record_id`` of the archives ``file, bytes``.

    All records but ``warcinfo`` come out, those of other writers too: ``page_id`` and ``refers_to`` are null where the ids
    are not of this module. The payload of a ``revisit`` is null, and its size and digest are what its header says.

    Three steps: scan ranges for candidates; jump pointers in each file (its candidates are two numbers each, and as many
    as records fit in an archive); read the reachable records, in ranges again. If a file's chain does not begin at its
    first byte and end at its last, it is broken or no archive, and reading raises an error that says where.
    """
    spark = files.sparkSession
    ship(spark)
    files = files.select(F.col("file").cast("string").alias("file"), F.col("bytes").cast("long").alias("bytes"))
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("a"))
    many = max(1, min(10_000, ranges.count()))

    def scan(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["file"]) as f:
                    got = list(candidates(f, r["a"], min(r["a"] + range_bytes, r["bytes"]), r["file"].endswith(".gz")))
                if r["a"] == 0:
                    got.append((-1, r["bytes"]))
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(got), pa.string()), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())], names=["file", "at", "next"])

    def chain(pdf):
        pdf = pdf.drop_duplicates("at").sort_values("at")
        size, pdf = int(pdf["next"].iloc[0]), pdf.iloc[1:]
        pdf = pdf[reachable(pdf["at"].to_numpy(), pdf["next"].to_numpy())]
        end = int(pdf["next"].iloc[-1]) if len(pdf) else 0
        if end != size:
            raise ValueError(f"the chain of records breaks at byte {end} of {size}")
        return pdf

    def checked(key, pdf):
        try:
            return chain(pdf)
        except ValueError as e:
            raise ValueError(f"{key[0]}: {e}") from None

    found = ranges.repartition(many).mapInArrow(scan, "file string, at long, next long")
    chained = found.groupBy("file").applyInPandas(checked, "file string, at long, next long")
    # Runs of neighbouring records are read at once.
    runs = chained.groupBy("file", F.floor(F.col("at") / range_bytes).alias("k")).agg(F.sort_array(F.collect_list(F.struct("at", "next"))).alias("records"))

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["file"]) as f:
                    out = []
                    for x in r["records"]:
                        f.seek(x["at"])
                        raw = f.read(x["next"] - x["at"])
                        for fields, block in parse_records(zlib.decompress(raw, 31) if r["file"].endswith(".gz") else raw):
                            kind = fields.get("warc-type", "").lower()
                            if kind == "warcinfo":
                                continue
                            full, said = block if kind != "revisit" else None, fields.get("warc-payload-digest", "").partition(":")[2]
                            size = len(block) if full is not None else int(fields.get("x-payload-bytes", len(block)))
                            out.append((_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, _page(fields.get("warc-refers-to")), full, size, digest_of(full) if full is not None else said or None, fields.get("warc-record-id")))
                            if len(out) >= 512:
                                yield _records(out)
                                out = []
                    yield _records(out)

    return runs.repartition(many).mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, record_id string")


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string())])


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(RECORD)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, RECORD, strict=True)], schema=RECORD)


def sql() -> str:
    """The rows of ``op10_warc`` in DuckDB; base32 is spelled from 20 bits of the digest at a time."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    part = lambda i: f"('0x' || substr(h, {5 * i + 1}, 5))::BIGINT"
    spelled = " || ".join(f"substr('{letters}', (({part(i)} >> {5 * k}) & 31)::INTEGER + 1, 1)" for i in range(8) for k in (3, 2, 1, 0))
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
    t AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS top FROM p)
    SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {spelled} AS payload_digest,
        CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
    FROM t"""

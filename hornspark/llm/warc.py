"""WARC archives: a writer with revisit records and a salvaging reader.

Writer: every task writes its own archives of one gzip member per record, closes one at
``max_bytes`` and starts the next.  They stay hidden under names of the task attempt until
the manifest, which has the archives of the one attempt that counts for each task, is in the
shared folder; then those it names, and no others, are renamed, and a rename that is done
already is left alone.  So neither a retry nor a speculative twin doubles or loses a record.
Equal payloads are found by hash before; only rows that may be revisits are shuffled.

Reader: a record counts only if all checks hold (member, version line, headers, length,
record end, digests).  Where one fails, the reader looks for the next member or version
line at which a whole record passes, goes on from there, and reports the bytes between as
a quarantined gap.  Inside a member it searches what was inflated: a sound member loses only
the record that fails, and of a member that is broken or cut off the records before the
damage are kept if their block digests hold; ``reason`` tells them from others, as the
member's checksum does not vouch for their headers.  One archive is read by one task;
``max_bytes`` bounds its memory.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import arrow_batches, cut, ensure_checkpoint_dir, filter_bits, join_groups, pack_slots, probe, slot_of, table

log = logging.getLogger(__name__)

MAX_ARCHIVE_BYTES = 16 << 20
ID_PREFIX = "urn:x-record:"
#: Fixed values of the WARC 1.1 standard.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_START = b"\x1f\x8b\x08"
NEEDED_FIELDS = {"warc-type", "warc-record-id", "content-length"}
#: Spark's readers skip files with this start, so archives are not seen before they count.
HIDDEN = "_"
#: Compressed bytes that are handed to zlib at a time.
STEP = 16 << 10

RECORD_SCHEMA = "path string, kind string, start long, length long, inner_start long, inner_length long, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def field_value(text: str | None) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record_bytes(record_id: str | None, url: str | None, digest: str, n_bytes: int, payload: bytes | None, refers_to: str | None, date: str) -> bytes:
    """One record: a response holding ``payload``, or a revisit of ``refers_to``."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (payload or b"")
    kind = "response" if refers_to is None else "revisit"
    head = [
        VERSION.decode(),
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{ID_PREFIX}{'' if record_id is None else field_value(record_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {field_value(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{field_value(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# --------------------------------------------------------------------------- reading


@dataclass
class Found:
    """A record, or (without headers) a quarantined gap, at ``start`` of the archive's bytes; a
    gap inside a member has its place among the inflated bytes too."""

    start: int
    length: int
    reason: str | None = None
    headers: dict[str, str] | None = None
    block: bytes = b""
    inner_start: int | None = None
    inner_length: int | None = None


class Damaged(Exception):
    """A check failed.  ``inflated``: what a broken member gave before the damage was met."""

    def __init__(self, reason: str, inflated: bytes = b""):
        super().__init__(reason)
        self.inflated = inflated


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; Damaged if any check fails."""
    if not re.match(rb"WARC/1\.\d+\r\n", data[at : at + 16]):
        raise Damaged("version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers")
    headers: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("headers")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not headers.keys() >= NEEDED_FIELDS or not re.fullmatch(r"\d{1,15}", headers["content-length"]):
        raise Damaged("headers")
    stop = end + 4 + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record end")
    block = data[end + 4 : stop]
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != base32_sha1(block):
        raise Damaged("block digest")
    return headers, block, stop + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The member at ``at`` and its end; Damaged if it is broken or cut off."""
    if data[at : at + 3] != GZIP_START:
        raise Damaged("member header")
    z, view, out, k = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not z.eof and k < len(data):  # in steps: a member leaves the rest of its step unread
            out.append(z.decompress(view[k : k + STEP]))
            k += STEP
    except zlib.error as e:
        raise Damaged("member", before_damage(data, at)) from e
    if not z.eof:
        raise Damaged("member cut off", b"".join(out))
    return b"".join(out), min(k, len(data)) - len(z.unused_data)


def before_damage(data: bytes, at: int) -> bytes:
    """All that the broken member at ``at`` gives up to the byte at which zlib fails."""
    z, out, k, step = zlib.decompressobj(31), [], at, STEP
    while step and k < len(data):
        saved = z.copy()
        try:
            out.append(z.decompress(data[k : k + step]))
            k += step
        except zlib.error:
            z, step = saved, step // 2
    return b"".join(out)


def records_in(inner: bytes, digest: bool) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """(start, length, headers, block) of the records among a member's inflated bytes, and
    (start, length, None, reason) of what lies between them.  ``digest``: only records with a
    block digest count."""
    at, gap, reason = 0, -1, b""
    while at < len(inner):
        try:
            headers, block, end = parse_record(inner, at)
            if digest and not headers.get("warc-block-digest", "").startswith("sha1:"):
                raise Damaged("no block digest")
        except Damaged as e:
            if gap < 0:
                gap, reason = at, str(e).encode()
            at = inner.find(b"WARC/1.", at + 1)
            at = len(inner) if at < 0 else at
            continue
        if gap >= 0:
            yield gap, at - gap, None, reason
            gap = -1
        yield at, end - at, headers, block
        at = end
    if gap >= 0:
        yield gap, len(inner) - gap, None, reason


def read_at(data: bytes, at: int) -> tuple[list[tuple[int, int, dict[str, str] | None, bytes]], int]:
    """What ``records_in`` finds in the member, or the one record, at ``at``, and the end; Damaged
    if nothing there counts."""
    if data[at : at + 3] != GZIP_START:
        headers, block, end = parse_record(data, at)
        return [(0, end - at, headers, block)], end
    inner, end = inflate(data, at)
    found = list(records_in(inner, digest=False))
    if found and all(headers is None for _, _, headers, _ in found):
        raise Damaged(found[0][3].decode())
    return found, end


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive that pass their checks, and the gaps between them.

    Either kind of archive may turn into the other after damage: both starts are looked for,
    from the byte after a failed one on, as broken data may run on into the next member.  A
    record that a broken member gave and that is met again there counts once."""
    starts = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
    at, gap, reason = 0, -1, ""
    saved: list[tuple[int, int, dict[str, str] | None, bytes]] = []  # from the broken member that the gap begins with
    known: list[tuple[dict[str, str], bytes]] = []  # its records

    def close(end: int) -> Iterator[Found]:
        lost = [x for x in saved if x[2] is None] or [(None, None, None, b"")]
        for start, length, _, _ in lost:
            yield Found(gap, end - gap, reason, inner_start=start, inner_length=length)
        for start, length, headers, block in saved:
            if headers is not None:
                yield Found(gap, end - gap, f"from a damaged member: {reason}", headers, block, start, length)

    while at < len(data):
        try:
            found, end = read_at(data, at)
        except Damaged as e:
            kept = list(records_in(e.inflated, digest=True))
            if any(headers is not None for _, _, headers, _ in kept):
                if gap >= 0:
                    yield from close(at)
                gap, reason, saved = at, str(e), kept
                known = [(headers, block) for _, _, headers, block in kept if headers is not None]
                if len(known) == len(kept):
                    saved.append((len(e.inflated), 0, None, b""))  # the damage follows the last record
            elif gap < 0:
                gap, reason, saved = at, str(e), []
            following = starts.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap >= 0:
            yield from close(at)
            gap = -1
        for start, length, headers, block in found:
            if headers is None:
                yield Found(at, end - at, block.decode(), inner_start=start, inner_length=length)
            elif (headers, block) in known:
                known.remove((headers, block))
                yield Found(at, end - at, "read already", inner_start=start, inner_length=length)
            else:
                yield Found(at, end - at, headers=headers, block=block)
        at = end
    if gap >= 0:
        yield from close(len(data))


def bare_id(uri: str | None) -> str | None:
    inner = (uri or "").strip("<>").removeprefix(ID_PREFIX)
    return inner or None


def described(path: str, f: Found) -> tuple:
    place = (f.start, f.length, f.inner_start, f.inner_length)
    if f.headers is None:
        return (path, "gap", *place, f.reason, *[None] * 7)
    h = f.headers
    http, found, payload = f.block.partition(b"\r\n\r\n")
    is_http = h.get("content-type", "").startswith("application/http") and bool(found)
    payload = payload if is_http else f.block
    told = h.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = h["warc-type"] == "revisit"
    if not revisit and told and told != base32_sha1(payload):
        return (path, "gap", *place, "payload digest", *[None] * 7)
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http) if revisit and is_http else None
    n_bytes = int(length[1]) if length else None if revisit else len(payload)
    return (path, "record", *place, f.reason, h["warc-type"], bare_id(h.get("warc-record-id")), h.get("warc-target-uri"), bare_id(h.get("warc-refers-to")), told or base32_sha1(payload), n_bytes, None if revisit else payload)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of RECORD_SCHEMA: the records (``kind`` record) and quarantined gaps (gap) of the
    archives at ``path``, by a path of any store that Spark reads.  A folder without archives
    gives no rows."""
    arrow_batches(spark, 1)  # an archive at a time
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content")
    names = [x.strip().split(" ")[0] for x in RECORD_SCHEMA.split(",")]
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, *[pa.string()] * 6, pa.int64(), pa.binary()]
    size = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows: list[tuple] = []
                for f in salvage(data.as_py()):
                    row = described(name, f)
                    rows.append(row if with_payload else (*row[:-1], None))
                    if len(rows) == size:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, RECORD_SCHEMA)


# --------------------------------------------------------------------------- writing


def file_system(uri: str):  # noqa: ANN201
    """pyarrow's file system for a folder, and the folder's path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    uri = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", uri))
    return fs.FileSystem.from_uri(uri)


def write_records(rows: DataFrame, uri: str, max_bytes: int, date: str) -> DataFrame:
    """Write (id, url, digest, n_bytes, payload, refers_to) rows as archives in folder ``uri``;
    the manifest (path, records, bytes).  Runs at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = file_system(uri)
        store.create_dir(folder, recursive=True)
        records, size, done = 0, 0, []
        out, name = None, ""
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():06d}-{len(done):05d}-{task.taskAttemptId()}.warc.gz"
                    out, records, size = store.open_output_stream(f"{folder}/{HIDDEN}{name}", compression=None), 0, 0
                digest = base64.b32encode(row["digest"]).decode()
                data = member(record_bytes(row["id"], row["url"], digest, row["n_bytes"], row["payload"], row["refers_to"], date))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= max_bytes:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["name", "records", "bytes"])

    arrow_batches(rows.sparkSession, 64)
    return commit(cut(rows.mapInArrow(run, "name string, records long, bytes long")), uri)


def commit(written: DataFrame, uri: str) -> DataFrame:
    """Show the archives (name, records, bytes) that count under their names; (path, records,
    bytes).  May run again after a failure, and in several tasks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(uri)
        for b in batches:
            paths = []
            for name in b.column("name").to_pylist():
                hidden, final = f"{folder}/{HIDDEN}{name}", f"{folder}/{name}"
                try:
                    store.move(hidden, final)
                except OSError:
                    if not store.get_file_info(final).is_file:
                        raise
                paths.append(final)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), b.column("records"), b.column("bytes")], ["path", "records", "bytes"])

    return cut(written.mapInArrow(run, "path string, records long, bytes long"))


def write_pages(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, max_bytes: int = MAX_ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row of ``pages`` to archives in ``uri``; returns the manifest.

    Of rows with equal payloads of ``min_bytes`` or more the one with the smallest id is a
    response, the others are revisits of it; rows that share id and payload are all
    responses, as are all smaller payloads.  Null html is an empty payload, a null url an
    empty field; a null id is an empty one and never the smallest."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("sha", F.sha2("payload", 256))
    keyed = cut(rows.select("id", "sha", "n_bytes"))
    groups = cut(keyed.filter(F.col("n_bytes") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    again = join_groups(keyed.select("id", "sha"), groups, "sha", "n", keyed.count()).filter(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    again = cut(again.select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), F.col("first").cast("string").alias("refers_to")).distinct())
    bits = filter_bits(again.count(), 16)
    slot = lambda i, s: slot_of(F.concat_ws("/", F.col(i).cast("string"), F.col(s)), bits)
    maps = cut(pack_slots(again.select(slot("rid", "rsha").alias("slot")), "slot"))
    marked = probe(rows.withColumn("slot", slot("id", "sha")), maps, "slot", "maybe").drop("slot")
    alone = marked.filter(~F.col("maybe")).withColumn("refers_to", F.lit(None).cast("string"))
    same = F.col("id").eqNullSafe(F.col("rid")) & (F.col("sha") == F.col("rsha"))
    doubtful = marked.filter("maybe").join(again, same, "left").drop("rid", "rsha")
    out = alone.unionByName(doubtful).select(
        F.col("id").cast("string").alias("id"),
        "url",
        F.unhex(F.sha1("payload")).alias("digest"),
        "n_bytes",
        F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
        "refers_to",
    )
    return write_records(out, uri, max_bytes, date)


def checked(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """The records of the archives in ``uri`` without payloads.  Gaps are logged to ``uri``-gaps, a
    Parquet table; raises if fewer or more records are read than the manifest has."""
    found = table(read_archives(spark, uri, with_payload=False))
    counts = found.agg(F.count(F.when(F.col("kind") == "record", 1)).alias("n"), F.count(F.when(F.col("kind") == "gap", 1)).alias("gaps")).first()
    written = manifest.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"]
    if counts["gaps"]:
        found.filter("kind = 'gap'").select("path", "start", "length", "inner_start", "inner_length", "reason").write.mode("overwrite").parquet(f"{uri}-gaps")
        log.warning("%d quarantined gaps in %s, listed in %s-gaps", counts["gaps"], uri, uri)
    if counts["n"] != written:
        raise RuntimeError(f"{uri}: {written} records written, {counts['n']} read, {counts['gaps']} gaps")
    return found.filter("kind = 'record'")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    read = checked(spark, uri, write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), uri))
    return read.select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY payload) AS first,
         [('0x' || substr(h, 5 * i + 1, 5))::INT FOR i IN range(8)] AS parts
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) % 32 + 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

"""WARC archives: a writer with revisit records, and a reader that salvages what lies behind damage.

Writing. Each record is one gzip member. Members go through Spark's own text writer, so a lost task is simply run again
and its half-written file never shows; an empty gzip member serves as the line separator, which leaves a valid stream.
Rows with equal payloads (SHA-1 and length) of at least `min_bytes` become one response, that of the largest key, and
revisits of it.

Reading. At each place of a file stands a gzip member or a plain record, whatever bytes payloads hold. After a member that doesn't
inflate or holds no record, or a record whose header, length, end, block digest or payload digest is wrong, the reader tries
every later gzip magic and version line until one holds a whole record, goes on there, and logs the bytes between as
quarantined. Every file is parsed once, as bytes, by one task: the writer bounds files by `file_bytes` (as an average, the
largest record on top), and Spark reads no file above 2 GB this way, so larger foreign archives must be split first.
Records and gaps are one table on disk.

Defined results: a null payload is the empty payload. Rows that repeat both key and payload of the response are responses
too. A null key is written as an empty field and read back as null; it counts as smaller than every other key. A null
address is written as the `urn:` of the key. No rows give an archive without records. Extra columns aren't written.
A record whose id isn't this writer's has page_id null (record_id has it as it stands); one without type or length is
quarantined; a revisit that repeats no HTTP length, and a record of any other type, has the length of what payload it holds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, delete, fresh_path, written

VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
FIELDS = "page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, target_uri string, record_id string"
FOUND = f"file string, start bigint, stop bigint, reason string, {FIELDS}"
NAMES = [x.split()[0] for x in FOUND.split(", ")]
KINDS = [pa.int64() if x.endswith("bigint") else pa.string() for x in FOUND.split(", ")]


def member(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def urn(key: int | None) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def key_of(value: str) -> int | None:
    own = re.fullmatch("<?urn:page:(-?[0-9]+)>?", value)
    return int(own[1]) if own else None


def digest_of(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(key: int | None, uri: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    http = HTTP % len(payload)
    body = http if revisit else http + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(key)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((uri or urn(key)).split())}",
        f"WARC-Payload-Digest: {digest_of(payload)}",
        f"WARC-Block-Digest: {digest_of(body)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(body)}"]).encode("utf-8")
    return VERSION + head + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = 32 << 20, spoil: Callable[[int | None, bytes], bytes] | None = None) -> None:
    """pages: page_id, url, html. spoil: what to make of a page's member, for archives that are damaged on purpose."""
    size = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)))).first()[0] or 0
    records_per_file = max(1, int(file_bytes // (size + 1000)))  # before compression, with some room for headers
    own = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")
    ).withColumns({"sha": F.sha1(F.encode("html", "utf-8")), "size": F.octet_length("html")})
    lead = own.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    lead = lead.where("n > 1").drop("n")
    rows = own.join(lead, ["sha", "size"], "left").select(
        "page_id",
        "url",
        "html",
        "first_id",
        (F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"),
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 2):
            cols = [c.to_pylist() for c in b.columns]
            out = [member(record(k, u, h.encode("utf-8"), again, first if again else None)) for k, u, h, first, again in zip(*cols, strict=True)]
            out = out if spoil is None else [spoil(k, m) for k, m in zip(cols[0], out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    end = member(b"").decode("latin-1")
    out = rows.mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).text(path)


class Damage(Exception):
    pass


def inflate(data: bytes, start: int, step: int = 1 << 15) -> tuple[bytes, int]:
    """Content and end of the gzip member that starts there; zlib.error if it isn't whole."""
    d, out, at, view = zlib.decompressobj(31), [], start, memoryview(data)
    while not d.eof:
        if at >= len(data):
            raise zlib.error("cut off")
        out.append(d.decompress(view[at : at + step]))
        at = min(at + step, len(data))
    return b"".join(out), at - len(d.unused_data)


def parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """The record that starts at `at`: where it ends, its header fields, its block. Damage if any check fails."""
    if not data.startswith(b"WARC/1.", at):
        raise Damage("no version line")
    stop = data.find(b"\r\n\r\n", at, at + MOST_HEADER)
    if stop < 0:
        raise Damage("header without end")
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line without colon")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit():
        raise Damage("no length")
    if not fields.get("warc-type"):
        raise Damage("no type")
    begin = stop + 4
    end = begin + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damage("record doesn't end where its length says")
    block = data[begin:end]
    said = fields.get("warc-block-digest", "")
    if said.startswith("sha1:") and said != digest_of(block):
        raise Damage("wrong block digest")
    said = fields.get("warc-payload-digest", "")
    if said.startswith("sha1:") and fields["warc-type"] != "revisit" and said != digest_of(payload_of(fields, block)):
        raise Damage("wrong payload digest")
    return end + 4, fields, block


MOST_HEADER = 1 << 16


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def record_at(data: bytes, at: int) -> tuple[int, list[tuple[dict[str, str], bytes]], str]:
    """What stands at `at`, a gzip member or a plain record: its end, its records, and why some of a member were lost, if so."""
    if not data.startswith(MAGIC, at):
        end, fields, block = parse(data, at)
        return end, [(fields, block)], ""
    try:
        content, end = inflate(data, at)
    except zlib.error:
        raise Damage("no valid gzip member") from None
    found, inner, why = [], 0, ""
    while inner < len(content):
        try:
            inner, fields, block = parse(content, inner)
            found.append((fields, block))
        except Damage as damage:
            why = why or str(damage)
            inner = content.find(b"WARC/1.", inner + 1)
            inner = len(content) if inner < 0 else inner
    if content and not found:
        raise Damage(why)
    return end, found, why


def salvage(data: bytes) -> tuple[list[tuple[dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """Records of one file, and the gaps (start, end, reason) in bytes of the file: what gave no record, or not all of a member's."""
    found, gaps = [], []
    at = lost = 0
    why = ""
    while at < len(data):
        try:
            end, records, inner = record_at(data, at)
        except Damage as damage:
            why = why or str(damage)
            then = [x for x in (data.find(MAGIC, at + 1), data.find(b"WARC/1.", at + 1)) if x >= 0]
            at = min(then, default=len(data))
            continue
        if lost < at:
            gaps.append((lost, at, why))
        if inner:
            gaps.append((at, end, inner))
        found += records
        at = lost = end
        why = ""
    if lost < len(data):
        gaps.append((lost, len(data), why))
    return found, gaps


def page_row(fields: dict[str, str], block: bytes) -> tuple:
    """A row of FIELDS. A revisit carries no payload: its length is that of the HTTP header it repeats, if there is one."""
    payload = payload_of(fields, block)
    size, digest = len(payload), fields.get("warc-payload-digest", "")
    revisit = fields["warc-type"] == "revisit"
    if revisit:
        said = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", block)
        size = int(said[1]) if said else size
    elif not digest.startswith("sha1:"):
        digest = digest_of(payload)
    refers = key_of(fields.get("warc-refers-to", "")) if revisit else None
    own = fields.get("warc-record-id", "")
    return key_of(own), fields["warc-type"], size, digest.removeprefix("sha1:") or None, refers, fields.get("warc-target-uri"), own or None


def read_archive(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined gaps: file, start, stop, reason) of all files of a folder: two views of one table."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                records, gaps = salvage(data.as_py())
                found = [(name, None, None, None, *page_row(*x)) for x in records] + [(name, *x, *[None] * 7) for x in gaps]
                for i in range(0, len(found), 1000):
                    cols = [pa.array(c, t) for c, t in zip(zip(*found[i : i + 1000], strict=True), KINDS, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, NAMES)

    found = written(files.mapInArrow(rows, FOUND), "archive")
    return found.where("reason is null").drop("start", "stop", "reason"), found.where("reason is not null").select("file", "start", "stop", "reason")


def op8_warc_salvage(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records, _ = read_archive(spark, path)
    delete(spark, path)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def spoilt(page_id: int | None, data: bytes) -> bytes:
    """Every fiftieth member with a byte in its middle turned over."""
    if page_id is None or page_id % 50 != 7:
        return data
    i = len(data) // 2
    return data[:i] + bytes([data[i] ^ 0xFF]) + data[i + 1 :]


def warc_salvage_gaps(spark, sf_dir: str) -> DataFrame:
    """Of an archive damaged on purpose, which pages come back; what lies behind a damaged member does."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = fresh_path(spark, "warc")
    write_archive(pages, path, spoil=spoilt)
    records, _ = read_archive(spark, path)
    delete(spark, path)
    back = records.where(F.col("page_id").isNotNull()).select("page_id", F.lit(True).alias("recovered"))
    return pages.select("page_id").join(back, "page_id", "left").select("page_id", F.coalesce("recovered", F.lit(False)).alias("recovered"))


SALVAGED = "select page_id, page_id % 50 <> 7 as recovered from pages"

ORACLE = r"""
with p as (select page_id, coalesce(html, '') as html, encode(coalesce(html, ''))::blob as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(html) as hex from p),
f as (select *, max(page_id) over (partition by hex, payload_bytes) as first_id from d)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, 5 * k + 1, 5))::bigint >> s) & 31) + 1)::int, 1)), '')), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from f
"""

"""WARC archives: a writer of one gzip member per record, and a reader that salvages damaged archives.

The reader checks every record (gzip CRC, version line, headers, Content-Length, closing line breaks, block digest).
Where a check fails it looks for the next place at which a whole valid record begins, either a gzip member or a
version line, goes on from there, and reports the bytes between as a quarantined gap. The same is done inside the
content of a member, as far as it can be inflated.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.catalog.base import table
from foliant.llm.base import in_batches, picked, query
from foliant.plans.sizing import scratch_path

if TYPE_CHECKING:
    import pyarrow as pa

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"(?:\A|(?<=\n))WARC/1\.\d\r?\n")
LINE = b"WARC/1."
DIGESTS = ("sha1", "sha256", "md5")
FEED = 1 << 15
#: An empty gzip member. It stands where Spark's text writer puts a line break, so that archives stay valid gzip.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ROW = (
    "archive string, kind string, start bigint, end bigint, inner_start bigint, inner_end bigint, reason string, warc_type string, record_id string, "
    "target_uri string, refers_to string, payload_digest string, headers map<string,string>, payload binary"
)


class Found(NamedTuple):
    """A record, or a gap if ``headers`` is None; ``start`` and ``end`` are bytes of the archive.

    In a gzip member these are the member's, and ``inner_start`` and ``inner_end`` are bytes of its content. A record
    with a reason is whole, but lies in a damaged member and has no digest that could vouch for it.
    """

    start: int
    end: int
    headers: dict[str, str] | None
    block: bytes
    reason: str
    inner_start: int | None = None
    inner_end: int | None = None


class Bad(ValueError):
    """A record that fails a check."""


# -- reading one archive -----------------------------------------------------------------------------------------------


class Member(NamedTuple):
    """What a gzip member holds, up to its end or its damage."""

    content: bytes
    end: int  # of the member, or of what could be inflated
    reason: str  # of the damage
    marks: list[tuple[int, int]]  # of a damaged one: bytes of content that were out, and the place in the archive

    def read_for(self, inner: int) -> int:
        """Place in the archive by which so many bytes of content were out."""
        return next((raw for out, raw in self.marks if out >= inner), self.end)

    def until(self, raw: int) -> Member:
        """What came out before a place in the archive."""
        out = max((out for out, at in self.marks if at <= raw), default=0)
        return self._replace(content=self.content[:out])


def _inflate(data: memoryview, start: int, damaged_at: int | None = None) -> Member:
    """The gzip member at ``start``; of a damaged one, all that comes out before the damage.

    zlib keeps back what it made of the piece that raises, so a damaged member is read again in small pieces.
    """
    member, parts, marks, at, out = zlib.decompressobj(31), [], [], start, 0
    while not member.eof:
        if at >= len(data):
            if damaged_at is None:
                return _inflate(data, start, at)
            return Member(b"".join(parts), len(data), "gzip member is cut off", marks)
        step = FEED if damaged_at is None else 64 if at + FEED < damaged_at else 1
        try:
            parts.append(member.decompress(data[at : at + step]))
        except zlib.error as error:
            if damaged_at is None:
                return _inflate(data, start, min(at + FEED, len(data)))
            return Member(b"".join(parts), at, f"gzip: {error}", marks)
        at += step
        if damaged_at is not None and parts[-1]:
            out += len(parts[-1])
            marks.append((out, min(at, len(data))))
    return Member(b"".join(parts), min(at, len(data)) - len(member.unused_data), "", marks)


def _digest_holds(block: bytes, stated: str) -> bool:
    name, _, value = stated.partition(":")
    if name.lower() not in DIGESTS:
        return True
    made = hashlib.new(name.lower(), block)
    return value.lower() == made.hexdigest() or value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


def _record(data: bytes | memoryview, start: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the uncompressed record at ``start``."""
    head_end, width = -1, 4
    window = 1 << 12
    while head_end < 0 and window < 1 << 22:
        head = bytes(data[start : start + window])
        if not VERSION.match(head):
            raise Bad("no version line")
        match = re.search(rb"\r?\n\r?\n", head)
        if match:
            head_end, width = match.start(), match.end() - match.start()
        elif start + window >= len(data):
            raise Bad("headers are cut off")
        window *= 4
    if head_end < 0:
        raise Bad("headers do not end")
    headers: dict[str, str] = {}
    for line in head[:head_end].decode("utf-8", "replace").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Bad("header line without colon")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Bad("no valid Content-Length")
    begin = start + head_end + width
    end = begin + int(length)
    if end > len(data):
        raise Bad("block is cut off")
    closing = re.match(rb"\r?\n\r?\n", bytes(data[end : end + 4]))
    if not closing:
        raise Bad("no line breaks after the block")
    block = bytes(data[begin:end])
    if "warc-block-digest" in headers and not _digest_holds(block, headers["warc-block-digest"]):
        raise Bad("block digest differs")
    return headers, block, end + closing.end()


def _vouched(member: Member, headers: dict[str, str], end: int) -> bool | None:
    """Whether a whole record of a member is sound; None if it only looks so.

    Without the member's CRC and a digest of its own, all that speaks for a record is that another begins at its end.
    """
    if not member.reason or headers.get("warc-block-digest", "").partition(":")[0].lower() in DIGESTS:
        return True
    after = member.content[end : end + len(LINE)]
    return None if after and LINE.startswith(after) else False


def _inside(member: Member, start: int) -> list[Found]:
    """Records and gaps of a member's content."""
    text, found, at = member.content, [], 0

    def gap(begin: int, end: int, reason: str) -> None:
        if found and found[-1].headers is None and found[-1].inner_end == begin:
            begin, reason = found[-1].inner_start, found.pop().reason
        found.append(Found(start, member.end, None, b"", reason, begin, end))

    while at < len(text):
        try:
            headers, block, end = _record(text, at)
        except Bad as error:
            resumed = at + 1
            while (resumed := _next_line(text, resumed)) < len(text):
                try:
                    _record(text, resumed)
                    break
                except Bad:
                    resumed += 1
            gap(at, resumed, member.reason if member.reason and resumed == len(text) else str(error))
            at = resumed
            continue
        sound = _vouched(member, headers, end)
        if sound is False:
            gap(at, end, member.reason)
        else:
            found.append(Found(start, member.end, headers, block, "" if sound else f"not verified: {member.reason}", at, end))
        at = end
    if member.reason and not any(x.reason for x in found):  # all came back, yet the member is damaged
        gap(at, at, member.reason)
    return found


def _found_at(data: bytes, view: memoryview, start: int) -> tuple[list[Found], Member | None]:
    """What the member, or the one plain record, at ``start`` holds; nothing for an empty member."""
    if not data.startswith(MAGIC, start):
        headers, block, end = _record(view, start)
        return [Found(start, end, headers, block, "")], None
    member = _inflate(view, start)
    found = _inside(member, start)
    if not any(x.headers for x in found) and (member.reason or found):
        raise Bad(member.reason or found[0].reason)
    return found, member


def _resumed(data: bytes, view: memoryview, at: int, lines_from: int = 0) -> int:
    """First place from ``at`` on where something valid begins, else the end. Plain records count from ``lines_from`` on."""
    while (at := _next_start(data, at)) < len(data):
        if at >= lines_from or data.startswith(MAGIC, at):
            try:
                _found_at(data, view, at)
                return at
            except Bad:
                pass
        at += 1
    return at


def salvage(data: bytes) -> Iterator[Found]:
    """All valid records of an archive, and a gap for every stretch of bytes that belongs to none."""
    view, at, size = memoryview(data), 0, len(data)
    while at < size:
        try:
            found, member = _found_at(data, view, at)
        except Bad as error:
            resumed = _resumed(data, view, at + 1)
            yield Found(at, resumed, None, b"", str(error))
            at = resumed
            continue
        end = member.end if member else found[-1].end
        if member and member.reason:
            # Where it ends is not known. Damage may also have drawn the members after it into its content: the next
            # member is looked for from its start on, the next plain record behind those that came out of it.
            last = max(x.inner_end for x in found if x.headers)
            end = _resumed(data, view, at + 1, member.read_for(last))
            if end < member.end:
                found = _inside(member.until(end), at)
        yield from (x._replace(start=at, end=end) for x in found)
        at = end


def _next_line(data: bytes, at: int) -> int:
    """First place from ``at`` on where a version line begins, else the end."""
    # A line's start is seen by the line break before it, so the search begins one byte earlier.
    line = VERSION.search(data, max(at - 1, 0))
    while line and line.start() < at:
        line = VERSION.search(data, line.end() - 1)
    return line.start() if line else len(data)


def _next_start(data: bytes, at: int) -> int:
    """First place from ``at`` on that looks like a member or a version line, else the end."""
    member = data.find(MAGIC, at)
    line = _next_line(data, at)
    return line if member < 0 else min(member, line)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP head, if it holds an HTTP message."""
    if headers.get("content-type", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    text, number = pa.string(), pa.int64()
    schema = pa.schema(
        [("archive", text), ("kind", text), ("start", number), ("end", number), ("inner_start", number), ("inner_end", number), ("reason", text), ("warc_type", text),
         ("record_id", text), ("target_uri", text), ("refers_to", text), ("payload_digest", text),
         ("headers", pa.map_(text, text)), ("payload", pa.binary())]
    )

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name = path.as_py()
                for x in salvage(content.as_py()):
                    place = (x.start, x.end, x.inner_start, x.inner_end)
                    if x.headers is None:
                        yield name, "gap", *place, x.reason, None, None, None, None, None, None, None
                        continue
                    h = x.headers
                    yield (
                        name, "unverified" if x.reason else "record", *place, x.reason or None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"),
                        h.get("warc-refers-to"), h.get("warc-payload-digest"), list(h.items()), payload_of(h, x.block),
                    )

    yield from in_batches(rows(), schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of the archives (plain, or gzip with any number of records in a member) under ``path``.

    One row per record (kind ``record``) or quarantined stretch of bytes (kind ``gap``: start, end, reason). Rows from
    gzip members have the member's start and end, and inner_start and inner_end in its content. Whole records of a
    damaged member that have no digest to vouch for them are of kind ``unverified``, with the damage as reason. An archive
    is one value of a task, so archives should be written in moderate sizes, as ``write_warc`` does. Empty files give no
    rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(_reading, ROW)


# -- writing -----------------------------------------------------------------------------------------------------------


def _header_value(value: Column) -> Column:
    """Control characters and line breaks would end the header; they become blanks."""
    return F.regexp_replace(value, r"[\x00-\x1F\x7F]", " ")


def _packing(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def member(head: str, date: str, payload: bytes, revisit: bool) -> bytes:
        block = HTTP_HEAD if revisit else HTTP_HEAD + payload
        digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
        text = (
            f"WARC/1.1\r\n{head}WARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\n"
            f"WARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n"
        )
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        schema = pa.schema([("member", pa.binary())])
        rows = (
            (member(head.as_py(), date.as_py(), payload.as_py(), revisit.as_py()),)
            for b in batches
            for head, date, payload, revisit in zip(*(b.column(i) for i in range(4)), strict=True)
        )
        yield from in_batches(rows, schema)

    return pack


def marked_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Add payload_digest and refers_to to (page_id, url, payload): where a record repeats the payload of another.

    Of equal payloads of ``least_bytes`` or more, the smallest page_id holds the payload; the others refer to it. Rows
    without page_id refer to it as well. Repeated rows with the smallest page_id all hold the payload.
    """
    hashed = pages.withColumn("payload_digest", F.sha2("payload", 256))
    firsts = (
        hashed.where(F.octet_length("payload") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first_id IS NOT NULL")
        .select("payload_digest", "first_id")
    )
    refers = F.expr("CASE WHEN NOT (page_id <=> first_id) THEN first_id END")
    return hashed.join(firsts, "payload_digest", "left").withColumn("refers_to", refers).drop("first_id")


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 100,
    date: str = "1970-01-01T00:00:00Z",
    level: int = 4,
) -> None:
    """Write one record per row, a gzip member each; repeated payloads become revisit records.

    A null payload is empty, a null URL is left out, a null id leaves a record that names none. ``date`` is the date of
    all records, so that a task that runs twice writes the same bytes.
    """
    slim = picked(pages, page_id=id_col, url=url_col, payload=payload_col)
    slim = slim.withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    marked = marked_revisits(slim, least_bytes)
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", _header_value(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("refers_to")))),
    )
    # A revisit does not carry the payload any further.
    payload = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    members = marked.select(head.alias("head"), F.lit(date).alias("date"), payload.alias("payload"), revisit.alias("revisit"))
    (
        members.mapInArrow(_packing(level), "member binary")
        .select(F.col("member").cast("string"))  # the text writer puts out bytes as they are
        .write.mode("errorifexists")
        .option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .text(path)
    )


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that ``write_warc`` wrote.

    The payload of a revisit is that of the record it refers to; size and digest come from the payload that was read.
    """
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).cast("bigint")
    read = records.where("kind = 'record'").select(
        F.expr("try_cast(nullif(regexp_extract(record_id, '<urn:page:(-?[0-9]+)>', 1), '') AS BIGINT)").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(F.col("warc_type") == "revisit", number("refers_to")).alias("refers_to"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("stated"),
    )
    full = read.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    held = (
        full.where("page_id IS NOT NULL")
        .groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"))
        .agg(F.first("payload_bytes").alias("held_bytes"))
    )
    revisits = (
        read.where("record_type = 'revisit'")
        .join(held, ["refers_to", "stated"], "left")
        .select("page_id", F.col("held_bytes").alias("payload_bytes"), F.col("stated").alias("payload_digest"), "record_type", "refers_to")
    )
    return full.unionByName(revisits)


OP2_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM m"""


@query("op2_warc_salvage", OP2_SQL)
def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), archives)
    return page_records(read_warc(spark, archives))

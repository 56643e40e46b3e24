"""Web archives whose repeated payloads are revisit records.

`resolve` decides from headers alone: rows of a key, a payload digest and a length are shuffled by digest, the
record with the largest key of each digest is the response and the others revisit it. `write` writes one record
a row with fresh headers, `read` parses archives into rows again, and `deduplicate` does all three from archives
to archives: revisit records that come in are joined to the originals by digest like all others.

A digest with very many records is met in `SALTS` parts: each part has its own largest key, the parts' keys make
the digest's, and records look up their own part. Payloads are shuffled once, to meet their headers.

Archives are gzip text files that Spark writes, so they lie on any file system that Spark knows and a lost
executor's files are written again and committed once. Reading cuts at the line that begins a record and joins the
pieces again until a record has its Content-Length, so payloads may hold anything, that line as well. A gzip file
is one task's; only the record at hand is in memory. Archives of others are read too, of one gzip member or of
one a record.

Null payloads are empty, and empty ones are equal to each other. Keys compare by their type; null keys are the
smallest. Records that tie for the largest key of their payload (repeated rows) are all responses. Payloads smaller than
`least` bytes are all responses. Null or odd addresses: none is written for null, line breaks and blanks are
escaped. Other columns, of any names, are not read. An empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _delete, exact, shared_folder

SALTS = 64
#: The archives' date unless the caller gives one: the present time is not read, so reruns agree.
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_URN = "urn:x-record:"
_END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: each five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def resolve(headers: DataFrame, key: str = "key", digest: str = "payload_digest", size: str = "payload_bytes", least: int = 0, held: str | None = None) -> DataFrame:
    """Adds record_type and refers_to, the largest key of the same payload; null for responses.

    held: a boolean column, false for records whose payload is not with them: these are revisits, and no response is
    chosen among them; refers_to is null where no record holds the payload.
    """
    here = F.lit(True) if held is None else F.coalesce(exact(held), F.lit(False))
    deal = F.pmod(F.xxhash64(exact(key)), F.lit(SALTS))
    shared = ~here | (F.coalesce(exact(size), F.lit(0)) >= least)
    # what takes no part has salts of its own, which no part of a digest has
    rows = headers.withColumn("salt", F.when(shared, deal).otherwise(-1 - deal)).withColumn("here", here)
    parts = rows.filter("salt >= 0").groupBy(exact(digest).alias("d"), F.col("salt").alias("s")).agg(F.max(F.when(F.col("here"), exact(key))).alias("k"))
    first = parts.groupBy("d").agg(F.max("k").alias("first"))
    known = parts.select("d", "s").join(first, "d")
    rows = rows.join(known, exact(digest).eqNullSafe(F.col("d")) & (F.col("salt") == F.col("s")), "left")
    revisits = F.col("s").isNotNull() & ~(F.col("here") & F.col("first").eqNullSafe(exact(key)))
    kind = F.when(revisits, "revisit").otherwise("response")
    return rows.withColumn("record_type", kind).withColumn("refers_to", F.when(revisits, F.col("first"))).drop("d", "s", "salt", "first", "here")


def _line(name: str, value: Column) -> Column:
    """One header line, nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)), F.lit(""))


def _record_id(digest: Column, key: Column) -> Column:
    """Made from payload and key, so that tasks that run twice write the same."""
    return F.concat(F.lit(f"<{_URN}"), digest, F.lit(":"), F.coalesce(F.url_encode(key.cast("string")), F.lit("")), F.lit(">"))


def record(date: str = DATE) -> Column:
    """The text of one record of columns key, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    col = F.col
    response = col("record_type") == "response"
    block = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), col("payload_bytes").cast("string"),
        F.lit(_END * 2), F.when(response, F.coalesce("payload", F.lit(""))).otherwise(F.lit("")),
    )
    address = F.regexp_replace(F.regexp_replace(F.regexp_replace(col("url").cast("string"), "\r", "%0D"), "\n", "%0A"), " ", "%20")
    head = F.concat(
        F.lit(VERSION + _END), _line("WARC-Type", col("record_type")), _line("WARC-Record-ID", _record_id(col("payload_digest"), col("key"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", address), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), col("payload_digest"))),
        _line("WARC-Refers-To", F.when(~response, _record_id(col("payload_digest"), col("refers_to")))), _line("WARC-Profile", F.when(~response, F.lit(PROFILE))),
        F.lit(f"Content-Type: application/http; msgtype=response{_END}Content-Length: "),
    )
    return F.concat(head, F.octet_length(block).cast("string"), F.lit(_END * 2), block, F.lit(_END + "\r"))  # the writer adds the last line feed


def write(records: DataFrame, path: str, date: str = DATE) -> None:
    """Writes archives to a folder of any file system that Spark knows; columns as for record()."""
    records.select(record(date).alias("value")).write.option("compression", "gzip").text(path)


_FIELD = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)\r?\n")


class _Parser:
    """Records of one file from its pieces in order; the cut between two pieces is part of the file."""

    def __init__(self, cut: bytes) -> None:
        self.cut, self.held, self.need, self.begun = cut, bytearray(), 0, False

    def add(self, piece: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
        if self.begun:
            self.held += self.cut
        self.held += piece
        self.begun = True
        while len(self.held) >= self.need:
            start = 0
            while self.held.startswith(b"\r\n", start):
                start += 2
            end = self.held.find(b"\r\n\r\n", start)
            if end < 0 or not self.held.startswith(b"WARC/", start):
                self.held.clear()  # what is left at a file's end
                self.need = 0
                return
            fields = {m[1].strip().lower(): m[2].strip() for m in _FIELD.finditer(self.held[start : end + 2].partition(b"\n")[2])}
            size = fields.get(b"content-length", b"")
            self.need = end + 4 + (int(size) if size.isdigit() else 0)
            if len(self.held) >= self.need:
                yield {bytes(k): bytes(v) for k, v in fields.items()}, bytes(self.held[end + 4 : self.need])
                del self.held[: self.need]
                self.need = 0
                if not self.held:
                    return


#: Columns of read(): payload_bytes and payload_digest are those of the whole payload, measured where it is there, else as the record states.
READ = "record_type string, record_id string, url string, date string, key string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _parsed(fields: dict[bytes, bytes], block: bytes, with_payload: bool) -> tuple:
    said = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    named = lambda urn: None if urn is None or not urn.startswith(f"<{_URN}") else unquote(urn[1:-1].rpartition(":")[2].replace("+", " ")) or None
    kind, payload, size = said(b"warc-type"), block, None
    if fields.get(b"content-type", b"").startswith(b"application/http") or block.startswith(b"HTTP/"):
        head, _, payload = block.partition(b"\r\n\r\n")
        stated = {m[1].strip().lower(): m[2].strip() for m in _FIELD.finditer(head + b"\r\n")}.get(b"content-length", b"")
        size = int(stated) if stated.isdigit() else None
    digest = (said(b"warc-payload-digest") or "").removeprefix("sha1:") or None
    if kind != "revisit":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324
    ids = said(b"warc-record-id"), said(b"warc-refers-to")
    return kind, ids[0], said(b"warc-target-uri"), said(b"warc-date"), named(ids[0]), named(ids[1]), size, digest, payload if with_payload and kind != "revisit" else None


_TYPES = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]
_NAMES = [c.split()[0] for c in READ.split(", ")]
_OUT_BYTES = 16_000_000


def read(spark: SparkSession, path: str, with_payload: bool = True, version: str = VERSION) -> DataFrame:
    """One row a record of the gzip archives below path, all of one version; with_payload=False leaves the payloads behind."""
    cut = _END * 2 + version + _END
    pieces = spark.read.option("lineSep", cut).text(path).select("_metadata.file_path", F.col("value").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, at, out, size = _Parser(cut.encode()), None, [], 0
        for batch in batches:
            for where, piece in zip(batch.column(0), batch.column(1), strict=True):
                if where.as_py() != at:
                    parser, at = _Parser(cut.encode()), where.as_py()
                for fields, block in parser.add(piece.as_py()):
                    out.append(_parsed(fields, block, with_payload))
                    size += 500 + (len(block) if with_payload else 0)
                if size > _OUT_BYTES:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    return pieces.mapInArrow(run, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def new_folder(spark: SparkSession) -> str:
    """A folder for archives that all executors see; it goes when the session's process ends."""
    path = f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    _delete(spark, path, now=False)
    return path


def archive(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = DATE) -> None:
    """Writes pages as archives: one response for each payload, revisits for the others."""
    rows = pages.select(exact(key_col).alias("key"), exact(url_col).alias("url"), F.coalesce(exact(payload_col).cast("string"), F.lit("")).alias("payload"))
    sized = rows.select("key", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload").cast("binary")).alias("payload_digest"))
    revisits = resolve(sized.distinct(), least=least).filter("record_type = 'revisit'").select(F.col("key").alias("its"), F.col("payload_digest").alias("of"), "refers_to")
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload").cast("binary"))})
    both = rows.join(revisits, F.col("key").eqNullSafe(F.col("its")) & (F.col("payload_digest") == F.col("of")), "left")
    write(both.withColumn("record_type", F.when(F.col("of").isNotNull(), "revisit").otherwise("response")), path, date)


def deduplicate(spark: SparkSession, source: str, target: str, least: int = 0, date: str = DATE, version: str = VERSION) -> None:
    """Archives to archives: of equal payloads the record of the largest name stays a response, the others revisit it.

    Names are the keys of archives written here, as text, else the record ids. A revisit whose payload is in no archive here
    is written as a revisit of the record it named. Records of other types are left behind.
    """
    records = read(spark, source, version=version).filter(F.col("record_type").isin("response", "revisit"))
    names = records.select(
        F.coalesce("key", "record_id").alias("key"), "url", F.col("payload").cast("string").alias("payload"), F.coalesce("payload_bytes", F.lit(0)).alias("payload_bytes"), "payload_digest",
        (F.col("record_type") == "response").alias("held"), F.col("refers_to").alias("named"),
    )
    chosen = resolve(names.select("key", "payload_bytes", "payload_digest", "held").distinct(), least=least, held="held")
    chosen = chosen.select(F.col("key").alias("its"), F.col("payload_digest").alias("of"), F.col("held").alias("so"), "record_type", "refers_to").distinct()
    same = F.col("key").eqNullSafe(F.col("its")) & F.col("payload_digest").eqNullSafe(F.col("of")) & (F.col("held") == F.col("so"))
    write(names.join(chosen, same).withColumn("refers_to", F.coalesce("refers_to", "named")), target, date)

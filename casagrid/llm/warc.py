"""WARC archives compressed with Zstandard: a frame for each record, a dictionary in the leading skippable frame.

Archives are written by Spark's text writer, a frame a line, so that the folder is committed as a whole and the path may
be any that Spark knows. The line separator is an empty skippable frame, which every decoder passes over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casagrid.llm.shared import shared_path, stored

# Fixed values of the two formats.
FRAME, DICTIONARY, TRAINED = 0xFD2FB528, 0x184D2A5D, 0xEC30A437
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\0\0\0\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"

#: The dictionary is trained on the first ``SAMPLE_CHARS`` characters of at most ``SAMPLE_ROWS`` pages.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 1 << 14, 1 << 16
ARCHIVE_BYTES = 16 << 20
MOST_RECORD_BYTES = 1 << 31
#: Groups with more than this share of all rows, a thousand at most, meet their rows by broadcast.
HOT_SHARE = 1000
RECORD = "id string, type string, uri string, date string, payload binary, payload_bytes long, payload_digest string, refers_to string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, id: str, date: str, block: bytes, *more: tuple[str, str | None]) -> bytes:
    named = [("WARC-Type", kind), ("WARC-Record-ID", f"<{id}>"), ("WARC-Date", date), *more, ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in named if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def clean_uri(uri: str | None) -> str | None:
    """White space and control characters, which end a header, as percent codes."""
    return None if uri is None else re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), uri)


def response(id: str, uri: str | None, date: str, payload: bytes, sha1: str) -> bytes:
    more = ("WARC-Target-URI", uri), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1}")
    return record("response", id, date, http_head(len(payload)) + payload, *more)


def revisit(id: str, uri: str | None, date: str, n: int, sha1: str, of: str) -> bytes:
    more = ("WARC-Target-URI", uri), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Profile", PROFILE)
    return record("revisit", id, date, http_head(n), *more, ("WARC-Refers-To", f"<{of}>"))


@lru_cache(maxsize=4)
def compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    """A frame tells its length and carries a checksum."""
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)


def trained(samples: list[bytes]) -> bytes:
    """A dictionary of ``samples``; empty where they are too few to train one."""
    if sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY, len(packed)) + packed


# Reading


class BadArchive(ValueError):
    """An archive that breaks the format; says where."""


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, by the lengths of its blocks."""
    flags = data[at + 4]
    single, sums = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind = head & 1, head >> 1 & 3
        if at + 3 > len(data) or kind == 3:
            raise BadArchive(f"cut off or broken at byte {at}")
        at += 3 + (1 if kind == 1 else head >> 3)
    return at + 4 * sums


def leading_dictionary(data: memoryview) -> tuple[bytes, int]:
    """Dictionary of the leading skippable frame and where records start; none in an archive without one."""
    if len(data) < 8:
        return b"", 0
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY:
        return b"", 0
    if 8 + size > len(data):
        raise BadArchive("the dictionary is cut off")
    found = bytes(data[8 : 8 + size])
    if int.from_bytes(found[:4], "little") == FRAME:
        found = zstandard.ZstdDecompressor().decompress(found, max_output_size=1 << 27)
    if int.from_bytes(found[:4], "little") != TRAINED:
        raise BadArchive("the leading frame holds no dictionary")
    return found, 8 + size


def frames(data: memoryview) -> Iterator[bytes]:
    """Contents of the frames of an archive, one decoded at a time; checksum and stated length must hold."""
    known, at = leading_dictionary(data)
    learnt = zstandard.ZstdCompressionDict(known) if known else None
    decoder = zstandard.ZstdDecompressor(dict_data=learnt)
    while at < len(data):
        if at + 8 > len(data):
            raise BadArchive(f"{len(data) - at} bytes left over at byte {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if magic == DICTIONARY:
                raise BadArchive(f"a second dictionary at byte {at}")
            at += 8 + size
            if at > len(data):
                raise BadArchive("a skippable frame is cut off")
            continue
        if magic != FRAME:
            raise BadArchive(f"no frame at byte {at}")
        end = frame_end(data, at)
        if end > len(data):
            raise BadArchive(f"the frame at byte {at} is cut off")
        told = zstandard.get_frame_parameters(data[at:end])
        if told.dict_id != (learnt.dict_id() if learnt and told.dict_id else 0):
            raise BadArchive(f"the frame at byte {at} needs dictionary {told.dict_id}")
        if told.content_size != zstandard.CONTENTSIZE_UNKNOWN and told.content_size > MOST_RECORD_BYTES:
            raise BadArchive(f"the frame at byte {at} is too long")
        try:
            if told.content_size == zstandard.CONTENTSIZE_UNKNOWN:
                content = decoder.decompressobj().decompress(data[at:end])
            else:
                content = decoder.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise BadArchive(f"the frame at byte {at}: {e}") from e
        yield content
        at = end


def header_lines(head: bytes) -> dict[str, str]:
    """Headers by lower-case name; a line that starts with white space continues the one before."""
    found: dict[str, str] = {}
    name = None
    for line in head.decode().split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name or name in found and name in ("content-length", "warc-type", "warc-record-id"):
            raise BadArchive(f"bad header {line[:80]!r}")
        found[name] = value.strip()
    return found


def length(text: str | None) -> int:
    if text is None or not re.fullmatch(r"[0-9]{1,18}", text):
        raise BadArchive(f"bad Content-Length {text!r}")
    return int(text)


def parsed(content: bytes) -> dict:
    """A record's fields; version, mandatory headers, lengths and the digest of a payload must hold."""
    if not content.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise BadArchive(f"no record: {content[:20]!r}")
    end = content.find(b"\r\n\r\n")
    if end < 0:
        raise BadArchive("headers without end")
    head = header_lines(content[10:end])
    missing = [h for h in ("warc-type", "warc-record-id", "warc-date", "content-length") if h not in head]
    if missing:
        raise BadArchive(f"headers missing: {missing}")
    size = length(head["content-length"])
    if len(content) != end + 4 + size + 4 or not content.endswith(b"\r\n\r\n"):
        raise BadArchive(f"a block of {len(content) - end - 8} bytes is said to have {size}")
    block, kind, bare = content[end + 4 : -4], head["warc-type"], lambda h: head[h].strip("<>") if h in head else None
    found = {
        "id": bare("warc-record-id"), "type": kind, "uri": head.get("warc-target-uri"), "date": head["warc-date"],
        "payload": None, "payload_bytes": None, "payload_digest": None, "refers_to": bare("warc-refers-to"),
    }
    if kind not in ("response", "revisit"):
        return {**found, "payload": block, "payload_bytes": len(block)}
    split = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or split < 0:
        raise BadArchive("a block without HTTP headers")
    stated = length(header_lines(block[block.find(b"\r\n") + 2 : split]).get("content-length"))
    scheme, _, sha1 = head.get("warc-payload-digest", "").partition(":")
    payload = block[split + 4 :]
    if scheme != "sha1":
        raise BadArchive("no SHA-1 digest")
    if kind == "response" and (len(payload) != stated or digest(payload) != sha1):
        raise BadArchive("length or digest of the payload differs")
    if kind == "revisit" and (payload or not found["refers_to"]):
        raise BadArchive("a revisit with a payload or without what it refers to")
    return {**found, "payload": payload if kind == "response" else None, "payload_bytes": stated, "payload_digest": sha1}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives of a folder: id, type, uri, date, payload, payload_bytes, payload_digest, refers_to.

    A payload is the body of an HTTP response, or the block of any other record; revisits have none, their size and digest
    are those of the record they refer to. Raises where headers, lengths, checksums or digests do not hold. An archive is
    one task's; without ``payloads`` they are checked but not returned.
    """
    types = pa.schema([(n, {"binary": pa.binary(), "long": pa.int64()}.get(t, pa.string())) for n, t in (c.split() for c in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for one in frames(memoryview(content.as_buffer())):
                    row = parsed(one)
                    size += len(row["payload"] or b"") if payloads else 0
                    rows.append(row if payloads else {**row, "payload": None})
                    if size > 1 << 23 or len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, types)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


# Writing


def _packed(pages: DataFrame, dictionary: bytes, date: str, level: int) -> DataFrame:
    """Every page as a response in a frame of its own, with what tells equal payloads; texts go no further."""
    types = pa.schema([("id", pa.int64()), ("uri", pa.string()), ("n", pa.int64()), ("sha1", pa.string()), ("more", pa.binary()), ("frame", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = compressor(dictionary, level)
        for batch in batches:
            rows, size = [], 0
            for id, uri, html in zip(*(batch.column(c) for c in ("id", "uri", "html")), strict=True):
                payload = (html.as_py() or "").encode()
                id, uri, sha1 = id.as_py(), clean_uri(uri.as_py()), digest(payload)
                frame = press.compress(response(record_id(id, sha1), uri, date, payload, sha1))
                rows.append({"id": id, "uri": uri, "n": len(payload), "sha1": sha1, "more": hashlib.blake2b(payload, digest_size=8).digest(), "frame": frame})
                size += len(frame)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_pylist(rows, types)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, types)

    return pages.mapInArrow(run, "id long, uri string, n long, sha1 string, more binary, frame binary")


def record_id(id: int | None, sha1: str) -> str:
    return f"urn:page:{'none' if id is None else id}:{sha1}"


def _chosen(packed: DataFrame, least: int) -> DataFrame:
    """``packed`` with ``of``, the id of the page whose record holds the payload; null where that is the row itself.

    Hot groups, at most ``HOT_SHARE``, are so few that they are broadcast; all others meet their rows by a shuffle.
    """
    key = ["sha1", "more", "n"]
    groups = packed.filter(F.col("n") >= least).groupBy(*key).agg(F.max("id").alias("of"), F.count("*").alias("rows"))
    groups = stored(groups.filter("rows > 1 and of is not null"), "warc-groups")
    hot = F.col("rows") * HOT_SHARE > packed.count()
    few = F.broadcast(groups.filter(hot).drop("rows"))
    rest = packed.join(few, key, "left_anti").join(groups.filter(~hot).drop("rows"), key, "left")
    names = [*packed.columns, F.when(~F.col("id").eqNullSafe(F.col("of")), F.col("of")).alias("of")]
    return packed.join(few, key).select(*names).unionByName(rest.select(*names))


def _sample(pages: DataFrame) -> list[bytes]:
    """Starts of at most ``SAMPLE_ROWS`` pages with the smallest hashes; the hashes are found first, without the texts."""
    keyed = pages.filter("html <> ''").select(F.xxhash64("id", "uri").alias("order"), F.substring("html", 1, SAMPLE_CHARS).alias("html"))
    last = keyed.select("order").orderBy("order").limit(SAMPLE_ROWS).agg(F.max("order")).first()[0]
    return sorted(r.html.encode() for r in keyed.filter(F.col("order") <= F.lit(last)).limit(SAMPLE_ROWS).collect()) if last is not None else []


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = NO_DATE, level: int = 3, id: str = "page_id", uri: str = "url", html: str = "html") -> None:
    """A record for each page in ``.warc.zst`` archives of about ``ARCHIVE_BYTES`` below ``path``.

    Of pages whose payloads (the text in UTF-8) are equal and have ``least`` bytes or more, the one with the largest id is
    written as a response and the others revisit it. A null text is an empty payload. A page with a null id is named
    ``none``: it revisits a page with an id, and is a response where its group has none. Rows that share the largest id
    are all responses. A null address has no header; white space in one becomes a percent code. Texts of any length up to
    2 GB are one record. An empty table gives no records. Further columns are not read.
    """
    spark = pages.sparkSession
    slim = pages.select(F.col(id).cast("long").alias("id"), F.col(uri).alias("uri"), F.col(html).alias("html"))
    dictionary = trained(_sample(slim))
    packed = stored(_packed(slim, dictionary, date, level), "warc-packed")
    size = packed.agg(F.sum(F.length("frame"))).first()[0] or 0
    lead = dictionary_frame(dictionary) if dictionary else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = compressor(dictionary, level)
        first = True
        for batch in batches:
            out = []
            if first and batch.num_rows:
                info = record("warcinfo", f"urn:archive:{TaskContext.get().partitionId()}", date, b"software: casagrid\r\nformat: WARC File Format 1.1\r\n", ("Content-Type", "application/warc-fields"))
                out, first = [lead + press.compress(info)], False
            for id, uri, n, sha1, of, frame in zip(*(batch.column(c) for c in ("id", "uri", "n", "sha1", "of", "frame")), strict=True):
                other = of.as_py()
                if other is None:
                    out.append(frame.as_buffer().to_pybytes())
                else:
                    sha1 = sha1.as_py()
                    out.append(press.compress(revisit(record_id(id.as_py(), sha1), uri.as_py(), date, n.as_py(), sha1, record_id(other, sha1))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    archives = max(1, round(size / ARCHIVE_BYTES))
    lines = _chosen(packed, least).drop("more").repartition(archives, "id", "sha1").mapInArrow(run, "frame binary")
    lines.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


def archived(pages: DataFrame, least: int = 0, **names: str) -> DataFrame:
    """Writes ``pages`` to a new folder of archives and reads their records back, but for the archives' own."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, least, **names)
    return read_archives(pages.sparkSession, path, payloads=False).filter("type <> 'warcinfo'")

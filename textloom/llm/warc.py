"""WARC archives with an embedded Zstandard dictionary: writing pages, reading them back."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, partitions, shared_dir

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Records whose bytes the dictionary of an archive is built from: the first of the archive, up to this size.
SAMPLE_BYTES = 2 << 20
#: An archive is closed once it holds so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
#: Payloads shorter than this are stored in full even if they repeat.
MIN_REVISIT = 0
#: Up to so many distinct repeated payloads, some 200 bytes each, their originals are broadcast to the pages.
BROADCAST_GROUPS = 100_000
#: Beyond that, parts into which the rows of one payload are dealt.
SALTS = 32
_DATE = "1970-01-01T00:00:00Z"
_HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324 - the format's digest


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC/1.1 record. A response's block is an HTTP message whose body is the payload; a revisit has the message's
    head alone and names its original by record id."""
    name = lambda x: f"<urn:page:{x}>"
    clean = lambda x: "".join(c for c in (x or "") if c not in "\r\n")
    block = _HTTP_HEAD + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {clean(url)}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Target-URI: {clean(refers_url)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"WARC-Original-Length: {len(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's block does not have its stated length")
    return fields, rest[:n]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from records; where they are too few to train one, their own bytes serve."""
    if len(samples) >= 8:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:DICTIONARY_BYTES]


class Writer:
    """Writes records to one archive: the dictionary in a skippable frame, then each record as a frame of its own."""

    def __init__(self, sink, samples: list[bytes]):
        raw = build_dictionary(samples)
        packed = zstandard.ZstdCompressor(level=19, write_content_size=True).compress(raw)
        self.sink = sink
        self.size = sink.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed) or len(packed) + 8
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)

    def write(self, raw: bytes) -> None:
        frame = self.compressor.compress(raw)
        self.sink.write(frame)
        self.size += len(frame)


def read_records(source) -> Iterator[bytes]:
    """The records of one archive, one at a time."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(source.read(size))
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    pending = b""
    while True:
        unit, parts = decompressor.decompressobj(), []
        while not unit.eof:
            pending = pending or source.read(1 << 20)
            if not pending:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(unit.decompress(pending))
            pending = unit.unused_data
        yield b"".join(parts)


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _writer(folder: str, archive_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes (page_id, url, html, digest, again, first id, first url) as archives under folder; yields their names and counts.

    Each attempt writes files of new names and only the names that a successful attempt returns are read, so a task that
    is lost and run again leaves at worst a file that nobody reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(folder)
        waiting: list[bytes] = []
        state: dict = {"writer": None, "held": 0, "n": 0}
        made: list[tuple[str, int]] = []

        def begin() -> None:
            state["name"] = f"{uuid.uuid4().hex}.warc.zst"
            state["file"] = store.open_output_stream(f"{base}/{state['name']}", compression=None)  # the name alone would have it compressed again
            state["writer"] = Writer(state["file"], waiting)
            for x in waiting:
                state["writer"].write(x)
            state["n"], state["held"] = len(waiting), 0
            waiting.clear()

        def finish() -> None:
            if waiting:
                begin()
            if state["writer"]:
                state["file"].close()
                made.append((state["name"], state["n"]))
                state["writer"] = None

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, sha1, again, first, first_url = (batch.column(k)[i].as_py() for k in range(7))
                raw = record("revisit" if again else "response", page_id, url, (html or "").encode("utf-8", "replace"), sha1, first, first_url)
                if state["writer"]:
                    state["writer"].write(raw)
                    state["n"] += 1
                    if state["writer"].size >= archive_bytes:
                        finish()
                else:
                    waiting.append(raw)
                    state["held"] += len(raw)
                    if state["held"] >= SAMPLE_BYTES:
                        begin()
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int64())], names=["archive", "records"])

    return run


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(folder)
        names = ["page_id", "url", "payload", "payload_digest", "record_type", "refers_to", "original_bytes"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        number = lambda x: None if x == "None" else int(x)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for raw in read_records(source):
                        head, block = parse(raw)
                        block = block.partition(b"\r\n\r\n")[2]
                        revisit = head["WARC-Type"] == "revisit"
                        refers = number(head["WARC-Refers-To"][len("<urn:page:") : -1]) if revisit else None
                        sha1 = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and digest(block) != sha1:
                            raise ValueError(f"record {head['WARC-Record-ID']} does not have its digest")
                        n = int(head["WARC-Original-Length"]) if revisit else len(block)
                        rows.append((number(head["WARC-Record-ID"][len("<urn:page:") : -1]), head["WARC-Target-URI"], block, sha1, head["WARC-Type"], refers, n))
                        size += len(block)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Writes one record per row of pages; returns (archive, records), the manifest of the archives under folder.

    Payloads are the html in UTF-8 (null: empty). Of rows with equal payloads of at least min_revisit bytes the one with
    the smallest id (null ids last; of rows that repeat an id, one) is a response and the others are revisits of it.
    The original of each repeated digest comes from an aggregate that is combined before its shuffle. Where no more than
    BROADCAST_GROUPS digests repeat, which is counted, the originals go to the pages and payloads are not shuffled;
    beyond that the rows of repeated payloads are joined with them, salted by row, and payloads are shuffled once by row.
    Each task writes its own archives, with a dictionary built from their first records.

    Rows are told apart by their numbers, so an input whose rows come in another order when read again must be written
    first. Nothing is written for an empty table; ids are longs; null addresses count as empty; other columns, whatever
    their names, are not read; a payload of any length is one record.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    keyed = base.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1(payload))
    # The row's own number tells rows apart that repeat an id.
    keyed = keyed.withColumn("row", F.monotonically_increasing_id())
    rank = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("id"), F.col("row").alias("row"), F.col("url").alias("url"))
    groups = keyed.filter(F.col("size") >= min_revisit).groupBy("sha1", "size").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = cut(groups.filter("n > 1").select(F.col("sha1").alias("again_sha1"), F.col("size").alias("again_size"), "first"))
    if repeated.count() <= broadcast_groups:
        named = keyed.join(F.broadcast(repeated), (F.col("sha1") == F.col("again_sha1")) & (F.col("size") == F.col("again_size")), "left")
    else:
        # Few columns, no payload; a payload that very many pages share is dealt out by a salt.
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        met = keyed.select("row", "sha1", "size", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")).join(
            repeated.select(F.col("again_sha1").alias("sha1"), F.col("again_size").alias("size"), "first", salts.alias("salt")), ["sha1", "size", "salt"]
        )
        named = keyed.join(met.select("row", "first"), "row", "left")
    again = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    shown = named.select(
        "page_id", "url", "html", F.upper(_base32(F.col("sha1"))).alias("sha1"), again.alias("again"), F.when(again, F.col("first.id")).alias("first_id"), F.when(again, F.col("first.url")).alias("first_url")
    )
    return cut(shown.mapInArrow(_writer(folder, archive_bytes), "archive string, records long"))


def _base32(sha1_hex):
    """Base 32 of a SHA-1 in hex: eight groups of five hex digits are four letters each."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz234567")
    out = []
    for g in range(8):
        n = F.conv(F.substring(sha1_hex, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substr(letters, F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the manifest's archives: page_id, url, payload, payload_digest, record_type, refers_to,
    original_bytes (of the full payload). A response whose block lacks its digest fails the read."""
    schema = "page_id long, url string, payload binary, payload_digest string, record_type string, refers_to long, original_bytes long"
    names = manifest.select("archive")
    return names.repartition(max(1, partitions(manifest.sparkSession)), "archive").mapInArrow(_reader(folder), schema)


def archive_round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes pages to archives in folder (one below spark.checkpoint.dir by default) and reads them back: page_id,
    payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    store, path = _place(folder)
    store.create_dir(path, recursive=True)
    records = read_archives(write_archives(pages, folder, **options), folder)
    return records.select("page_id", F.col("original_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")

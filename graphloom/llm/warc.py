"""WARC archives compressed record by record with a Zstandard dictionary that each archive carries itself.

Writing: rows with equal payloads are found by (SHA-1, length); the row with the largest id becomes the ``response``
record and the others ``revisit`` records that refer to it. Every Spark task writes its rows, sorted by id, into archives
of bounded size. The first records of an archive (a bounded sample) train its dictionary, which is stored in a leading
skippable frame; each record is a Zstandard frame of its own after it. An archive is written under a temporary name
and renamed, so a task that runs twice leaves one complete file.

Reading: tasks stream archives and parse one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import new_path, stash, tidy

SKIPPABLE_MAGIC = 0x184D2A5D  # fixed value: the dictionary frame of the .warc.zst format
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"  # fixed value: start of a formatted Zstandard dictionary
BLANK_DATE = "1970-01-01T00:00:00Z"
MANIFEST = "path string, n_records long, n_bytes long, dictionary_bytes long"
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def _page(urn: str | None):
    return None if urn in (None, "<urn:page:null>") else int(urn[10:-1])


def encode_record(page_id, url: str | None, payload: bytes, digest: str, revisit_of=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record: headers, HTTP headers with the full payload's length, and for responses the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {BLANK_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + "".join(url.splitlines()))
    if revisit:
        head += [f"WARC-Refers-To: {_urn(revisit_of)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> tuple:
    """(page_id, url, type, digest, payload length, refers_to, payload or None) of one record."""
    at = data.index(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in data[:at].decode().split("\r\n")[1:])
    block = data[at + 4 : at + 4 + int(head["Content-Length"])]
    cut = block.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in block[:cut].decode().split("\r\n")[1:])
    revisit = head["WARC-Type"] == "revisit"
    payload = None if revisit else block[cut + 4 :]
    return (_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"]), _page(head.get("WARC-Refers-To")), payload)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from records; with too few of them to train on, their own bytes (a raw-content dictionary)."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if raw.startswith(DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_frame(raw: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw


def read_frames(stream, chunk: int = 1 << 14) -> Iterator[bytes]:
    """The records of an archive, one at a time; holds one record and one chunk."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    raw = stream.read(size)
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)) if raw else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        frame, out = reader.decompressobj(), []
        while True:
            out.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = stream.read(chunk)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


def _open(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri)


class _Archive:
    """Collects encoded records and writes them as one archive."""

    def __init__(self, folder: str, name: str, sample_bytes: int, dictionary_bytes: int, level: int):
        self.uri, self.sample_bytes, self.dictionary_bytes, self.level = f"{folder}/{name}", sample_bytes, dictionary_bytes, level
        self.held: list[bytes] = []
        self.held_bytes = self.n = self.size = 0
        self.sink = None

    def add(self, record: bytes) -> None:
        self.n += 1
        if self.sink is not None:
            self._put(self.writer.compress(record))
            return
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= self.sample_bytes:
            self._start()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def _start(self) -> None:
        self.fs, self.path = _open(self.uri)
        self.temporary = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.sink = self.fs.open_output_stream(self.temporary, compression=None)
        # long records lend their first 16 KB, so that the sample holds many records
        self.raw = train_dictionary([r[: 1 << 14] for r in self.held], self.dictionary_bytes)
        self.writer = zstandard.ZstdCompressor(level=self.level, dict_data=_dictionary(self.raw)) if self.raw else zstandard.ZstdCompressor(level=self.level)
        self._put(dictionary_frame(self.raw))
        for record in self.held:
            self._put(self.writer.compress(record))
        self.held = []

    def close(self) -> tuple[str, int, int, int]:
        if self.sink is None:
            self._start()
        self.sink.close()
        self.fs.move(self.temporary, self.path)
        return self.uri, self.n, self.size, len(self.raw)


def mark_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Adds payload_sha1 (hex), payload_bytes, record_type, refers_to.

    Payload counts are aggregated before the shuffle, and only payloads that occur more than once are joined back;
    adaptive execution splits the rows of a payload that is very common.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("payload_sha1"), F.octet_length(html).cast("long").alias("payload_bytes"))
    groups = (
        pages.select("page_id", F.sha1(html.cast("binary")).alias("payload_sha1"), F.octet_length(html).cast("long").alias("payload_bytes"))
        .filter(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("payload_sha1", "payload_bytes")
        .agg(F.max("page_id").alias("kept_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    revisit = F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id"))
    return rows.join(groups, ["payload_sha1", "payload_bytes"], "left").select(
        "page_id", "url", "html", "payload_sha1", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept_id")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, archive_bytes: int = 64 << 20, sample_bytes: int = 2 << 20, dictionary_bytes: int = 64 << 10, level: int = 3) -> DataFrame:
    """Write ``pages`` (page_id, url, html; other columns are ignored) to ``folder``; returns the manifest (one row a file).

    Null html is an empty payload; a null url leaves out the target URI; among rows with equal payloads those with the
    largest page_id are responses (all of them, if that id is repeated), null ids revisit them; an empty table writes
    nothing. ``sample_bytes`` bounds the records that an archive's dictionary is trained on and a task holds.
    """

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, done, archive = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for page_id, url, html, sha1, kind, refers in zip(batch.page_id, batch.url, batch.html, batch.payload_sha1, batch.record_type, batch.refers_to, strict=True):
                if archive is None:
                    archive = _Archive(folder, f"part-{part:06d}-{len(done):05d}.warc.zst", sample_bytes, dictionary_bytes, level)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                archive.add(encode_record(None if pd.isna(page_id) else int(page_id), url, (html or "").encode(), digest, None if pd.isna(refers) else int(refers), kind == "revisit"))
                if archive.size >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pd.DataFrame(done, columns=["path", "n_records", "n_bytes", "dictionary_bytes"])

    marked = mark_revisits(pages, min_revisit_bytes).select(F.col("page_id").cast("string"), "url", "html", "payload_sha1", "record_type", F.col("refers_to").cast("string"))
    return stash(marked.sortWithinPartitions("page_id", "url", "payload_sha1").mapInPandas(tidy(write), MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives in ``manifest``: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    Digest and length of responses are computed from the payload that was read and must agree with the headers.
    """

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch.path:
                fs, path = _open(uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in read_frames(stream):
                        row = decode_record(data)
                        if row[6] is not None and (base32_sha1(row[6]) != row[3] or len(row[6]) != row[4]):
                            raise ValueError(f"record {row[0]} of {uri} is damaged")
                        rows.append(row if payloads else (*row[:6], None))
                        held += len(data)
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield _frame(rows)
                            rows, held = [], 0
                yield _frame(rows)

    def _frame(rows):
        out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    files = manifest.select("path")
    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism)).mapInPandas(tidy(read), RECORDS)


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` into archives in the shared folder and read every record back."""
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc"), min_revisit_bytes), payloads=False)

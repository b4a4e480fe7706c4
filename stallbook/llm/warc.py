"""WARC archives with a Zstandard dictionary.

Every archive (`.warc.zst`) begins with a skippable frame that holds a dictionary, built from
a sample of the archive's own records; every record is a frame of its own, compressed with
that dictionary, so that a reader can start at any record. Records are WARC/1.1: a response
with the payload, or a revisit that names the response with the same payload. The pages come
without HTTP headers, so a response holds the html alone, as its Content-Type says.

Archives are written by the tasks to a folder all executors share, under names of the attempt.
What counts is the manifest, a written table that has the files of the attempts that Spark
accepted: a task that runs again, in whatever order its rows come, leaves files that no manifest
names, and readers open the files of the manifest only.
"""

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.config import keep
from stallbook.llm.arrow import ready

#: Magic number of the frame that holds the dictionary, and of any Zstandard frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: An archive is closed when its records are this large, before compression.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
#: At most so many records, evenly spread over the archive, and so many bytes of them build it.
SAMPLE_RECORDS, SAMPLE_TOTAL = 400, 8 << 20
#: Records that do not fit whole give pieces of this size, spread over each.
PIECE_BYTES = 8 << 10
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Add payload_bytes, payload_digest, record_type and refers_to to every page.

    Of pages with equal payloads of at least `least` bytes the one with the largest page_id is a
    response, the others revisit it; all smaller ones are responses. A null html is an empty
    payload. Rows that share the largest page_id are all responses; a null page_id is below
    all others, and equal payloads without any page_id are responses. Groups are found by
    counts that are combined before their shuffle; only digests with several pages are
    joined again, as a written table, which Spark broadcasts when small and splits when skewed.
    """
    added = ("payload_bytes", "payload_digest", "record_type", "refers_to")
    own = [c for c in pages.columns if c not in added]
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    measured = pages.select(*own, F.length(payload).cast("long").alias("payload_bytes"),
                            F.sha1(payload).alias("payload_digest"))
    groups = keep(measured.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.max("page_id").alias("of"), F.count("*").alias("n")).where("n > 1 AND of IS NOT NULL")
        .select(F.col("payload_digest").alias("digest"), "of"), "groups")
    again = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("of"))
    return measured.join(groups, F.col("payload_digest") == F.col("digest"), "left").select(
        *own, "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("of")).alias("refers_to"))


def _record_id(page_id: int | None) -> str:
    """A fixed URN with the page's number in it; the nil URN for none."""
    if page_id is None:
        return f"urn:uuid:{uuid.UUID(int=0)}"
    return f"urn:uuid:{uuid.UUID(int=(5 << 76 | 1 << 127) | page_id % (1 << 64))}"


def _page_id(record_id: str) -> int | None:
    number = uuid.UUID(record_id.strip("<>")).int
    low = number % (1 << 64)
    return None if number == 0 else low - (1 << 64) if low >> 63 else low


def _target(url: str | None) -> list[str]:
    """The header lines of a url, none for a null one. A url that a line can't hold as it is, for
    blanks or control characters, is percent-encoded, and a line of its own says so."""
    if url is None:
        return []
    if not re.search(r"[\s\x00-\x1f\x7f-\x9f]", url):
        return [f"WARC-Target-URI: {url}"]
    return [f"WARC-Target-URI: {quote(url, safe='/:?#&=')}", "X-Url-Encoded: 1"]


def record(row: dict) -> bytes:
    """A page's WARC record."""
    revisit = row["record_type"] == "revisit"
    body = b"" if revisit else (row["html"] or "").encode()
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Date: {_DATE}",
        f"WARC-Record-ID: <{_record_id(row['page_id'])}>",
        *_target(row["url"]), f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}"]
    if revisit:
        head += [f"WARC-Refers-To: <{_record_id(row['refers_to'])}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The page's columns from a record; raises if a response differs from its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                  for line in lines[1:])
    body = rest[:int(fields["Content-Length"])]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["X-Payload-Length"])
    if kind == "response" and (hashlib.sha1(body).hexdigest(), len(body)) != (digest, size):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    url = fields.get("WARC-Target-URI")
    return {"page_id": _page_id(fields["WARC-Record-ID"]),
            "url": unquote(url) if "X-Url-Encoded" in fields else url,
            "html": None if kind == "revisit" else body.decode(), "payload_bytes": size,
            "payload_digest": digest, "record_type": kind,
            "refers_to": _page_id(fields["WARC-Refers-To"]) if kind == "revisit" else None}


def sample_of(records: list[bytes]) -> list[bytes]:
    """Evenly spread records, whole if they fit into `SAMPLE_TOTAL`, else in spread pieces."""
    n = min(len(records), SAMPLE_RECORDS)
    chosen = [records[i * len(records) // n] for i in range(n)]
    total = sum(map(len, chosen))
    if total <= SAMPLE_TOTAL:
        return chosen
    share = (SAMPLE_TOTAL - n * PIECE_BYTES) / total
    out = []
    for i, r in enumerate(chosen):
        pieces, room = max(1, int(len(r) * share / PIECE_BYTES)), max(0, len(r) - PIECE_BYTES)
        starts = [room * j // (pieces - 1) for j in range(pieces)] if pieces > 1 else [room * (i % 4) // 3]
        out += [r[a:a + PIECE_BYTES] for a in starts]
    return out


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from a sample of the records; raw sample bytes where they are too few."""
    sample = sample_of(records)
    size = min(DICTIONARY_BYTES, max(1 << 10, sum(map(len, sample)) // 8))
    try:
        return zstandard.train_dictionary(size, sample, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:size],
                                             dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3) -> bytes:
    """The dictionary's frame, then one frame per record."""
    shared = dictionary(records)
    press = zstandard.ZstdCompressor(level=level, dict_data=shared)
    content = shared.as_bytes()
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(content)), content,
                     *(press.compress(r) for r in records)])


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no dictionary")
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(
        data[8:8 + size]))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        end = frame_end(data, at)
        yield opener.decompressobj().decompress(view[at:end])
        at = end


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, from the sizes of its blocks."""
    if struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError("no frame where one should begin")
    flags = data[at + 4]
    single = flags >> 5 & 1
    content = (single, 2, 4, 8)[flags >> 6]
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + content
    last = False
    while not last:
        block = int.from_bytes(data[at:at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)  # kind 1 repeats a single byte
    return at + 4 * (flags >> 2 & 1)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES,
                   level: int = 3) -> DataFrame:
    """Write `decide`d pages as archives; returns the manifest: file, records and bytes of each.

    A task holds one archive's records at a time. The manifest is a written table.
    """
    ready(pages.sparkSession)
    run = uuid.uuid4().hex[:12]  # a folder may be written to several times

    def write(batches):
        place, root = pafs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        task, held, size, part = TaskContext.get(), [], 0, 0

        def close():
            data = archive(held, level)
            name = f"{run}-{task.partitionId():06d}-{task.taskAttemptId()}-{part:06d}.warc.zst"
            with place.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([len(held)]), pa.array([len(data)])],
                ["file", "records", "bytes"])

        for batch in batches:
            for row in batch.to_pylist():
                held.append(record(row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, part = [], 0, part + 1
        if held:
            yield close()

    columns = ("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type",
               "refers_to")
    return keep(pages.select(*columns).mapInArrow(write, "file string, records long, bytes long"),
                "archives")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the manifest's archives in a folder; without `payloads` html is null.

    Archives are bounded in size, so a task holds one at a time. Files that the manifest does
    not name are not opened.
    """
    ready(manifest.sparkSession)

    def read(batches):
        place, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with place.open_input_stream(f"{root}/{name}", compression=None) as file:
                    data = file.read()
                rows = []
                for one in records(data):
                    rows.append(parse(one))
                    if not payloads:
                        rows[-1]["html"] = None
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])
    return manifest.select("file").repartition(F.col("file")).mapInArrow(
        read, "page_id long, url string, html string, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long")

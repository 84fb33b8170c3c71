"""Web archives packed in ZIP files: written by tasks, read back by ranges without extraction.

An archive holds a stored member ``archive/data.warc.gz`` (one gzip member a
record) and a stored index ``indexes/index.cdxj`` with the offset and length of
each record. Readers find the members through the central directory, in its
32- or 64-bit form, and read only the ranges they need.

Archives get a fresh name in every task attempt, and only the names that
finished tasks report are read, so a lost executor leaves no half-written
archive in the result.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.session import cut_lineage, shared_folder

ARCHIVE_BYTES = 16 << 20
REVISIT_BYTES = 1000
READ_AT_ONCE = 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- records


def _header_value(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 response record, or a revisit record, which has the HTTP head without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>", f"WARC-Date: {date}"]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record; the payload of a revisit is None, its length comes from its HTTP head."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = top.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(named["content-length"])
    block = rest[:size]
    if len(block) < size:
        raise ValueError("a WARC record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode("utf-8").split("\r\n")[1:])}
    revisit = named["warc-type"] == "revisit"
    digest = named["warc-payload-digest"].removeprefix("sha1:")
    if not revisit:
        found = hashlib.sha1(payload).hexdigest()
        if found != digest:
            raise ValueError(f"payload digest {found} where {digest} is stated")
    return {
        "page_id": int(named["warc-page-id"]) if "warc-page-id" in named else None,
        "url": named.get("warc-target-uri"),
        "record_type": named["warc-type"],
        "refers_to": int(named["warc-refers-to"].removeprefix("<urn:page:").rstrip(">")) if revisit else None,
        "payload_digest": digest,
        "payload_bytes": int(told["content-length"]) if revisit else len(payload),
        "payload": None if revisit else payload,
    }


# ---------------------------------------------------------------- archives


def packed(data: bytes, index: list[dict], zip64: bool = False) -> bytes:
    """A ZIP file with both members stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in ((DATA, data), (INDEX, "".join(json.dumps(x) + "\n" for x in index).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(content)
    return out.getvalue()


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """(start, length) of each stored member, from the central directory at the end of the file."""
    tail_at = max(0, size - 65_557 - 20)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if tail[end - 20 : end - 16] == b"PK\x06\x07" and end >= 20:
        (wide_at,) = struct.unpack_from("<Q", tail, end - 12)
        wide = file.read_at(56, wide_at)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory where its locator points")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
    listing = file.read_at(length, start)
    out, at = {}, 0
    for _ in range(count):
        if listing[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        method, inside, full = struct.unpack_from("<H8xII", listing, at + 10)
        name_len, extra_len, note_len = struct.unpack_from("<HHH", listing, at + 28)
        (local,) = struct.unpack_from("<I", listing, at + 42)
        name = listing[at + 46 : at + 46 + name_len].decode("utf-8")
        extra = listing[at + 46 + name_len : at + 46 + name_len + extra_len]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:
                # Only fields that do not fit 32 bits are there, in this order.
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = wide.pop(0) if full == 0xFFFFFFFF and wide else full
                inside = wide.pop(0) if inside == 0xFFFFFFFF and wide else inside
                local = wide.pop(0) if local == 0xFFFFFFFF and wide else local
            extra = extra[4 + n :]
        if method == 0:
            own = file.read_at(30, local)
            n, m = struct.unpack_from("<HH", own, 26)
            out[name] = (local + 30 + n + m, inside)
        at += 46 + name_len + extra_len + note_len
    return out


def _walk(file, start: int, length: int) -> Iterator[tuple[int, int]]:
    """Offsets and lengths of the gzip members of a range, for an archive without an index."""
    at, end = start, start + length
    while at < end:
        z, begun = zlib.decompressobj(31), at
        while not z.eof:
            piece = file.read_at(min(READ_AT_ONCE, end - at), at)
            if not piece:
                raise ValueError("a gzip member is cut off")
            z.decompress(piece)
            at += len(piece)
        at -= len(z.unused_data)
        yield begun, at - begun


def write(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Write one record a page and return (archive, bytes, records), one row an archive.

    Of pages with equal payloads of at least 1,000 bytes those with the largest
    id are responses and the others revisit it. A null payload is empty; pages
    with a null id never win, and if an equal group has no other id all its
    rows are responses. Rows that repeat the largest id are responses too.
    A task holds one archive at a time.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    long_ = rows.where(F.octet_length("html") >= REVISIT_BYTES)
    kept = long_.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 AND kept IS NOT NULL").select("digest", "kept")
    rows = rows.join(kept, "digest", "left").withColumn("kept", F.expr("CASE WHEN page_id <=> kept THEN NULL ELSE kept END"))
    folder = shared_folder(pages.sparkSession)

    def run(batches):
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        data, index = bytearray(), []

        def flush():
            name = f"{uuid.uuid4().hex}.wacz"
            whole = packed(bytes(data), index, zip64)
            with store.open_output_stream(f"{path}/{name}") as f:
                f.write(whole)
            done = pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "bytes": [len(whole)], "records": [len(index)]})
            data.clear()
            index.clear()
            return done

        for batch in batches:
            for p, u, h, d, k in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "kept")), strict=True):
                raw = record(p.as_py(), u.as_py(), h.as_py().encode(), d.as_py(), k.as_py(), date)
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                piece = z.compress(raw) + z.flush()
                index.append({"url": u.as_py(), "offset": len(data), "length": len(piece), "digest": d.as_py()})
                data.extend(piece)
                if len(data) >= archive_bytes:
                    yield flush()
        if index:
            yield flush()

    # The list is kept, so that no later action writes the archives again.
    return cut_lineage(rows.select("page_id", "url", "html", "digest", "kept").mapInArrow(run, "archive string, bytes long, records long"))


def index_of(archives: DataFrame) -> DataFrame:
    """(archive, at, length) of every record, from the index members; archives without one are walked through."""

    def run(batches):
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                store, path = _store(uri)
                with store.open_input_file(path) as f:
                    found = members(f, f.size())
                    if DATA not in found:
                        raise ValueError(f"{uri} has no stored {DATA}")
                    start, length = found[DATA]
                    if INDEX in found:
                        lines = f.read_at(found[INDEX][1], found[INDEX][0]).splitlines()
                        spots = [(start + x["offset"], x["length"]) for x in map(json.loads, lines)]
                    else:
                        spots = list(_walk(f, start, length))
                for lo in range(0, len(spots), 10_000):
                    cut = spots[lo : lo + 10_000]
                    yield pa.RecordBatch.from_pydict({"archive": [uri] * len(cut), "at": [a for a, _ in cut], "length": [n for _, n in cut]})

    return archives.select("archive").mapInArrow(run, "archive string, at long, length long")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes and, if asked for, payload of every record.

    Records go to the tasks in runs of neighbouring ones; a task reads a run's
    range at once and holds 1 MB or one record.
    """
    spots = index_of(archives).withColumn("run", F.floor(F.col("at") / READ_AT_ONCE))
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spots = spots.repartition(tasks, "archive", "run").sortWithinPartitions("archive", "at")
    fields = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", *(["payload"] if payloads else [])]
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches):
        held, opened, file = [], "", None

        def done():
            out = pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], type=kinds.get(c, pa.string())) for c in fields], names=fields)
            held.clear()
            return out

        try:
            for batch in batches:
                rows = list(zip(batch.column("archive").to_pylist(), batch.column("at").to_pylist(), batch.column("length").to_pylist(), strict=True))
                i = 0
                while i < len(rows):
                    uri, at, _ = rows[i]
                    j, end = i, at
                    while j < len(rows) and rows[j][0] == uri and rows[j][1] == end and (j == i or end + rows[j][2] - at <= READ_AT_ONCE):
                        end, j = end + rows[j][2], j + 1
                    if uri != opened:
                        if file is not None:
                            file.close()
                        store, path = _store(uri)
                        opened, file = uri, store.open_input_file(path)
                    piece = file.read_at(end - at, at)
                    held += [parse(zlib.decompress(piece[a - at : a - at + n], 31)) for _, a, n in rows[i:j]]
                    i = j
                    yield done()
        finally:
            if file is not None:
                file.close()

    return spots.select("archive", "at", "length").mapInArrow(run, schema)

"""Archives against the standard ZIP reader, ZIP64 and index-free ones, and round trips of pages."""

import hashlib
import io
import zipfile
import zlib

import pytest

from freshet.llm import warc


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("zip64", [False, True])
def test_members_as_the_standard_reader_sees_them(zip64):
    raw = warc.packed(b"abc" * 100, [{"offset": 0, "length": 300}], zip64)
    found = warc.members(Bytes(raw), len(raw))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert {n: raw[a : a + size] for n, (a, size) in found.items()} == {n: z.read(n) for n in z.namelist()}


def test_zip64_end_records_comments_and_compressed_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):  # more than 16 bits count
            z.writestr(f"m{i}", b"x")
        z.writestr(zipfile.ZipInfo("last"), b"the last")
        z.comment = b"PK note"
    raw = out.getvalue()
    found = warc.members(Bytes(raw), len(raw))
    assert len(found) == 66_001 and raw[found["last"][0] :][:8] == b"the last"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("packed", b"x" * 1000)
    assert warc.members(Bytes(out.getvalue()), len(out.getvalue())) == {}
    with pytest.raises(ValueError, match="no end"):
        warc.members(Bytes(b"not a zip"), 9)


def test_walk_without_an_index():
    parts = [zlib.compress(b"x" * n, 1, 31) for n in (10, 0, 3_000_000)]
    data = b"pre" + b"".join(parts)
    assert [n for _, n in warc._walk(Bytes(data), 3, len(data) - 3)] == [len(p) for p in parts]


def plain(rows):
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        best = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        to = max(best) if len(p) >= 1000 and best and i != max(best) and sum((g or "") == (h or "") for _, _, g in rows) > 1 else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("zip64", [False, True])
def test_round_trip(spark, zip64):
    long_, other = "<p>é</p>" * 200, "WARC/1.1\r\n\r\n" * 100
    rows = [(1, "u", long_), (2, "v\r\nx: y", long_), (3, None, None), (4, "w", ""), (5, "é", other), (6, "z", "short"), (7, "z", "short"), (None, None, long_), (8, "q", "x" * 3_000_000)]
    rows += [(9, "a", other), (9, "a", other), (None, "n", "lonely " * 300), (None, "n", "lonely " * 300), (10, "b", "y" * 999), (11, "b", "y" * 999)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    archives = warc.write(df, archive_bytes=200, zip64=zip64)
    assert archives.count() > 3
    got = warc.read(archives).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == plain(rows)
    texts = {(r[0], r[2] or "") for r in rows}
    for r in got:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        assert r["payload"] is None or (r["page_id"], bytes(r["payload"]).decode()) in texts
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_a_changed_payload_is_noticed():
    raw = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"abc", b"abd"))

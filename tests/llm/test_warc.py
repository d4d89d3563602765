import gzip
import random
import zlib
from hashlib import sha1

import pytest

from wardline.llm import warc
from wardline.llm.common import workspace

SCHEMA = "page_id long, url string, html string, digest string, record string, refers_to long"


def pages():
    rng = random.Random(7)
    long = "<html>" + "".join(rng.choice("abc déf<p>\n") for _ in range(1500)) + "</html>"
    rows = [(n, f"http://host/{n}", long + str(n % 7)) for n in range(40)]
    rows += [(100 + n, "http://same", long) for n in range(60)]  # one payload that most rows share
    rows += [
        (200, None, None), (201, "", ""), (202, "http://x/\r\nWARC-Type: fake", "x"), (203, "http://ü/ \t", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
        (204, "u", "y" * 999), (205, "u", "y" * 999), (206, "u", "y" * 1000), (207, "u", "y" * 1000), (208, "u", "é" * 500), (209, "u", "é" * 500),
        (210, "u", "\r\n\r\n" * 300), (211, "u", "\0" * 1200), (212, "u", "\x1f\x8b\x08" * 500), (5, "http://second", "another text of page 5" * 60),
        (207, "u", "y" * 1000), (None, "u", long), (213, "http://long", "z" * 300_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 3) for r in rows], SCHEMA).repartition(4)


def plain(rows):
    rows = [(i, (h or "").encode()) for i, _, h in rows if i is not None]
    largest = {}
    for i, h in rows:
        largest[h] = max(i, largest.get(h, i))
    out = []
    for i, h in rows:
        again = len(h) >= 1000 and i < largest[h]
        out.append((i, len(h), sha1(h).hexdigest(), "revisit" if again else "response", largest[h] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compressed", [True, False])
def test_pages_come_back(spark, compressed):
    path = workspace(spark, "warc")
    warc.write_archives(frame(spark, pages()), path, compressed, bytes_in_archive=50_000)
    found = warc.read_archives(spark, path)
    assert sorted(map(tuple, warc.pages_of(found).collect()), key=str) == plain(pages())
    assert warc.quarantine_log(found).count() == 0
    assert found.where("record_type = 'warcinfo'").select("archive").distinct().count() == found.select("archive").distinct().count() > 1
    html = {(i, (h or "").encode()) for i, _, h in pages() if i is not None}
    whole = warc.resolved(found).where("record_type <> 'warcinfo'").selectExpr("cast(fields['page-id'] as long) AS i", "payload").collect()
    assert {(r.i, bytes(r.payload)) for r in whole} == html


def test_files_are_plain_gzip(spark):
    """Any reader of gzip sees the records end to end."""
    path = workspace(spark, "warc")
    warc.write_archives(frame(spark, pages()), path, bytes_in_archive=10**9)
    files = [r for r in spark.read.format("binaryFile").load(path).collect() if r.length]
    text = b"".join(gzip.decompress(bytes(r.content)) for r in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type: re") >= len(plain(pages()))


def record(n, body=None, **more):
    return warc.page_record(n, f"http://h/{n}", body if body is not None else b"body %d " % n * 50, None, **more)


def archive(records, compressed):
    return [warc.gzip_members(r) if compressed else r for r in records]


def read(raw):
    found = list(warc.salvage_bytes(raw))
    at = 0
    for f in found:
        assert f.offset == at
        at += f.length
    assert at == len(raw)
    return [int(f.fields["page-id"]) for f in found if f.problem is None], [(f.offset, f.length, f.problem) for f in found if f.problem]


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage(compressed):
    parts = archive([record(n) for n in range(5)], compressed)
    places = [sum(map(len, parts[:n])) for n in range(6)]
    whole = b"".join(parts)
    assert read(whole) == ([0, 1, 2, 3, 4], [])

    def hurt(at, to=None):
        raw = bytearray(whole)
        raw[at] = to if to is not None else raw[at] ^ 0x55
        return bytes(raw)

    # a byte in the middle of a record, of its first bytes, of its last ones
    for at in (places[2] + len(parts[2]) // 2, places[2], places[2] + 1, places[3] - 1, places[3] - 3):
        ids, gaps = read(hurt(at))
        assert ids == [0, 1, 3, 4] and [(g[0], g[1]) for g in gaps] == [(places[2], len(parts[2]))], at
    # cut off in the middle, begun in the middle, bytes between records, bytes missing
    assert read(whole[: places[4] + 20])[0] == [0, 1, 2, 3]
    ids, gaps = read(whole[places[1] + 7 :])
    assert ids == [2, 3, 4] and gaps[0][0] == 0
    assert read(whole[: places[2]] + b"garbage \x1f\x8b\x08 WARC/1.1 more\n" + whole[places[2] :])[0] == [0, 1, 2, 3, 4]
    middle = places[2] + len(parts[2]) // 2
    assert read(whole[:middle] + whole[middle + 30 :])[0] == [0, 1, 3, 4]
    assert read(whole[: middle - len(parts[1])] + whole[middle + len(parts[2]) + 10 :])[0] == [0, 4]  # two damaged ones side by side: one gap
    assert read(b"\0" * 1000) == ([], [(0, 1000, "no version line")])
    assert read(b"") == ([], [])


def test_every_single_damaged_byte_is_noticed():
    """Whatever byte changes, no changed record passes and the others come back."""
    for compressed in (True, False):
        parts = archive([record(n, b"text %d" % n) for n in range(3)], compressed)
        raw, first = b"".join(parts), len(parts[0])
        originals = {bytes(f.block) for f in warc.salvage_bytes(raw)}
        for at in range(first, first + len(parts[1])):
            bad = bytearray(raw)
            bad[at] ^= 0x20
            found = list(warc.salvage_bytes(bytes(bad)))
            assert {bytes(f.block) for f in found if f.problem is None} <= originals
            ids = [f.fields.get("page-id") for f in found if f.problem is None]
            assert ids[0] == "0" and ids[-1] == "2", at


def test_wrong_digests_in_whole_frames():
    good, other = record(1), record(2)
    bad = good.replace(b"body 1 body 1", b"body 7 body 1", 1)
    assert read(bad + other)[0] == [2] and read(other + bad) == ([2], [(len(other), len(bad), "block digest")])
    wrapped = warc.gzip_members(bad) + warc.gzip_members(other)
    assert read(wrapped)[0] == [2]
    # a record inside a damaged record's payload is not taken for one of the archive
    inner = record(9)
    nest = record(3, b"x\n" + inner + b"y").replace(b"\nx\n"[1:], b"z\n", 1)
    assert read(nest + other)[0] == [2]


def test_records_over_several_members(monkeypatch):
    monkeypatch.setattr(warc, "BYTES_IN_MEMBER", 100)
    parts = archive([record(n) for n in range(3)], True)
    assert all(p.endswith(b"\0") for p in parts) and read(b"".join(parts))[0] == [0, 1, 2]
    raw = bytearray(b"".join(parts))
    raw[len(parts[0]) + len(parts[1]) // 2] ^= 1
    assert read(bytes(raw))[0] == [0, 2]


def test_foreign_archives():
    """Several records in a member, older version lines, folded fields, no digests, other kinds of digest."""
    plain_record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    found = list(warc.salvage_bytes(gzip.compress(plain_record * 3) + plain_record))
    assert [f.problem for f in found] == [None] * 4 and found[0].fields["warc-target-uri"] == "http://a b" and found[3].block == b"abc"
    odd = plain_record.replace(b"Content-Length", b"WARC-Block-Digest: md5:aaaa\r\nContent-Length")
    assert [f.problem for f in warc.salvage_bytes(odd)] == [None]
    hexed = plain_record.replace(b"Content-Length", b"WARC-Block-Digest: sha1:%s\r\nContent-Length" % sha1(b"abc").hexdigest().encode())
    assert [f.problem for f in warc.salvage_bytes(hexed)] == [None]
    assert [f.problem for f in warc.salvage_bytes(plain_record.replace(b": 3", b": -3"))] == ["header"]
    assert [f.problem for f in warc.salvage_bytes(plain_record.replace(b": 3", b": 2"))] == ["length"]
    assert [f.problem for f in warc.salvage_bytes(zlib.compress(b"x" * 99))] == ["no version line"]


def test_damaged_files_in_a_table(spark):
    parts = archive([record(n) for n in range(6)], True)
    broken = b"".join(parts[:3]) + b"?" * 50 + b"".join(parts[3:])
    rows = [("one", bytearray(broken)), ("two", bytearray(b"".join(parts))), ("none", None), ("empty", bytearray())]
    found = warc.salvage(spark.createDataFrame(rows, "path string, content binary"), with_payload=False)
    assert warc.records(found).count() == 12 and found.where("payload IS NOT NULL").count() == 0
    assert [(r.archive, r.length) for r in warc.quarantine_log(found).collect()] == [("one", 50)]


def test_no_pages(spark):
    path = workspace(spark, "warc")
    warc.write_archives(frame(spark, []), path)
    assert warc.pages_of(warc.read_archives(spark, path)).collect() == []

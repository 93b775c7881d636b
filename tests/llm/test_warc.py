import base64
import hashlib
import io
import struct
from collections import Counter

import zstandard

from voxlake.llm.warc import archive, parsed, read_archives, record, records_in, write_archives

ROWS = [(i, f"http://h/{i % 9}\r\nx", f"<p>page {i % 40}</p>\r\n\r\n" * (i % 30)) for i in range(400)] + [
    (400, None, None), (401, "u", ""), (None, "u", "<p>only</p>"), (None, "u", "<p>page 1</p>\r\n\r\n"), (7, "u", "<p>page 7</p>\r\n\r\n" * 7), (402, "u", "é" * 900_000)]


def pages(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "clash", "p") for r in rows], "page_id long, url string, html string, _first string, path string").repartition(parts)


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = Counter()
    for i, u, h in rows:
        raw = (h or "").encode()
        of = first.get(h or "") if len(raw) >= least else None
        kind = "response" if of is None or of == i else "revisit"
        out[(None if i is None else str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if kind == "response" else str(of), raw if kind == "response" else None, u and u.replace("\r\n", ""))] += 1
    return out


def test_round_trip_of_every_row(spark, tmp_path):
    for least in (0, 300):
        written = write_archives(pages(spark, ROWS), str(tmp_path / f"a{least}"), archive_bytes=20_000, min_revisit_bytes=least)
        got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]) if r["payload"] is not None else None, r["url"]) for r in read_archives(written).collect())
        want = Counter({(*k[:5], k[5] or k[5], k[6]): v for k, v in expected(ROWS, least).items()})
        assert got == want
        assert sum(r["records"] for r in written.collect()) == len(ROWS) and written.count() > 4
        assert not [p for p in (tmp_path / f"a{least}").iterdir() if p.name.startswith(".part")]


def test_an_archive_starts_with_its_dictionary_and_has_a_frame_for_each_record():
    raws = [record(str(i), "http://x", f"<html>{'word ' * 50}{i}</html>".encode(), None, False) for i in range(300)]
    data = b"".join(archive(raws))
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and zstandard.decompress(data[8 : 8 + size])[:4] == b"\x37\xa4\x30\xec"
    assert list(records_in(io.BytesIO(data))) == raws
    assert len(data) < sum(len(zstandard.compress(x)) for x in raws)
    assert list(records_in(io.BytesIO(b"".join(archive(raws[:1]))))) == raws[:1]


def test_headers_of_a_revisit():
    r = record("9", "u", b"body", "4", True).decode()
    assert "WARC-Type: revisit" in r and "WARC-Refers-To: <urn:page:4>" in r and "WARC-Profile: " in r and "body" not in r
    assert parsed(r.encode())["payload_bytes"] == 4


def test_no_pages(spark, tmp_path):
    written = write_archives(pages(spark, []), str(tmp_path / "none"))
    assert written.count() == 0 and read_archives(written).collect() == []

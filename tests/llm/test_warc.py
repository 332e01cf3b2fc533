import base64
import hashlib
import struct
from pathlib import Path

import pytest
import zstandard

from strata.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload string, first int"


def pages(spark, rows, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def expected(rows, least):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data]
        ids = [p for p in same if p is not None]
        first = min(ids) if ids else None
        later = len(data) >= least and len(same) > 1 and page != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if later else "response", first if later else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, tmp_path, least):
    body = "<html>\r\n\r\n<body>é {}</body>"
    rows = [(i, f"http://x/{i}", body.format(i % 60)) for i in range(200)]
    rows += [(300, None, None), (301, "", ""), (302, "http://a b\r\nX: y", "z"), (299, "u", "z"), (None, "n", "z"), (None, "n", "own"), (None, "n", "own"),
             (303, "same", "twice"), (303, "same", "twice"), (304, "big", "<p>" + "long " * 300_000)]
    path = str(tmp_path / "out")
    names = warc.write_archives(pages(spark, rows, tmp_path), path, least_bytes=least)
    found = warc.read_archives(spark, path, names, block=9).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == expected(rows, least)
    html = {(p, h or "") for p, _, h in rows}
    assert all((r.page_id, bytes(r.payload).decode()) in html for r in found if r.record_type == "response")
    assert {r.url for r in found if r.page_id in (300, 302)} == {None, "http://a%20b%0D%0AX:%20y"}


def test_each_record_is_a_frame_behind_the_dictionary(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<html><head><title>Page {i}</title></head><body>{'common words here ' * 5}{i * i}</body></html>") for i in range(300)]
    path = str(tmp_path / "out")
    names = warc.write_archives(pages(spark, rows, tmp_path), path)
    total = 0
    for name in names:
        data = Path(path, name).read_bytes()
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D and size > 0
        words, at = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size
        while at < len(data):
            frame = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
            assert frame.decompress(data[at:]).startswith(b"WARC/1.1\r\n")
            at = len(data) - len(frame.unused_data)
            total += 1
    assert total == 300


def test_empty(spark, tmp_path):
    names = warc.write_archives(pages(spark, [], tmp_path), str(tmp_path / "out"))
    assert names == [] and warc.read_archives(spark, str(tmp_path / "out"), names).count() == 0

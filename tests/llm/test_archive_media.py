import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import archive, media
from weftline.llm.common import Scratch


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([1, 2]), st.lists(st.tuples(st.text(alphabet="abc/:. ", min_size=1, max_size=20), st.binary(max_size=300)), max_size=6))
def test_arc_versions_round_trip(version, rows):
    data = archive.arc_version_block(version, "x.arc") + b"".join(archive.arc_record(version, archive.clean_url(u), b, "x.arc", 0) for u, b in rows)
    got = list(archive.arc_records(io.BytesIO(data)))
    assert [(r.version, r.fields["URL"], r.block) for r in got] == [(version, archive.clean_url(u), b) for u, b in rows]


@pytest.mark.parametrize("data", [b"http://x 0 0 t 3\nabc\n", b"filedesc://x 0.0.0.0 2 text/plain 4\n9 0 \n\n", archive.arc_version_block(1, "x") + b"http://a 0 2 text/html 9\nabc\n", archive.arc_version_block(1, "x") + b"bad\n"])
def test_broken_archives_are_errors(data):
    with pytest.raises(ValueError, match="ARC|base 10"):
        list(archive.arc_records(io.BytesIO(data)))


@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.binary(min_size=20, max_size=20))
def test_record_ids_tell_the_page(page, digest):
    own = archive.record_id(page, digest)
    assert archive.page_of(own) == page and own[14] == "8" and own[19] in "89ab"


def test_gzip_members_read_as_one_stream():
    parts = [b"a" * 100_000, b"", b"xyz\r\n" * 7]
    packed = b"".join((lambda c: c.compress(p) + c.flush())(zlib.compressobj(3, zlib.DEFLATED, 31)) for p in parts)
    assert io.BufferedReader(archive.Inflated(io.BytesIO(packed)), 4096).read() == b"".join(parts)


def test_converted_records_keep_dates_and_digests():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    arc = archive.ArcRecord(1, {"URL": "http://a/", "IP-address": "1.2.3.4", "Archive-date": "19970203040506", "Content-type": "text/html"}, block)
    for revisit in (False, True):
        fields, body = next(archive.warc_records(io.BytesIO(archive.warc_record(arc, 7, 9, revisit))))
        assert fields["WARC-Date"] == "1997-02-03T04:05:06Z" and fields["WARC-Target-URI"] == "http://a/"
        assert archive.described(fields, body) == (7, 2, hashlib.sha1(b"hi").hexdigest(), "revisit" if revisit else "response", 9 if revisit else None)
        assert body == (block[:-2] if revisit else block)
    broken = archive.warc_record(arc, 7).replace(b"hi", b"ho")
    with pytest.raises(ValueError, match="digest"):
        archive.described(*next(archive.warc_records(io.BytesIO(broken))))


LONG = "é\r\n\r\nWARC/1.1 " * 100


@pytest.mark.parametrize("rows", [[], [(1, "http://a b/", LONG), (5, None, LONG), (3, "u", LONG), (3, "u", LONG), (2, "u", None), (4, "u", "short"), (6, "u", "short"), (None, "u", LONG), (-9, "u", "z" * 3_000_000)]])
def test_archives_hold_every_row(spark, rows, monkeypatch):
    monkeypatch.setattr(archive, "ARCHIVE_BYTES", 500)
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, target string")
    got = archive.read_archives(*archive.write_archives(df, Scratch(spark, "t"))).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        again = len(data) >= 1000 and i != top and top is not None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def bmp(pixels, bits, down=False, palette=None):
    h, w = pixels.shape[:2]
    rows = []
    for line in pixels if down else pixels[::-1]:
        if bits == 24:
            raw = line[:, ::-1].tobytes()
        elif bits == 32:
            raw = np.dstack([line[None, :, ::-1], np.zeros((1, w, 1), np.uint8)]).tobytes()
        elif bits == 8:
            raw = line.tobytes()
        else:
            codes = np.unpackbits(line[:, None], axis=1)[:, 8 - bits :].ravel()
            raw = np.packbits(codes).tobytes()
        rows.append(raw + bytes(-len(raw) % 4))
    table = b"" if palette is None else b"".join(bytes([b, g, r, 0]) for r, g, b in palette)
    head = struct.pack("<IiiHHIIiiII", 40, w, -h if down else h, 1, bits, 0, 0, 0, 0, len(palette or ()), 0)
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(table)) + head + table + b"".join(rows)


@pytest.mark.parametrize("bits", [24, 32])
@pytest.mark.parametrize("down", [False, True])
def test_bmp_colours(bits, down):
    pixels = np.random.default_rng(0).integers(0, 256, (3, 5, 3), np.uint8)
    assert (media.decode(bmp(pixels, bits, down)) == pixels).all()


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_bmp_palettes(bits):
    rnd = np.random.default_rng(bits)
    n = 1 << bits
    index = rnd.integers(0, n, (4, 7)).astype(np.uint8)
    colours = rnd.integers(0, 256, (n, 3), np.uint8)
    assert (media.decode(bmp(index, bits, palette=colours.tolist())) == colours[index]).all()
    greys = np.repeat(rnd.integers(0, 256, (n, 1), np.uint8), 3, axis=1)
    assert (media.decode(bmp(index, bits, palette=greys.tolist())) == greys[index][..., 0]).all()


def test_netpbm_kinds():
    grey = np.arange(6, dtype=np.uint8).reshape(2, 3)
    colour = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    assert (media.decode(b"P2 # c\n3 2\n# d\n9\n0 1 2\n3 4 5\n") == grey).all()
    assert (media.decode(b"P5 3 2 255\n" + grey.tobytes()) == grey).all()
    assert (media.decode(b"P6\n3 2\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P3 3 2 255 " + b" ".join(str(x).encode() for x in range(18))) == colour).all()
    assert (media.decode(b"P1 3 2 101 010") == [[0, 1, 0], [1, 0, 1]]).all()
    assert (media.decode(b"P4 3 2\n\xa0\x40") == [[0, 1, 0], [1, 0, 1]]).all()
    wide = media.decode(b"P5 2 1 1000\n" + np.array([1, 999], ">u2").tobytes())
    assert wide.dtype == np.uint16 and wide.tolist() == [[1, 999]]


@pytest.mark.parametrize("data", [None, b"", b"P", b"P9 1 1 1\n0", b"P5 9 9 255\nabc", b"P5 x", b"BM", b"GIF89a", b"P5 1 1 0\n0", b"P2 1 1 5 9"])
def test_other_bytes_are_no_image(data):
    assert media.decode(data) is None


@pytest.mark.parametrize(("h", "w", "to"), [(7, 5, (3, 4)), (8, 9, (8, 9)), (2, 3, (5, 7)), (40, 24, (16, 16)), (1, 1, (2, 2))])
def test_area_resize_against_brute_force(h, w, to):
    pixels = np.random.default_rng(3).integers(0, 256, (h, w))
    fine = np.repeat(np.repeat(pixels, to[0], axis=0), to[1], axis=1)
    want = fine.reshape(to[0], h, to[1], w).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(pixels, *to), want)


def test_tiles_are_npy_files():
    pixels = np.random.default_rng(4).integers(0, 256, (50, 20, 3), np.uint8)
    tile = np.load(io.BytesIO(media.tile_of(pixels)))
    assert tile.shape == (16, 16) and tile.dtype == np.uint8
    assert len(media.difference_hash(media.grey(pixels))) == 16
    assert media.difference_hash(np.tile(np.arange(90, 0, -10), (8, 1))) == "f" * 16


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "é" * 1000), (3, "é" * 1000), (None, "x" * 576), (4, "y" * 2_000_000)]])
def test_texts_are_stored_whole(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, media string")
    got = media.text_media(df, Scratch(spark, "t")).collect()
    want = []
    for i, text in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        image = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)


def test_described_columns(spark):
    df = spark.createDataFrame([(1, bytearray(b"P5 2 1 255\n\x00\xff")), (2, None), (3, bytearray(b"junk"))], "id long, media binary")
    got = {r["id"]: (r["height"], r["width"], r["dhash"]) for r in media.described(df).collect()}
    assert got[1][:2] == (1, 2) and got[2] == got[3] == (None, None, None)


def test_legacy_files_of_many_records_are_a_table(spark, tmp_path):
    import gzip

    want = {}
    for version in (1, 2):
        for packed in (False, True):
            records = [(f"http://h/{version}/{i} x", f"HTTP/1.1 200 OK\r\nA: b\r\n\r\n{'page ' * i}".encode() if i % 3 else b"no header" * i) for i in range(40)]
            parts = [archive.arc_version_block(version, "old.arc"), *(archive.arc_record(version, url, block, "old.arc", 0, "19990203040506") for url, block in records)]
            name = f"old-{version}-{packed}.arc"
            (tmp_path / name).write_bytes(b"".join(map(gzip.compress, parts)) if packed else b"".join(parts))
            want |= {(name, i): r for i, r in enumerate(records)}
    (tmp_path / "empty.arc").write_bytes(b"")
    got = archive.arc_table(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert len(got) == len(want)
    for r in got:
        url, block = want[(r["file"].rsplit("/", 1)[1], r["record"])]
        fields, body = next(archive.warc_records(io.BytesIO(r["warc"])))
        payload = archive.split_http(block)[1]
        assert (r["url"], r["date"], r["payload_bytes"], body) == (url, "19990203040506", len(payload), block)
        assert fields["WARC-Date"] == "1999-02-03T04:05:06Z" and r["payload_digest"] == hashlib.sha1(payload).hexdigest()
    assert len({next(archive.warc_records(io.BytesIO(r["warc"])))[0]["WARC-Record-ID"] for r in got}) == len(got)


def test_header_lines_with_spaces_and_short_dates():
    read = lambda line, n: archive.header_values(line, n)
    assert read("http://a/ 1.2.3.4 20240101000000 text/html; charset=utf-8 12", 5) == ["http://a/", "1.2.3.4", "20240101000000", "text/html; charset=utf-8", "12"]
    assert read("http://a/x y 2001:db8::1 20240229 text/html 0", 5) == ["http://a/x y", "2001:db8::1", "20240229000000", "text/html", "0"]
    assert read("http://a/ 1.2.3.4 202401020304 a/b; c=d 200 - - 0 f.arc 7", 10) == ["http://a/", "1.2.3.4", "20240102030400", "a/b; c=d", "200", "-", "-", "0", "f.arc", "7"]
    for line in ("http://a/ 1.2.3.4 20241301 text/html 5", "http://a/ 1.2.3.4 20240230 t 5", "http://a/ host 20240101 text/html 5", "http://a/ 1.2.3.4 20240101 text/html x", "http://a/ 1.2.3.4 2024 text/html 5", ""):
        with pytest.raises(ValueError, match="ARC header line"):
            read(line, 5)
    block = b"HTTP/1.1 200 OK\r\n\r\nhi"
    data = archive.arc_version_block(1, "x.arc") + b"http://a/ 1.2.3.4 20240101 text/html; charset=utf-8 %d\n" % len(block) + block + b"\n"
    (record,) = archive.arc_records(io.BytesIO(data))
    assert record.fields["Content-type"] == "text/html; charset=utf-8" and b"WARC-Date: 2024-01-01T00:00:00Z" in archive.warc_record(record, 1)

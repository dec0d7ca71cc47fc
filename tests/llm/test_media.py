import hashlib
import io
import zlib

import numpy as np
import pytest

from colophon.llm import media
from tests.llm.cases import docs, empty, rows


def area_by_hand(pixels, height, width):
    h, w, c = pixels.shape
    big = np.repeat(np.repeat(pixels.astype(float), height, axis=0), width, axis=1)
    return big.reshape(height, h, width, w, c).mean(axis=(1, 3))


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (8, 8), (13, 2), (40, 7)])
def test_round_trips_and_area_resize(shape):
    pixels = np.random.default_rng(1).integers(0, 256, (*shape, 3), np.uint8)
    assert (media.decode(media.encode_netpbm(pixels)) == pixels).all()
    assert (media.decode(media.encode_bmp(pixels)) == pixels).all()
    assert (media.decode(media.encode_netpbm(pixels[:, :, 0]))[:, :, 0] == pixels[:, :, 0]).all()
    assert np.allclose(media.resize_area(pixels, 4, 6), area_by_hand(pixels, 4, 6))


def test_netpbm_kinds_by_hand():
    grey = [[0, 128, 255], [7, 9, 11]]
    as_list = lambda data: media.decode(data)[:, :, 0].tolist()
    assert as_list(b"P2 # note\n3 2\n255\n0 128 255\n7 9 11\n") == grey
    assert as_list(b"P5\n3 2\n255\n" + bytes(sum(grey, []))) == grey
    assert as_list(b"P2\n2 1\n15\n15 5\n") == [[255, 85]]
    assert as_list(b"P5\n2 1\n65535\n\xff\xff\x80\x00") == [[255, 128]]
    assert as_list(b"P1\n3 2\n1 0 1\n011") == [[0, 255, 0], [255, 0, 0]]
    assert as_list(b"P4\n3 2\n" + bytes([0b10100000, 0b01100000])) == [[0, 255, 0], [255, 0, 0]]
    assert as_list(b"P4\n9 1\n" + bytes([0xFF, 0x00])) == [[0] * 8 + [255]]
    assert media.decode(b"P3\n1 2\n255\n1 2 3 4 5 6").tolist() == [[[1, 2, 3]], [[4, 5, 6]]]
    for bad in (b"P1\n3 2\n1 0", b"P4\n9 2\n\xff", b"P2\n2 2\n255\n1 2 3", b"P5\n1 1\n0\n\x00", b"P7\n", b"P6"):
        with pytest.raises((ValueError, IndexError)):
            media.decode(bad)


def bmp(depth, width, height, body, palette=b"", colours=0):
    at = 54 + len(palette)
    return media.BMP_HEADER.pack(b"BM", at + len(body), 0, 0, at, 40, width, height, 1, depth, 0, len(body), 0, 0, colours, 0) + palette + body


def test_bmp_kinds_by_hand():
    palette = bytes([10, 20, 30, 0, 40, 50, 60, 0])
    one, two = [30, 20, 10], [60, 50, 40]
    assert media.decode(bmp(8, 2, -1, bytes([1, 0, 0, 0]), palette, 2)).tolist() == [[two, one]]
    assert media.decode(bmp(8, 2, 2, bytes([1, 0, 0, 0, 0, 0, 0, 0]), palette, 2)).tolist() == [[one, one], [two, one]]
    assert media.decode(bmp(1, 3, -1, bytes([0b01100000, 0, 0, 0]), palette)).tolist() == [[one, two, two]]
    assert media.decode(bmp(4, 3, -1, bytes([0x01, 0x10, 0, 0]), palette + bytes(56))).tolist() == [[one, two, two]]
    assert media.decode(bmp(32, 1, -1, bytes([1, 2, 3, 99]))).tolist() == [[[3, 2, 1]]]
    assert media.decode(bmp(24, 1, -1, bytes([1, 2, 3, 0]))).tolist() == [[[3, 2, 1]]]
    for bad in (bmp(8, 2, -1, bytes([5, 0, 0, 0]), palette, 2), bmp(16, 1, -1, bytes(4)), bmp(32, 2, -1, bytes(4))):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_damaged_images_are_rows(spark):
    good = media.encode_netpbm(np.zeros((5, 3, 3), np.uint8))
    frame = spark.createDataFrame([(1, good), (2, b"P6\n9 9\n255\nxx"), (3, None), (4, b"")], "id bigint, media binary")
    got = media.image_tiles(frame, 2).collect()
    assert sum(r.id == 1 for r in got) == 6 and all(r.error for r in got if r.id != 1) and len(got) == 9
    assert np.load(io.BytesIO(bytes(got[0].tile))).dtype == np.uint8


def test_texts_are_stored_and_read_back(spark):
    got = media.text_media(docs(spark)).collect()
    assert len(got) == len(rows())
    texts = {}
    for r in got:
        texts.setdefault(r.media_sha256, set()).add((r.payload_sha256, r.feature))
        assert r.payload_bytes % 192 == 0 and r.payload_bytes >= max(192, r.n_bytes)
        back = media.decode(bytes(r.media)).tobytes()
        assert hashlib.sha256(back).hexdigest() == r.payload_sha256 and zlib.crc32(back[-16:]) == r.tail_crc32
    assert all(len(v) == 1 for v in texts.values())
    by = {(r.doc_id, r.n_bytes): r for r in got}
    assert by[2, 0].payload_sha256 == by[3, 0].payload_sha256 == hashlib.sha256(b" " * 192).hexdigest()
    assert media.text_media(empty(spark)).count() == 0

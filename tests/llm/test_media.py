from __future__ import annotations

import hashlib
import io
import zlib

import numpy as np
import pytest

from fathomline.llm import media


def test_formats_round_trip():
    rnd = np.random.default_rng(1)
    for h, w in ((1, 1), (3, 5), (40, 33)):
        grey, colour = rnd.integers(0, 256, (h, w), np.uint8), rnd.integers(0, 256, (h, w, 3), np.uint8)
        assert (media.decode(media.encode_pgm(grey)) == grey).all()
        assert (media.decode(media.encode_ppm(colour)) == colour).all()
        assert (media.decode(media.encode_bmp(colour)) == colour).all()


def test_other_netpbm_kinds():
    assert media.decode(b"P1\n# note\n3 1\n1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode(b"P2 2 1 100 0 100").tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    for bad in (b"", b"P5 2 2 255\n\0", b"BM", b"GIF89a", b"P9 1 1 1\n0"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_is_the_mean_of_areas(monkeypatch):
    image = np.random.default_rng(2).integers(0, 256, (21, 17), np.uint8)
    fine = np.kron(image, np.ones((8, 9)))  # 168 x 153, divisible by 8 and 9
    want = np.rint(fine.reshape(8, 21, 9, 17).mean(axis=(1, 3)))
    monkeypatch.setattr(media, "BLOCK_ROWS", 4)
    assert np.abs(media.area_resize(image, 8, 9).astype(int) - want).max() <= 1
    assert (np.load(io.BytesIO(media.npy(image))) == image).all()


def test_text_media(docs, nothing):
    rows = {r.doc_id: r for r in media.text_media(docs).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for i, data in texts.items():
        if i is None:
            continue
        padded = data + b"\0" * (-len(data) % 64 or (64 if not data else 0))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
    assert rows[1].feature == rows[2].feature and rows[1].media_sha256 == rows[2].media_sha256
    assert media.text_media(nothing).count() == 0


HOSTILE = [
    b"P5 99999999999 99999999999 255\n\0", b"P5 99999999999999999999 1 255\n\0", b"P2 1 1 255 99999999999999999999", b"P2 2 1 255 -5 300", b"P2 1 1 100 101",
    b"P5 1 1 0\n\0", b"P5 1 1 70000\n\0\0", b"P2 1 1 255 x", b"P4 100000 100000\n\0", b"BM" + b"\xff" * 60, media.encode_bmp(np.zeros((2, 2, 3), np.uint8))[:60],
]


def test_hostile_images_are_errors_of_their_row(spark):
    rows = media.image_tiles(spark.createDataFrame([(str(i), d, "x") for i, d in enumerate(HOSTILE)], "id string, media binary, tile string"), "id", "media").collect()
    assert len(rows) == len(HOSTILE) and all(r.error and r.tile is None and r.height is None for r in rows)
    dated = spark.sql("SELECT DATE'2024-01-01' AS id, CAST(NULL AS BINARY) AS media")
    assert str(media.image_tiles(dated, "id", "media").first().id) == "2024-01-01"


def test_image_tiles(spark):
    image = np.random.default_rng(3).integers(0, 256, (50, 60, 3), np.uint8)
    data = [(1, media.encode_bmp(image)), (2, media.encode_ppm(image)), (3, b"?"), (4, None), (5, b"")]
    rows = {r.id: r for r in media.image_tiles(spark.createDataFrame(data, "id long, media binary"), "id", "media").collect()}
    assert rows[1].dhash == rows[2].dhash and rows[1].tile == rows[2].tile
    assert np.load(io.BytesIO(rows[1].tile)).shape == (32, 32)
    assert all(rows[i].error and rows[i].tile is None for i in (3, 4, 5))

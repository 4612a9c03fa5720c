"""Image files: every filter and depth of PNG, portable maps, and files that can't be read."""

import struct
import zlib

import numpy as np
import pytest

from examlake.operators import page_images
from examlake.sources import images


def filtered(rows, kinds, step):
    """Filters applied byte by byte."""
    out = bytearray()
    for r, (row, kind) in enumerate(zip(rows, kinds, strict=True)):
        up = rows[r - 1] if r else bytes(len(row))
        out.append(kind)
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
    return bytes(out)


def png(samples, colour, depth=8, kinds=None, palette=None, interlaced=0):
    h, w = samples.shape[:2]
    if depth == 8:
        rows = [samples[r].tobytes() for r in range(h)]
    elif depth == 16:
        rows = [samples[r].astype(">u2").tobytes() for r in range(h)]
    else:
        rows = [np.packbits(np.array([[v >> k & 1 for k in range(depth - 1, -1, -1)] for v in samples[r]], np.uint8).ravel()).tobytes() for r in range(h)]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    body = zlib.compress(filtered(rows, kinds or [0] * h, max(1, channels * depth // 8)))
    half = len(body) // 2
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", body[:half]) + chunk(b"IDAT", body[half:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour, channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_all_filters(colour, channels):
    rng = np.random.default_rng(colour)
    for h, w in ((1, 1), (9, 5), (14, 23)):
        x = rng.integers(0, 256, (h, w, channels)).astype(np.uint8)
        for kinds in ([k] * h for k in range(5)):
            assert (images.decoded(png(x, colour, kinds=kinds)) == x[:, :, : channels - (channels in (2, 4)) or 1]).all()
        mixed = rng.integers(0, 5, h).tolist()
        assert (images.decoded(png(x, colour, kinds=mixed)) == x[:, :, : channels - (channels in (2, 4)) or 1]).all()


def test_depths_and_palettes():
    rng = np.random.default_rng(1)
    for depth in (1, 2, 4):
        x = rng.integers(0, 1 << depth, (7, 11))
        assert (images.decoded(png(x, 0, depth))[:, :, 0] == x * (255 // ((1 << depth) - 1))).all()
        palette = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
        assert (images.decoded(png(x, 3, depth, palette=palette)) == palette[x]).all()
    deep = rng.integers(0, 65536, (5, 6, 3))
    assert (images.decoded(png(deep, 2, 16, kinds=[4] * 5)) == deep >> 8).all()


def test_portable_maps():
    x = np.random.default_rng(2).integers(0, 256, (4, 6)).astype(np.uint8)
    assert (images.decoded(b"P5\n# a note\n6 4\n255\n" + x.tobytes())[:, :, 0] == x).all()
    assert (images.decoded(b"P2 6 4 255\n" + " ".join(map(str, x.ravel())).encode())[:, :, 0] == x).all()
    assert (images.decoded(b"P5 6 4 65535\n" + (x.astype(">u2") * 257).tobytes())[:, :, 0] == x).all()
    rgb = np.dstack([x, x // 2, 255 - x])
    assert (images.decoded(b"P6 6 4 255 " + rgb.tobytes()) == rgb).all()
    assert images.grey_of(rgb)[1, 2] == round(0.299 * rgb[1, 2, 0] + 0.587 * rgb[1, 2, 1] + 0.114 * rgb[1, 2, 2])
    assert images.saturation(np.dstack([x, x, x])) == 0 and images.saturation(np.full((2, 2, 3), (200, 100, 0), np.uint8)) == 255


def test_files_that_cannot_be_read():
    good = png(np.zeros((6, 6, 1), np.uint8), 0)
    cases = {b"": "TOO_SMALL", b"x" * 40: "UNKNOWN_FORMAT", good[:-20]: "CORRUPT", good[:45] + bytes([good[45] ^ 1]) + good[46:]: "CORRUPT", good[:8] + b"\0" * 30: "CORRUPT", b"P5 6 4 255\n" + b"abc" * 4: "CORRUPT", b"P5 x 4 255\n" + b"abc" * 9: "CORRUPT", png(np.zeros((6, 6, 1), np.uint8), 0, interlaced=1): "UNSUPPORTED", b"P2 2 2 255 1 2 x 4      ": "CORRUPT"}
    for raw, why in cases.items():
        with pytest.raises(images.Unreadable, match=why):
            images.decoded(raw)


def test_a_folder_of_images_is_measured(spark, tmp_path):
    page = np.full((320, 310), 220, np.uint8)
    page[40:280:20, 40:270] = 50
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "one.png").write_bytes(png(page[:, :, None], 0, kinds=[4] * 320))
    (tmp_path / "two.pgm").write_bytes(b"P5 310 320 255\n" + page.tobytes())
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"junk" * 9)
    (tmp_path / "note.txt").write_text("no image")
    found = {r.page_id.rsplit("/", 1)[1]: r for r in images.image_files(spark, str(tmp_path)).collect()}
    assert {k: r.problem for k, r in found.items()} == {"one.png": None, "two.pgm": None, "bad.png": "CORRUPT"}
    assert bytes(found["one.png"].pixels) == page.tobytes() == bytes(found["two.pgm"].pixels) and found["one.png"].saturation == 0
    assert [r.path.rsplit("/", 1)[1] for r in images.ordered_paths(spark, str(tmp_path)).collect()] == ["one.png", "bad.png", "two.pgm"]
    evidence = {r.page_id.rsplit("/", 1)[1]: r for r in page_images.page_evidence(images.image_files(spark, str(tmp_path))).collect()}
    assert evidence["one.png"].paper_white == 220 and evidence["two.pgm"].luminance == pytest.approx(page.mean(), abs=1e-5) and evidence["bad.png"].luminance is None
    rows = spark.createDataFrame([(1, None), (None, bytearray(png(page[:9, :9, None], 0)))], "k long, b binary")
    assert {(r.page_id, r.problem, r.width) for r in images.decoded_images(rows, "k", "b").collect()} == {(1, "MISSING", None), (None, None, 9)}

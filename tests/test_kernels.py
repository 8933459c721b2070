"""Pixel kernels, EXIF and columns against golden values and scalar definitions."""

import hashlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from photonlake.functions import photo, raster
from photonlake.operators.ingest import shutter_seconds
from photonlake.sources import codecs, exif


def checker(h, w, s):
    y, x = np.mgrid[0:h, 0:w]
    return np.where((x // s ^ y // s) & 1, 255, 0).astype(np.uint8)


def inside(h, w, s, box):
    x0, x1, y0, y1 = box
    out = np.full((h, w), 128, np.uint8)
    out[y0:y1, x0:x1] = checker(h, w, s)[y0:y1, x0:x1]
    return out


def tiles(amplitude, cells):
    out = np.full((768, 1024), 128, np.uint8)
    pattern = np.where(checker(768, 1024, 4) > 0, 128 + amplitude // 2, 128 - amplitude // 2).astype(np.uint8)
    for r, c in cells:
        out[64 * r : 64 * r + 64, 64 * c : 64 * c + 64] = pattern[64 * r : 64 * r + 64, 64 * c : 64 * c + 64]
    return out


GOLDEN = [
    (np.full((384, 512), 128, np.uint8), False, (0, 0, 0, 0), True),
    (checker(384, 512, 8), False, (39972.2513, 40640.625, 1, 1), False),
    (inside(384, 512, 4, (208, 304, 144, 240)), False, (4486.5324, 53348.832, 0.0833, 0.0833), False),
    (inside(384, 512, 4, (224, 288, 160, 224)), True, (1965.9038, 23376.3672, 0.0833, 0.0833), False),
    (tiles(24, [(5, 7)]), False, (4.3337, 819.2812, 0.0052, 0.0052), True),
    (tiles(24, [(5, 7)]), True, (4.3337, 819.2812, 0.0052, 0.0052), False),
    (tiles(28, [(5, 7)]), False, (5.8986, 1115.1328, 0.0052, 0.0052), False),
    (tiles(16, [(r, c) for r in range(3, 8) for c in range(4, 10)]), False, (59.8146, 384.0, 0.1562, 0.1562), False),
    (tiles(16, [(r, c) for r in range(0, 11, 2) for c in range(0, 15, 2)][:30]), False, (57.4142, 365.8433, 0.1562, 0.0052), True),
]


@pytest.mark.parametrize(("gray", "bokeh", "want", "blurry"), GOLDEN)
def test_blur_goldens(gray, bokeh, want, blurry):
    got = raster.compute_blur(gray, bokeh)
    values = [got[k] for k in ("laplacian_variance", "max_tile_variance", "sharp_tile_fraction", "largest_sharp_cluster")]
    assert values == pytest.approx(want, abs=6e-5, rel=1e-6)
    assert got["is_blurry"] is blurry


def test_blur_edges():
    for shape in ((2, 50), (50, 2), (0, 0)):
        got = raster.compute_blur(np.zeros(shape, np.uint8))
        assert got["is_blurry"]
        assert got["laplacian_variance"] == 0
    got = raster.compute_blur(checker(20, 20, 2))
    assert got["mean_tile_variance"] == got["max_tile_variance"] == got["p95_tile_variance"] == got["laplacian_variance"] > 100
    assert (got["sharp_tile_fraction"], got["is_blurry"]) == (0, False)


def scalar_blur(gray, tile):
    h, w = gray.shape
    sums = {}
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            lap = int(gray[y - 1, x]) + int(gray[y + 1, x]) + int(gray[y, x - 1]) + int(gray[y, x + 1]) - 4 * int(gray[y, x])
            sums.setdefault((y // tile, x // tile), []).append(lap)
    every = [v for s in sums.values() for v in s]
    return float(np.var(every)), {k: float(np.var(v)) for k, v in sums.items() if len(v) >= int(tile * tile * 0.25)}


@settings(max_examples=30, deadline=None)
@given(st.integers(3, 30), st.integers(3, 30), st.integers(0, 10**6))
def test_blur_like_a_scalar_version(h, w, seed):
    gray = np.random.default_rng(seed).integers(0, 256, (h, w), dtype=np.uint8)
    overall, var = scalar_blur(gray, 8)
    got = raster.compute_blur(gray, tile=8)
    assert got["laplacian_variance"] == pytest.approx(overall)
    if var:
        assert got["mean_tile_variance"] == pytest.approx(np.mean(list(var.values())))
        assert got["p95_tile_variance"] == pytest.approx(sorted(var.values())[min(int(0.95 * len(var)), len(var) - 1)])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 8), st.integers(1, 8), st.integers(0, 10**6))
def test_largest_cluster(h, w, seed):
    cells = np.random.default_rng(seed).random((h, w)) < 0.55
    seen, best = set(), 0
    for start in zip(*np.nonzero(cells), strict=True):
        stack, n = [tuple(map(int, start))], 0
        while stack:
            y, x = stack.pop()
            if (y, x) in seen or not (0 <= y < h and 0 <= x < w and cells[y, x]):
                continue
            seen.add((y, x))
            n += 1
            stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        best = max(best, n)
    assert raster.largest_cluster(cells) == best


def test_exposure():
    gray = np.array([[24, 25, 230, 229]], np.uint8)
    got = raster.compute_exposure(gray)
    assert (got["pct_underexposed"], got["pct_overexposed"], got["verdict"]) == (0.25, 0.25, "Normal")
    edge = np.array([[0] * 3 + [100] * 7], np.uint8)
    assert raster.compute_exposure(edge)["verdict"] == "Normal"  # a share of exactly 0.30
    assert raster.compute_exposure(np.array([[0] * 4 + [255] * 4 + [9] * 2], np.uint8))["verdict"] == "HighContrast"
    assert raster.compute_exposure(np.zeros((0, 0), np.uint8)) == {"mean_luminance": 0.0, "pct_underexposed": 0.0, "pct_overexposed": 0.0, "verdict": "Normal"}


def test_subject_focus():
    gray = np.full((384, 512), 128, np.uint8)
    gray[:, :256] = checker(384, 512, 4)[:, :256]
    left = raster.compute_subject_focus(gray, [[0, 0, 0.49, 1]])
    assert (left["verdict"], left["subject_blur_variance"], left["background_blur_variance"]) == ("SubjectSharp", pytest.approx(96678.217), pytest.approx(1869.176, abs=1e-3))
    right = raster.compute_subject_focus(gray, [[0.52, 0, 0.48, 1]])
    assert (right["verdict"], right["subject_blur_variance"]) == ("BackFocus", 0)
    assert right["background_blur_variance"] == pytest.approx(92690.0, abs=0.05)
    assert raster.compute_subject_focus(gray, [[0, 0, 1, 1]]) is None
    assert raster.compute_subject_focus(gray, None) is None
    flat = raster.compute_subject_focus(np.full((40, 40), 9, np.uint8), [[0.2, 0.2, 0.4, 0.4]])
    assert (flat["verdict"], flat["focus_ratio"]) == ("AllBlurry", 10.0)


def test_orientation_and_size():
    r = np.arange(6, dtype=np.uint8).reshape(2, 3)
    want = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]], 9: [[0, 1, 2], [3, 4, 5]]}
    for k, v in want.items():
        assert raster.orient(r, k).tolist() == v
    assert raster.fit_within(4000, 3000, 1024) == (1024, 768)
    assert raster.fit_within(5000, 1, 300) == (300, 1)
    assert raster.shrink(np.zeros((10, 20), np.uint8), 1024).shape == (10, 20)
    assert raster.resize(np.full((50, 70, 3), 77, np.uint8), 7, 5).tolist() == np.full((5, 7, 3), 77).tolist()


def test_perceptual_hash():
    rng = np.random.default_rng(4)
    big = raster.resize(rng.integers(0, 256, (12, 12), dtype=np.uint8), 96, 96)
    a, b = raster.perceptual_hash(big), raster.perceptual_hash(np.clip(big.astype(int) + 3, 0, 255).astype(np.uint8))
    assert len(a) == 18
    apart = sum(bin(x ^ y).count("1") for x, y in zip(a, b, strict=True))
    assert apart <= 10 < sum(bin(x ^ y).count("1") for x, y in zip(a, raster.perceptual_hash(np.rot90(big)), strict=True))


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.booleans(), st.integers(0, 10**6))
def test_png_round_trip(h, w, colour, seed):
    r = np.random.default_rng(seed).integers(0, 256, (h, w, 3) if colour else (h, w), dtype=np.uint8)
    assert (codecs.decode(codecs.encode_png(r)) == r).all()


def tiff(order="<", turn=6):
    """EXIF with every field, in either byte order."""
    heap, base = bytearray(), [8]

    def directory(entries, at):
        body = struct.pack(order + "H", len(entries))
        for tag, kind, count, raw in entries:
            if len(raw) > 4:
                body += struct.pack(order + "HHII", tag, kind, count, heap_at + len(heap))
                heap.extend(raw)
            else:
                body += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
        return body + struct.pack(order + "I", 0)

    heap_at = 400
    ratio = lambda *xs: b"".join(struct.pack(order + "II", *x) for x in xs)
    short = lambda v: struct.pack(order + "H", v)
    main = directory([(0x010F, 2, 6, b'"Acme"\0'[:7]), (0x0110, 2, 3, b"X1\0"), (0x0112, 3, 1, short(turn)), (0x8769, 4, 1, struct.pack(order + "I", 120)), (0x8825, 4, 1, struct.pack(order + "I", 260))], 8)
    sub = directory([(0x829A, 5, 1, ratio((1, 250))), (0x829D, 5, 1, ratio((18, 10))), (0x8827, 3, 1, short(400)), (0x9003, 2, 20, b"2024:01:15 14:30:00\0"), (0x920A, 5, 1, ratio((85, 1)))], 120)
    gps = directory([(1, 2, 2, b"S\0"), (2, 5, 3, ratio((40, 1), (30, 1), (0, 1))), (3, 2, 2, b"E\0"), (4, 5, 3, ratio((10, 1), (15, 1), (36, 1)))], 260)
    del base
    out = bytearray(400)
    out[0:8] = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    out[8 : 8 + len(main)], out[120 : 120 + len(sub)], out[260 : 260 + len(gps)] = main, sub, gps
    return bytes(out + heap)


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    body = b"Exif\0\0" + tiff(order)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"
    want = {"date_time_original": "2024:01:15 14:30:00", "gps_lat": -40.5, "gps_lng": 10.26, "camera_make": "Acme", "camera_model": "X1", "focal_length_mm": 85.0, "aperture": 1.8, "iso": 400, "shutter_speed": "1/250 s", "orientation": 6}
    assert exif.read_exif(jpeg) == pytest.approx(want)
    assert exif.read_exif(tiff(order)) == pytest.approx(want)
    assert exif.read_orientation(jpeg) == 6
    for cut in range(0, len(jpeg), 7):
        exif.read_exif(jpeg[:cut])  # never raises
    assert exif.read_exif(b"\xff\xd8\xff\xda") is None
    assert exif.gps_degrees([(40, 1), (30, 1)], "N") is None


SHUTTER = {"1/250": 0.004, "1/250 s": 0.004, "0.5": 0.5, '"1/8000"': 0.000125, None: None, "1/0": None, "abc": None, "1/1.6 s": 0.625}


def test_shutter(spark):
    df = spark.createDataFrame([(t,) for t in SHUTTER], "t string")
    got = {r.t: r.s for r in df.select("t", photo.shutter_seconds(F.col("t")).alias("s")).collect()}
    assert got == pytest.approx(SHUTTER)
    assert {t: shutter_seconds(t) for t in SHUTTER} == pytest.approx(SHUTTER)


def test_intent(spark):
    rows = [(5.6, 200.0, "1/30", False, True), (2.79, None, None, True, False), (2.8, 50.0, None, False, False), (3.9, 70.0, None, True, False), (4.0, 70.0, None, False, False), (None, None, None, False, False)]
    df = spark.createDataFrame([r[:3] for r in rows], "a double, f double, s string")
    got = [tuple(r) for r in df.select(photo.bokeh_likely(F.col("a"), F.col("f")), photo.shake_risk(F.col("s"), F.col("f"))).collect()]
    assert got == [r[3:] for r in rows]


def test_dates_sizes_ids(spark):
    dates = {"2024:01:15 14:30:00": 1705329000, "2024-01-15 14:30:00": 1705329000, '"2024-01-15 14:30:00" ': 1705329000, "2024:01-15 14:30:00": None, "soon": None, None: None, "2024:13:15 14:30:00": None}
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.createDataFrame([(d,) for d in dates], "d string")
        assert {r.d: r.s for r in df.select("d", photo.exif_seconds(F.col("d")).alias("s")).collect()} == dates
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.createDataFrame([("/p/é.jpg", 1700000000), ("", 0)], "p string, m long")
    want = [hashlib.sha256(p.encode() + m.to_bytes(8, "little")).hexdigest() for p, m in df.collect()]
    assert [r[0] for r in df.select(photo.image_id(F.col("p"), F.col("m"))).collect()] == want
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 1048576: "1.0 MB", 5 * 1024**3: "5120.0 MB"}
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    assert {r.s: r.t for r in df.select("s", photo.format_size(F.col("s")).alias("t")).collect()} == sizes
    kept = spark.createDataFrame([(p,) for p in ("a.JPG", "b.Cr3", "c.gif", "d", "e.txt", "x.d/y")], "p string").where(photo.is_photo(F.col("p")))
    assert [r.p for r in kept.collect()] == ["a.JPG", "b.Cr3"]


def test_eyes(spark):
    def box(w, h, n=4):
        return [(0.0, 0.0), (w, 0.0), (0.0, h), (w, h)][:n]

    cases = [(box(1.0, 0.05), 0.0), (box(1.0, 0.20), 0.5), (box(1.0, 0.35), 1.0), (box(1.0, 0.2, 3), 1.0), (box(0.0005, 0.2), 1.0), ([], 1.0), (None, 1.0)]
    df = spark.createDataFrame([(p,) for p, _ in cases], "p array<struct<x:double,y:double>>")
    assert [r[0] for r in df.select(photo.eye_openness(F.col("p"))).collect()] == pytest.approx([w for _, w in cases])
    df = spark.createDataFrame([(0.29, 0.9), (0.3, 0.3)], "a double, b double")
    assert [r[0] for r in df.select(photo.face_closed(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_hamming_and_cosine(spark):
    df = spark.createDataFrame([(b"\x00\xff", b"\x01\x0f\xff", [1.0, 0.0], [1.0, 1.0, 5.0]), (b"", b"\x01", [0.0, 0.0], [1.0, 2.0])], "a binary, b binary, x array<double>, y array<double>")
    got = df.select(photo.hamming_binary(F.col("a"), F.col("b")), photo.cosine(F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in got] == [5, 0]
    # Norms are of whole vectors, the product goes as far as the shorter.
    assert [r[1] for r in got] == pytest.approx([27**-0.5, 0.0])
    three = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0, 12.0])], "x array<double>, y array<double>")
    assert three.select(photo.cosine(F.col("x"), F.col("y"))).first()[0] == pytest.approx(25 / 65)


def test_progress(spark):
    df = spark.createDataFrame([(50, 200, 1000), (0, 200, 0), (0, 0, 5)], "c long, t long, ms long")
    got = [tuple(r[0]) for r in df.select(photo.progress(F.col("c"), F.col("t"), F.col("ms"))).collect()]
    assert got == [(50.0, 3.0, 25), (None, None, 0), (None, None, None)]


@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (17, 30), (9, 20, 3), (40, 56, 3)])
@pytest.mark.parametrize("quality", [20, 80, 100])
def test_jpeg_round_trip(shape, quality):
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    pixels = np.stack([x * 4 + 20, y * 5 + 9, (x + y) * 2 + 40], axis=2).astype(np.uint8)
    pixels = pixels if len(shape) == 3 else pixels[..., 0]
    got = codecs.decode(codecs.encode_jpeg(pixels, quality))
    assert got.shape == pixels.shape
    assert np.abs(got.astype(int) - pixels).mean() < {20: 14, 80: 5, 100: 1.5}[quality]


def test_code_lengths():
    for times in ({7: 5}, {1: 1, 2: 1}, {k: 1 for k in range(162)}, {k: 2**k for k in range(30)}):
        found = codecs.code_lengths(dict(times))
        assert sorted(s for _, s in found) == sorted(times)
        assert max(n for n, _ in found) <= 16
        assert sum(2.0**-n for n, _ in found) < 1  # the code of all ones is free

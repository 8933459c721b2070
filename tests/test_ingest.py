"""Scanning and analysing real files: names that Spark hides, links, broken photos, thumbnails, deletion."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonlake.functions import raster
from photonlake.operators import ingest
from photonlake.operators.library import Library, NoResults
from photonlake.sources import codecs, fixtures, photos
from photonlake.settings import Settings
from photonlake.sources.photos import discover


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "photos"
    for name in ("_DSC0001.JPG", ".h.jpg", "_sub/s.jpg", "n.jpg", "ok/a b é#1.jpg", "notes.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * 10)
    os.symlink(root / "ok", root / "linked")
    os.symlink(root / "n.jpg", root / "link.jpg")
    return root


def test_scan(spark, tree):
    got = sorted(os.path.relpath(r.path, tree) for r in discover(spark, str(tree)).collect())
    assert got == sorted(["_DSC0001.JPG", ".h.jpg", "_sub/s.jpg", "n.jpg", "ok/a b é#1.jpg"])
    assert discover(spark, str(tree), photos_only=False).count() == 6
    assert {r.file_size for r in discover(spark, str(tree)).collect()} == {10}
    with pytest.raises(ValueError, match="Invalid directory path"):
        discover(spark, str(tree / "n.jpg"))


def test_scan_opens_a_bounded_number_of_directories(tree, monkeypatch):
    for k in range(30):
        (tree / f"d{k % 3}" / f"e{k}" / "f").mkdir(parents=True)
        (tree / f"d{k % 3}" / f"e{k}" / "f" / f"{k}.jpg").write_bytes(b"x")
    found = []
    for frontier, opened in ((512, 4096), (4, 4096), (512, 2), (1, 1)):
        monkeypatch.setattr(photos, "FRONTIER", frontier)
        monkeypatch.setattr(photos, "OPENED", opened)
        reader = photos.PhotoReader(str(tree), True)
        parts = reader.partitions()
        assert sum(len(p.paths) for p in parts if not p.deep) <= opened
        found.append(sorted(row for p in parts for row in reader.read(p)))
    assert len(found[0]) == 35
    assert all(f == found[0] for f in found)


def java_jpeg(spark, rgb):
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    h, w, _ = rgb.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    values = gateway.new_array(jvm.int, w * h)
    flat = rgb.astype(int)
    for i, v in enumerate(((flat[..., 0] << 16) | (flat[..., 1] << 8) | flat[..., 2]).ravel().tolist()):
        values[i] = v
    image.setRGB(0, 0, w, h, values, 0, w)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def test_jpeg_like_java(spark, tmp_path):
    y, x = np.mgrid[0:45, 0:61]
    rgb = np.stack([x * 4, y * 5, (x + y) * 2], axis=2).astype(np.uint8)
    data = java_jpeg(spark, rgb)
    (tmp_path / "a.jpg").write_bytes(data)
    image = spark.read.format("image").load(str(tmp_path / "a.jpg")).select("image.*").first()
    want = np.frombuffer(image.data, np.uint8).reshape(image.height, image.width, 3)[..., ::-1]
    got = codecs.decode(data)
    assert got.shape == want.shape
    # Two decoders may interpolate chroma differently, so single pixels are compared loosely, all of them closely.
    assert np.abs(got.astype(int) - want).mean() < 2.5
    assert codecs.decode(data[:200]) is None
    assert codecs.decode(b"no image") is None


def test_pipeline(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    rng = np.random.default_rng(1)
    sharp = np.kron(rng.integers(0, 2, (48, 64), dtype=np.uint8) * 255, np.ones((4, 4), np.uint8))
    (root / "_sharp.png").write_bytes(codecs.encode_png(sharp))
    (root / "dark.png").write_bytes(codecs.encode_png(np.full((40, 50, 3), 5, np.uint8)))
    (root / "wide.png").write_bytes(codecs.encode_png(np.full((10, 2000), 128, np.uint8)))
    (root / "broken.jpg").write_bytes(b"\xff\xd8 nothing")
    (root / "raw.nef").write_bytes(b"raw")
    (root / "empty.png").write_bytes(b"")
    seen = lambda pixels: {"faces": [{"bounding_box": [0.1, 0.1, 0.3, 0.3], "left": 0.2, "right": 0.9, "embedding": [1.0, 2.0]}] if pixels.shape[0] == 192 else [], "salient": None}
    got = {r.file_name: r for r in ingest.analyse_photos(spark, str(root), seen, thumb_dir=str(tmp_path / "thumbs")).collect()}
    assert len(got) == 6
    assert (got["_sharp.png"].width, got["_sharp.png"].height) == (256, 192)
    assert got["_sharp.png"].blur.is_blurry is False
    assert got["_sharp.png"].closed_eyes.has_closed_eyes is True
    assert got["_sharp.png"].subject_focus.subject_source == "face"
    assert got["dark.png"].exposure.verdict == "Underexposed"
    assert (got["wide.png"].width, got["wide.png"].height) == (2000, 10)
    for name in ("broken.jpg", "raw.nef", "empty.png"):
        assert got[name].blur is None
        assert got[name].id
    thumb = codecs.decode(open(got["_sharp.png"].thumbnail_path, "rb").read())
    assert thumb.shape == (192, 256)  # small photos are not enlarged
    faces = ingest.face_rows(ingest.analyse_photos(spark, str(root), seen)).collect()
    assert [(r.face_index, r.embedding) for r in faces] == [(0, [1.0, 2.0])]


def test_jvm_decoder(spark, tmp_path):
    root = tmp_path / "in"
    (root / "a b é#1").mkdir(parents=True)
    (tmp_path / "elsewhere").mkdir()
    y, x = np.mgrid[0:64, 0:80]
    rgb = np.stack([x * 3, y * 3, x + y], axis=2).astype(np.uint8)
    data = java_jpeg(spark, rgb)
    for name in ("x.jpg", "_x.jpg", "a b é#1/y.JPG"):
        (root / name).write_bytes(data)
    (tmp_path / "elsewhere/z.jpg").write_bytes(data)
    os.symlink(tmp_path / "elsewhere", root / "linked")
    os.symlink(root / "x.jpg", root / "link.jpg")
    (root / "gray.png").write_bytes(codecs.encode_png(np.full((20, 30), 200, np.uint8)))
    (root / "broken.jpg").write_bytes(b"\xff\xd8 nothing")
    (root / "raw.nef").write_bytes(b"raw")
    kinds = [{r.path: r for r in ingest.analyse_photos(spark, str(root), jvm_decoder=k).collect()} for k in (False, True)]
    assert sorted(kinds[0]) == sorted(kinds[1])
    assert len(kinds[0]) == 6
    for path, a in kinds[0].items():
        b = kinds[1][path]
        assert (a.id, a.file_size, a.modified_at, a.width, a.height, a.file_name) == (b.id, b.file_size, b.modified_at, b.width, b.height, b.file_name)
        assert (a.blur is None) == (b.blur is None)
        if a.blur:
            assert a.exposure.mean_luminance == pytest.approx(b.exposure.mean_luminance, abs=0.01)


def tiff_with_directory_at_end(order, pixels):
    """Gray TIFF whose directories (size, strip, orientation, EXIF with an aperture and a date) follow the pixels."""
    h, w = pixels.shape
    date = b"2024:05:06 07:08:09\0"
    at = 8 + h * w
    at += at % 2
    exif_at = at + 2 + 12 * 10 + 4
    values_at = exif_at + 2 + 12 * 2 + 4

    def entry(tag, kind, count, value):
        return struct.pack(f"{order}HHI", tag, kind, count) + (struct.pack(f"{order}HH", value, 0) if kind == 3 else struct.pack(f"{order}I", value))

    main = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, 8), (274, 3, 1, 6), (278, 4, 1, h), (279, 4, 1, h * w), (0x8769, 4, 1, exif_at)]
    sub = [(0x829D, 5, 1, values_at), (0x9003, 2, len(date), values_at + 8)]
    out = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(f"{order}I", at) + pixels.tobytes()
    out = out.ljust(at, b"\0")
    for entries in (main, sub):
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entry(*e) for e in entries) + bytes(4)
    return out + struct.pack(f"{order}II", 18, 10) + date


def test_jvm_decoder_reads_exif_anywhere(spark, tmp_path):
    y, x = np.mgrid[0:560, 0:600]
    gray = ((x * 3 + y * 5) % 256).astype(np.uint8)
    files = {f"{k}.tiff": tiff_with_directory_at_end(order, gray) for k, order in enumerate("<>")}
    tiny = tiff_with_directory_at_end("<", gray[:2, :2])
    jpeg = java_jpeg(spark, np.stack([gray[:64, :80]] * 3, axis=2))
    app2 = b"\xff\xe2" + struct.pack(">H", 60_002) + bytes(60_000)
    files["late.jpg"] = jpeg[:2] + app2 * 5 + b"\xff\xe1" + struct.pack(">H", len(tiny) + 8) + b"Exif\0\0" + tiny + jpeg[2:]
    for name, data in files.items():
        assert len(data) > 300_000
        (tmp_path / name).write_bytes(data)
    kinds = [{r.file_name: r for r in ingest.analyse_photos(spark, str(tmp_path), jvm_decoder=k).collect()} for k in (False, True)]
    for name in files:
        a, b = kinds[0][name], kinds[1][name]
        assert a.exif == b.exif
        assert (b.exif.aperture, b.exif.orientation, b.exif.date_time_original) == (1.8, 6, "2024:05:06 07:08:09")
        assert b.blur.bokeh_likely
        assert (b.width, b.height) == ((560, 600) if name.endswith("tiff") else (64, 80))  # turned


def test_lazy_detector_builds_once():
    built = []

    def factory():
        built.append(1)
        return ingest.no_detector

    lazy = ingest.LazyDetector(factory)
    assert lazy(np.zeros((3, 3))) == lazy(np.zeros((3, 3))) == {"faces": None, "salient": None}
    assert built == [1]


def test_lazy_detectors_of_one_scope_are_two():
    import functools
    import pickle

    make = lambda says: ingest.LazyDetector(functools.partial(lambda x: (lambda pixels: x), says))
    one, two = make({"faces": [1]}), make({"faces": [2]})
    assert (one(None), two(None)) == ({"faces": [1]}, {"faces": [2]})
    plain = ingest.LazyDetector(len)
    assert pickle.loads(pickle.dumps(plain)).key == plain.key  # a worker's copies share what it builds


def test_thumbnails_are_jpeg_and_never_larger(spark, tmp_path):
    y, x = np.mgrid[0:40, 0:64]
    small = np.stack([x * 4, y * 6, x + y], axis=2).astype(np.uint8)
    path = ingest.write_thumbnail(small, str(tmp_path), "s")
    assert path.endswith("s_v2.jpg")
    image = spark.read.format("image").load(path).select("image.*").first()
    got = np.frombuffer(image.data, np.uint8).reshape(image.height, image.width, 3)[..., ::-1]
    assert got.shape == small.shape
    assert np.abs(got.astype(int) - small).mean() < 4
    large = ingest.write_thumbnail(np.zeros((600, 900), np.uint8), str(tmp_path), "l")
    assert codecs.decode(open(large, "rb").read()).shape == (200, 300)


def test_variants(tmp_path):
    y, x = np.mgrid[0:48, 0:64]
    photo = ((x // 16 + y // 16) % 2 * 200 + 20).astype(np.uint8)
    made = fixtures.variants(photo)
    assert len(made) == 16
    sharpness = [raster.compute_blur(made[n])["laplacian_variance"] for n in fixtures.BLURS]
    assert sharpness == sorted(sharpness, reverse=True)
    means = [made[n].mean() for n in fixtures.EXPOSURES]
    assert means == sorted(means)
    assert (made["exp_normal"] == photo).all()
    assert (made["exp_overexposed"] == np.minimum((photo * 1.8).astype(int), 255)).all()
    assert abs(made["blur_heavy"].mean() - photo.mean()) < 2
    paths = fixtures.write_variants(photo, str(tmp_path / "v"))
    assert sorted(os.listdir(tmp_path / "v")) == sorted(f"{n}.jpg" for n in made)
    assert np.abs(codecs.decode(open(paths[-1], "rb").read()).astype(int) - made["combo_blurry_dark"]).mean() < 4


def test_delete_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"a")
    plan = spark.createDataFrame([("1", str(tmp_path / "a.jpg")), ("2", str(tmp_path / "gone.jpg"))], "image_id string, path string")
    dry = ingest.delete_files(plan, str(tmp_path / "trash"))
    assert [r["error"] for r in dry] == [None, None]
    assert (tmp_path / "a.jpg").exists()
    done = ingest.delete_files(plan, str(tmp_path / "trash"), confirm=True)
    assert done[0]["error"] is None
    assert done[1]["error"]
    assert os.listdir(tmp_path / "trash") == ["1-a.jpg"]


def test_face_thumbnail(tmp_path):
    path = ingest.write_face_thumbnail(np.zeros((100, 200, 3), np.uint8), [0.4, 0.4, 0.1, 0.2], str(tmp_path), "ab" * 32, 3)
    assert path.endswith("abababababababab_face_3.jpg")
    assert max(codecs.decode(open(path, "rb").read()).shape[:2]) == 120


def test_no_detector_is_null(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(codecs.encode_png(np.full((40, 50), 9, np.uint8)))
    row = ingest.analyse_photos(spark, str(tmp_path)).select("closed_eyes", "subject_focus", F.size("embeddings").alias("n")).first()
    assert (row.closed_eyes, row.subject_focus, row.n) == (None, None, 0)


def test_library(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    rng = np.random.default_rng(1)
    same = np.kron(rng.integers(0, 255, (24, 32), dtype=np.uint8), np.ones((4, 4), np.uint8))
    for k, (name, pixels) in enumerate({"a.png": same, "b.png": same, "c.png": same.T, "d.png": same}.items()):
        (root / name).write_bytes(codecs.encode_png(pixels))
        os.utime(root / name, (1_700_000_000 + (3 * k if k < 3 else 1000),) * 2)
    seen = lambda pixels: {"faces": [{"bounding_box": [0.1, 0.1, 0.3, 0.3], "left": 0.9, "right": 0.9, "embedding": [1.0, float(pixels.shape[0] > 100)]}], "salient": None}
    results = Library(spark, f"file://{tmp_path}/results")
    for getter in (results.analysis, results.duplicate_groups, results.scene_groups, results.person_groups):
        with pytest.raises(NoResults, match="No analysis results yet"):
            getter()
    names = {r.id: r.file_name for r in results.scan(str(root), seen).collect()}
    assert sorted(names.values()) == ["a.png", "b.png", "c.png", "d.png"]
    group = lambda df: sorted((r[0], [names[m] for m in r.members]) for r in df.collect())
    assert group(results.duplicate_groups()) == [("dup-1", ["a.png", "b.png"])]
    assert group(results.scene_groups()) == [("scene-1", ["a.png", "b.png", "c.png"])]
    persons = sorted((r.person_id, sorted(names[m.image_id] for m in r.members)) for r in results.person_groups().collect())
    assert persons == [("person-1", ["a.png", "b.png", "c.png", "d.png"])]
    results.regroup(Settings(duplicate_window_secs=2000, person_similarity=0.9))
    assert group(results.duplicate_groups()) == [("dup-1", ["a.png", "b.png", "d.png"])]
    assert len(results.person_groups().collect()) == 2

"""Grouping and review fixtures, and properties that must hold."""

import os
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from photonlake.functions import predicates
from photonlake.operators import components, grouping, hashes, ingest, persons, review
from photonlake.plans import catalog
from photonlake.sources import codecs
from photonlake.settings import Settings
from photonlake.streaming.scenes import stream_scenes

H = "ord long, image_id string, ts long, phash long"


def bits(n):
    return (1 << n) - 1


def groups(spark, rows, window=5, threshold=10, **kw):
    df = spark.createDataFrame([(i, f"i{i}", t, h) for i, (t, h) in enumerate(rows)], H)
    out = grouping.find_duplicate_groups(df, "ord", "ts", "phash", window, threshold, **kw).collect()
    return {r.ord: r.duplicate_group_id for r in out}


CASES = [
    ([(0, 0), (5, 0)], {0: "dup-1", 1: "dup-1"}),
    ([(0, 0), (6, 0)], {}),
    ([(0, 0), (5, 0), (10, 0)], {0: "dup-1", 1: "dup-1", 2: "dup-1"}),
    ([(0, 0), (1, bits(10))], {0: "dup-1", 1: "dup-1"}),
    ([(0, 0), (1, bits(11))], {}),
    ([(0, 0), (1, bits(8)), (2, bits(16))], {0: "dup-1", 1: "dup-1", 2: "dup-1"}),
    ([(0, 7), (5, None), (10, 7)], {0: "dup-1", 2: "dup-1"}),
    ([(100, 1), (0, 2), (100, 1), (0, 2)], {0: "dup-1", 1: "dup-2", 2: "dup-1", 3: "dup-2"}),
    ([(0, 0)], {}),
    ([(86_398, 5), (86_401, 5), (172_800, 5)], {0: "dup-1", 1: "dup-1"}),
]


@pytest.mark.parametrize(("rows", "want"), CASES)
def test_duplicates(spark, rows, want):
    assert groups(spark, rows) == want


def test_banded_candidates_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    rows = []
    for i in range(200):
        h = base[i % 40]
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            h ^= 1 << int(b)
        h = (h + 2**63) % 2**64 - 2**63
        rows.append((0, h))
    df = spark.createDataFrame([(1, i, h) for i, (_, h) in enumerate(rows)], "g int, o long, h long")
    got = {tuple(r) for r in grouping.similar_pairs(df, "g", "o", "h", 4).collect()}
    assert got == {(i, j) for i in range(200) for j in range(i + 1, 200) if bin((rows[i][1] ^ rows[j][1]) & (2**64 - 1)).count("1") <= 4}


def test_binary_hashes_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    base = [int.from_bytes(rng.bytes(18), "big") for _ in range(20)]
    hashes = []
    for i in range(120):
        h = base[i % 20]
        for b in rng.choice(144, rng.integers(0, 9), replace=False):
            h ^= 1 << int(b)
        hashes.append(h.to_bytes(18, "big"))
    hashes += [hashes[3][:9], hashes[5] + b"more", None]
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate(hashes)], "g int, o long, h binary")

    def distance(a, b):
        return sum((x ^ y).bit_count() for x, y in zip(a, b, strict=False))

    for threshold in (10, 20):  # by bands, and all with all
        got = [tuple(r) for r in grouping.similar_pairs(df, "g", "o", "h", threshold).collect()]
        n = len(hashes) - 1
        assert sorted(got) == [(i, j) for i in range(n) for j in range(i + 1, n) if distance(hashes[i], hashes[j]) <= threshold]


def test_duplicates_of_one_long_session(spark):
    """40,000 photos of a session, copies of 200 hashes, were compared pair by pair."""
    shots = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 200)
    near = spark.createDataFrame([(int(h), k) for k, h in enumerate(shots)], "phash long, k long")
    df = spark.range(40_000).withColumn("k", F.col("id") % 200).join(near, "k").select(F.col("id").alias("ord"), (F.col("id") % 50).alias("ts"), "phash")
    links = grouping.duplicate_links(df, "ord", "ts", "phash", 5, 24).where("ord < 200").orderBy("ord").collect()
    linked = np.bitwise_count(shots.view(np.uint64)[:, None] ^ shots.view(np.uint64)[None, :]) <= 24
    assert [r.links for r in links] == (linked.sum(axis=1) * 200 - 1).tolist()
    got = grouping.find_duplicate_groups(df, "ord", "ts", "phash", 5, 24).groupBy("duplicate_group_id").count().collect()
    assert len(got) == len({r.class_id for r in links})
    assert sum(r["count"] for r in got) == 40_000


def test_regroup_of_one_long_session(spark):
    """30,000 copies in a session made 450 million pairs."""
    df = spark.range(30_000).select(F.col("id").alias("ord"), F.concat(F.lit("i"), "id").alias("image_id"), (F.col("id") % 50).alias("ts"), F.lit(7).cast("long").alias("phash"))
    got = grouping.regroup_images(df, Settings(duplicate_window_secs=60, duplicate_threshold=24)).groupBy("duplicate_group_id", "scene_group_id").count().collect()
    assert [tuple(r) for r in got] == [("dup-1", "scene-1", 30_000)]


@pytest.mark.parametrize(("size", "threshold"), [(8, 24), (18, 10)])
def test_short_sessions_are_linked_where_they_meet(spark, monkeypatch, size, threshold):
    """the stars of 10,000 short sessions went through all rounds of joins; their inputs were read once for each use."""
    monkeypatch.setattr(hashes, "connected_components", lambda *_: pytest.fail("rounds of joins for short sessions"))
    rng, rows = np.random.default_rng(6), []
    for g in range(30):  # each session a chain of hashes, the ends of which are far apart
        h = int.from_bytes(rng.bytes(size), "big")
        for k in range(g):
            for b in rng.choice(8 * size, threshold if k % 5 else 8 * size // 2, replace=False):
                h ^= 1 << int(b)
            rows.append((g, len(rows), h.to_bytes(size, "big")))
    shuffled = rng.permutation(len(rows)).tolist()
    rows = [(g, shuffled[o], h) for g, o, h in rows]
    near = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True)) <= threshold
    of = (lambda h: h) if size == 18 else (lambda h: int.from_bytes(h, "big", signed=True))
    kind = "binary" if size == 18 else "long"
    want = plain_links(rows, near)
    df = spark.createDataFrame([(g, o, of(h)) for g, o, h in rows], f"g long, o long, h {kind}")
    assert {r.o: (r.class_id, r.links) for r in hashes.linked_hashes(df, "g", "o", "h", threshold).collect()} == want
    inputs = spark.createDataFrame([(o, f"i{o}", 1000 * g, of(h), "kept") for g, o, h in rows], f"ord long, image_id string, ts long, phash {kind}, links string")
    got = grouping.regroup_images(inputs, Settings(duplicate_window_secs=5, duplicate_threshold=threshold, scene_window_secs=999)).collect()
    number = {c: n for n, c in enumerate(sorted({c for c, links in want.values() if links}), 1)}
    assert {r.ord: r.duplicate_group_id for r in got} == {o: f"dup-{number[c]}" if links else None for o, (c, links) in want.items()}
    assert {(r.image_id, r.scene_group_id, r.links) for r in got} == {(f"i{o}", f"scene-{g - 1}" if g > 1 else None, "kept") for g, o, _ in rows}


def test_similar_hashes_are_a_row_for_each_photo(spark, sf_dir):
    """one row for each pair grew with the square of a session."""
    got = catalog.QUERIES["join_similar_hashes"](spark, sf_dir)
    assert got.columns == ["ord", "class_id", "links"]
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert got.agg(F.count("*"), F.count_distinct("ord")).first()[:] == (events.count(),) * 2


def plain_links(rows, near):
    """(class, number of links) by position, from rows (group, position, hash)."""
    linked = {o: [p for k, p, y in rows if p != o and k == g is not None and None not in (x, y) and near(x, y)] for g, o, x in rows}
    least = {o: o for o in linked}
    while (new := {o: min([least[o], *(least[p] for p in linked[o])]) for o in linked}) != least:
        least = new
    return {o: (least[o], len(linked[o])) for o in linked}


@pytest.mark.parametrize("block", [40, 4096])
@pytest.mark.parametrize(("size", "threshold"), [(8, 24), (8, 5), (18, 10), (18, 20)])
def test_linked_hashes_equal_brute_force(spark, size, threshold, block):
    rng = np.random.default_rng(threshold)
    base, rows = [int.from_bytes(rng.bytes(size), "big") for _ in range(12)], []
    for i in range(260):
        h = base[rng.integers(12)]
        for b in rng.choice(8 * size, rng.integers(0, 2 + threshold), replace=False):
            h ^= 1 << int(b)
        rows.append((None if i == 7 else int(i % 9 > 0) * (i % 3 > 0) + 5 * (i % 31 == 0), i, None if i % 40 == 3 else h.to_bytes(size, "big")))
    rows += [(rows[i][0], 300 + i, rows[i][2]) for i in range(0, 30, 2)]
    distance = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x, y, strict=False))
    if size == 18:
        rows += [(1, 400, rows[1][2][:9]), (1, 401, rows[4][2] + b"more"), (2, 402, b""), (1, 403, rows[1][2][:9])]
        df = spark.createDataFrame(rows, "g long, o long, h binary")
    else:
        df = spark.createDataFrame([(g, o, None if h is None else int.from_bytes(h, "big", signed=True)) for g, o, h in rows], "g long, o long, h long")
    got = {r.o: (r.class_id, r.links) for r in hashes.linked_hashes(df, "g", "o", "h", threshold, block=block).collect()}
    assert got == plain_links(rows, lambda x, y: distance(x, y) <= threshold)


def test_duplicates_of_analysed_photos(spark, tmp_path):
    rng = np.random.default_rng(3)
    shots = [rng.integers(0, 200, (90, 90)).astype(np.uint8).repeat(2, 0).repeat(2, 1) for _ in range(3)]
    for k, shot in enumerate([shots[0], shots[1], shots[0] + 20, shots[2], shots[1] + 9]):
        (tmp_path / f"{k}.png").write_bytes(codecs.encode_png(shot))
        os.utime(tmp_path / f"{k}.png", (1000 + k, 1000 + k))
    photos = ingest.analyse_photos(spark, str(tmp_path)).withColumn("ord", F.substring("file_name", 1, 1).cast("bigint"))
    got = grouping.find_duplicate_groups(photos, "ord", "modified_at", "phash").collect()
    assert {r.ord: r.duplicate_group_id for r in got} == {0: "dup-1", 2: "dup-1", 1: "dup-2", 4: "dup-2"}


def test_regroup_takes_the_person_threshold(spark):
    inputs = spark.createDataFrame([(2, "a", 0, 0), (1, "b", 3, 0), (3, "c", 500, 1)], H)
    rows = [("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("b", 0, [0.8, 0.6]), ("c", 0, []), ("gone", 0, [1.0, 0.0])]
    faces = spark.createDataFrame(rows, "image_id string, face_index int, embedding array<float>")

    def at(similarity, of=faces):
        images, persons = grouping.regroup(inputs, Settings(person_similarity=similarity), of)
        assert {r.image_id: (r.duplicate_group_id, r.scene_group_id) for r in images.collect()} == {"a": ("dup-1", "scene-1"), "b": ("dup-1", "scene-1"), "c": (None, None)}
        return {(r.image_id, r.face_index): r.person_id for r in persons.collect()}

    assert at(0.7) == {("b", 0): "person-1", ("a", 0): "person-1", ("a", 1): "person-2", ("c", 0): None}
    assert at(0.9) == {("b", 0): "person-1", ("a", 0): "person-2", ("a", 1): "person-3", ("c", 0): None}
    assert at(0.7, faces.where("image_id = 'b'")) == {("b", 0): None}


def test_nearest_in_single_precision_is_the_nearest():
    """F2: candidates come from single precision, and the nearest of them, or of all where they are many, from double."""
    rng = np.random.default_rng(8)
    few = rng.normal(size=(4, 16))[rng.integers(0, 4, 600)] + 1e-7 * rng.normal(size=(600, 16))
    for m in (rng.normal(size=(700, 64)), rng.normal(size=(300, 2)), np.vstack([few, rng.normal(size=(80, 16))]), np.vstack([rng.normal(size=(900, 16)), few[:3], few[:3], np.zeros((2, 16))])):
        m /= np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-300)[:, None]
        asking, among = (np.sort(rng.choice(len(m), size, replace=False)) for size in (len(m) // 2, 2 * len(m) // 3))
        sim = m[asking] @ m[among].T
        sim[asking[:, None] == among[None, :]] = -np.inf
        best, top = persons._nearest(m, asking, among)
        assert best.tolist() == among[(sim >= sim.max(axis=1)[:, None] - 1e-12).argmax(axis=1)].tolist()
        assert np.abs(top - sim.max(axis=1)).max() < 1e-11
    assert [x.tolist() for x in persons._nearest(np.ones((1, 2)), np.array([0]), np.array([0]))] == [[-1], [-np.inf]]


@pytest.mark.parametrize("count", [0, 1, 200])
def test_forest_roots(spark, count):
    """merges are a forest, the roots of which took all rounds of connected components."""
    rng, to = np.random.default_rng(9), {}
    for i in range(count):
        to[i + 1] = i if i < 40 else int(rng.integers(0, i + 1))
    to = {a: b for a, b in to.items() if a % 50}
    root = lambda x: root(to[x]) if x in to else x
    got = components.forest_roots(spark.createDataFrame(list(to.items()), "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((a, root(a)) for a in to)


def test_regroup_persons_of_a_large_component(spark):
    """like F1; 3000 copies and what is near to them were a component of which a task held all pairs."""
    inputs = spark.range(1010).select(F.col("id").alias("ord"), F.concat(F.lit("i"), "id").alias("image_id"))
    at = F.when(F.col("id") < 3000, 0.0).otherwise(F.col("id") % 7 * 15.0 + 10)
    faces = spark.range(3030).select(F.concat(F.lit("i"), F.floor(F.col("id") / 3)).alias("image_id"), (F.col("id") % 3).cast("int").alias("face_index"), F.array(F.cos(F.radians(at)), F.sin(F.radians(at))).alias("embedding"))
    got = grouping.regroup_persons(inputs, Settings(person_similarity=0.65), faces)
    assert sum(r["count"] for r in got.groupBy("person_id").count().collect()) == 3030
    assert got.where("person_id = 'person-1'").count() >= 3000
    vectors = angle(0, *((i % 7) * 15 + 10 for i in range(3000, 3030)))
    points = pd.DataFrame({"c": range(31), "n": [3000] + [1] * 30, "v": [np.array(v) * n for v, n in zip(vectors, [3000] + [1] * 30, strict=True)], "nn": np.nan, "s": np.nan})
    merged = persons._merged_to_the_end(points, 0.65)
    assert got.select("person_id").distinct().count() == 31 - len(merged)


def test_scenes(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([0, 60, 121, 500, 510])], "i long, t long")
    assert {r.i: r.scene_group_id for r in grouping.find_scene_groups(df, "i", "t", 60).collect()} == {0: "scene-1", 1: "scene-1", 3: "scene-2", 4: "scene-2"}


@pytest.mark.parametrize("bucket", [7, 50, 86_400])
def test_sessions_do_not_depend_on_buckets_or_order(spark, bucket):
    rng = np.random.default_rng(bucket)
    ts = [int(t) for t in rng.integers(0, 4000, 300)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i long, t long").orderBy(F.rand(1))
    got = {r.i: r.session_start for r in grouping.sessions(df, "t", 20, bucket).collect()}
    start, want, last = None, {}, None
    for t, i in sorted((t, i) for i, t in enumerate(ts) if t is not None):
        if last is None or t - last > 20:
            start = t
        last, want[i] = t, start
    assert got == want | {300: None}


def angle(*degrees):
    return [[float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))] for d in degrees]


@pytest.mark.parametrize(
    ("vectors", "want"),
    [
        (angle(0, 45, 90), [1, 1, 2]),
        (angle(0, 20, 100, 110), [1, 1, 2, 2]),
        ([[0.0, 0.0], *angle(0, 5)], [1, 2, 2]),
        (angle(0), []),
        ([[], *angle(0)], []),
        ([[], *angle(0, 1)], [None, 1, 1]),
    ],
)
def test_persons(spark, vectors, want):
    df = spark.createDataFrame(list(enumerate(vectors)), "o long, e array<float>")
    got = {r.o: r.person_id for r in persons.cluster_faces(df, "o", "e", 0.65).collect()}
    assert got == {i: f"person-{w}" for i, w in enumerate(want) if w}


def plain_persons(vectors, threshold):
    label = persons.average_linkage([np.asarray(v, np.float32) for v in vectors], threshold)
    number = {first: i + 1 for i, first in enumerate(sorted(set(label.tolist())))}
    return {i: f"person-{number[x]}" for i, x in enumerate(label.tolist())}


def test_persons_in_blocks_and_libraries(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(7, 8))
    vectors = [(centres[rng.integers(7)] + rng.normal(size=8) * 0.5).tolist() for _ in range(90)] + [[0.0] * 8, [1.0, 2.0]]
    want = plain_persons(vectors, 0.65)
    assert len(set(want.values())) > 5
    df = spark.createDataFrame(list(enumerate(vectors)), "o long, e array<float>")
    for block in (1024, 7):
        assert {r.o: r.person_id for r in persons.cluster_faces(df, "o", "e", 0.65, block=block).collect()} == want
    two = df.withColumn("who", F.when(F.col("o") < 40, "a").when(F.col("o") < 91, "b"))
    got = {r.o: r.person_id for r in persons.cluster_faces(two, "o", "e", 0.65, library="who", block=7).collect()}
    parts = [plain_persons(vectors[:40], 0.65), plain_persons(vectors[40:91], 0.65)]
    assert got == parts[0] | {i + 40: p for i, p in parts[1].items()}  # the third library has one face: no person


def test_persons_of_a_library_beyond_a_table_of_pairs():
    """a component's table of pairs, 900 MB here, was held by one task."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(15_000, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = pd.DataFrame({"c": np.arange(len(v)), "n": 1, "v": list(v), "nn": pd.Series([None] * len(v), dtype="float64"), "s": np.nan})
    tracemalloc.start()
    merged = persons._merged_to_the_end(rows, 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    assert 1 < len(v) - len(merged) < 20
    assert (merged["b"] < merged["a"]).all()
    assert merged["a"].is_unique


def test_persons_of_copies_ties_and_broken_vectors(spark):
    vectors = [*angle(0, 60, 0, 120), *angle(*[0] * 300), [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [float("inf"), 0.0], [0.0, 0.0], [0.5, 0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "o long, e array<double>")
    for block in (2, 1024):
        got = {r.o: int(r.person_id[7:]) for r in persons.cluster_faces(df, "o", "e", 0.45, block=block).collect()}
        # 60 degrees is as far from 0 as from 120: the first pair merges, all copies of 0 with it
        one = {i: 1 for i in (0, 1, 2, *range(4, 304), 309)}
        assert got == one | {3: 2, 304: 3, 305: 4, 306: 5, 307: 6, 308: 7}


def test_unequal_lengths():
    sim = persons.similarity_matrix([np.array([3.0, 4.0]), np.array([3.0, 4.0, 12.0]), np.array([0.0])])
    assert sim[0, 1] == pytest.approx(25 / 65)
    assert sim[0, 2] == 0
    assert sim.diagonal().tolist() == [1, 1, 1]


def test_average_linkage_like_a_plain_version():
    rng = np.random.default_rng(0)
    for n in (2, 5, 30):
        vectors = list(rng.normal(size=(n, 4)).astype(np.float32))
        sim = persons.similarity_matrix(vectors).copy()
        clusters, label = {i: [i] for i in range(n)}, np.arange(n)
        s = sim.copy()
        while len(clusters) > 1:
            keys = sorted(clusters)
            best = max(((s[i, j], -i, -j) for a, i in enumerate(keys) for j in keys[a + 1 :]))
            if best[0] < np.float32(0.3):
                break
            i, j = -best[1], -best[2]
            a, b = np.float32(len(clusters[i])), np.float32(len(clusters[j]))
            for k in keys:
                if k not in (i, j):
                    s[i, k] = s[k, i] = (a * s[i, k] + b * s[j, k]) / (a + b)
            clusters[i] += clusters.pop(j)
        for first, members in clusters.items():
            label[members] = first
        assert persons.average_linkage(vectors, 0.3).tolist() == label.tolist()


VIEW = "ord long, image_id string, laplacian_variance double, mean_luminance double, duplicate_group_id string"


def test_block_order(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 0.5, None), (2, "b", 1.0, 0.5, "dup-1"), (3, "c", 1.0, 0.5, None), (4, "d", 1.0, 0.5, "dup-1"), (5, "e", 1.0, 0.5, None)], VIEW)
    got = review.filtered_images(df).orderBy("pos").collect()
    assert [r.image_id for r in got] == ["a", "b", "d", "c", "e"]
    assert [r.pos for r in got] == [1, 2, 3, 4, 5]


def test_sorts_with_nulls(spark):
    df = spark.createDataFrame([(1, "a", None, 0.9, None), (2, "b", 5.0, None, None), (3, "c", 2.0, 0.4, None), (4, "d", 5.0, 0.6, None)], VIEW)
    order = lambda by: [r.image_id for r in review.filtered_images(df, sort_by=by).orderBy("pos").collect()]
    assert order("blur") == ["c", "b", "d", "a"]
    assert order("exposure") == ["b", "d", "c", "a"] or order("exposure") == ["b", "c", "d", "a"]


def test_scene_breaks(spark):
    df = spark.createDataFrame([(i + 1, s) for i, s in enumerate(["s1", "s1", None, None, "s2"])], "pos long, s string")
    assert sorted(r.pos - 1 for r in grouping.scene_breaks(df, "pos", "s").collect()) == [2, 4]


def test_best_of_group(spark):
    df = spark.createDataFrame([(1, "a", 5.0, 0.5, "g"), (2, "b", 5.0, 0.5, "g"), (3, "c", None, 0.5, "g"), (4, "d", None, 0.5, "h")], VIEW)
    assert {r.image_id: r.mark for r in review.pick_best(df).collect()} == {"a": "keep", "b": "delete", "c": "delete", "d": "keep"}


def test_blurry_rules(spark):
    kinds = "laplacian_variance double, mean_tile_variance double, max_tile_variance double, sharp_tile_fraction double, largest_sharp_cluster double, bokeh_likely boolean, focus_verdict string"
    rows = [(150.0, 0.0, 10.0, 0.0, 0.0, False, None), (150.0, float("nan"), 10.0, 0.0, 0.0, False, None), (150.0, 99.0, 10.0, 0.0, 0.0, False, None), (1.0, 1.0, 900.0, 0.0, 0.0, False, None),
            (1.0, 1.0, 700.0, 0.0, 0.0, True, None), (1.0, 1.0, 0.0, 0.12, 0.06, False, None), (1.0, 1.0, 900.0, 0.0, 0.0, False, "AllBlurry"), (1.0, 1.0, 1.0, 0.0, 0.0, False, "SubjectSharp"),
            (1.0, 1.0, 1.0, 0.0, 0.0, False, "BackFocus"), (None,) * 7]
    got = [r[0] for r in spark.createDataFrame(rows, kinds).select(predicates.is_blurry()).collect()]
    assert got == [False, False, True, False, False, False, True, False, True, False]


def test_selection(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "image_id string")
    pick = lambda df: sorted(r.image_id for r in df.collect())
    assert pick(review.invert(ids("a", "b"), ids("a", "z"))) == ["b"]
    assert pick(review.toggle(ids("a", "b"), ids("b", "c"))) == ["a", "c"]
    assert pick(review.union_ids(ids("a", "b"), ids("b", "c"))) == ["a", "b", "c"]
    placed = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "image_id string, pos long")
    assert pick(review.select_range(placed, "pos", "image_id", "c", "a")) == ["a", "b", "c"]
    assert pick(review.select_range(placed, "pos", "image_id", "c", "c")) == ["c"]
    assert pick(review.select_range(placed, "pos", "image_id", "c", "z")) == []


def test_marks(spark):
    log = spark.createDataFrame([(1, "a", "delete"), (2, "b", "keep"), (3, "a", "unmarked"), (4, "z", "delete"), (5, "c", "delete"), (6, "d", "delete")], "seq long, image_id string, mark string")
    marks = review.apply_marks(log)
    index = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "image_id string")
    assert sorted(r.image_id for r in review.deletion_plan(marks, index).collect()) == ["c", "d"]
    left = review.after_deletes(marks, spark.createDataFrame([("d",)], "image_id string"))
    assert {r.image_id: r.mark for r in left.collect()} == {"a": "unmarked", "b": "keep", "d": "delete"}


def test_positions_are_a_permutation(spark):
    df = spark.range(5000).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"))
    got = [(r.k, r.id) for r in grouping.with_position(df, F.col("k").desc(), F.col("id").asc()).orderBy("pos").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1]))
    assert grouping.with_position(df, F.col("id").asc()).agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()[:] == (1, 5000, 5000)


def test_stream_of_scenes(spark, tmp_path):
    rows = [(t,) for t in (0, 60, 121, 500, 510, 100_000)]
    spark.createDataFrame(rows, "t long").select(F.timestamp_seconds("t").alias("at"), F.lit("x").alias("camera")).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema("at timestamp, camera string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = stream_scenes(stream, "at", "camera", 60, "1 minute").writeStream.format("memory").queryName("scenes").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((int(r.first_ts.timestamp()), r.photos) for r in spark.table("scenes").collect())
    assert [n for _, n in got] == [2, 2]

"""BPE against the tokenizer library, JPEG against Java's codec, chat and WARC round trips, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from photonlake.llm import bpe, chat, media, warc

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, "a" * 3000, " " * 700 + "x", "日本語 😀😀 é́", "don't we'll  \n\n x", "\x00\x01abc", "The the THE 12345 +-*/", "word " * 20_000]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_bpe_like_the_library(spark, sf_dir, codec, library):
    texts = [t or "" for t in TEXTS] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for text, raw in zip(texts, codec.encode(texts), strict=True):
        assert ids_of(raw) == library.encode_ordinary(text)
        assert codec.decode(raw) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(codec, library, text):
    (raw,) = codec.encode([text])
    assert ids_of(raw) == library.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=40), min_size=1, max_size=30))
def test_bpe_ties_take_the_leftmost_pair(words):
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"ba": 4, b"aab": 5, b"abab": 6, b"bb": 7, b"aaaa": 8}
    own = bpe.Codec(b"\n".join(__import__("base64").b64encode(t) + b" %d" % r for t, r in ranks.items()), r"[ab]+")
    for word, raw in zip(words, own.merge_words([w.encode() for w in words]), strict=True):
        parts = [word[i : i + 1].encode() for i in range(len(word))]
        if word.encode() in ranks:
            parts = [word.encode()]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 99), i) for i in range(len(parts) - 1))
            if rank == 99:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert ids_of(raw) == [ranks[p] for p in parts]


def test_bpe_column(spark, library):
    rows = [*enumerate(TEXTS), (None, "null id"), (7, TEXTS[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "n_tokens", "batch")})
    got = [tuple(r) for r in bpe.encode_column(df, VOCABULARY, public_tokenizers.PATTERN).collect()]
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.encode_column(df.where("false"), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def payloads():
    rng = np.random.default_rng(1)
    raw = [b"", b"a" * 64, bytes(range(256)) * 3, b"\xff\x00" * 900, rng.bytes(64 * 8191 + 640), "é😀".encode() * 50]
    return [p.ljust(max(64, -(-len(p) // 64) * 64), b"\0") for p in raw]


def test_jpeg_round_trip():
    for payload, found in zip(payloads(), media.thumbnails(media.pack(payloads())), strict=True):
        assert b"".join(t.tobytes() for _, t in found) == payload


def image_io(spark, data):
    """(height, width, channels, bytes) of a JPEG by Java's codec, channels in order B, G, R; null if it is none."""
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    path = f"{spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:')}/jpeg-{hashlib.sha256(data).hexdigest()[:16]}"
    import os

    os.makedirs(path, exist_ok=True)
    with open(f"{path}/x.jpg", "wb") as f:
        f.write(df.first().content)
    image = spark.read.format("image").load(path).select("image.*").first()
    return np.frombuffer(image.data, np.uint8).reshape(image.height, image.width, image.nChannels)


def test_java_reads_packed_images(spark):
    payload = bytes(np.random.default_rng(5).integers(0, 256, 640, dtype=np.uint8))
    pixels = image_io(spark, media.pack([payload])[0])[..., 0]
    assert pixels.shape == (80, 512)
    assert (pixels == np.kron(np.frombuffer(payload, np.uint8).reshape(10, 64), np.ones((8, 8), np.uint8))).all()


def java_jpeg(spark, raster):
    """A JPEG that Java's codec writes of an RGB raster (4:2:0, its own tables)."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    h, w, _ = raster.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    values = gateway.new_array(jvm.int, w * h)
    flat = raster.astype(int)
    for i, v in enumerate(((flat[..., 0] << 16) | (flat[..., 1] << 8) | flat[..., 2]).ravel().tolist()):
        values[i] = v
    image.setRGB(0, 0, w, h, values, 0, w)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def test_thumbnail_of_a_colour_jpeg(spark):
    y, x = np.mgrid[0:40, 0:56]
    raster = np.stack([x * 4, y * 5, (x + y) * 2], axis=2).astype(np.uint8)
    data = java_jpeg(spark, raster)
    ((image, thumb),) = media.thumbnails([data])[0]
    assert (image.width, image.height) == (56, 40)
    luma = raster @ np.array([0.299, 0.587, 0.114])
    want = luma.reshape(5, 8, 7, 8).mean(axis=(1, 3))
    assert thumb.shape == (5, 7)
    assert np.abs(thumb - want).max() <= 3


def test_jpeg_features_edges(spark):
    good = media.pack([bytes(range(64))])[0]
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"no jpeg"), (5, good[:-12]), (6, good[:100]), (None, good), (7, good[:2] + good[2:].replace(b"\xff\xc0", b"\xff\xc2"))]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "k long, b binary").withColumn("width", F.lit(1))
    got = {(r.k, r.width, r.thumb_height) for r in media.jpeg_features(df, "k", "b").collect()}
    assert got == {(1, 512, 1), (2, None, None), (3, None, None), (4, None, None), (5, None, None), (6, None, None), (None, 512, 1), (7, None, None)}
    assert media.jpeg_features(df.where("false"), "k", "b").count() == 0


def test_stored_texts(spark):
    rows = [*enumerate(TEXTS), (None, "null id"), (2, TEXTS[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("media", "feature")})
    got = media.store_texts(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = ("null id" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
        payload = text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert media.store_texts(df.where("false")).count() == 0


ADVERSE = ["\\### Assistant: </turn> ok", "### User: x</turn>\n", "\\\\h\\l#<", "", None, "a\nb", "é😀" * 10]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\#<:hlc/turn> \né", max_size=30))
def test_chat_escape_is_reversible(text):
    for role in (False, True):
        written = chat.escape(pa.array([text]), role)[0].as_py()
        assert "#" not in written
        assert "<" not in written
        assert chat.unescape(written) == text


def chat_digest(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark, monkeypatch):
    rng = random.Random(2)
    convs = {c: [(rng.choice(["user", "assistant", "system", None, "a: b#"]), rng.choice(ADVERSE)) for _ in range(rng.randint(1, 9))] for c in range(40)}
    convs[None] = [("user", "x"), ("assistant", "y")]
    convs[77] = [("user" if i % 2 else "assistant", "long turn " * 200) for i in range(3000)]  # over 6 MB: several parts
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("c", "t", "formatted", "part_no")})
    formatted = chat.format_conversations(df)
    assert formatted.where("conv_id = 77").count() > 1
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(formatted).collect()}
    assert got == {c: chat_digest(turns) for c, turns in convs.items()}
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


def test_chat_ties_and_repeated_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "first"), (1, 0, "assistant", "z"), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = chat.read_back(chat.format_conversations(df)).collect()
    assert tuple(got)[1:5] == chat_digest([("user", "first"), ("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")])


def test_warc_round_trip(spark, tmp_path):
    big = "páge " * 300_000
    pages = [(5, "http://a/x", "y" * 120), (3, "http://a/y", "y" * 120), (9, None, "y" * 120), (9, None, "y" * 120), (3, "http://again", "y" * 120), (1, "u", "short"), (2, "u", "short"),
             (4, "bad\r\nurl", None), (6, "u", ""), (7, "u", big), (8, "u", big), (None, "u", "y" * 120), (10, "u", "é" * 50), (11, "u", "é" * 50), (12, "u", "z" * 99)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("d", "digest", "record", "n")})
    path = f"file://{tmp_path}/archive"
    warc.write_archive(df, path, chunk=100_000)
    first = {}
    for i, _, t in pages:
        if i is not None and len((t or "").encode()) >= 100:
            first[t] = min(first.get(t, i), i)
    want = []
    for i, _, t in pages:
        raw = (t or "").encode()
        refers = first.get(t) if first.get(t) != i else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers is not None else "response", refers))
    got = [tuple(r) for r in warc.read_archive(spark, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    chunks = spark.read.schema(warc.SCHEMA).parquet(path)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] < 101_000
    # The chunks of a record, in order, are one WARC record.
    long = chunks.where("not last or chunk_no > 0").orderBy("record", "chunk_no").collect()
    raw = b"".join(r.data for r in long)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert raw.endswith(big.encode() + b"\r\n\r\n")
    assert warc.read_chunks(chunks.where("false")).count() == 0
    warc.write_archive(df.where("false"), f"{path}-empty")
    assert warc.read_archive(spark, f"{path}-empty").count() == 0


@pytest.mark.parametrize("damage", ["data", "missing"])
def test_warc_damage_is_seen(spark, tmp_path, damage):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 500)], "page_id long, url string, html string"), path, chunk=100)
    chunks = spark.read.schema(warc.SCHEMA).parquet(path)
    if damage == "data":
        chunks = chunks.withColumn("data", F.when(F.col("chunk_no") == 2, F.encode(F.lit("y" * 100), "UTF-8")).otherwise(F.col("data")))
    else:
        chunks = chunks.where("chunk_no <> 3")
    with pytest.raises(Exception, match=r"damaged|lacks a chunk"):
        warc.read_chunks(chunks).collect()

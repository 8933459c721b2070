"""Ids that repeat with other texts, clashing names, very long values, parts out of order, and kernels against plain versions."""

import hashlib
import math
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_text_operators import DOC, components, prose, without_repeats

import corpus_pipeline
from photonlake.llm import bpe, chat, common, decontam, lines, neardup, quality, secrets, toxicity, warc


def own_words(rng, n):
    return [f"x{rng.randrange(10**8)}" for _ in range(n)]


# --- near-duplicates


def test_least_labels():
    rng = np.random.default_rng(4)
    for n in (1, 2, 50, 300):
        a, b = rng.integers(0, n, n // 2 + 1), rng.integers(0, n, n // 2 + 1)
        want = np.arange(n)
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                want[x] = want[y] = min(want[x], want[y])
        for x in range(n):
            while want[want[x]] != want[x]:
                want[x] = want[want[x]]
        assert neardup.least_labels(n, a, b).tolist() == want.tolist()


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_link_components_like_all_pairs(percent):
    rng = random.Random(percent)
    for trial in range(40):
        pool = [rng.randrange(2**63) for _ in range(rng.choice([12, 60, 400]))]
        sets = [set(rng.sample(pool, rng.randint(1, 12)))]
        for _ in range(30):
            s = set(rng.choice(sets))
            for _ in range(rng.randint(0, 2)):
                s.discard(rng.choice(sorted(s)))
                s.add(rng.choice(pool))
            sets.append(s)
        label = list(range(len(sets)))
        for _ in sets:
            for i, x in enumerate(sets):
                for j, y in enumerate(sets):
                    if 100 * len(x & y) >= percent * len(x | y):
                        label[i] = label[j] = min(label[i], label[j])
        flat = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        assert neardup.link_components(flat, at, percent).tolist() == label, trial


def test_link_components_is_not_quadratic():
    rng = np.random.default_rng(1)
    times = []
    for n in (4000, 16000):  # sets that share a few frequent shingles and don't link
        hot = rng.integers(0, 2**63, 40).astype(np.uint64)
        rows = [np.unique(np.concatenate([rng.choice(hot, 30), rng.integers(0, 2**63, 60).astype(np.uint64)])) for _ in range(n)]
        began = time.process_time()
        label = neardup.link_components(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), 85)
        times.append(time.process_time() - began)
        assert (label == np.arange(n)).all()
    assert times[1] < 10 * times[0]


def near_copies(rng, n):
    base, out = prose(rng, 150).split(), []
    for _ in range(n):
        words = list(base)
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**8)}"
        out.append(" ".join(words))
    return out


def test_a_large_group_makes_few_rows(spark):
    rng = random.Random(9)
    df = spark.createDataFrame(list(enumerate(near_copies(rng, 3000))), DOC)
    sketch = neardup._sketch(df.withColumn("tk", F.lit(0).cast("bigint")), 3)
    nodes = sketch.select(F.explode("roots").alias("key"), F.lit(1).alias("depth"), F.col("doc_id").alias("id"), "sig")
    assert neardup._compare_nodes(nodes, 0.5).count() <= 3000 * neardup.TREES
    got = neardup.near_duplicates(df, 3, 85).select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0]


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(1)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (7, a), (7, b), (8, b), (8, b), (9, c), (9, c + " one"), (5, c + " one two")]
    df = spark.createDataFrame(rows, DOC).withColumn("gone_id", F.lit("kept"))
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == sorted([(1, 1, True), (7, 1, False), (7, 7, True), (8, 7, False), (8, 7, False), (9, 5, False), (9, 5, False), (5, 5, True)])
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (7, b), (5, c + " one two")])
    twice = spark.createDataFrame([(3, a), (3, a + " one"), (4, b), (4, c)], DOC)
    assert sorted(r.doc_id for r in neardup.keep_one(twice).collect()) == [3, 4, 4]


def test_large_clusters_meet_leaders_first(spark):
    rng = random.Random(5)
    rows = list(enumerate(near_copies(rng, 60) + near_copies(rng, 40) + [prose(rng, 80) for _ in range(20)]))
    for i in range(30):  # a chain: each differs a little more from the first
        words = rows[0][1].split() if i == 0 else rows[-1][1].split()
        words[4 * i % 150] = f"c{i}"
        rows.append((len(rows), " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOC), 3, 85, block=700).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, 3, 85)


# --- lines


def test_lines_of_repeated_ids_stay_apart(spark):
    rng = random.Random(2)
    passage = own_words(rng, 60)
    first = " ".join([*own_words(rng, 5), *passage])
    second = " ".join([*own_words(rng, 20), *passage, *own_words(rng, 60)])
    other = " ".join(own_words(rng, 140))
    rows = [(1, first), (5, second), (5, other), (6, other), (6, other)]
    got = sorted((r.doc_id, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, DOC)).collect())
    cut = " ".join([*second.split()[:20], *second.split()[80:]])
    assert got == sorted([(1, first), (5, cut), (5, other), (6, ""), (6, "")])


def test_lines_keep_columns_of_any_name(spark):
    rng = random.Random(3)
    text = " ".join(own_words(rng, 80))
    names = ("n_runs", "spans", "of", "rest0", "doc", "text_key", "found", "N_Deleted")
    df = spark.createDataFrame([(1, text), (2, text)], DOC).withColumns({c: F.lit(c) for c in names})
    out = lines.dedup_lines(df, keep=names)
    assert out.columns == ["doc_id", "text", "_n_runs", "_n_deleted", *names]
    for r in out.collect():
        assert all(r[c] == c for c in names)
        assert (r["_n_deleted"], r.text) == ((0, text) if r.doc_id == 1 else (80, ""))


def test_lines_delete_only_what_is_repeated(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip(" ").translate(lower)
    want = without_repeats([(i, words(t)) for i, t in rows], 32)
    got = {r.doc_id: words(r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {i: " ".join(w) for i, w in want.items()}


# --- the pipeline's stages and decontamination with further columns


def test_stages_keep_further_columns(spark):
    names = ("hit_doc", "_hit_doc", "hit_key", "gone_id", "gone_key", "rest0", "n_deleted", "of", "tk", "found", "quality", "item_id")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({c: F.lit(c) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns[-len(names) :] == list(names)
    assert docs.count() > 50
    assert docs.where(" or ".join(f"{c} <> '{c}'" for c in names)).count() == 0


def test_decontamination_takes_any_column_name(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x a b c d e f g h i j y"), (2, "clean text"), (None, None)], DOC)
    df = df.withColumns({c: F.lit(1) for c in ("hit_doc", "_hit_doc", "hit_at", "hit_key", "d", "t")})
    assert sorted(str(r.doc_id) for r in decontam.decontaminate(df, bench).collect()) == ["2", "None"]
    cut = {r.doc_id: r.text for r in decontam.decontaminate(df, bench, remove="spans").collect()}
    assert cut == {1: "x y", 2: "clean text", None: None}


def test_a_window_of_many_items(spark):
    text = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(i, text) for i in range(500)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{text} . {text}"), (2, "one two")], DOC)
    for limit in (1 << 24, 0):
        got = {r.doc_id: r for r in decontam.find_contamination(docs, bench, limit=limit).collect()}
        want = hashlib.sha256(",".join(sorted(str(i) for i in range(500))).encode()).hexdigest()
        assert (got[1].n_hit, got[1].n_items, got[1].items_sha256) == (22, 500, want)
        assert not got[2].contaminated


# --- WARC


def test_warc_long_urls_and_odd_ids(spark, tmp_path):
    ids = ["a\r\nX: y", "é 😀%0D", "", "plain"]
    rows = [(i, "http://x/" + "p" * 200_000, "z" * 150) for i in ids] + [("other", "http://y/\r\n\x00q", "short")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    path = f"file://{tmp_path}/archive"
    warc.write_archive(df, path, date="2024-01-15T14:30:00Z")
    got = {r.page_id: r for r in warc.read_archive(spark, path, "string").collect()}
    assert set(got) == {*ids, "other"}
    assert {i: got[i].refers_to for i in ids} == {i: None if i == "" else "" for i in ids}
    heads = [bytes(r.data).split(b"\r\n\r\n")[0].decode().split("\r\n") for r in spark.read.schema(warc.SCHEMA).parquet(path).collect()]
    fields = [dict(line.split(": ", 1) for line in h[1:]) for h in heads]
    assert all(f["WARC-Date"] == "2024-01-15T14:30:00Z" for f in fields)
    assert all(not re.search(r"[\x00-\x20\x7f]", f["WARC-Target-URI"]) for f in fields)
    ids_of = {f["WARC-Record-ID"]: f for f in fields}
    assert len(ids_of) == len(fields)
    for f in fields:
        if f["WARC-Type"] == "revisit":
            assert ids_of[f["WARC-Refers-To"]]["WARC-Type"] == "response"


# --- chat


def long_conversation(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", f"turn {i} " * 300) for i in range(1500)] + [(8, 0, "user", "x")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_parts_in_any_order(spark):
    rows, df = long_conversation(spark)
    formatted = common.materialise(chat.format_conversations(df))
    n = formatted.where("conv_id = 7").count()
    assert n > 2
    assert formatted.where("last").count() == 2
    want = {7: len([r for r in rows if r[0] == 7]), 8: 1}
    for mixed in (formatted.repartition(5, "part_no"), formatted.coalesce(1).orderBy(F.desc("part_no"))):
        assert {r.conv_id: r.n_turns for r in chat.read_back(mixed).collect()} == want
    plain = sorted(map(tuple, chat.read_back(formatted).collect()))
    assert sorted(map(tuple, chat.read_back(formatted.orderBy(F.rand(3))).collect())) == plain
    for lost in (0, n // 2, n - 1):
        with pytest.raises(Exception, match="lacks"):
            chat.read_back(formatted.where(f"conv_id = 8 or part_no <> {lost}")).collect()
    with pytest.raises(Exception, match="lacks a part before|has it twice"):
        chat.read_back(formatted.union(formatted.where("part_no = 1"))).collect()


# --- BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def test_long_pretokens_like_the_library(codec):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "a", "etaoinshrdluéü日"):
        for n in (2, 3, 17, 2049, 5000):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert np.frombuffer(codec._merge_long(word.encode()), "<u4").tolist() == library.encode_ordinary(word) or n < 18
    for n in (3000, 9000):
        word = "".join(rng.choice(("the", "ing", "er", "x")) for _ in range(n))
        (raw,) = codec.encode([word])
        assert np.frombuffer(raw, "<u4").tolist() == library.encode_ordinary(word)


def test_long_pretokens_where_a_later_pair_ranks_lower():
    import base64

    rng = random.Random(3)
    for _ in range(300):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        tokens = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(14)}
        ranks |= {t: 3 + i for i, t in enumerate(rng.sample(sorted(tokens), len(tokens)))}  # long ones may come first
        own = bpe.Codec(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()), "[abc]+")
        word = "".join(rng.choice("abc") for _ in range(rng.randint(2, 60))).encode()
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 99), i) for i in range(len(parts) - 1))
            if rank == 99:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert np.frombuffer(own._merge_long(word), "<u4").tolist() == [ranks[p] for p in parts]


def test_a_megabyte_of_letters(codec):
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    began = time.process_time()
    (raw,) = codec.encode([word])
    assert time.process_time() - began < 60
    assert codec.decode(raw) == word.encode()
    assert word not in codec.cache


# --- classifiers


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_fitting_is_bounded(spark, module, label):
    rows = [(1, f"text {i}") for i in range(3000)] + [(2, "bad words"), (3, "x" * 5000), (4, None)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], f"doc_id long, {label} int")
    assert common.sampled(docs, labels, label, 2, 1 << 20).count() == 2
    assert common.sampled(docs, labels, label, 9, 1 << 20).count() == 4
    assert 1 <= common.sampled(docs, labels, label, 9, 1).count() <= 2
    again = [sorted(map(tuple, common.sampled(d, labels, label, 9, 1 << 20).collect())) for d in (docs, docs.repartition(5))]
    assert again[0] == again[1]
    module.train(docs, labels)


def test_logits_are_the_sum_over_pairs():
    rng = np.random.default_rng(7)
    k = 40
    m = toxicity.Machine(np.arange(k, dtype=np.int32), 0.3, rng.normal(size=k), rng.normal(size=(k, 8)))
    texts = [np.sort(rng.choice(k, rng.integers(0, 12), replace=False)) for _ in range(30)]
    owner = np.repeat(np.arange(30), [len(t) for t in texts])
    got = m.logits(30, owner, np.concatenate(texts))
    for t, z in zip(texts, got, strict=True):
        pairs = sum(m.vectors[a] @ m.vectors[b] for i, a in enumerate(t) for b in t[i + 1 :])
        assert math.isclose(z, 0.3 + m.weights[t].sum() + pairs, abs_tol=1e-9)


def test_ratios_and_margins_like_plain_loops():
    rng = random.Random(8)
    rows = [np.array(sorted(rng.sample(range(12), rng.randint(1, 6)))) for _ in range(25)]
    y = np.array([rng.randrange(2) for _ in rows])
    got = quality.log_count_ratios(rows, y, 12)
    p = [1 + sum(b in r for r, t in zip(rows, y, strict=True) if t) for b in range(12)]
    q = [1 + sum(b in r for r, t in zip(rows, y, strict=True) if not t) for b in range(12)]
    assert np.allclose(got, [math.log((p[b] / sum(p)) / (q[b] / sum(q))) for b in range(12)])
    model = quality.Model(got, np.array([rng.gauss(0, 1) for _ in range(13)]), 1.0, 0.0)
    for r, z in zip(rows, model.margins(rows), strict=True):
        x = [got[b] for b in r]
        assert math.isclose(z, sum(v * model.weights[b] for v, b in zip(x, r, strict=True)) / sum(v * v for v in x) ** quality.POWER + model.weights[-1], rel_tol=1e-9)


# --- the battery


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def test_battery_like_a_plain_version(spark):
    rng = random.Random(11)
    alphabets = {16.0: "0123456789abcdef", 32.0: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 62.0: secrets.ALPHABET[:62]}
    tokens = []
    for k, letters in alphabets.items():
        for n in (20, 33, 64):
            t = "".join(rng.choice(letters) for _ in range(n - 2)) + ("a7" if k == 16.0 else "Z7")
            tokens.append((k, t))
    docs = spark.createDataFrame([(i, f"( {t} )") for i, (_, t) in enumerate(tokens)], DOC)
    got = {r.doc_id: r for r in secrets.battery(docs).collect()}
    assert len(got) == len(tokens)
    for i, (k, t) in enumerate(tokens):
        n, df = len(t), k - 1
        chi = k / n * sum(t.count(c) ** 2 for c in set(t)) - n
        codes = [secrets.ALPHABET.index(c) + 1 for c in t]
        middle, mean = sorted(codes)[n // 2], sum(codes) / n
        high = [c >= middle for c in codes]
        runs = 1 + sum(a != b for a, b in zip(high[:-1], high[1:], strict=True))
        expected = 2 * sum(high) * (n - sum(high)) / n + 1
        variance = (expected - 1) * (expected - 2) / (n - 1)
        serial = sum((a - mean) * (b - mean) for a, b in zip(codes[:-1], codes[1:], strict=True)) / sum((c - mean) ** 2 for c in codes)
        p_chi = 1 - phi(((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
        p_runs, p_serial = 2 * phi(-abs((runs - expected) / math.sqrt(variance))), 2 * phi(-abs((serial + 1 / n) * math.sqrt(n)))
        shift = n * secrets.EXCESS
        kinds = [0 if c.isdigit() else 1 if c.islower() else 2 for c in t]
        changes = sum(a != b for a, b in zip(kinds[:-1], kinds[1:], strict=True))
        p_change = 1 - phi((changes - 0.5 - 0.3 * (n - 1)) / math.sqrt((n - 1) * 0.21))
        p_text = phi((chi - df - shift) / math.sqrt(2 * (df + 2 * shift)))
        assert math.isclose(got[i].p, min(1, 2 * min(p_text, p_change)), abs_tol=1e-6)
        assert math.isclose(got[i].noise, 3 * min(p_chi, p_runs, p_serial), abs_tol=1e-6)
        assert (got[i].start, got[i].stop) == (2, 2 + n)


def test_the_bar_holds_over_the_table(spark):
    rng = random.Random(12)
    strong = ["".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(90)) + "7" for _ in range(40)]
    weak = ["".join(rng.choice("abcde12") for _ in range(24)) + "1" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(f"x {t} y" for t in strong + weak)), DOC)
    rows = secrets.battery(docs).collect()
    mean = sum(r.n for r in rows) / len(rows)
    q = sorted(r.p * mean / r.n for r in rows)
    best = max((x for k, x in enumerate(q, 1) if x <= secrets.FDR * k / len(q)), default=0.0)
    got_mean, bar = secrets.discovery_bar(secrets._found(docs))
    assert math.isclose(got_mean, mean)
    # A level of the grid at which the rate holds, and no more than a step below the bar of the plain procedure.
    assert len(q) * bar <= secrets.FDR * sum(x <= bar for x in q)
    assert bar >= best * 2 ** (-1 / 8)
    nothing = spark.createDataFrame([(1, "no token here")], DOC)
    assert secrets.discovery_bar(secrets._found(nothing)) == (1.0, 0.0)
    assert secrets.scan_secrets(nothing).first().n_random == 0
